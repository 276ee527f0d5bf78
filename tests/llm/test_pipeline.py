"""The pipeline's stages on a small table."""

import random

import corpus_pipeline as P
from gleanery.llm import token_counts

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = {"en": "the and that with from this which thing often".split(), "de": "der und nicht mit von dieses welche schon auch".split()}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(lang, rng.randrange(60, 160)), lang, "big" if i < 60 else "small", None))
    common = prose("en", 55)
    rows += [(80 + i, f"{common}\n{prose('en', 70)}", "en", "big", None) for i in range(6)]
    rows += [(90, rows[5][1], "en", "small", None), (91, rows[7][1].replace(" ", " x ", 1).replace("th", "zz", 2), "en", "small", None), (92, None, None, "big", None), (93, "1234", "en", None, None)]
    rows += [(94, " ".join("".join(rng.choice("bcfjkpqxz") for _ in range(7)) for _ in range(80)), None, "big", None), (95, "Сегодня хорошая погода", None, "big", None)]
    docs = spark.createDataFrame(rows, DOC)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == list(P.COLUMNS)
        kept.append(at.collect())
        at = spark.createDataFrame(kept[-1], at.schema)
    ids = [{r["doc_id"] for r in k} for k in kept]
    assert ids[0] == {r[0] for r in rows} - {92, 93, 94, 95}
    assert ids[0] - ids[1] == {90} and sum(common in r["text"] for r in kept[1]) == 1
    assert ids[1] - ids[2] == {91}
    assert ids[3] == ids[2] and len(kept[3]) > len(kept[2])
    out = P.STAGES[-1][1](spark, at, "").collect()
    c = token_counts.counter(P.tokenizer_path(P.TOKENIZER))
    assert sum(r["n_tokens"] for r in out) == sum(c.count(r["text"]) for r in kept[3])


def test_stages_take_odd_tables(spark, tmp_path):
    rows = [(1, "The one text, and it is here.\nA second line that is long enough.", "en", "s", 9)] * 3 + [(1, None, None, None, None), (None, "No key but a text that has letters.", "en", None, 1), (2, "", "en", "s", 0)]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", n_tokens string, score int")
    for docs, least in ((odd, 1), (odd.where("doc_id > 5"), 0)):
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, "")
            assert k == len(P.STAGES) - 1 or docs.columns == list(P.COLUMNS)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert (docs.count() > 0) == bool(least)


def test_documents_stay_without_a_language_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "other text", None, "s", 10)], DOC)
    assert {r["doc_id"] for r in P.language(spark, docs, "").collect()} == {1, 2}
