"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

A line of at least min_chars characters goes if an earlier line (by document key, then place) equals it or is within max_edits
insertions, deletions or substitutions of a character; a shorter one of at least exact_chars characters, not all of them white
space, goes if an earlier line equals it. Equal lines are found by a 128-bit hash. For one edit:

- Different lines within one edit share a half: their first h or last h characters, h half the shorter's length. Each distinct
  line gives four hashed halves (two lengths at either end); only lines with a half in common with another go on. This filter
  is exact and leaves few lines.
- The edit lies in one of 16 cells of the line; lines that agree with another in all outside of a cell keep that cell. This is
  exact too.
- Of those cells the deletion neighbourhood is emitted: for each place, the hash of the line without that character. Lines with equal length
  that agree without the same place are one substitution apart: of such a group the earliest stands for all, so no pairs are
  made. A line that equals another's variant is one deletion from it.
- Each line found so is verified with the edit distance to the earlier line it met.

For k edits, more than one, lines go on that share one of the k + 1 parts of the shorter, moved by up to k places; of those every
variant with up to k characters deleted or blanked is emitted, about (2n)^k / k! a line. Lines with the same variant are within as
many edits as blanks and deletions on either side add up to, so again the earliest of a group stands for all.

Hashed rows are small; texts are moved once, to lines that share a half. Hot lines and hot halves are aggregated before any
shuffle of lines.

Cases: null text has no lines, stays null; lines are split at \\n only; lines shorter than exact_chars
(min_chars by default), and blank ones shorter than min_chars, always stay. Rows that repeat a key count as one document: lines at the same place of both are not repeats of each other. Rows with a
null key stay as they are. Very long lines are compared whole. An empty table gives none. Columns other than the key and the text are kept as they are; an input column named n_lines, n_exact or n_near gives way to the operator's own.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_shuffles, stash, unstash

#: Lines that share a half are compared again by so many cells of either.
CELLS = 16


def _hash2(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """key, line_no (from 0), near (false: equal to an earlier line), first_key, first_line: the lines that go, and an earlier line they repeat."""
    if max_edits < 0:
        raise ValueError("max_edits must be 0 or more")
    rows = docs.select(F.col(f"`{key}`").alias("d"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("i", "line"))
    rows = rows.withColumn("n", F.length("line"))
    long = F.col("n") >= min_chars
    rows = rows.where(long if exact_chars is None else long | ((F.col("n") >= exact_chars) & F.col("line").rlike(r"\S")))
    # null for lines that the near join leaves out
    parts = F.when(long, F.array(*(_halves() if max_edits == 1 else _parts(max_edits) if max_edits else [])))
    hashed = stash(rows.select("d", "i", "n", *_hash2(F.col("line")), parts.alias("halves")))
    first = hashed.groupBy("h1", "h2").agg(F.min(F.struct("d", "i")).alias("at"), F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves"), F.first("n").alias("n"))
    first = stash(first)
    again = hashed.select("d", "i", "h1", "h2").join(first.where("times > 1").select("h1", "h2", "at"), ["h1", "h2"]).where(F.struct("d", "i") != F.col("at"))
    exact = again.select("d", "i", F.lit(False).alias("near"), F.col("at.d").alias("fd"), F.col("at.i").alias("fi"))
    if not max_edits:
        return _named(exact, key)

    keys = first.select("at", F.explode(F.array_distinct("halves")).alias("half")).where("half is not null")
    shared = keys.groupBy("half").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("half")
    cands = stash(keys.join(shared, "half", "left_semi").select("at").distinct())
    exact = stash(exact)
    unstash(first)
    unstash(hashed)
    free_shuffles(docs.sparkSession)
    lines = stash(rows.select(F.struct("d", "i").alias("at"), "line", "n").join(cands, "at", "left_semi"))
    unstash(cands)
    free_shuffles(docs.sparkSession)
    pairs = stash(_one_edit(lines) if max_edits == 1 else _edits(lines, max_edits))
    pairs = pairs.join(lines.select("at", F.col("line").alias("x")), "at").join(lines.select(F.col("at").alias("a"), F.col("line").alias("y")), "a")
    ok = pairs.where(F.levenshtein("x", "y", max_edits).between(0, max_edits)).groupBy("at").agg(F.min("a").alias("a"))
    # every occurrence of a line that is near an earlier one goes; later occurrences have gone as equal to the first
    near = ok.select(F.col("at.d").alias("d"), F.col("at.i").alias("i"), F.lit(True).alias("near"), F.col("a.d").alias("fd"), F.col("a.i").alias("fi"))
    return _named(exact.unionByName(near), key)


def _halves() -> list[Column]:
    """What two different lines within one edit have one of in common."""
    h = F.floor(F.col("n") / 2).cast("int")
    halves = []
    for size in (h, h - 1):
        halves.append(F.xxhash64(F.lit(0), size, F.substring(F.col("line"), F.lit(1), size)))
        halves.append(F.xxhash64(F.lit(1), size, F.substring(F.col("line"), F.col("n") - size + 1, size)))
    return halves


def _parts(k: int) -> list[Column]:
    """What two lines within k edits have one of in common: a part of the shorter, of length m, at its place or up to k from it. Null beyond the line's ends."""
    parts = []
    for less in range(k + 1):
        m = F.col("n") - less
        for j in range(k + 1):
            lo, hi = (F.floor(F.lit(x) * m / (k + 1)).cast("int") for x in (j, j + 1))
            for start in (lo + shift for shift in range(-k, k + 1)):
                inside = (m >= 0) & (start >= 0) & (start + hi - lo <= F.col("n"))
                parts.append(F.when(inside, F.xxhash64(m, F.lit(j), F.substring(F.col("line"), start + 1, hi - lo))))
    return parts


def _edits(lines: DataFrame, k: int) -> DataFrame:
    """at, a: lines with an earlier one within k edits. A blank is a line feed, which no line holds."""
    state = lines.select("at", F.col("line").alias("w"), F.lit(1).alias("p"), F.lit(0).alias("blanks"), F.lit(0).alias("cuts"))
    every = state
    for _ in range(k):
        at = state.where(F.col("p") <= F.length("w")).select("at", "w", "blanks", "cuts", F.explode(F.sequence("p", F.length("w"))).alias("p"))
        left, right = F.substring(F.col("w"), F.lit(1), F.col("p") - 1), F.substring(F.col("w"), F.col("p") + 1, F.length("w"))
        cut = at.select("at", F.concat(left, right).alias("w"), "p", "blanks", (F.col("cuts") + 1).alias("cuts"))
        blank = at.where(F.substring(F.col("w"), F.col("p"), F.lit(1)) != "\n").select("at", F.concat(left, F.lit("\n"), right).alias("w"), (F.col("p") + 1).alias("p"), (F.col("blanks") + 1).alias("blanks"), "cuts")
        state = cut.unionByName(blank)
        every = every.unionByName(state)
    variants = stash(every.select("at", "blanks", "cuts", *_hash2(F.col("w"))).distinct())
    group = ["h1", "h2", "blanks"]
    groups = variants.groupBy(*group).agg(F.min("at").alias("a"), F.max("at").alias("b"), *[F.min(F.when(F.col("cuts") == c, F.col("at"))).alias(f"a{c}") for c in range(k + 1)]).where("a <> b").drop("a", "b")
    met = variants.join(groups, group)
    found = [met.where((F.col(f"a{c}") < F.col("at")) & (F.col("blanks") + F.col("cuts") + c <= k)).select("at", F.col(f"a{c}").alias("a")) for c in range(k + 1)]
    return functools.reduce(DataFrame.unionByName, found).distinct()


def _one_edit(lines: DataFrame) -> DataFrame:
    """at, a: lines with an earlier one within one edit."""
    # cells: m is the shorter's length, [lo, hi] the places of the edit; all outside of them must agree
    size = F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("m")
    cells = lines.select("at", "line", "n", size).select("at", "line", "n", "m", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("j"))
    cells = cells.withColumn("lo", F.floor(F.col("j") * F.col("m") / CELLS).cast("int")).withColumn("hi", F.floor((F.col("j") + 1) * F.col("m") / CELLS).cast("int"))
    tail = F.col("m") - F.col("hi")
    cells = cells.select("at", "n", "m", "lo", "hi", F.xxhash64("m", "j", F.substring("line", F.lit(1), F.col("lo")), F.substring("line", F.col("n") - tail + 1, tail)).alias("c"))
    cells = stash(cells)
    met = cells.groupBy("c").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("c")
    cells = cells.join(met, "c", "left_semi").select("at", "n", "m", "lo", "hi").distinct()
    place = F.when(F.col("m") == F.col("n"), F.sequence(F.col("lo") + 1, F.greatest(F.col("hi"), F.col("lo") + 1))).otherwise(F.sequence(F.col("lo") + 1, F.col("hi") + 1))
    cut = F.xxhash64(F.concat(F.substring("line", F.lit(1), F.col("p") - 1), F.substring("line", F.col("p") + 1, F.col("n"))))
    variants = stash(cells.join(lines.select("at", "line"), "at").select("at", "line", "n", "m", F.explode(place).alias("p")).where("p <= n").select("at", "n", "m", "p", cut.alias("v")).distinct())
    # one substitution: equal without the same place; the group's earliest stands for all
    same = variants.where("m = n").select("at", "n", "p", "v")
    groups = same.groupBy("n", "p", "v").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("n", "p", "v", "a")
    swapped = same.join(groups, ["n", "p", "v"]).where(F.col("a") < F.col("at")).select("at", "a")
    # one deletion: a whole line equals another's variant
    wholes = lines.select(F.xxhash64("line").alias("v"), F.col("at").alias("w"), F.col("n").alias("m"))
    met = variants.where("m < n").select("at", "m", "v").distinct().join(wholes, ["m", "v"]).select("at", "w")
    shorter = met.groupBy("w").agg(F.min("at").alias("a")).where(F.col("a") < F.col("w")).select(F.col("w").alias("at"), "a")
    longer = met.where(F.col("w") < F.col("at")).select("at", F.col("w").alias("a"))
    return swapped.unionByName(shorter).unionByName(longer).distinct()


def _named(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col("d").alias(key), F.col("i").alias("line_no"), "near", F.col("fd").alias("first_key"), F.col("fi").alias("first_line"))


def without_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, max_edits: int = 1, exact_chars: int | None = None) -> DataFrame:
    """docs with the lines that go taken out of the text, and the columns n_lines, n_exact and n_near beside the others."""
    gone = repeated_lines(docs, key, text, min_chars, max_edits, exact_chars)
    gone = gone.groupBy(F.col(key).alias("k")).agg(F.collect_set("line_no").alias("gone"), F.count_if(~F.col("near")).alias("exact"), F.count_if("near").alias("near"))
    # a map lookup for each line, not a walk through the list
    gone = gone.select(F.struct("k", F.map_from_arrays("gone", F.array_repeat(F.lit(True), F.size("gone"))).alias("gone"), "exact", "near").alias("__gone"))
    # the input's columns travel as one, so that no name of theirs can clash with another
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    out = rows.join(gone, F.col("__doc")[key] == F.col("__gone.k"), "left")
    whole = F.col("__doc")[text]
    lines = F.split(whole, "\n", -1)
    kept = F.array_join(F.filter(lines, lambda x, i: F.element_at(F.col("__gone.gone"), i).isNull()), "\n")
    own = {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("bigint"), "n_exact": F.coalesce("__gone.exact", F.lit(0)), "n_near": F.coalesce("__gone.near", F.lit(0))}
    # a column of the input that has one of these names gives way
    kept_columns = [c for c in docs.columns if c not in own]
    return out.select(*[(F.when(F.col("__gone").isNull(), whole).otherwise(kept) if c == text else F.col("__doc")[c]).alias(c) for c in kept_columns], *[v.alias(c) for c, v in own.items()])
