"""The command line end to end, with exit codes."""

import json

from gleanery import cli


def test_commands(spark, tmp_path, capsys):
    d = tmp_path / "d.txt"
    d.write_text("the quick brown fox jumps over it\nlazy dogs sleep all day long here\nspark joins tables quickly and well\n")
    assert cli.main(["version"]) == 0
    assert cli.main(["index", str(d), str(tmp_path / "ix")]) == 0
    capsys.readouterr()
    assert cli.main(["search", str(tmp_path / "ix"), "lazy dogs", "--top-k", "1"]) == 0
    assert "lazy dogs" in json.loads(capsys.readouterr().out)["text"]
    assert cli.main(["search", str(tmp_path / "ix"), " "]) == 2
    assert cli.main(["audit", str(d)]) == 0
    base, now = tmp_path / "b.json", tmp_path / "c.json"
    base.write_text('{"mrr": 0.9, "map": 0.8, "ndcg": {"5": 0.7}}')
    now.write_text('{"mrr": 0.9, "map": 0.5, "ndcg": {"5": 0.7}}')
    assert cli.main(["quality-gate", str(base), str(base)]) == 0 and cli.main(["quality-gate", str(base), str(now)]) == 1
