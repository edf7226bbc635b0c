"""Sources, configuration and sinks."""

from __future__ import annotations

import gzip
import json

import pytest

from treeloom.sources import config, files, sinks


def test_collect_and_scripts(spark, tmp_path):
    for p, text in {"src/a.ts": "let a", "src/b.txt": "b", "node_modules/x/c.js": "c", "src/d.test.js": "d", "gen/e.js": "e"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    root = f"file:{tmp_path}"
    every = files.collect(spark, str(tmp_path), ["*.ts", "*.js"], ["*.test.js"])
    names = lambda f: sorted(r["path"].removeprefix(root + "/") for r in f.collect())
    assert names(every) == ["gen/e.js", "node_modules/x/c.js", "src/a.ts"]
    assert names(files.scripts(every, root, exclude=["node_modules"], gitignore="# no\ngen/\n")) == ["src/a.ts"]


def test_snapshot_records_errors(spark):
    rows = spark.createDataFrame([("a", "fine"), ("b", "bad"), ("c", None)], "path string, content string")

    def parse(text):
        if text == "bad":
            raise SyntaxError("no")

    got = {r["path"]: r["parse_error"] for r in files.snapshot(rows, parse).collect()}
    assert got == {"a": None, "b": "SyntaxError: no", "c": None}


def test_records(spark, tmp_path):
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write(json.dumps({"type": "metadata", "n": 1}) + "\n" + json.dumps({"n": 2}) + "\n")
    meta, rows = files.records(spark, str(tmp_path / "r.jsonl.gz"))
    assert meta.count() == 1 and rows.first()["n"] == 2


def test_config(tmp_path):
    assert config.load(tmp_path) == config.Config()
    (tmp_path / config.NAMES[0]).write_text(config.template("strict"))
    assert config.load(tmp_path).complexity.low == 5
    (tmp_path / "x.toml").write_text("severity = 'info'\n[clones]\nsimilarity = 0.9\n")
    assert config.load(tmp_path / "x.toml").clones.similarity == 0.9
    for bad in ({"nope": 1}, {"clones": {"x": 1}}, {"severity": "loud"}, {"clones": {"bands": 64}}):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, ["x"])], "name string, n int, tags array<string>")
    sinks.write_json({"s": frame}, str(tmp_path / "j"))
    sinks.write_csv({"s": frame}, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j/s")).first()["n"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "c/s")).first()["tags"] == '["x"]'
    data = sinks.rows(frame)
    assert sinks.to_yaml({"rows": data, "none": []}) == 'rows:\n  -\n    name: "a"\n    n: 1\n    tags:\n      - "x"\nnone: []\n'
    assert sinks.to_text("T", data).splitlines()[1].split() == ["name", "n", "tags"]
    assert "&lt;b&gt;" in sinks.to_html("t", {"s": [{"v": "<b>"}]})


def test_dot():
    out = sinks.to_dot([{"id": "a", "risk": "high", "cycle": 1}, {"id": "b", "risk": "low", "cycle": 1}, {"id": 'c"', "risk": None}], [{"src": "a", "dst": "b", "edge_type": "dynamic"}], "LR")
    assert 'subgraph cluster_0' in out and '"a" -> "b" [style=dashed];' in out and '"c\\""' in out and "rankdir=LR" in out
    with pytest.raises(ValueError):
        sinks.to_dot([], [], "XX")
