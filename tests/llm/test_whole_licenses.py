"""Known licence texts are found however they are wrapped, marked as comments and spelled."""

import textwrap

import duckdb
import pytest

from treeloom.llm import licenses


def find(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(rows).collect()}
    return [got[n] for n in range(len(texts))]


def test_full_licence_texts_are_known(spark):
    texts = licenses.full_texts()
    ids = {i for i, _ in texts}
    assert {"Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"} <= ids
    assert find(spark, ["Copyright (c) 2020 Someone\n" + t.upper() for _, t in texts]) == [i for i, _ in texts]


def test_wraps_and_comment_marks_hide_nothing(spark):
    known = licenses.KNOWN + licenses.full_texts()
    texts, want = [], []
    for i, t in known:
        for width in range(40, 121, 8):
            lines = textwrap.wrap(t, width, break_long_words=False)
            for mark in ("", "# ", " * ", "// "):
                texts.append("\n".join(mark + x for x in lines))
                want.append(i)
    assert find(spark, texts) == want


def test_spellings_across_line_breaks(spark):
    known = spark.createDataFrame([(str(n), f"to {a} the holder{n} of it") for n, (a, _) in enumerate(licenses.SPELLINGS)], "license_id string, text string")
    rows, want = [], []
    for n, (a, b) in enumerate(licenses.SPELLINGS):
        for form in (a, b, a.replace(" ", "\n"), b.replace(" ", "-\n"), a.upper()):
            rows.append((len(rows), f"to\n{form}\nthe holder{n} of it"))
            want.append({str(m) for m, (x, y) in enumerate(licenses.SPELLINGS) if m == n})
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [{got[i]} for i in range(len(rows))] == want


def test_words_are_replaced_whole(spark):
    known = spark.createDataFrame([("a", "the ownership of it")], "license_id string, text string")
    rows = spark.createDataFrame([(1, "the holdership of it"), (2, "The OWNERSHIP; of it")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan(rows, known).collect()} == {1: None, 2: "a"}


@pytest.mark.parametrize("line", ["copyright notice, this list of things", "COPYRIGHT HOLDERS BE LIABLE FOR", "Copyright holder may"])
def test_lines_that_merely_begin_with_copyright_stay(spark, line):
    rows = spark.createDataFrame([(1, f"a b\n{line}\nc d")], "doc_id long, text string")
    assert licenses.scan(rows).first()["canonical_chars"] == len("a b " + " ".join(line.lower().replace(",", "").split()) + " c d")


def test_query_and_its_sql_find_planted_licences_and_notices(spark, tmp_path):
    mit = dict(licenses.KNOWN)["MIT"]
    gpl = dict(licenses.full_texts())["GPL-3.0"]
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 A\n\n" + mit),
        (2, "\n".join("# " + x for x in textwrap.wrap(gpl, 61))),
        (3, f"Some prose.\nReleased under the MIT licence.\nMore.\n  * {licenses.KNOWN[0][1]}"),
        (4, None),
        (5, ""),
        (6, "Copyright 2001 X"),
        (7, "x" * 100_000),
    ]
    (tmp_path / "t").mkdir()
    path = str(tmp_path / "t" / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    got = sorted(tuple(r) for r in licenses.op1_license_scan(spark, str(tmp_path / "t")).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(con.execute(licenses.OP1_SQL).fetchall()) == got
    assert {r[0]: r[3:] for r in got} == {1: ("MIT", "MIT"), 2: ("GPL-3.0", ""), 3: (None, "Apache-2.0-notice,MIT-notice"), 4: (None, ""), 5: (None, ""), 6: (None, ""), 7: (None, "")}
