"""Scripts to facts, and the analyses of a small project."""

from __future__ import annotations

import pytest

from treeloom.plans.analyze import Project
from treeloom.sources import scripts

FILES = {
    "src/index.ts": "import { used, spare } from './util';\nimport type { T } from './types';\nimport * as ns from './ns';\nimport './side';\nconst x: T = used(1);\nns.go();\nnew Service();\n",
    "src/util.ts": "export function used(a) {\n  if (a > 1 && a < 5) { return a; }\n  return a ? 1 : 2;\n  console.log('dead');\n}\nexport function lonely() { return 1; }\nexport const spare = 2;\n",
    "src/ns.ts": "import { b } from './b';\nexport const go = () => { for (const i of [1]) { while (b) { break; } } };\n",
    "src/b.ts": "import { go } from './ns';\nexport const b = /[/]{2}/.test(`x${go}`);\n",
    "src/side.ts": "switch (1) {\n  case 1:\n    break;\n    foo();\n  default:\n    bar();\n}\n",
    "src/types.ts": "export interface T { a: number }\n",
    "src/c1.ts": "import { d } from './d1';\nexport class C { go() { try { d(); } catch (e) { throw e; } } }\n",
    "src/d1.ts": "import { C } from './c1';\nexport function d() { return new C(); }\n",
    "src/bad.ts": "function ( {\n",
}


@pytest.fixture(scope="module")
def project(spark):
    return Project(spark, spark.createDataFrame(list(FILES.items()), "file_path string, content string"))


def test_facts_of_a_module():
    f = scripts.facts(FILES["src/index.ts"])
    assert [(i["import_type"], i["imported"], i["local"], i["is_type_only"]) for i in f.imports] == [("named", "used", "used", False), ("named", "spare", "spare", False), ("named", "T", "T", True), ("namespace", "*", "ns", False), ("side_effect", "", "", False)]
    assert "used" in f.references and "spare" not in f.references and f.classes == [{"dep": "Service", "kind": "instantiation", "line": 7}]


def test_functions_and_dead_statements():
    f = scripts.facts(FILES["src/util.ts"])
    assert [(x["name"], x["complexity"]) for x in f.functions] == [("used", 4), ("lonely", 1)]
    assert [(x["reason"], x["start_line"]) for x in f.findings] == [("unreachable_after_return", 4)]
    assert [(x["reason"], x["start_line"]) for x in scripts.facts(FILES["src/side.ts"]).findings] == [("unreachable_after_break", 4)]
    go = scripts.facts(FILES["src/ns.ts"]).functions
    assert [(x["name"], x["nesting"], x["complexity"]) for x in go] == [("go", 2, 3)]


@pytest.mark.parametrize("text", ["if (a) {", "a ]", "x = 'open"])
def test_syntax_errors(text):
    with pytest.raises(SyntaxError):
        scripts.tokens(text)


def test_parse_errors_are_rows(project):
    bad = project.snapshot.where("parse_error is not null").collect()
    assert [r["file_path"] for r in bad] == ["src/bad.ts"]


def test_dead_code(project):
    d = project.dead_code()
    assert {(r["file_path"], r["local"]) for r in d["imports"].collect()} == {("src/index.ts", "spare")}
    assert {(r["file_path"], r["name"]) for r in d["functions"].collect()} == {("src/util.ts", "lonely")}
    assert d["exports"].count() == 0 and d["statements"].count() == 2


def test_dependencies(project):
    d = project.dependencies()
    cycles = {}
    for r in d["cycles"].collect():
        cycles.setdefault(r["component"], set()).add(r["name"])
    assert sorted(map(sorted, cycles.values())) == [["src/b.ts", "src/ns.ts"], ["src/c1.ts", "src/d1.ts"]]
    assert {r["id"] for r in d["orphans"].collect()} == {"src/c1.ts", "src/d1.ts"}


def test_coupling_and_check(project):
    c = {r["class"]: r["coupling"] for r in project.coupling().collect()}
    assert c["src/index.ts"] == 5 and c["src/d1.ts"] == 1
    assert {r["category"] for r in project.check(most=3).collect()} == {"complexity", "dead_code", "cycles"}


def test_summary(project):
    row = project.summary().first()
    assert (row["files"], row["failed"], row["in_cycles"], row["scale"]) == (9, 1, 4, "Micro")
    assert 0 <= row["score"] <= 100 and row["grade"] in "ABCDF"
