"""Scripts (JavaScript, TypeScript) to rows: imports, exports, references, functions, dead statements.

A tokeniser that knows strings, templates, regular expressions and comments feeds single-pass
extractors.  A file whose brackets do not match is an error of that file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import ship

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<template>`(?:\\.|[^`\\])*`)"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>=>|\.\.\.|&&=|\|\|=|\?\?=|&&|\|\||\?\?|\?\.|[{}()\[\];,<>=+\-*%!~^&|?:.@#]|/)""",
    re.S,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
#: Words that each add a path, and operators that do.
DECISIONS, DECISION_SIGNS = {"if", "for", "while", "case", "catch"}, {"&&", "||", "??"}
NESTING = {"if", "for", "while", "switch", "try", "do"}
JUMPS = {"return", "throw", "break", "continue"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


def tokens(source: str) -> list[Token]:
    """Tokens without white space and comments; unmatched brackets raise."""
    out: list[Token] = []
    at, line = 0, 1
    stack: list[str] = []
    while at < len(source):
        last = out[-1] if out else None
        if source[at] == "/" and source[at + 1 : at + 2] not in ("/", "*") and (last is None or last.text in _BEFORE_REGEX or (last.kind == "sign" and last.text not in (")", "]", "}"))) and (m := _REGEX.match(source, at)):
            out.append(Token("regex", m[0], line))
        else:
            m = _TOKEN.match(source, at)
            if not m:
                raise SyntaxError(f"line {line}: cannot read {source[at : at + 10]!r}")
            if m.lastgroup not in ("space", "comment"):
                out.append(Token(m.lastgroup, m[0], line))
                if m.lastgroup == "sign":
                    if m[0] in "([{":
                        stack.append(m[0])
                    elif m[0] in _PAIRS and (not stack or stack.pop() != _PAIRS[m[0]]):
                        raise SyntaxError(f"line {line}: unmatched {m[0]}")
        line += m[0].count("\n")
        at = m.end()
    if stack:
        raise SyntaxError(f"unclosed {stack[-1]}")
    return out


@dataclass
class Facts:
    imports: list[dict] = field(default_factory=list)
    exports: list[dict] = field(default_factory=list)
    references: set[str] = field(default_factory=set)
    classes: list[dict] = field(default_factory=list)
    functions: list[dict] = field(default_factory=list)
    findings: list[dict] = field(default_factory=list)


def _close(ts: list[Token], at: int) -> int:
    """The bracket that matches the one at ``at``."""
    depth = 0
    for i in range(at, len(ts)):
        if ts[i].kind == "sign":
            depth += ts[i].text in "([{" and len(ts[i].text) == 1
            depth -= ts[i].text in _PAIRS
            if depth == 0:
                return i
    return len(ts) - 1


def _names(ts: list[Token], a: int, b: int) -> list[tuple[str, str, bool]]:
    """(imported, local, type only) of the braces' contents."""
    out, part = [], []
    for t in [*ts[a + 1 : b], Token("sign", ",", 0)]:
        if t.text != ",":
            part.append(t.text)
            continue
        if part:
            typed = part[0] == "type" and len(part) > 1 and part[1] != "as"
            part = part[1:] if typed else part
            out.append((part[0], part[2] if len(part) > 2 and part[1] == "as" else part[0], typed))
        part = []
    return out


def facts(source: str) -> Facts:
    ts = tokens(source)
    out = Facts()
    skip: set[int] = set()
    text = lambda i: ts[i].text if 0 <= i < len(ts) else ""
    unquote = lambda s: s[1:-1]

    def imported(line, source_, kind, imported_="", local="", typed=False):
        out.imports.append({"source": source_, "import_type": kind, "imported": imported_, "local": local, "is_type_only": typed, "line": line})

    i = 0
    while i < len(ts):
        t = ts[i]
        if t.kind == "name" and t.text == "import" and text(i - 1) != "." and text(i + 1) != ".":
            if text(i + 1) == "(":
                if ts[i + 2].kind == "string":
                    imported(t.line, unquote(text(i + 2)), "dynamic")
                i += 2
                continue
            j = i + 1
            if j < len(ts) and ts[j].kind == "string":
                imported(t.line, unquote(text(j)), "side_effect")
                i = j + 1
                continue
            typed = text(j) == "type" and text(j + 1) not in ("from", ",")
            j += typed
            end = next((k for k in range(j, len(ts)) if ts[k].kind == "string"), None)
            if end is None:
                i += 1
                continue
            target = unquote(ts[end].text)
            while j < end:
                if text(j) == "{":
                    k = _close(ts, j)
                    for name, local, one in _names(ts, j, k):
                        imported(t.line, target, "named", name, local, typed or one)
                    j = k
                elif text(j) == "*":
                    imported(t.line, target, "namespace", "*", text(j + 2), typed)
                    j += 2
                elif ts[j].kind == "name" and text(j) != "from":
                    imported(t.line, target, "default", "default", text(j), typed)
                j += 1
            skip.update(range(i, end + 1))
            i = end + 1
            continue
        if t.kind == "name" and t.text == "require" and text(i + 1) == "(" and i + 2 < len(ts) and ts[i + 2].kind == "string":
            imported(t.line, unquote(text(i + 2)), "require", "*", text(i - 2) if text(i - 1) == "=" else "")
        if t.kind == "name" and t.text == "export" and text(i - 1) != ".":
            j = i + 1
            if text(j) == "type" and text(j + 1) == "{":
                j += 1
            if text(j) in ("{", "*"):
                k = _close(ts, j) if text(j) == "{" else j
                again = text(k + 1) == "from" or text(j) == "*"
                for name, local, _ in _names(ts, j, k) if text(j) == "{" else [("*", "*", False)]:
                    out.exports.append({"name": local, "kind": "all" if name == "*" else "reexport" if again else "named", "declaration": "", "line": t.line})
                    if not again:
                        out.references.add(name)
                if again:
                    end = next((m for m in range(k, len(ts)) if ts[m].kind == "string"), k)
                    if ts[end].kind == "string":
                        imported(t.line, unquote(ts[end].text), "reexport", "*" if text(j) == "*" else "")
                        k = end
                skip.update(range(i, k + 1))
                i = k + 1
                continue
            word = text(j)
            if word == "default":
                out.exports.append({"name": "default", "kind": "default", "declaration": text(j + 1) if text(j + 1) in ("function", "class") else "", "line": t.line})
            else:
                while text(j) in ("async", "declare", "abstract"):
                    j += 1
                kind = text(j)
                name = text(j + 2) if text(j + 1) == "*" else text(j + 1)
                out.exports.append({"name": name, "kind": "type" if kind in ("type", "interface") else "named", "declaration": kind if kind in ("function", "class") else "", "line": t.line})
        elif t.kind == "name" and i not in skip and text(i - 1) not in (".", "?.") and not (text(i + 1) == ":" and text(i - 1) in ("{", ",")):
            out.references.add(t.text)
        elif t.kind == "template":
            for inner in re.findall(r"\$\{([^}]*)\}", t.text):
                out.references.update(re.findall(r"[A-Za-z_$][\w$]*", inner))
        if t.text == "new" and i + 1 < len(ts) and ts[i + 1].kind == "name":
            out.classes.append({"dep": text(i + 1), "kind": "instantiation", "line": t.line})
        if t.text == "extends" and i + 1 < len(ts) and ts[i + 1].kind == "name":
            out.classes.append({"dep": text(i + 1), "kind": "inheritance", "line": t.line})
        i += 1
    out.functions = list(_functions(ts))
    out.findings = list(_dead(ts))
    return out


def _bodies(ts: list[Token]) -> Iterator[tuple[str, int, int, int]]:
    """(name, first token, opening brace, closing brace) of functions, methods and arrows with a body."""
    for i, t in enumerate(ts):
        if t.text != "{" or i == 0:
            continue
        before = ts[i - 1].text
        j = None
        if before == "=>":
            j = i - 2
            if ts[j].text == ")":
                j = _open(ts, j)
            name = ts[j - 2].text if j >= 2 and ts[j - 1].text == "=" else "<arrow>"
            if j >= 3 and ts[j - 1].text == "async" and ts[j - 2].text == "=":
                name = ts[j - 3].text
        elif before == ")":
            j = _open(ts, i - 1)
            head = ts[j - 1] if j else t
            if head.kind != "name" and head.text != "*" or head.text in NESTING | {"catch", "with"}:
                continue
            if head.text == "function" or head.text == "*":
                name = ts[j - 3].text if j >= 3 and ts[j - 2].text == "=" else "<anonymous>"
            else:
                name = head.text
            j = j - 1
        if j is None:
            continue
        yield name, j, i, _close(ts, i)


def _open(ts: list[Token], at: int) -> int:
    depth = 0
    for i in range(at, -1, -1):
        if ts[i].kind == "sign":
            depth += ts[i].text in _PAIRS
            depth -= ts[i].text in ("(", "[", "{")
            if depth == 0:
                return i
    return 0


def _functions(ts: list[Token]) -> Iterator[dict]:
    bodies = list(_bodies(ts))
    for name, head, a, b in bodies:
        inner = [(x, y) for _, _, x, y in bodies if a < x and y < b]
        inside = lambda k: any(x < k < y for x, y in inner)  # noqa: E731, B023
        complexity, nesting, handlers, depth = 1, 0, 0, []
        for k in range(a + 1, b):
            if inside(k):
                continue
            t = ts[k]
            if (t.kind == "name" and t.text in DECISIONS and ts[k - 1].text != ".") or t.text in DECISION_SIGNS:
                complexity += 1
            if t.text == "?" and ts[k + 1].text not in (".", ":", ",", ")", "]") and ts[k - 1].text != "(":
                complexity += 1
            handlers += t.text == "catch" and t.kind == "name" and ts[k - 1].text != "."
            while depth and k > depth[-1]:
                depth.pop()
            if t.kind == "name" and t.text in NESTING and ts[k - 1].text not in (".", "else"):
                start = k + 1
                if start < b and ts[start].text == "(":
                    start = _close(ts, start) + 1
                if start < b and ts[start].text == "{":
                    depth.append(_close(ts, start))
                    nesting = max(nesting, len(depth))
        yield {"name": name, "start_line": ts[head].line, "end_line": ts[b].line, "complexity": complexity, "nesting": nesting, "handlers": handlers, "node_count": b - a}


def _dead(ts: list[Token]) -> Iterator[dict]:
    """Statements after a jump at the end of a statement list, up to the closing brace or the next case."""
    for k, t in enumerate(ts):
        if t.kind != "name" or t.text not in JUMPS or k == 0 or ts[k - 1].text not in (";", "{", "}", ":"):
            continue
        if ts[k - 1].text == ":" and not _is_case(ts, k - 1):
            continue
        if ts[k - 1].text == "}" and k >= 2 and ts[k - 2].text == "=>":
            continue
        end, depth = k, 0
        while end + 1 < len(ts):
            nxt = ts[end + 1]
            if depth == 0 and (nxt.text in (";", "}") or (nxt.line > ts[end].line and t.text in ("break", "continue"))):
                break
            if depth == 0 and nxt.line > ts[end].line and nxt.kind == "name" and end > k and ts[end].kind != "sign":
                break
            depth += nxt.text in ("(", "[", "{") and nxt.kind == "sign"
            depth -= nxt.text in _PAIRS
            end += 1
        start = end + 1 + (end + 1 < len(ts) and ts[end + 1].text == ";")
        if start >= len(ts) or ts[start].text in ("}", "case", "default", "function"):
            continue
        stop, depth = start, 0
        while stop < len(ts) and not (depth == 0 and ts[stop].text in ("}", "case", "default")):
            depth += ts[stop].text in ("(", "[", "{") and ts[stop].kind == "sign"
            depth -= ts[stop].text in _PAIRS
            stop += 1
        yield {"reason": f"unreachable_after_{t.text}", "severity": "critical", "start_line": ts[start].line, "end_line": ts[stop - 1].line}


def _is_case(ts: list[Token], colon: int) -> bool:
    for k in range(colon - 1, max(-1, colon - 12), -1):
        if ts[k].text in ("case", "default"):
            return True
        if ts[k].text in (";", "{", "}", "?"):
            return False
    return False


_IMPORT = "struct<source:string,import_type:string,imported:string,local:string,is_type_only:boolean,line:int>"
_EXPORT = "struct<name:string,kind:string,declaration:string,line:int>"
_FUNCTION = "struct<name:string,start_line:int,end_line:int,complexity:int,nesting:int,handlers:int,node_count:int>"
_FINDING = "struct<reason:string,severity:string,start_line:int,end_line:int>"
_CLASS = "struct<dep:string,kind:string,line:int>"
SCHEMA = f"file_path string, content string, parse_error string, imports array<{_IMPORT}>, exports array<{_EXPORT}>, refs array<string>, classes array<{_CLASS}>, functions array<{_FUNCTION}>, findings array<{_FINDING}>"


def parsed(files: DataFrame) -> DataFrame:
    """One row for each file (file_path, content) with its facts, or its error and none."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["file_path"], frame["content"]):
                try:
                    f, error = facts(content or ""), None
                except SyntaxError as e:
                    f, error = Facts(), str(e)
                rows.append((path, content, error, f.imports, f.exports, sorted(f.references), f.classes, f.functions, f.findings))
            yield pd.DataFrame(rows, columns=["file_path", "content", "parse_error", "imports", "exports", "refs", "classes", "functions", "findings"])

    return files.select("file_path", "content").mapInPandas(run, SCHEMA)


def table_of(snapshot: DataFrame, column: str) -> DataFrame:
    """The rows of one kind with their file."""
    if column == "refs":
        return snapshot.select("file_path", F.explode("refs").alias("name"))
    return snapshot.select("file_path", F.inline(column))
