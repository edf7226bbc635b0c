"""Chat formatting: a small template language compiled to Python closures.

Language: ``{{ expression }}``, ``{% if %}/{% elif %}/{% else %}/{% endif %}`` and
``{% generation %}...{% endgeneration %}``, which marks what the loss covers.  Expressions
hold string and integer literals, names, ``==``, ``!=``, ``in``, ``and``, ``or``, ``not``,
``~`` (join) and ``| filter``.  Names resolve only to the fields of a turn, and filters only
to the given table: no attribute, call or index exists, so a template cannot reach Python.

Lexer -> parser -> syntax tree -> constant folding -> closures ``f(turn, out)``.  A template
renders one turn at a time (``first``, ``last``, ``index`` say where it stands), so a
conversation of any length streams through in bounded memory.

Escaping: a backslash becomes two, ``<|`` becomes ``\\l|`` and, in a role, a line feed becomes
``\\n``; no text can therefore hold a control string, and ``unescape`` restores it exactly.

Defined cases: null text or role is empty; turns sort by turn (null first), then role and
text; repeated rows are separate turns; a null conv_id is a conversation of its own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import ship

Node = tuple
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[~|()]))""")
_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_KEEP = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class TemplateError(ValueError):
    """The template does not parse."""


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "\\l|")


def escape_role(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "n": "\n"}[m[1]], text)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "trim": str.strip, "upper": str.upper, "lower": str.lower}

DEFAULT_TEMPLATE = "{% if first %}<|chat|>\n{% endif %}<|turn|>{{ role | escape_role }}\n{% if role == 'assistant' %}{% generation %}{{ text | escape }}{% endgeneration %}{% else %}{{ text | escape }}{% endif %}<|end|>\n"


class _Parser:
    """Recursive descent over the tags of a template."""

    def __init__(self, source: str):
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in _TAG.finditer(source):
            if m.start() > at:
                self.parts.append(("text", source[at : m.start()]))
            self.parts.append(("print", m[1]) if m[1] is not None else ("tag", m[2].strip()))
            at = m.end()
        if at < len(source):
            self.parts.append(("text", source[at:]))
        self.at = 0

    def body(self, stop: tuple[str, ...]) -> tuple[Node, str]:
        out: list[Node] = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(("emit", ("const", value)))
            elif kind == "print":
                out.append(("emit", self.expression(value)))
            else:
                word = value.split(None, 1)[0] if value else ""
                if word in stop:
                    return ("seq", out), value
                if word == "if":
                    out.append(self.branch(value[2:]))
                elif word == "generation":
                    inner, _ = self.body(("endgeneration",))
                    out.append(("loss", inner))
                else:
                    raise TemplateError(f"unexpected tag {value!r}")
        if stop:
            raise TemplateError(f"missing {' or '.join(stop)}")
        return ("seq", out), ""

    def branch(self, test: str) -> Node:
        condition = self.expression(test)
        then, tag = self.body(("elif", "else", "endif"))
        if tag.startswith("elif"):
            return ("if", condition, then, self.branch(tag[4:]))
        if tag == "else":
            other, _ = self.body(("endif",))
            return ("if", condition, then, other)
        return ("if", condition, then, ("seq", []))

    def expression(self, source: str) -> Node:
        self.tokens: list[tuple[str, Any]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            text, number, name, sign = m.groups()
            self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _KEEP.get(x[1], x[0]), text[1:-1])) if text else ("const", int(number)) if number else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.pos = 0
        out = self.either()
        if self.pos != len(self.tokens):
            raise TemplateError(f"left over in {source!r}")
        return out

    def take(self, *values: str) -> str | None:
        if self.pos < len(self.tokens) and self.tokens[self.pos][0] != "const" and self.tokens[self.pos][1] in values:
            self.pos += 1
            return self.tokens[self.pos - 1][1]
        return None

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.joined()
        while sign := self.take("==", "!=", "in"):
            left = (sign, left, self.joined())
        return left

    def joined(self) -> Node:
        left = self.filtered()
        while self.take("~"):
            left = ("~", left, self.filtered())
        return left

    def filtered(self) -> Node:
        value = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.pos] if self.pos < len(self.tokens) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.pos += 1
            value = ("filter", name, value)
        return value

    def atom(self) -> Node:
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return inner
        if self.pos >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.pos]
        self.pos += 1
        if kind == "const":
            return ("const", value)
        if kind == "name" and value in ("role", "text", "first", "last", "index"):
            return ("name", value)
        raise TemplateError(f"no name {value!r}")


_OPERATIONS: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: str(a) in str(b), "~": lambda a, b: f"{a}{b}", "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: Node) -> Node:
    """Evaluate what does not depend on the turn, drop dead branches and join neighbouring literals."""
    kind = node[0]
    if kind in _OPERATIONS:
        a, b = fold(node[1]), fold(node[2])
        return ("const", _OPERATIONS[kind](a[1], b[1])) if a[0] == b[0] == "const" else (kind, a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(node[2])
        return ("const", FILTERS[node[1]](str(a[1]))) if a[0] == "const" else ("filter", node[1], a)
    if kind == "emit":
        return ("emit", fold(node[1]))
    if kind == "loss":
        return ("loss", fold(node[1]))
    if kind == "if":
        test = fold(node[1])
        if test[0] == "const":
            return fold(node[2] if test[1] else node[3])
        return ("if", test, fold(node[2]), fold(node[3]))
    if kind == "seq":
        out: list[Node] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "seq" else [x]:
                if out and y[0] == "emit" and out[-1][0] == "emit" and y[1][0] == "const" and out[-1][1][0] == "const":
                    out[-1] = ("emit", ("const", f"{out[-1][1][1]}{y[1][1]}"))
                else:
                    out.append(y)
        return ("seq", out)
    return node


def _value(node: Node) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda turn, v=node[1]: v
    if kind == "name":
        return lambda turn, n=node[1]: turn[n]
    if kind == "not":
        a = _value(node[1])
        return lambda turn: not a(turn)
    if kind == "filter":
        f, a = FILTERS[node[1]], _value(node[2])
        return lambda turn: f(str(a(turn)))
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda turn: a(turn) and b(turn)
    if kind == "or":
        return lambda turn: a(turn) or b(turn)
    op = _OPERATIONS[kind]
    return lambda turn: op(a(turn), b(turn))


class _Out:
    """Rendered pieces, their length so far and the spans under the loss mask."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)


def _code(node: Node) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "emit":
        value = _value(node[1])
        return lambda turn, out: out.put(str(value(turn)))
    if kind == "loss":
        inner = _code(node[1])

        def masked(turn: dict, out: _Out) -> None:
            begin = out.size
            inner(turn, out)
            out.spans.append((begin, out.size))

        return masked
    if kind == "if":
        test, then, other = _value(node[1]), _code(node[2]), _code(node[3])
        return lambda turn, out: then(turn, out) if test(turn) else other(turn, out)
    steps = [_code(x) for x in node[1]]

    def sequence(turn: dict, out: _Out) -> None:
        for step in steps:
            step(turn, out)

    return sequence


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a turn's fields to (formatted text, loss spans in code points)."""
    parser = _Parser(source)
    tree, _ = parser.body(())
    run = _code(fold(tree))

    def render(turn: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(turn, out)
        return "".join(out.pieces), out.spans

    return render


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, bool, str, str]]:
    """(conversation, begins it, role, text) in order, over batch edges."""
    last: Any = object()
    for batch in batches:
        for conv, role, text in zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            yield conv, conv != last, role or "", text or ""
            last = conv


def _formatted(template: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[tuple] = []
        size = 0
        before = None
        index = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            spans = pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in held], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.string()), spans, pa.array([x[4] for x in held], pa.bool_())], names=["conv_id", "index", "formatted", "loss_spans", "last"])
            held.clear()
            size = 0
            return out

        def put(row: tuple, last: bool) -> None:
            nonlocal size
            conv, i, role, text = row
            piece, spans = render({"role": role, "text": text, "first": i == 0, "last": last, "index": i})
            held.append((conv, i, piece, spans, last))
            size += len(piece)

        for conv, begins, role, text in _rows(batches):
            index = 0 if begins else index + 1
            if before is not None:
                put(before, begins)
                if size > 1 << 20:
                    yield flush()
            before = (conv, index, role, text)
        if before is not None:
            put(before, True)
        if held:
            yield flush()

    return run


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), "role", "text")
    return rows.repartition("conv").sortWithinPartitions("conv", "at", "role", "text").select("conv", "role", "text")


def format_conversations(turns: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, index, formatted, loss_spans, last): each turn's piece; a conversation is its pieces in order.

    The pieces of a conversation lie together and in order inside a partition.
    """
    ship(turns.sparkSession)
    compile_template(template)
    return _ordered(turns).mapInArrow(_formatted(template), "conv_id long, index long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, last boolean")


_TURN = re.compile(r"(?:<\|chat\|>\n)?<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.S)


def read_back(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in text that the default template has formatted."""
    out, at = [], 0
    while at < len(piece):
        m = _TURN.match(piece, at)
        if not m:
            raise ValueError("not formatted by the default template")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    turns = loss = None
    n = loss_chars = chars = 0
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        for conv, index, piece, spans, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "index", "formatted", "loss_spans", "last"))):
            if index == 0:
                turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, text in read_back(piece):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            for s in spans:
                plain = unescape(piece[s["start"] : s["end"]])
                loss.update(plain.encode("utf-8", "surrogatepass"))
                loss_chars += len(plain)
            chars += len(piece)
            if last:
                held.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []


PROBE = "\\### Assistant: </turn> ok"


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return format_conversations(turns.union(probe)).mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Lengths of the default template's fixed text: 9 once a conversation; 8 + 1 + 8 for each turn.
OP3_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '\l|')) AS lt, length(replace(replace(replace(role, '\', '\\'), '<|', '\l|'), chr(10), '\n')) AS lr FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(9 + sum(17 + lt + lr) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
