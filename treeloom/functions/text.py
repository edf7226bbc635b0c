"""Text expressions: normalisation, hashing, byte-wise edit distance, globs, shingles."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions.udf import pandas_udf


def line_count(content: Column) -> Column:
    """One more than the number of line feeds."""
    return (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1).cast("long")


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def normalize_plain(content: Column) -> Column:
    """N16 for text without quotes: blanks survive only between two word characters."""
    word = "[A-Za-z0-9_]"
    marked = F.regexp_replace(content, rf"(?<={word})[ \t\r\n\f\x0b]+(?={word})", "\u0001")
    return F.replace(F.regexp_replace(marked, r"[ \t\r\n\f\x0b]+", ""), F.lit("\u0001"), F.lit(" "))


_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|`(?:\\.|[^`\\])*`?|\s+|[^\"'`\s]+", re.S)


def _normalize(text: str | None) -> str | None:
    if text is None:
        return None
    out: list[str] = []
    gap = False
    for token in _QUOTED.findall(text):
        if token[0].isspace():
            gap = bool(out)
            continue
        if gap and re.match(r"\w", token[0], re.A) and re.match(r"\w", out[-1][-1], re.A):
            out.append(" ")
        out.append(token)
        gap = False
    return "".join(out)


@pandas_udf("string")
def normalize_quoted(content: pd.Series) -> pd.Series:
    """As ``normalize_plain``, but white space inside quotes is kept."""
    return content.map(_normalize, na_action="ignore")


_COMMENT = re.compile(r"(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)


@pandas_udf("string")
def strip_comments(content: pd.Series) -> pd.Series:
    """Line and block comments outside quotes are dropped."""
    return content.map(lambda s: _COMMENT.sub(lambda m: m[1] or "", s), na_action="ignore")


def content_hash(normalized: Column) -> Column:
    """A stable digest of normalised text, empty for empty text."""
    return F.when(normalized == "", F.lit("")).otherwise(F.md5(normalized))


def exact_match(a: Column, b: Column) -> Column:
    """Equality of normalised texts; the empty text matches nothing."""
    return (a == b) & (a != "")


def bytes_as_characters(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def byte_levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(bytes_as_characters(a), bytes_as_characters(b))


def textual_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in bytes; two empty texts are equal, one is unlike."""
    n = F.greatest(F.octet_length(a), F.octet_length(b))
    return (
        F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0))
        .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .otherwise(1.0 - byte_levenshtein(a, b) / n)
    )


def words(text: Column) -> Column:
    """Lower-case words split at white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingles(tokens: Column, k: int, joiner: str = ":") -> Column:
    """All runs of k tokens; none where k is 1 or less or the sequence is shorter."""
    if k <= 1:
        return F.array().cast("array<string>")
    return F.when(
        F.size(tokens) >= k,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), joiner)),
    ).otherwise(F.array().cast("array<string>"))


def canonical_label(label: Column) -> Column:
    """A label without its payload."""
    return F.regexp_replace(label, r"\(.*$", "")


def count_bin(n: Column) -> Column:
    """1, 2-3, 4-7, 8-15, 16+; zero counts as 1."""
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 7, "4-7").when(n <= 15, "8-15").otherwise("16+")


def _segment(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            j = glob.find("]", i + 2)
            if j < 0:
                raise ValueError(f"bad pattern {glob!r}")
            inner = glob[i + 1 : j]
            out += "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner).replace("\\", "\\\\") + "]"
            i = j
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(glob: str) -> str | None:
    """A base-name glob as a regular expression; a bad pattern matches nothing."""
    try:
        return f"^{_segment(glob)}$"
    except ValueError:
        return None


def path_glob_regex(glob: str) -> str | None:
    """Slash-less patterns match any segment; slashed ones start at a boundary and match prefixes; ``**`` is any depth."""
    glob = glob.strip("/").lower()
    try:
        if "/" not in glob:
            return "(^|/).*(/|$)" if glob == "**" else f"(^|/){_segment(glob)}(/|$)"
        parts = []
        for part in glob.split("/"):
            parts.append("(?:[^/]+/)*" if part == "**" else _segment(part) + "/")
        body = "".join(parts)
        return f"(^|/){body[:-1]}(/|$)" if body.endswith("/") else f"(^|/){body}"
    except ValueError:
        return None


def matches_any(name: Column, globs: list[str], to_regex=glob_regex) -> Column:
    out = F.lit(False)
    for r in filter(None, map(to_regex, globs)):
        out = out | name.rlike(r)
    return out


def matches_name(name: Column, pattern: str) -> Column:
    """A glob where the pattern has wildcards, else equality without regard to case."""
    if any(c in pattern for c in "*?"):
        r = glob_regex(pattern)
        return F.lit(False) if r is None else name.rlike(r)
    return F.lower(name) == pattern.lower()


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """The parent directory; '.' for a bare name."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(d == "", "/").otherwise(d)


def clean_path(path: Column) -> Column:
    """Leading './' and doubled slashes removed."""
    return F.regexp_replace(F.regexp_replace(path, r"^(?:\./)+", ""), r"/{2,}|/(?:\./)+", "/")


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")
