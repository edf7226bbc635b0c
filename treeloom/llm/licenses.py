"""License scans: canonical digest lookup of whole texts.

A text is brought to canonical form - lower case, punctuation and white space reduced to single
blanks, spelling variants made equal word by word - and the SHA-256 of that form is joined to
the digests of known licences.  Line breaks and comment marks do not matter.  A second form
leaves out whole lines that hold a copyright statement (the word or sign, then (c), a year or a
place for one), "all rights reserved" or a licence's title; each known text and each document
is looked up by both forms, so neither a changed copyright line nor a re-wrapped text hides a
match.  A match is an equality of entire texts, and nothing is compared pairwise.

``notices`` looks up every line of a text in the same way, as a text of its own, and so finds
licence notices inside documents.

Known licences are a table of (license_id, text): ``KNOWN``, and the full texts in the folder
``license_texts``, each also without the appendix after its terms.  The table's digests are
broadcast when they are at most ``BROADCAST_LICENSES`` and hash-joined otherwise.

Defined cases: null or empty text has an empty canonical form, no digest and no licence; one
that is only copyright lines is looked up as it is; texts equal in canonical form share a
digest; where two known licences have one digest the least id stands; repeated rows stay, and
rows that share an id share its notices; an empty table gives no rows; columns that share a
name with a result are replaced.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import spread

BROADCAST_LICENSES = 100_000

#: Words that licences use one for another.
SPELLINGS = [
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("sub licenses", "sublicenses"),
    ("sub licensed", "sublicensed"),
    ("sublicence", "sublicense"),
    ("sublicences", "sublicenses"),
    ("analogue", "analog"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("owner", "holder"),
    ("owners", "holders"),
    ("per cent", "percent"),
    ("recognise", "recognize"),
    ("redistribution s", "redistributions"),
    ("wilful", "willful"),
    ("https", "http"),
]

#: Texts of known licences and licence notices.
KNOWN = [
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT-notice", "Released under the MIT License."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "ISC",
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "BSD-2-Clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
]

#: Lines of the second form's exception: a copyright statement, the reservation of rights, the title of a licence.
DROPPED_LINE = (
    r"(?m)^[ \t#*/;!%'\"-]*(?:"
    r"(?:copyright[: \t]*|\(c\)[ \t]*|©[ \t]*)(?:\(c\)|©|[0-9]{4}|<|\[|\{)[^\n]*"
    r"|all rights reserved[. \t]*"
    r"|(?:the )?(?:mit|isc|bsd|simplified bsd|apache) licen[sc]e(?: \(mit\))?[ \t]*"
    r")$"
)


def _lower(text: Column) -> Column:
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r"), F.lit("\n"))


def _spelled(t: Column, between: str) -> Column:
    """Words set apart by two blanks, so that each has a blank of its own on either side, in one spelling."""
    t = F.concat(F.lit(" "), F.regexp_replace(t, between, "  "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} ".replace(" ", "  ")[1:-1]), F.lit(f" {b} ".replace(" ", "  ")[1:-1]))
    return F.regexp_replace(t, " +", " ")


def canonical(text: Column, whole: bool = False) -> Column:
    """The canonical form, of the text ``whole`` or without copyright lines and titles: built-in expressions only."""
    t = _lower(text)
    return F.trim(_spelled(t if whole else F.regexp_replace(t, DROPPED_LINE, ""), r"[^\p{L}\p{N}]+"))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line."""
    t = _spelled(F.replace(_lower(text), F.lit("\n"), F.lit(" \n ")), r"[^\p{L}\p{N}\n]+")
    return F.split(F.replace(F.replace(t, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n")), "\n")


def full_texts() -> list[tuple[str, str]]:
    """(license_id, text) of the files of ``license_texts``, whole and up to the end of the terms."""
    out = []
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text("utf-8")
        terms, end, appendix = text.partition("END OF TERMS AND CONDITIONS")
        out += [(path.stem, text)] + ([(path.stem, terms + end), (path.stem, terms)] if appendix.strip() else [])
    return out


def known_digests(spark, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id) of a table of (license_id, text), by both forms."""
    known = spark.createDataFrame(KNOWN + full_texts(), "license_id string, text string") if known is None else known
    forms = F.array(canonical(F.col("text")), canonical(F.col("text"), whole=True))
    rows = known.select(F.col("license_id").cast("string").alias("license_id"), F.explode(forms).alias("c")).where("c <> '' and license_id is not null")
    return rows.groupBy(F.sha2("c", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def _bounded(digests: DataFrame) -> DataFrame:
    return F.broadcast(digests) if digests.limit(BROADCAST_LICENSES + 1).count() <= BROADCAST_LICENSES else digests


def scan(documents: DataFrame, known: DataFrame | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with canonical_chars, digest and license_id (null where the text is no known licence)."""
    digests = _bounded(known_digests(documents.sparkSession, known))
    made = ["canonical_chars", "digest", "license_id"]
    names = [f"`{c}`" for c in (documents.columns if keep is None else keep) if c not in made]
    whole = canonical(F.col(text), whole=True)
    # most texts have no such line, and so but one form
    less = F.when(_lower(F.col(text)).rlike(DROPPED_LINE), canonical(F.col(text)))
    rows = documents.select(*names, whole.alias("__whole"), less.alias("__less"))
    sha = lambda c: F.when(F.col(c) != "", F.sha2(c, 256))
    form = F.coalesce("__less", "__whole")
    rows = rows.select(*names, F.length(form).cast("long").alias("canonical_chars"), sha("__whole").alias("__digest"), F.when(F.col("__less").isNull(), sha("__whole")).otherwise(sha("__less")).alias("digest"))
    for n, column in enumerate(("digest", "__digest")):
        own = digests.select(F.col("digest").alias(f"__d{n}"), F.col("license_id").alias(f"__l{n}"))
        rows = rows.join(own, F.col(column) == F.col(f"__d{n}"), "left")
    return rows.select(*names, "canonical_chars", "digest", F.coalesce("__l0", "__l1").alias("license_id"))


def notices(documents: DataFrame, known: DataFrame | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the number of each line (from 1) that is a known text of its own, and its license_id."""
    digests = _bounded(known_digests(documents.sparkSession, known)).withColumnsRenamed({"digest": "__digest"})
    names = [f"`{c}`" for c in (documents.columns if keep is None else keep) if c not in ("line", "license_id")]
    lines = documents.select(*names, F.posexplode(canonical_lines(F.col(text))).alias("__at", "__form")).where("trim(__form) <> ''")
    found = lines.join(digests, F.sha2(F.trim("__form"), 256) == F.col("__digest"))
    return found.select(*names, (F.col("__at") + 1).cast("long").alias("line"), "license_id")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    inside = notices(docs, keep=["doc_id"]).groupBy(F.col("doc_id").alias("__id")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))  # at most the known ids
    found = scan(docs, keep=["doc_id"]).join(inside, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return found.select("doc_id", "canonical_chars", "digest", "license_id", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(t: str, between: str) -> str:
        t = f"' ' || regexp_replace({t}, {quote(between)}, '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, {quote(f' {a} '.replace(' ', '  ')[1:-1])}, {quote(f' {b} '.replace(' ', '  ')[1:-1])})"
        return f"regexp_replace({t}, ' +', ' ', 'g')"

    def forms(x: str) -> str:
        t = f"replace(lower(coalesce({x}, '')), chr(13), chr(10))"
        less = f"regexp_replace({t}, {quote(DROPPED_LINE)}, '', 'g')"
        return f"trim({spelled(less, LETTERS)}) AS f, trim({spelled(t, LETTERS)}) AS g"

    LETTERS = r"[^\p{L}\p{N}]+"
    broken = "replace(replace(lower(coalesce(text, '')), chr(13), chr(10)), chr(10), ' ' || chr(10) || ' ')"
    lines = spelled(broken, r"[^\p{L}\p{N}\n]+")
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN + full_texts())
    return (
        f"WITH v AS MATERIALIZED (SELECT i, {forms('t')} FROM (VALUES {known}) v(i, t)), "
        "k AS MATERIALIZED (SELECT sha256(f) AS digest, min(i) AS license_id FROM (SELECT i, f FROM v UNION ALL SELECT i, g FROM v) WHERE f <> '' GROUP BY 1), "
        f"d AS MATERIALIZED (SELECT doc_id, {forms('text')} FROM documents), "
        f"l AS (SELECT doc_id, trim(unnest(string_split({lines}, chr(10)))) AS f FROM documents), "
        "n AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM l JOIN k ON f <> '' AND sha256(f) = k.digest GROUP BY doc_id) "
        "SELECT x.doc_id, CAST(length(f) AS BIGINT) AS canonical_chars, x.digest, coalesce(k.license_id, w.license_id) AS license_id, coalesce(notices, '') AS notices "
        "FROM (SELECT *, CASE WHEN f <> '' THEN sha256(f) END AS digest, CASE WHEN g <> '' THEN sha256(g) END AS digest2 FROM d) x "
        "LEFT JOIN k ON x.digest = k.digest LEFT JOIN k w ON x.digest2 = w.digest LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM x.doc_id"
    )


OP1_SQL = _sql()
