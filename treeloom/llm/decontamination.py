"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A window is ``window`` consecutive words of a benchmark item; an item of fewer words, but
not none, is one window.  Windows of one length share a shift table: for each block of two
words (hashed into the table) how far the search may jump because no window ends sooner.
Where the shift is zero, the block's full hash selects a bucket of windows, and the words
themselves are compared.  All segments of a batch advance in step, so each jump is one
numpy pass.

Defined cases: null or empty text has no words; rows with the same id stay separate rows;
an empty benchmark hits nothing; items with null id are ignored; columns of the input that
share a name with a result are replaced.  The windows travel in blocks of bounded size, one
broadcast and one map each, so a larger benchmark adds passes and never a larger broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.kernel import NOT_ALNUM, Words, chain, code_points, lists, map_texts
from treeloom.runtime import spread

#: Bytes of benchmark text in one block; a block becomes about 30 times that in tables.
BLOCK_BYTES = 4_000_000
TABLE_BITS = 18
LANE = 256

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(SPAN)),
]


class Patterns:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, hashes: np.ndarray, words: list[list[bytes]], item_of: list[np.ndarray]):
        self.length, self.block = length, min(2, length)
        size = 1 << TABLE_BITS
        self.shift = np.full(size, length - self.block + 1, np.int32)
        for q in range(self.block - 1, length):
            np.minimum.at(self.shift, self._slot(self._block(hashes, q)), length - 1 - q)
        suffix = self._block(hashes, length - 1)
        order = np.argsort(suffix, kind="stable")
        self.hashes, self.words, self.items = hashes[order], [words[i] for i in order], [item_of[i] for i in order]
        self.suffix, self.begin = np.unique(suffix[order], return_index=True)
        self.stop = np.append(self.begin[1:], len(order))

    def _block(self, hashes: np.ndarray, q: int) -> np.ndarray:
        return chain(*(hashes[:, q - j] for j in reversed(range(self.block))))

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the last word, pattern) of every occurrence."""
        m, h = self.length, w.h
        lanes = np.maximum(0, -(-(w.counts - m + 1) // LANE))
        row = np.repeat(np.arange(len(lanes)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = w.first[:-1][row] + m - 1 + nth * LANE
        end = np.minimum(at + LANE, w.first[1:][row])
        found = []
        while len(at):
            jump = self.shift[self._slot(chain(*(h[at - j] for j in reversed(range(self.block)))))]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            on = at < end
            at, end = at[on], end[on]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        suffix = chain(*(h[at - j] for j in reversed(range(self.block)))) if len(at) else np.zeros(0, np.uint64)
        bucket = np.searchsorted(self.suffix, suffix)
        bucket[bucket == len(self.suffix)] = 0
        hit = self.suffix[bucket] == suffix
        at, bucket = at[hit], bucket[hit]
        many = self.stop[bucket] - self.begin[bucket]
        pattern = np.repeat(self.begin[bucket], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        for j in range(m):
            same = self.hashes[pattern, m - 1 - j] == h[at - j]
            at, pattern = at[same], pattern[same]
        same = np.fromiter((all(w.word(a - m + 1 + j) == x for j, x in enumerate(self.words[p])) for a, p in zip(at, pattern)), bool, len(at))
        return at[same], pattern[same]


def compile_patterns(items: list[tuple[object, str | None]], window: int) -> list[Patterns]:
    groups: dict[int, dict[tuple[bytes, ...], set]] = {}
    known: dict[bytes, np.uint64] = {}
    for item, text in items:
        data = (text or "").encode("utf-8", "surrogatepass")
        w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), NOT_ALNUM)
        words = [w.word(i) for i in range(len(w.start))]
        known.update(zip(words, w.h))
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            groups.setdefault(m, {}).setdefault(tuple(words[i : i + m]), set()).add(str(item))
    return [Patterns(m, np.array([[known[x] for x in p] for p in found], np.uint64), [list(p) for p in found], [np.array(sorted(s), object) for s in found.values()]) for m, found in sorted(groups.items())]


def scan(tables: list[Patterns], buf: np.ndarray, offsets: np.ndarray, earlier: pa.RecordBatch | None) -> dict:
    w = Words(buf, offsets, NOT_ALNUM)
    rows = len(offsets) - 1
    cover = np.zeros(len(w.start) + 1, np.int64)
    items: list[set] = [set() for _ in range(rows)]
    for t in tables:
        at, pattern = t.search(w)
        np.add.at(cover, at - t.length + 1, 1)
        np.add.at(cover, at + 1, -1)
        for r, p in zip(w.row[at], pattern):
            items[r].update(t.items[p])
    hit = np.cumsum(cover[:-1]) > 0
    if earlier is not None:
        for r, (seen, spans) in enumerate(zip(earlier.column("hit_items").to_pylist(), earlier.column("hit_spans").to_pylist())):
            if seen:
                items[r].update(seen)
                a, b = w.first[r], w.first[r + 1]
                begins = code_points(buf, int(offsets[r]), w.start[a:b])
                for s in spans:
                    hit[a + np.searchsorted(begins, s["start"]) : a + np.searchsorted(begins, s["end"])] = True
    sums = np.append(0, np.cumsum(hit))
    n_hit = sums[w.first[1:]] - sums[w.first[:-1]]
    spans: list[list] = []
    for r in range(rows):
        if not n_hit[r]:
            spans.append([])
            continue
        a, b = w.first[r], w.first[r + 1]
        edge = np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0])))
        begin, end = w.start[a:b][np.flatnonzero(edge == 1)], w.end[a:b][np.flatnonzero(edge == -1) - 1]
        spans.append([{"start": int(x), "end": int(y)} for x, y in zip(code_points(buf, int(offsets[r]), begin), code_points(buf, int(offsets[r]), end))])
    ids = [sorted(s) for s in items]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return {
        "n_words": w.counts.astype(np.int64),
        "n_hit": n_hit.astype(np.int64),
        "hit_items": lists([x for s in ids for x in s], np.append(0, np.cumsum([len(s) for s in ids])), pa.string()),
        "hit_spans": pa.array(spans, kind),
    }


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 8, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_words, n_hit, hit_items (sorted ids) and hit_spans (code points) of each row."""
    spark = documents.sparkSession
    bench = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_BYTES)) if total > BLOCK_BYTES else 1
    keep = list(documents.columns if keep is None else keep)
    out = documents.select(*(f"`{c}`" for c in dict.fromkeys([*keep, text])))
    names = [f.name for f in FIELDS]
    for b in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(compile_patterns([(r[0], r[1]) for r in part.toLocalIterator()], window))

        def work(batch, buf, offsets, sent=sent, first=b == 0):
            return scan(sent.value, buf, offsets, None if first else batch)

        if b:
            out = _again(out, text, work)
        else:
            out = map_texts(out, text, [c for c in dict.fromkeys([*keep, text]) if c not in names], FIELDS, work) if blocks > 1 or text in keep else map_texts(out, text, [c for c in keep if c not in names], FIELDS, work)
    return out.select(*(f"`{c}`" for c in keep if c not in names), *names)


def _again(out: DataFrame, text: str, work) -> DataFrame:
    """A further block: the spans and items so far travel with the row and are merged."""
    names = [f.name for f in FIELDS]
    carried = out.withColumnsRenamed({"hit_items": "__items", "hit_spans": "__spans"}).drop("n_words", "n_hit")

    def merged(batch, buf, offsets):
        view = pa.RecordBatch.from_arrays([batch.column("__items"), batch.column("__spans")], names=["hit_items", "hit_spans"])
        return work(view, buf, offsets)

    keep = [c for c in carried.columns if c not in names]
    return map_texts(carried, text, keep, FIELDS, merged).drop("__items", "__spans")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n = F.size("hit_items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(8, len(w)) AS m FROM bw WHERE len(w) > 0),
bp AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT item_id, w, least(8, len(w)) AS m, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
dp AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, m, item_id FROM dp JOIN bp USING (m, p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
