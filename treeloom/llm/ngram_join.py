"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct k-word shingles.  Each shingle flips one bit of a
sketch, so the Hamming distance of two sketches never exceeds the symmetric difference of
the sets.  For a size band whose smaller member has at most ``a`` shingles, a link at
Jaccard >= t leaves at most d = (1-t)/t * a differing shingles; a sketch of d+1+z words
then has at least z+1 equal words.  Documents are joined on equal words.  A
document with at most z empty words shares a non-empty one with every partner, so empty
words are keys only for documents with more.

Documents of equal sets are collapsed first.  Documents that share a key are never paired
with each other: they join the group of the key's first document, and a group is searched
in blocks of bounded size, where whole-set sketches discard pairs, exact intersections
verify the rest, and pairs already in one component are skipped.  Groups whose members a
first pass has not brought into one component are searched whole in a second pass.  Before
any text moves, the sketches alone sieve each group, so only documents with a possible
partner are read again.

Defined cases: null or empty text, or text without words, has an empty set and links with
nothing; fewer than k words form one shingle; rows that share an id are one vertex; a null
id links with nothing and has a null component; extra columns are ignored.
Sets hold 64-bit hashes of shingles, so sizes and overlaps err only on a hash collision
inside one pair of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm.kernel import SPACE, Words, byte_view, distinct, flat_texts, map_texts, mix, runs, shingles
from treeloom.operators.components import components, local_labels
from treeloom.operators.sift import sifted
from treeloom.runtime import Scratch, ship, spread

_U = np.uint64
#: Shingles in one block of a group: its sets take eight bytes each, its texts about as much.
BLOCK_SHINGLES = 1_500_000
#: Documents in one block of the sieve, which holds sketches only.
BLOCK_SKETCHES = 16_384
MOST_BITS = 16
PROFILE = [T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("sketch", T.BinaryType())]


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = Words(buf, offsets, SPACE)
    return distinct(*shingles(w, k), len(offsets) - 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def whole_sketches(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches of one to two bits a shingle, as 64-bit words with row bounds.

    Unrelated sets then differ in over a third as many bits as they have shingles, well over the
    bound.  Widths are powers of two; a sketch folds to half its width by XOR of its halves.
    """
    sizes = np.diff(first)
    bits = np.clip(np.ceil(np.log2(np.maximum(sizes, 64))), 6, MOST_BITS).astype(np.int64)
    words = np.left_shift(1, bits - 6)
    bound = np.append(0, np.cumsum(words))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(bound[-1], np.uint64)
    place = bound[:-1][row] + ((flat >> _U(6)) & (words[row] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(out, place, _U(1) << (flat & _U(63)))
    return out, bound


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one group as rows of the least width among them."""
    least = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), least), np.uint64)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint64)
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, least), axis=0)
    return out


def profile(batch, buf, offsets, k: int) -> dict:
    flat, first = shingle_sets(buf, offsets, k)
    words, bound = whole_sketches(flat, first)
    sketch = pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer((bound * 8).astype(np.int32)), pa.py_buffer(words)])
    return {"sketch": sketch, "n_shingles": np.diff(first).astype(np.int64), "set_a": _sums(mix(flat + _U(1)), first), "set_b": _sums(mix(flat ^ _U(0x5BD1E995)), first)}


class Bands:
    """Size bands, and for each the sketch words that its links must share."""

    def __init__(self, part: int, whole: int, largest: int = 1 << 40):
        self.part, self.whole = part, whole
        edge = [1]
        while edge[-1] < largest:
            edge.append(max(edge[-1] + 1, -(-edge[-1] * whole // part)))
        self.edge = np.array(edge)
        self.differ = (whole - part) * (self.edge[1:] - 1) // part
        self.spare = np.where(self.differ > 2, 2 + self.differ // 40, 1)
        self.words = self.differ + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, sizes, side="right") - 1


def keys(flat: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for every sketch word that a row is joined on; rows' hashes are sorted.

    A word has 2**64 bits of which each shingle flips one; it is held as the XOR of its
    shingles' hashes, which differs wherever the words do and is 0 for an empty word.
    """
    sizes = np.diff(first)
    band = bands.of(np.maximum(sizes, 1))
    out_rows, out_keys = [], []
    for back in (0, 1):
        tag = band - back
        use = (sizes > 0) & (tag >= 0)
        use &= bands.differ[np.maximum(tag, 0)] > 0
        rows = np.flatnonzero(use)
        if not len(rows):
            continue
        words = bands.words[tag[rows]]
        slot0 = np.concatenate(([0], np.cumsum(words)))
        at = np.repeat(np.arange(len(rows)), sizes[rows])
        h = flat[np.repeat(use, sizes)]
        slot = slot0[at] + (((h >> _U(32)) * words[at].astype(np.uint64)) >> _U(32)).astype(np.int64)
        turn = np.concatenate(([0], np.flatnonzero(np.diff(slot)) + 1))
        sketch = np.zeros(slot0[-1], np.uint64)
        sketch[slot[turn]] = np.bitwise_xor.reduceat(mix(h + _U(0x51)), turn)
        owner = np.repeat(np.arange(len(rows)), words)
        index = np.arange(len(owner)) - slot0[owner]
        empty = sketch == 0
        many = np.bincount(owner[empty], minlength=len(rows)) > bands.spare[tag[rows]]
        on = ~empty | many[owner]
        owner, index, sketch = owner[on], index[on], sketch[on]
        place = (tag[rows][owner].astype(np.uint64) << _U(40)) + index.astype(np.uint64)
        out_rows.append(rows[owner])
        out_keys.append(mix(mix(place + _U(0x1000003)) ^ sketch))
    if not out_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out_keys)


def _stars(batches):
    """Sorted (key, doc) rows to distinct (leader, doc); the leader is a key's first document."""
    last_key, leader = None, 0
    for batch in batches:
        key, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if last_key is not None and key[0] == last_key:
            new[0] = False
        where = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lead = np.where(where >= 0, doc[np.maximum(where, 0)], leader)
        last_key, leader = key[-1], lead[-1]
        own = lead != doc
        if own.any():
            pair = np.unique(np.stack([lead[own], doc[own]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["leader", "doc"])


def sieve_block(docs: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, query: np.ndarray, leader: np.int64, part: int, whole: int) -> np.ndarray:
    """True for rows that some other row may link to, by size and Hamming distance.

    Rows are first held against the leader; ``query`` rows without a partner there are held against all.
    """
    passed = np.zeros(len(docs), bool)

    def against(y: int) -> None:
        at = np.flatnonzero((np.minimum(sizes, sizes[y]) * whole >= np.maximum(sizes, sizes[y]) * part) & (docs != docs[y]))
        apart = np.bitwise_count(sketch[at] ^ sketch[y]).sum(1, dtype=np.int64)
        at = at[apart <= (whole - part) * (sizes[at] + sizes[y]) // (whole + part)]
        if len(at):
            passed[at] = True
            passed[y] = True

    for y in np.flatnonzero(docs == leader):
        against(y)
    for y in np.flatnonzero(query):
        if not passed[y]:
            against(y)
    return passed


def sieve_apart(docs: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, query: np.ndarray, known: np.ndarray, part: int, whole: int) -> np.ndarray:
    """True for rows of which one may link a ``query`` row to a row of another component, both ends of the link."""
    passed = np.zeros(len(docs), bool)
    for y in np.flatnonzero(query):
        at = np.flatnonzero((known != known[y]) & (np.minimum(sizes, sizes[y]) * whole >= np.maximum(sizes, sizes[y]) * part))
        apart = np.bitwise_count(sketch[at] ^ sketch[y]).sum(1, dtype=np.int64)
        at = at[apart <= (whole - part) * (sizes[at] + sizes[y]) // (whole + part)]
        if len(at):
            passed[at] = True
            passed[y] = True
    return passed


def _sieve_apart(part: int, whole: int):
    def run(batches):
        for group in runs(batches, ["leader", "block"]):
            docs = group.column("doc").to_numpy()
            query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
            passed = sieve_apart(docs, group.column("n").to_numpy(), folded(group.column("sketch").to_pylist()), query, group.column("known").to_numpy(), part, whole)
            if passed.any():
                yield pa.RecordBatch.from_arrays([pa.array(group.column("leader").to_numpy()[passed]), pa.array(docs[passed])], names=["leader", "doc"])

    return run


def _sieve(part: int, whole: int):
    def run(batches):
        for group in runs(batches, ["leader", "block"]):
            docs, leader = group.column("doc").to_numpy(), group.column("leader").to_numpy()
            query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
            passed = sieve_block(docs, group.column("n").to_numpy(), folded(group.column("sketch").to_pylist()), query, leader[0], part, whole)
            yield pa.RecordBatch.from_arrays([pa.array(leader), group.column("block").combine_chunks(), pa.array(docs), pa.array(passed)], names=["leader", "block", "doc", "passed"])

    return run


def survivors(star: DataFrame, sketches: DataFrame, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """The (leader, doc) rows of ``star`` whose documents have a possible partner in the leader's group."""

    def sieved(members: DataFrame) -> DataFrame:
        rows = members.join(sketches, "doc").select("leader", "block", "query", "doc", "n", "sketch")
        return rows.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(_sieve(part, whole), "leader long, block int, doc long, passed boolean")

    load = star.groupBy("leader").agg(F.ceil(F.count("*") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    large = scratch.cut(load.where("blocks > 1"))
    whole_groups = large.isEmpty()
    if whole_groups:
        dealt = star.union(star.select("leader", F.col("leader").alias("doc")).distinct()).select("leader", F.lit(0).alias("block"), "doc")
    else:
        own = load.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("doc"))
        dealt = star.join(load, "leader").select("leader", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc").union(own)
    first = scratch.cut(sieved(dealt.withColumn("query", F.lit(True))))
    passed = first.where("passed").select("leader", "doc")
    if not whole_groups:
        # documents without a partner in their own block are asked of every block
        lone = first.where("not passed").join(large, "leader").where("doc <> leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc", F.lit(True).alias("query"))
        rest = first.join(large.select("leader"), "leader", "left_semi").where("passed").select("leader", "block", "doc", F.lit(False).alias("query"))
        passed = passed.union(sieved(rest.union(lone)).where("passed").select("leader", "doc"))
    out = scratch.cut(passed.where("leader <> doc").distinct())
    scratch.drop(first, large)
    return out


def unsettled(rest: DataFrame, sketches: DataFrame, part: int, whole: int, scratch: Scratch) -> DataFrame:
    """The (leader, doc, c, l) rows of ``rest`` that may take part in a link between two components.

    Documents outside their leader's component are held by sketch against all of the group, so that
    the second search moves only texts that it can need.
    """
    lead = rest.select("leader", F.col("leader").alias("doc"), F.col("l").alias("known"), F.lit(False).alias("query")).distinct()
    members = rest.select("leader", "doc", F.col("c").alias("known"), (F.col("c") != F.col("l")).alias("query")).union(lead)
    load = rest.groupBy("leader").agg(F.ceil((F.count("*") + 1) / BLOCK_SKETCHES).cast("int").alias("blocks"))
    at = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    places = F.when(F.col("query"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(at))
    dealt = members.join(load, "leader").select("leader", F.explode(places).alias("block"), "doc", "known", "query")
    rows = dealt.join(sketches, "doc").select("leader", "block", "query", "known", "doc", "n", "sketch")
    found = rows.repartition("leader", "block").sortWithinPartitions("leader", "block").mapInArrow(_sieve_apart(part, whole), "leader long, doc long")
    return scratch.cut(rest.join(found.distinct(), ["leader", "doc"], "left_semi"))


def search_block(ids: np.ndarray, known: np.ndarray, flat: np.ndarray, first: np.ndarray, query: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all linked rows of a block.

    ``known`` holds components found before; ``query`` marks rows that are tested against the others.
    """
    sizes = np.diff(first)
    m = len(ids)
    words, bound = whole_sketches(flat, first)
    sketch = folded([words[bound[i] : bound[i + 1]].tobytes() for i in range(m)])
    comp = np.unique(known, return_inverse=True)[1]
    edges = []
    for y in np.flatnonzero(query & (sizes > 0)):
        other = comp != comp[y]
        other &= ~query | (np.arange(m) > y)
        other &= (np.minimum(sizes, sizes[y]) * whole >= np.maximum(sizes, sizes[y]) * part) & (sizes > 0)
        at = np.flatnonzero(other)
        if not len(at):
            continue
        bound = (whole - part) * (sizes[at] + sizes[y]) // (whole + part)
        apart = np.bitwise_count(sketch[at] ^ sketch[y]).sum(1, dtype=np.int64)
        near = apart <= bound
        at = at[near][np.argsort(apart[near], kind="stable")]
        own = flat[first[y] : first[y + 1]]
        for j in at:
            if comp[j] == comp[y]:
                continue
            his = flat[first[j] : first[j + 1]]
            spot = np.searchsorted(own, his)
            spot[spot == len(own)] = 0
            same = int((own[spot] == his).sum())
            if whole * same >= part * (len(own) + len(his) - same):
                edges.append((ids[y], ids[j]))
                comp[comp == comp[j]] = comp[y]
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _blocks(k: int, part: int, whole: int):
    def run(batches):
        for group in runs(batches, ["leader", "block"]):
            docs = group.column("doc").to_numpy()
            buf, offsets = byte_view(group.column("text"))
            flats, firsts, at = [], [np.zeros(1, np.int64)], 0
            while at < len(docs):  # word tables of a block are made a slice at a time
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (1 << 20), side="right")) - 1)
                f, first = shingle_sets(buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], k)
                firsts.append(first[1:] + firsts[-1][-1])
                flats.append(f)
                at = to
            query = group.column("query").to_numpy(zero_copy_only=False).astype(bool)
            src, dst = search_block(docs, group.column("known").to_numpy(), np.concatenate(flats), np.concatenate(firsts), query, part, whole)
            own = src != dst
            if own.any():
                ids, root = local_labels(src[own], dst[own])
                far = ids != root
                yield pa.RecordBatch.from_arrays([pa.array(root[far]), pa.array(ids[far])], names=["src", "dst"])

    return run


def _search(members: DataFrame, texts: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Edges from (leader, block, doc, known, query) rows."""
    rows = members.join(texts, "doc").select("leader", "block", "query", "doc", "known", "text")
    return rows.repartition("leader", "block").sortWithinPartitions("leader", "block", F.desc("query")).mapInArrow(_blocks(k, part, whole), "src long, dst long")


def _blocked(star: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members and leader of each group, dealt into blocks of bounded total size; a leader is in each block."""
    star = star.join(sizes, "doc")
    load = star.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = star.join(load, "leader").select("leader", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block"), "doc")
    own = load.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("doc"))
    return dealt.union(own)


def classes(documents: DataFrame, text: str = "text", doc: str = "doc_id", k: int = 4, part: int = 85, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of links with Jaccard >= part / whole."""
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    docs = documents.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    facts = map_texts(docs, "text", ["doc"], PROFILE, lambda batch, buf, offsets: profile(batch, buf, offsets, k))
    facts = scratch.cut(facts)
    sets = ["n_shingles", "set_a", "set_b"]
    linked = F.expr("n_shingles > 0 and doc is not null")
    # a table of its own: the join below then has two plain sides, and a set with many copies is split over tasks
    first = scratch.cut(facts.where(linked).groupBy(*sets).agg(F.min("doc").alias("rep")))
    with_rep = facts.where(linked).join(first, sets).select("doc", "n_shingles", "rep", F.expr("case when doc = rep then sketch end").alias("sketch"))
    alone = facts.where(~F.coalesce(linked, F.lit(False))).select("doc", "n_shingles", F.lit(None).cast("long").alias("rep"), F.lit(None).cast(facts.schema["sketch"].dataType).alias("sketch"))
    mapped = scratch.cut(with_rep.unionByName(alone))
    scratch.drop(facts, first)
    sizes = mapped.where("doc = rep").groupBy("doc").agg(F.max("n_shingles").alias("n"))
    sketches = mapped.where("doc = rep").select("doc", F.col("n_shingles").alias("n"), "sketch").distinct()
    bands = Bands(part, whole)

    def keyed(batch, buf, offsets):
        row, key = keys(*shingle_sets(buf, offsets, k), bands)
        return [key.view(np.int64), batch.column("doc").to_numpy()[row]]

    only = docs.join(sizes.where(F.col("n") * (whole - part) >= part).select("doc"), "doc", "left_semi")
    found = flat_texts(only, "text", "key long, doc long", keyed)
    star = scratch.cut(found.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_stars, "leader long, doc long").distinct())
    scratch.release()
    all_stars, star = star, survivors(star, sketches, part, whole, scratch)
    scratch.drop(all_stars)
    scratch.release()
    wanted = scratch.cut(star.select("doc").union(star.select("leader")).distinct())
    texts = scratch.cut(sifted(docs, "doc", wanted).where("__near").drop("__near").join(wanted, "doc", "left_semi"))
    scratch.release()
    nearest = star.groupBy("doc").agg(F.min("leader").alias("leader"))
    once = _blocked(nearest, sizes).select("*", F.col("doc").alias("known"), F.lit(True).alias("query"))
    # rows that share an id are one vertex: what their texts stand for is linked
    twice = mapped.where("rep is not null").groupBy("doc").agg(F.min("rep").alias("src"), F.max("rep").alias("top"), F.count("*").alias("rows")).where("src <> top").select("doc", "src")
    twice = mapped.join(twice, "doc").select("src", F.col("rep").alias("dst"))
    a = scratch.cut(_search(once, texts, k, part, whole).union(twice))
    scratch.release()
    label = components(a, scratch)
    named = lambda column, out: label.select(F.col("id").alias(column), F.col("component").alias(out))
    both = star.join(named("doc", "c"), "doc", "left").join(named("leader", "l"), "leader", "left")
    both = both.select("leader", "doc", F.coalesce("c", "doc").alias("c"), F.coalesce("l", "leader").alias("l"))
    apart = both.where("c <> l").select("leader").distinct()
    rest = scratch.cut(both.join(apart, "leader", "left_semi"))
    if not rest.isEmpty():
        settled, rest = rest, unsettled(rest, sketches, part, whole, scratch)
        scratch.drop(settled)
        scratch.release()
    if not rest.isEmpty():
        dealt = _blocked(rest.select("leader", "doc"), sizes)
        tops = dealt.groupBy("leader").agg(F.max("block").alias("top"))
        asked = rest.where("c <> l").join(tops, "leader").select("leader", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("block"), "doc", F.lit(True).alias("query"))
        members = dealt.withColumn("query", F.lit(False)).union(asked).groupBy("leader", "block", "doc").agg(F.max("query").alias("query"))
        members = members.join(named("doc", "c"), "doc", "left").select("leader", "block", "doc", F.coalesce("c", "doc").alias("known"), "query")
        b = scratch.cut(_search(members, texts, k, part, whole))
        scratch.release()
        if not b.isEmpty():
            scratch.drop(label)
            label = components(a.union(b), scratch)
        scratch.drop(b)
    scratch.drop(a, star, rest, texts, wanted)
    out = mapped.join(named("rep", "component"), "rep", "left")
    at = F.when(F.col("doc").isNotNull(), F.coalesce("component", "rep", "doc"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", at.alias("component_id"))


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return classes(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP4_SQL = r"""
WITH RECURSIVE dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, least(4, len(w)) AS m, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sz AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
sym AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, s.y FROM reach r JOIN sym s ON r.y = s.x),
comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sz USING (doc_id) LEFT JOIN comp ON comp.x = d.doc_id
"""
