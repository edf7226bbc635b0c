"""Operators read all of what they say they read."""

import zlib

import numpy as np
import pyarrow as pa

from treeloom.llm import lm_scoring
from treeloom.runtime import Scratch, ship


def test_lm_learns_from_every_training_text(spark):
    """Ids of a long text and of many short ones are counted, and tables are those of one process."""
    docs = [(1, "zebra quagga " * 2000)] + [(i, f"common words number {i % 7}") for i in range(2, 1003)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    ship(spark)
    scratch = Scratch(spark)
    ranks = lm_scoring.read_ranks(lm_scoring.VOCABULARY)
    end = len(ranks)
    rows = docs.selectExpr("doc_id", "text", "false held_out", "true trains")
    schema = "piece long, ids array<long>, held array<boolean>, vocabulary binary, counts binary, tokens binary, first binary, flat binary, sizes binary, entries long, trained long"
    pieces = scratch.cut(rows.mapInArrow(lm_scoring._pieces(spark.sparkContext.broadcast(ranks)), schema))
    model = lm_scoring.fitted(*lm_scoring.learn(pieces, scratch, end, shard_windows=200))
    encode = lm_scoring.encoder(ranks)._core_bpe.encode_ordinary
    texts = [[x for w in r.text.lower().split() for x in encode(" " + w)] for r in docs.collect()]
    ids = np.array([x for t in texts for x in [*t, end]])
    class_of, inside, row_of, _ = lm_scoring.layout(np.bincount(ids, minlength=end + 1))
    assert (model.class_of == class_of).all() and np.allclose(model.inside, inside)
    one = lm_scoring.train(texts, end, end + 1, epochs=1)
    assert (model.pairs == one.pairs).all() and len(one.pairs) > 10
    assert np.allclose(model.p["ng"].astype(int), one.p["ng"].astype(int), atol=1) and np.allclose(model.p["nc"].astype(int), one.p["nc"].astype(int), atol=1)


def test_lm_windows_come_from_the_whole_of_a_text():
    ids = np.arange(1, 1001)
    seen = np.zeros(1001, bool)
    for phase in range(lm_scoring.STRIDE):
        text, cut = lm_scoring.cut_windows(ids, np.array([0]), np.array([1000]), np.array([phase]), 0)
        assert (text == 0).all()
        for row in cut:
            lead, left = row[-2:]
            targets = row[lm_scoring.CONTEXT : lm_scoring.CONTEXT + left]
            assert not seen[targets].any() and (np.diff(row[lm_scoring.CONTEXT - lead : lm_scoring.CONTEXT + left]) == 1).all()
            seen[targets] = True
    assert seen[1:].all()


def test_lm_beats_the_unigram_base_on_held_out_texts(spark):
    """Two languages of words that follow each other: what came before tells what comes next."""
    r = np.random.default_rng(5)
    chains = [[f"{a}{b}" for a in "kmpt" for b in ("ala", "oro", "ini")], [f"{a}{b}" for a in "bdgz" for b in ("uck", "esh", "arm")]]
    docs = []
    for i in range(600):
        words = chains[i % 2]
        docs.append((i, " ".join(words[int(x)] for x in r.integers(0, len(words), 60))))
    got = lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert set(held.index) == {i for i in range(600) if zlib.crc32(str(i).encode()) % 10 == 0}
    assert (held.n_known == held.n_tokens).all()
    assert (held.score / held.n_tokens).mean() > (held.base_score / held.n_tokens).mean() + 0.2


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = [(i, f"some words {i % 5} and {'more ' * (i % 11)} here") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    one = lm_scoring.score(frame.coalesce(1)).toPandas().set_index("doc_id").sort_index()
    many = lm_scoring.score(frame.repartition(7)).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(one.score, many.score, rtol=1e-5) and np.allclose(one.base_score, many.base_score, rtol=1e-9)


def test_lm_fits_every_window_of_every_training_text(spark, monkeypatch):
    """Each id of each training text is a target once, in one process and dealt over turns and shards."""
    fitted = []
    monkeypatch.setattr(lm_scoring, "fit", lambda p, cut, *rest: fitted.append(cut))
    r = np.random.default_rng(4)
    lm_scoring.train([r.integers(0, 50, n).tolist() for n in (0, 3, 8, 40, 1000)], 60, 61, epochs=1)
    assert sum(int(cut[:, -1].sum()) for cut in fitted) == 1051 + 5

    end, rounds, shards = 60, 4, 3
    texts = [r.integers(0, 60, n).tolist() for n in (0, 1, 7, 8, 9, 300, 9000)]
    words, bound = np.concatenate(texts).astype(np.uint16), np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
    held = [i == 5 for i in range(len(texts))]
    cell = lambda x: pa.array([x.tobytes()], pa.binary())
    piece = pa.RecordBatch.from_arrays([pa.array([list(range(len(texts)))]), pa.array([held]), cell(words), cell(bound), cell(np.arange(60, dtype=np.uint16)), cell(np.ones(60, np.uint32))], names=["ids", *lm_scoring.PIECE_CELLS])
    targets = {i: [] for i in range(len(texts))}
    dealt = set()
    for turn in range(rounds):
        for batch in lm_scoring._runs_of_ids(end, shards, turn, rounds)([piece]):
            for row in batch.to_pylist():
                dealt.add((turn, row["shard"]))
                for w in lm_scoring.row_windows([row["data"]], [row["number"]], end).astype(int):
                    lead, left = w[-2:]
                    targets[row["doc_id"]].append((row["number"], w[lm_scoring.CONTEXT - lead : lm_scoring.CONTEXT + left].tolist(), int(lead)))
    for i, text in enumerate(texts):
        found = sorted(targets[i], key=lambda x: x[0])
        whole = [*text, end]
        assert [x for _, ids, lead in found for x in ids[lead:]] == ([] if held[i] else whole)
        at = 0
        for _, ids, lead in found:
            assert lead == min(at, lm_scoring.CONTEXT) and ids[:lead] == whole[at - lead : at]
            at += len(ids) - lead
    assert len(dealt) > 1


def test_lm_encodes_a_word_of_several_pieces_once(spark, monkeypatch):
    """A task's pieces share many words; each goes through the byte pairs once, and texts keep the ids they have on their own."""
    seen = []
    encoded = lm_scoring.subwords
    monkeypatch.setattr(lm_scoring, "subwords", lambda words, *rest: seen.extend(words) or encoded(words, *rest))
    monkeypatch.setattr(lm_scoring, "PIECE_BYTES", 2000)
    ranks = lm_scoring.read_ranks(lm_scoring.VOCABULARY)
    texts = [" ".join(f"Word{(i * j) % 97} été{j % 5} common" for j in range(i % 40)) for i in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts), pa.array([i % 10 == 0 for i in range(200)]), pa.array([i % 10 != 0 for i in range(200)])], names=["doc_id", "text", "held_out", "trains"])
    encode = lm_scoring.encoder(ranks)._core_bpe.encode_ordinary
    low = lambda t: t.encode().lower().split()  # noqa: E731  A-Z alone
    want = [[x for w in low(t) for x in encode(" " + w.decode())] + [len(ranks)] for t in texts]

    class Sent:
        value = ranks

    def read():
        out = []
        pieces = list(lm_scoring._pieces(Sent)([rows]))
        for piece in pieces:
            for _, ids, begins, many, _ in lm_scoring._training_ids(piece, len(ranks)):
                out += [ids[a : a + n].tolist() for a, n in zip(begins, many)]
        return len(pieces), out

    pieces, got = read()
    assert pieces > 5 and got == want
    assert sorted(seen) == sorted({w for t in texts for w in low(t)})
    monkeypatch.setattr(lm_scoring, "MET", 50)
    assert read()[1] == want


def test_lm_steps_go_down_the_slope():
    """The first step of Adam moves each weight against the slope of the loss, which small changes of the weight give."""
    r = np.random.default_rng(6)
    texts = [r.integers(0, 50, n).tolist() for n in (3, 40, 200, 500)]
    model = lm_scoring.train(texts, 60, 61, epochs=0)
    ids = np.array([x for t in texts for x in [*t, 60]])
    many = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(many) - many
    cut = lm_scoring.cut_windows(ids, begins, many, np.zeros(len(many), np.int64), 60)[1]

    def loss(p):
        own = lm_scoring.Model(60, model.class_of, model.inside, model.row_of, model.pairs, p)
        return -own.log10(ids, np.repeat(begins, many)).sum()

    moved = {k: v.copy() for k, v in model.p.items()}
    lm_scoring.fit(moved, cut, model.row_of, model.class_of, model.rows_of_pairs, int(model.row_of[60]), 0.001, 3)
    assert loss(moved) < loss(model.p)
    for key in lm_scoring.FITTED:
        slopes = []
        for at in r.choice(np.flatnonzero(moved[key] != model.p[key]), 20):
            near = []
            for by in (-0.05, 0.05):
                p = {k: v.copy() for k, v in model.p.items()}
                p[key].reshape(-1)[at] += np.float32(by)
                near.append(loss(p))
            slopes.append((near[1] - near[0], (moved[key] - model.p[key]).reshape(-1)[at]))
        slopes.sort(key=lambda x: -abs(x[0]))
        assert all(slope * step < 0 for slope, step in slopes[:5]), key


def test_lm_large_exponents_stay_finite():
    """Where the weights are so large that exponents could leave single precision, they are clipped."""
    r = np.random.default_rng(7)
    model = lm_scoring.train([r.integers(0, 50, 40).tolist() for _ in range(20)], 60, 61, epochs=1)
    for key in ("q", "ug", "uc"):
        model.p[key] = model.p[key] * np.float32(1e4)
    ids = np.append(r.integers(0, 50, 37), 60)
    assert np.isfinite(model.log10(ids, np.zeros(len(ids), np.int64))).all() and model.tables.far


def test_a_text_is_spelled_out_in_its_own_turns_alone(monkeypatch):
    r = np.random.default_rng(11)
    end, rounds = 60, 4
    texts = [r.integers(0, 60, n).tolist() for n in [0, 1, *r.integers(2, 300, 200)]]
    words, bound = np.concatenate(texts).astype(np.uint16), np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
    cell = lambda x: pa.array([x.tobytes()], pa.binary())
    piece = pa.RecordBatch.from_arrays([pa.array([list(range(len(texts)))]), pa.array([[False] * len(texts)]), cell(words), cell(bound), cell(np.arange(60, dtype=np.uint16)), cell(np.ones(60, np.uint32))], names=["ids", *lm_scoring.PIECE_CELLS])
    blocks, spelled = lm_scoring.id_blocks, []

    def counted(*args):
        for block in blocks(*args):
            spelled.append(len(block[1]))
            yield block

    monkeypatch.setattr(lm_scoring, "id_blocks", counted)
    rows = [(turn, row["doc_id"], row["data"]) for turn in range(rounds) for batch in lm_scoring._runs_of_ids(end, 3, turn, rounds)([piece]) for row in batch.to_pylist()]
    assert sorted((doc, np.frombuffer(data, np.uint16).tolist()) for _, doc, data in rows) == [(i, [*t, end]) for i, t in enumerate(texts)]
    assert len({turn for turn, *_ in rows}) == rounds
    assert sum(spelled) == sum(len(t) + 1 for t in texts)  # before: once a turn


def test_distinct_hashes_as_numpy_finds_them():
    for h in (np.zeros(0, np.uint64), np.random.default_rng(2).integers(0, 50, 400).astype(np.uint64) << np.uint64(57)):
        values, place, at = lm_scoring.distinct(h)
        want, back = np.unique(h, return_inverse=True)
        assert (values == want).all() and (h[place] == want).all() and (at == back).all()


def test_lm_deals_all_turns_in_one_pass_over_the_pieces():
    """Rows of all turns together, each with its turn, are those of the turns one by one; the pieces are read once."""
    r = np.random.default_rng(12)
    end, rounds = 60, 4
    texts = [r.integers(0, 60, n).tolist() for n in [0, 1, 9000, *r.integers(2, 300, 100)]]
    words, bound = np.concatenate(texts).astype(np.uint16), np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
    cell = lambda x: pa.array([x.tobytes()], pa.binary())
    piece = pa.RecordBatch.from_arrays([pa.array([list(range(len(texts)))]), pa.array([[i % 7 == 3 for i in range(len(texts))]]), cell(words), cell(bound), cell(np.arange(60, dtype=np.uint16)), cell(np.ones(60, np.uint32))], names=["ids", *lm_scoring.PIECE_CELLS])
    deal = lambda turn: [row for batch in lm_scoring._runs_of_ids(end, 3, turn, rounds)([piece]) for row in batch.to_pylist()]
    order = lambda rows: sorted(rows, key=lambda x: (x["turn"], x["doc_id"], x["number"]))
    one_by_one = [row | {"turn": turn} for turn in range(rounds) for row in deal(turn)]
    assert order(deal(None)) == order(one_by_one) and len({row["turn"] for row in one_by_one}) == rounds


def test_lm_learning_reads_the_pieces_once_for_all_turns(spark, monkeypatch):
    """A turn's ids come from a table cut by turn, which is gone at the end."""
    asked, made, runs = [], [], lm_scoring._runs_of_ids
    monkeypatch.setattr(lm_scoring, "_runs_of_ids", lambda end, shards, turn, rounds: asked.append(turn) or runs(end, shards, turn, rounds))

    class Kept(lm_scoring.Scratch):
        def cut(self, df, *by):
            out = super().cut(df, *by)
            made.extend((out, by) for _ in by[:1])
            return out

    monkeypatch.setattr(lm_scoring, "Scratch", Kept)
    docs = [(i, f"some words {i % 5} and {'more ' * (i % 11)} here") for i in range(60)]
    assert lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string")).count() == 60
    assert asked == [None]  # before: one pass for each turn
    (frame, by), *more = made
    assert by == ("turn",) and not more
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def test_lm_scores_of_short_and_long_texts_are_those_of_each_alone():
    """Windows at the edges of texts see their own text alone, wherever it lies; whole windows have no mask."""
    r = np.random.default_rng(13)
    model = lm_scoring.train([r.integers(0, 50, n).tolist() for n in (3, 40, 200, 500)], 60, 61, epochs=1)
    many = np.array([1, 7, 8, 9, 15, 16, 17, 24, 90])
    texts = [np.append(r.integers(0, 50, n - 1), 60) for n in many]
    begins = np.cumsum(many) - many
    together = model.log10(np.concatenate(texts), np.repeat(begins, many))
    alone = [model.log10(t, np.zeros(len(t), np.int64)) for t in texts]
    assert np.allclose(together, np.concatenate(alone), rtol=1e-5)
    whole = texts[-1]
    for cut in (5, 8, 33):  # nothing behind a position counts
        assert np.allclose(model.log10(whole[:cut], np.zeros(cut, np.int64)), alone[-1][:cut], rtol=1e-5)
