import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import recurrent_lm as r
from tidemark.session import materialize


def network(n=12, end=3):
    return r.GatedNetwork(np.linspace(50, 2, n), 30.0, end, seed=4)


def documents(rng, n, most, size=12, end=3):
    return [np.array([*(int(x) for x in rng.integers(0, size + 1, rng.integers(0, most)) if x != end), end], np.int32) for _ in range(n)]


def slow_score(net, doc):
    """One document alone, token by token, from the definitions."""
    table, h, total = net.table(), np.zeros((1, r.HIDDEN), np.float32), 0.0
    for token in doc:
        logits = (h @ net.p["class"] + net.p["class_bias"])[0].astype(float)
        k = net.class_of[token]
        total += logits[k] - np.log(np.exp(logits).sum())
        a, b = net.starts[k], net.starts[k + 1]
        inner = (h @ net.p["word"] + net.p["word_bias"])[0, a:b].astype(float)
        total += inner[token - a] - np.log(np.exp(inner).sum())
        h, _ = net.step(h, table[[token]])
    return total / np.log(10)


def test_state_is_carried_over_windows_and_lanes_do_not_mix():
    rng = np.random.default_rng(0)
    net, docs = network(), documents(rng, 40, 90)
    for v in net.p.values():
        v += rng.standard_normal(v.shape).astype(np.float32) * 0.3
    wanted = [slow_score(net, d) for d in docs]
    for lanes, window in ((1, 1000), (3, 7), (1024, 64)):
        assert net.score(docs, lanes, window) == pytest.approx(wanted, rel=1e-4)
    assert len(net.score([])) == 0


def test_probabilities_add_up():
    net = network()
    h = np.random.default_rng(1).standard_normal((1, r.HIDDEN)).astype(np.float32)
    logs = [net.log_probability(h, np.array([k]))[0] for k in range(net.n + 1)]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)


def test_gradient():
    rng = np.random.default_rng(2)
    net = network()
    net.p = {k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float64) for k, v in net.p.items()}
    ids, on, _ = r.pack(documents(rng, 5, 6), 2, net.end)
    start = np.zeros((ids.shape[1], r.HIDDEN))
    _, gradient = net._window(start, ids, on)

    def loss():
        h, total, table = start, 0.0, net.table()
        for step, live in zip(ids, on):
            total -= net.log_probability(h, step)[live].sum()
            h, _ = net.step(h, table[step])
            h = np.where((step == net.end)[:, None], 0, h)
        return total / on.sum()

    for name, values in net.p.items():
        flat = values.reshape(-1)
        for k in rng.integers(0, len(flat), 4):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert gradient[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6), name


def test_training_learns_what_follows_what():
    docs = [np.array([0, 1, 2] * 8 + [3], np.int32)] * 60
    net = network()
    before = net.score(docs[:1])[0]
    net.train(docs, epochs=6, lanes=4)
    assert net.score(docs[:1])[0] > before / 2


def test_scores(spark, edge):
    df, rows, empty = edge
    held = lambda i: i % 5 == 1
    train = df.filter("doc_id % 5 <> 1")
    counts = materialize(r.token_counts(train), "counts")
    model = r.fit(train, counts)
    n, wanted = brute.unigram_scores(rows, held)
    assert model.known.total == n
    found = {x.doc_id: x for x in r.scored(df, model, counts).collect()}
    for id_, (tokens, known, base) in wanted.items():
        assert (found[id_].n_tokens, found[id_].n_known) == (tokens, known)
        assert found[id_].base_score == pytest.approx(base)
        assert found[id_].score < 0
    assert r.scored(empty, model, counts).count() == 0
    assert r.scored(df.union(df), model, counts).count() == 2 * len(rows)


def test_rare_words_are_joined(spark, edge):
    """With a table of three frequent words all others take the way over the join, to the same score."""
    df, rows, _ = edge
    counts = materialize(r.token_counts(df), "counts")
    model = r.fit(df, counts)
    few = r.unigrams(counts, frequent=3)
    assert len(few.words) == 3
    wanted = {x.doc_id: x for x in r.scored(df, model, counts).collect()}
    network, model.known, model.network = model.network, few, None
    for x in r.scored(df, model, counts).collect():
        assert x.base_score == pytest.approx(wanted[x.doc_id].base_score)
        assert (x.n_tokens, x.n_known) == (wanted[x.doc_id].n_tokens, wanted[x.doc_id].n_known)
    assert network is not None


def test_no_training_rows(spark, edge):
    df, rows, empty = edge
    counts = materialize(r.token_counts(empty), "counts")
    model = r.fit(empty, counts)
    assert model.network is None and model.known.total == 0
    found = r.scored(df, model, counts).collect()
    assert len(found) == len(rows)
    assert all(x.n_known == 0 and x.score == x.base_score == 0 for x in found)


def test_every_training_row_trains_the_network(spark, monkeypatch):
    """Without the sample, what follows what is learnt from the rows on Spark alone."""
    monkeypatch.setattr(r, "sample_documents", lambda *a: [])
    monkeypatch.setattr(r, "ROUND_RATE", 0.02)
    rows = [(k, "one two three " * (40 + k % 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    counts = materialize(r.token_counts(df), "counts")
    model = r.fit(df, counts)
    found = r.scored(df.limit(50), model, counts).selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert found.s > found.b * 0.8


def test_copies_are_averaged_by_tokens():
    import pyarrow as pa

    parts = [np.array([1, 2], np.float32), np.array([4, 8], np.float32)]
    batch = pa.record_batch(
        [pa.array([5, 5], pa.int32()), pa.array([1, 2], pa.int64()), pa.array([p.tobytes() for p in parts])], names=["block", "n", "part"]
    )
    (found,) = r._averaged(iter([batch]))
    assert np.frombuffer(found.column(1)[0].as_py(), np.float32).tolist() == [3, 6]


def test_memory_follows_tokens_beside_a_long_document():
    import tracemalloc

    net = network()
    docs = [np.array([0, 3], np.int32)] * 1023 + [np.array([0, 1, 2] * 20_000 + [3], np.int32)]
    tracemalloc.start()
    found = net.score(docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[-1] < found[0] < 0
    assert most < 60 << 20  # a grid of 60,001 steps and 1,024 lanes takes over 500 MB


def test_a_long_document_is_learnt_in_pieces_of_all_lanes():
    rng = np.random.default_rng(6)
    docs = [np.array([*rng.integers(0, 3, 20 if k else 9000), 3], np.int32) for k in range(400)]
    cut = r.pieces(docs, 64, 3)
    assert max(map(len, cut)) <= 1 + r.BEHIND + max(r.LEAST_PIECE, -(-sum(map(len, docs)) // 64))
    assert np.concatenate([c[c >= 0] for c in cut]).tolist() == np.concatenate(docs).tolist()
    assert (~cut[1][: r.BEHIND]).tolist() == cut[0][cut[0] >= 0][-r.BEHIND :].tolist() and cut[0][-1] == ~3
    net = network()
    adam = r.Adam(net.p)
    net.learn(docs, adam, 64, 24, 0.01)
    assert adam.steps < 20  # the lane of the long one alone has 376 windows


def test_words_of_a_batch():
    import pyarrow as pa

    texts = ["", "  A b\x0b\x0cC\x1c \u00c9A\u2003x ", " ", "z", "\r\n\tq"]
    words, owners = r.batch_tokens(pa.array(texts))
    assert [w.encode() for w in words.to_pylist()] == [w for t in texts for w in r.tokens(t)]
    assert owners.tolist() == [k for k, t in enumerate(texts) for _ in r.tokens(t)]
    found = pa.array([None if k % 2 else k for k in range(len(words))], pa.int32())
    ids, bounds = r.batch_ids(found, owners, len(texts), 77, -1)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[77], [0, -1, 2, -1, 77], [77], [4, 77], [-1, 77]]
