"""Language ID and the hidden Markov model."""

import tracemalloc
import itertools
import math

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import hmm, langid
from stratalog.llm.common import words

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_languages_held_out(spark, docs):
    train = docs.where("doc_id % 2 = 0")
    model = langid.train(train, rows_per_language=60)
    got = langid.identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([x.language == x.lang for x in got]) > 0.97 and np.mean([x.accepted for x in got]) > 0.98
    assert (model.weights == 0).mean() > 0.5 and 0.05 < model.temperature < 20
    sure = [x for x in got if x.confidence > 0.9]
    assert np.mean([x.language == x.lang for x in sure]) > 0.98


def brute_ftrl(rows, y, classes, buckets, alpha=0.5, beta=1.0, l1=0.02, l2=0.1, epochs=4, seed=7):
    """Number by number, as the method is published: w from z and n, then gradients, then z and n. The last bucket is the bias, without penalties."""
    z = [[0.0] * classes for _ in range(buckets + 1)]
    n = [[0.0] * classes for _ in range(buckets + 1)]

    def w(b, c):
        pen, ridge = (0.0, 0.0) if b == buckets else (l1, l2)
        if abs(z[b][c]) <= pen:
            return 0.0
        return -(z[b][c] - math.copysign(pen, z[b][c])) / ((beta + math.sqrt(n[b][c])) / alpha + ridge)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = [*zip(rows[r][0].tolist(), rows[r][1].tolist()), (buckets, 1.0)]
            now = {b: [w(b, c) for c in range(classes)] for b, _ in x}
            s = [sum(v * now[b][c] for b, v in x) for c in range(classes)]
            e = [math.exp(t - max(s)) for t in s]
            for b, v in x:
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == y[r]))
                    sigma = (math.sqrt(n[b][c] + g * g) - math.sqrt(n[b][c])) / alpha
                    z[b][c] += g - sigma * now[b][c]
                    n[b][c] += g * g
    return np.array([[w(b, c) for c in range(classes)] for b in range(buckets)]), np.array([w(buckets, c) for c in range(classes)])


def test_ftrl_against_brute_force():
    r = np.random.default_rng(8)
    rows = [(np.sort(r.choice(40, 6, replace=False)).astype(np.int32), r.random(6)) for _ in range(60)]
    y = np.array([int(b.sum()) % 3 for b, _ in rows])
    got, want = langid.ftrl(rows, y, 3, 40), brute_ftrl(rows, y, 3, 40)
    assert np.allclose(got[0], want[0], atol=1e-12) and np.allclose(got[1], want[1], atol=1e-12)
    heavy = langid.ftrl(rows, y, 3, 40, l1=0.5)
    assert np.allclose(heavy[0], brute_ftrl(rows, y, 3, 40, l1=0.5)[0], atol=1e-12) and (heavy[0] == 0).any() and (heavy[0] != 0).any()


def test_identify_against_brute_force(spark, docs):
    """The query's answers from a model, text by text."""
    model = langid.train(docs, rows_per_language=40)
    text = {x.doc_id: x.text for x in docs.collect()}
    for x in langid.identify(docs, model).where("doc_id < 120").collect():
        b, v = langid.features(text[x.doc_id])
        z = ((model.weights[b].astype(np.float64) * v[:, None]).sum(0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if text[x.doc_id].strip():
            assert x.language == model.languages[p.argmax()] and x.confidence == pytest.approx(p.max(), abs=1e-4) and x.accepted == (x.confidence >= langid.MIN_CONFIDENCE)


def test_copies_are_one_example(spark):
    rows = [("la le les des", "fr")] * 3000 + [(f"mot {k} de la liste", "fr") for k in range(40)] + [(f"word {k} of the list", "en") for k in range(6)] * 500 + [("", "en"), (None, "de"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    model = langid.train(df, rows_per_language=30)
    assert model.languages == ["en", "fr"]
    got = langid.identify(spark.createDataFrame([(1, "word 99 of the list"), (2, "mot 99 de la liste")], "doc_id long, text string"), model).collect()
    assert {x.doc_id: x.language for x in got} == {1: "en", 2: "fr"}


def test_document_frequency_counts_all(spark, docs):
    some = docs.where("doc_id < 60").select("text")
    want = {}
    for (t,) in some.collect():
        for b in set(langid.features(t)[0].tolist()):
            want[b] = want.get(b, 0) + 1
    got = {x.bucket: x.df for x in langid.document_frequency(some.repartition(3)).collect()}
    assert got.pop(-1) == 60 and got == want


def test_logits_are_sums_of_features():
    r = np.random.default_rng(1)
    m = langid.Model(["a", "b"], r.normal(size=(1 << 16, 2)).astype(np.float32), np.array([0.5, -0.5]), 2.0)
    texts = ["a", "Ab\0c", "xyz " * 500, "É é", "q"]
    for t, z in zip(texts, m.logits(texts)):
        b, x = langid.features(t)
        assert np.allclose(z, (m.weights[b] * x[:, None]).sum(0) + m.bias, atol=1e-5)
    p = m.probabilities(texts)
    assert np.allclose(p.sum(1), 1)


def test_language_edges(spark, docs):
    model = langid.train(docs, rows_per_language=30)
    rows = [(1, None), (2, ""), (3, " \n"), (None, "the of and"), (4, "x" * 300000), (5, "the and of thes"), (5, "the and of thes"), (6, "\ud83d".encode("utf-8", "replace").decode())]
    df = spark.createDataFrame([(i, t, "en", 1.0) for i, t in rows], "doc_id long, text string, language string, confidence double")
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows) and {x.doc_id: x.accepted for x in got if x.doc_id in (1, 2, 3)} == {1: False, 2: False, 3: False}
    assert all(x.language is None and x.confidence == 0 for x in got if x.doc_id in (1, 2, 3))
    kept = langid.keep_identified(df, model)
    assert kept.schema == df.schema and not {1, 2, 3} & {x.doc_id for x in kept.collect()}
    assert langid.identify(df.limit(0), model).count() == 0
    none = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert langid.identify(df, none).count() == len(rows)


def test_temperature_is_the_best_one():
    r = np.random.default_rng(2)
    z = r.normal(size=(400, 3)) * 5
    y = np.array([r.choice(3, p=np.exp(a / 3) / np.exp(a / 3).sum()) for a in z])
    assert 2 < langid.calibrate(z, y) < 4.5
    assert langid.calibrate(np.eye(3)[[0, 1, 2, 0]] * 50, np.array([0, 1, 2, 0])) > 1
    assert langid.calibrate(np.zeros((0,)), np.zeros(0, int)) == 1.0


def small(states=3, symbols=4, seed=3):
    r = np.random.default_rng(seed)
    n = lambda x, a: x / x.sum(a, keepdims=True)
    return hmm.Model({f"w{i}": i for i in range(1, symbols)}, n(r.random(states), 0), n(r.random((states, states)), 1), n(r.random((symbols, states)), 0))


def paths(m, seq):
    """Every path of states with its probability."""
    for p in itertools.product(range(len(m.start)), repeat=len(seq)):
        x = m.start[p[0]] * m.emit[seq[0], p[0]]
        for a, b, o in zip(p, p[1:], seq[1:]):
            x *= m.move[a, b] * m.emit[o, b]
        yield p, x


def test_forward_and_counts_against_all_paths():
    m, r = small(), np.random.default_rng(4)
    seqs = [r.integers(0, 4, n).tolist() for n in (3, 1, 5, 0, 6, 2)]
    obs, n = np.array(sum(seqs, []), np.int32), np.array([len(s) for s in seqs])
    ll = hmm.forward(m, obs, n)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s, x in zip(seqs, ll):
        if not s:
            assert x == 0
            continue
        total = sum(p for _, p in paths(m, s))
        assert x == pytest.approx(math.log(total))
        for p, q in paths(m, s):
            start[p[0]] += q / total
            for a, b in zip(p, p[1:]):
                move[a, b] += q / total
            for a, o in zip(p, s):
                emit[o, a] += q / total
    a, b, c, d = hmm.expected_counts(m, obs, n)
    assert np.allclose(a, start) and np.allclose(b, move) and np.allclose(c, emit) and d == pytest.approx(ll.sum())


def test_stretches_and_neighbours_change_nothing():
    m, r = small(4, 9), np.random.default_rng(6)
    n = np.array([3, 700, 0, 12, 1, 55, 700])
    obs = r.integers(0, 9, n.sum())
    whole = hmm.expected_counts(m, obs, n)
    for held in (1, 7, 100):
        for x, y in zip(whole, hmm.expected_counts(m, obs, n, held)):
            assert np.allclose(x, y, rtol=1e-9)
    ll = hmm.forward(m, obs, n)
    groups = [hmm.Group(np.arange(8), m, obs[:703], n[:2], pa.array([0, 1])), hmm.Group(np.arange(8), m, obs[703:], n[2:], pa.array([2, 3, 4, 5, 6]))]
    hmm_long, hmm.LONG = hmm.LONG, 50
    try:
        got = {}
        total = np.zeros((9, 4))
        for g in hmm._side_by_side(iter(groups), 60):
            got |= dict(zip(g.names.to_pylist(), hmm.forward(g.model, g.obs, g.n)))
            z = hmm.expected_counts(g.model, g.obs, g.n)[2]
            total[0] += z[0]
            np.add.at(total, g.h + 1, z[1:])
    finally:
        hmm.LONG = hmm_long
    assert np.allclose([got[i] for i in range(7)], ll) and np.allclose(total, whole[2])


def test_scores_from_codes_are_those_from_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b a c b a"), (None, "a b"), (3, "a b a c b a"), (5, "b a " * 9000), (6, "once a")]
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t in rows], "doc_id long, text string, n_words int, h double").repartition(3)
    one = sorted(map(repr, ((x.doc_id, x.n_words, x.log_likelihood and round(x.log_likelihood, 6)) for x in hmm.train_and_score(df, rounds=2).collect())))
    two = sorted(map(repr, ((x.doc_id, x.n_words, x.log_likelihood and round(x.log_likelihood, 6)) for x in hmm.score(df, hmm.train(df, rounds=2)).collect())))
    assert one == two and len(one) == len(rows) and hmm.train_and_score(df.limit(0)).count() == 0


def test_long_sequences_stay_finite():
    m = small()
    obs = np.random.default_rng(5).integers(0, 4, 50000).astype(np.int32)
    x = hmm.forward(m, obs, np.array([50000]))[0]
    assert np.isfinite(x) and -50000 * 5 < x < 0


def test_training_improves_and_doesn_t_depend_on_partitions(spark, docs):
    some = docs.where("doc_id < 200")
    total = []
    for k in (0, 1, 3):
        m = hmm.train(some, states=3, rounds=k, min_share=1e-3)
        total.append(hmm.score(some, m).agg({"log_likelihood": "sum"}).first()[0])
    assert total[0] < total[1] < total[2]
    a, b = (hmm.train(some.repartition(p), states=3, rounds=2, min_share=1e-3) for p in (1, 6))
    assert a.vocabulary == b.vocabulary and np.allclose(a.emit, b.emit, atol=1e-9) and np.allclose(a.move, b.move, atol=1e-9)
    n = sum(len(words(t)) for (t,) in some.select("text").collect())
    assert hmm.word_totals(some).agg({"n": "sum"}).first()[0] == n
    assert all(c >= max(2, 1e-3 * n) for w, c in hmm.word_totals(some).collect() if w in a.vocabulary)


def test_scores_of_edge_cases(spark):
    m = small()
    rows = [(1, None), (2, ""), (3, "w1 W2, w9"), (None, "w1"), (3, "w1 W2, w9"), (4, "w1 " * 70000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, n_words double")
    got = {x.doc_id: (x.n_words, x.log_likelihood, x.per_word) for x in hmm.score(df, m).collect()}
    assert got[1] == (None, None, None) and got[2] == (0, 0.0, None) and got[4][0] == 70000
    assert got[3][1] == pytest.approx(math.log(sum(p for _, p in paths(m, [1, 2, 0])))) and got[3][2] == pytest.approx(got[3][1] / 3)
    assert hmm.score(df, m).count() == len(rows) and hmm.score(df.limit(0), m).count() == 0
    empty = hmm.train(df.limit(0))
    assert empty.vocabulary == {} and hmm.score(df, empty).count() == len(rows)


def test_runs_cover_all_rows():
    m = small()
    col = pa.array(["w1 w2", None, "", "w3 " * 10, "w1"])
    seen = [(i, n.tolist()) for i, _, n in hmm._runs(m, col, most=3)]
    assert sum(len(n) for _, n in seen) == 5 and [x for _, n in seen for x in n] == [2, 0, 0, 10, 1]


def test_words_by_count_and_rare_words_share_a_symbol(spark):
    texts = [f"often often twice{k} twice{k} " for k in range(40_000)] + ["once%d" % k for k in range(1000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = hmm.train(df, rounds=1)
    assert len(m.vocabulary) == 40_001 and not any(w.startswith("once") for w in m.vocabulary)
    assert m.rare == 1001 and np.allclose(m.emit.sum(0), 1)
    got = {x.doc_id: x.per_word for x in hmm.score(df, m).where("doc_id % 20000 = 1 OR doc_id = 40500").collect()}
    assert got[40500] < got[1] - 2  # 1,000 words seen once don't outdo common ones


def test_training_goes_on_until_rounds_gain_little(spark):
    r = np.random.default_rng(3)
    texts = [" ".join(f"{'ab'[(k + s) % 2]}{r.integers(20)}" for k in range(60)) for s in r.integers(0, 2, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = hmm.train(df, states=2)
    got = hmm.score(df, m).agg({"log_likelihood": "sum"}).first()[0] / (400 * 60)
    assert got > -math.log(20) - 0.05  # word order counts: shares alone give -log(40)


def test_counts_of_a_piece_are_added_up_row_by_row(tmp_path):
    keys, tasks = np.arange(0, 6000, 2, dtype=np.int64), 400
    got = {}

    def sent(at):
        for t in range(tasks if at else 1):
            h = keys if not at else np.sort(np.random.default_rng(t).choice(keys, 1500, False))
            c = np.full((len(h), 2), 1.0 + t)
            if at:
                np.add.at(got.setdefault("sum", np.zeros((6000, 2))), h, c)
            few = np.arange(3), np.ones((3, 2))
            yield pa.RecordBatch.from_arrays([pa.array([0, -1 - t % 3]), pa.array([h[::-1].tobytes() if not at else h.tobytes(), few[0].tobytes()], pa.binary()), pa.array([c.tobytes(), few[1].tobytes()], pa.binary())], names=["piece", "h", "c"])

    for at in (0, 1):
        tracemalloc.start()
        base = pa.total_allocated_bytes()
        most, rows = 0, []

        def watched():
            nonlocal most
            for b in sent(at):
                most = max(most, pa.total_allocated_bytes() - base)
                yield b

        for b in hmm._gather(str(tmp_path), at, 2)(watched()):
            rows += b.to_pylist()
        most += tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert not at or most < 1_500_000  # all rows of round 1 together have 14 MB; round 0 imports what is missing
    assert (np.load(tmp_path / "0.npy") == keys).all() and np.allclose(np.load(tmp_path / "0-1.npy"), got["sum"][keys])
    total = np.zeros((6, 2))
    for x in rows:
        total[x["k"]] += x["c0"], x["c1"]
    assert (total[:3] == tasks).all() and np.allclose(total[5], got["sum"].sum(0)) and (total[3:5] == 0).all()


def test_expected_counts_hold_two_tables_of_values_at_most():
    r = np.random.default_rng(4)
    m, n = small(6, 50), np.full(1000, 200)
    obs = r.integers(0, 50, n.sum())
    hmm.expected_counts(m, obs[:400], n[:2])
    tracemalloc.start()
    hmm.expected_counts(m, obs, n)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3 * obs.size * 6 * 8  # forward values, emissions, and what is small beside them


def test_sequences_of_a_length_advance_together_in_few_steps():
    m, r = small(3, 50), np.random.default_rng(8)
    n = r.permutation(np.concatenate([np.full(1000, 10), np.full(8, 1250), [0, 0]]))
    obs = r.integers(0, 50, n.sum())
    ll, whole = hmm.forward(m, obs, n), hmm.expected_counts(m, obs, n)
    got, steps, total = {}, 0, np.zeros((50, 3))
    for g in hmm._side_by_side(iter([hmm.Group(np.arange(49), m, obs, n, pa.array(np.arange(len(n))))]), 5000):
        steps += int(g.n.max())
        got |= dict(zip(g.names.to_pylist(), hmm.forward(g.model, g.obs, g.n)))
        total += hmm.expected_counts(g.model, g.obs, g.n)[2]
    assert np.allclose([got[i] for i in range(len(n))], ll) and np.allclose(total, whole[2])
    assert steps <= 2 * 1250 + 4 * 10  # in the order of the table nearly each part holds a long one


def test_texts_are_bytes_and_pieces_of_the_table_ranges_of_hashes(spark):
    coded = hmm.encoded(spark.createDataFrame([(1, "b a b"), (2, None), (3, "c")], "doc_id long, text string"), id_col="doc_id")
    assert [coded.schema[c].dataType.typeName() for c in ("h", "c", "place", "obs")] == ["binary"] * 4  # the JVM would take arrays apart
    back = {}
    for x in coded.collect():
        h, place, obs = np.frombuffer(x.h, np.int64), np.frombuffer(x.place, np.int32), np.frombuffer(x.obs, np.int32)
        assert (np.diff(h) > 0).all() and np.frombuffer(x.c, np.int64).tolist() == np.bincount(obs, minlength=len(h))[place].tolist()
        by_code = dict(zip(place.tolist(), h.tolist()))
        for name, null, a, b in zip(x.names, x.null, np.cumsum(x.n) - x.n, np.cumsum(x.n)):
            back[name] = None if null else [by_code[o] for o in obs[a:b].tolist()]
    a, b, c = hmm.hashes(["a", "b", "c"]).tolist()
    assert back == {1: [b, a, b], 2: None, 3: [c]}
    h = np.sort(np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, 5000))
    for pieces in (1, 2, 64):
        p = hmm.pieces_of(h, pieces)
        assert (np.diff(p) >= 0).all() and set(p.tolist()) == set(range(pieces))
