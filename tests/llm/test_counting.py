"""Frequencies, top items and co-occurrence against brute force, with awkward rows."""

import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from topicloom.llm import cooccurrence as co
from topicloom.llm import term_frequency as tf
from topicloom.llm.top_n import top_n

DOCS = "doc_id long, words array<string>, added_at int, word string, n_docs int, p int, payload int, items int, kind int, rec int"


def delivered(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], DOCS)


AWKWARD = [(1, ["A", " a\t", "b", None, "", " \t"], 1), (1, ["A", " a\t", "b", None, "", " \t"], 5), (2, None, 1), (3, [], 1), (4, ["b", "c"], None), (None, ["a", "zz"], 1), (5, ["B"] * 3000, 2), (5, ["B"] * 3000, 2), (6, [None, ""], 3)]


def brute(rows):
    one = {}
    for i, w, t in rows:
        if i is not None and (i not in one or (t is not None, t or 0) < (one[i][1] is not None, one[i][1] or 0)):
            one[i] = (w, t)
    out = {i: [x for x in (v.strip(" \t").lower() for v in w if v is not None) if x] for i, (w, _) in one.items() if w}
    return {i: w for i, w in out.items() if w}


def test_terms_of_awkward_rows(spark):
    got = {r.word: (r.n_occurrences, r.n_docs, r.mark) for r in tf.term_frequency(delivered(spark, AWKWARD)).collect()}
    assert got == {"a": (2, 1, "rare"), "b": (3002, 3, "common"), "c": (1, 1, "rare")}
    assert tf.term_frequency(delivered(spark, AWKWARD).limit(0)).count() == 0
    assert tf.term_frequency(delivered(spark, [(1, None, 1)])).count() == 0


def test_counters_handed_on_early_give_the_same(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    rows = [[str(x) for x in rng.integers(0, 40, n)] for n in rng.integers(0, 30, 200)]
    monkeypatch.setattr(tf, "HELD_TERMS", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(rows[a : a + 7], pa.list_(pa.string()))], ["words"]) for a in range(0, 200, 7)]
    occurrences, records = Counter(), Counter()
    for b in tf._counters(iter(batches)):
        for w, o, r in zip(*b.to_pydict().values()):
            occurrences[w] += o
            records[w] += r
    assert records.pop(None) == sum(bool(r) for r in rows) and occurrences.pop(None) == 0
    assert occurrences == Counter(w for r in rows for w in r) and records == Counter(w for r in rows for w in set(r))


TOPW = "topic_id long, word string, weight double, g int, item int, score int, least int, bin int, rank_no int"


def weights(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, 2, 3, 4, 5) for r in rows], TOPW)


@pytest.mark.parametrize(("n", "limit"), [(3, 1_000_000), (3, 1), (50, 1_000_000)])
def test_top_items_equal_brute_force(spark, n, limit):
    rng = np.random.default_rng(2)
    rows = [(7, f"w{rng.integers(0, 400)}", float(rng.choice([0.0, -1.5, 2.0, rng.random(), rng.random() * 1e-9]))) for _ in range(3000)]
    rows += [(int(g), f"w{i}", float(rng.random())) for g in range(20) for i in range(rng.integers(0, 6))]
    rows += [(7, None, 9.0), (7, "bad", float("nan")), (7, "bad", float("inf")), (7, "bad", float("-inf")), (7, "bad", None), (8, "eq1", 5.0), (8, "eq0", 5.0), (8, "eq0", 5.0), (8, "eq0", -7.0), (None, "free", 1.0)]
    best = defaultdict(dict)
    for g, w, s in rows:
        if w is not None and s is not None and math.isfinite(s):
            best[g][w] = max(s, best[g].get(w, -math.inf))
    want = {(g, i + 1, w) for g, d in best.items() for i, (w, _) in enumerate(sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n])}
    got = {(r.topic_id, r.rank_no, r.word) for r in top_n(weights(spark, rows), "topic_id", "word", "weight", n, max_thresholds=limit).collect()}
    assert got == want


def test_top_items_of_nothing(spark):
    assert top_n(weights(spark, [(1, None, 1.0)]), "topic_id", "word", "weight", 10).count() == 0


def pairs_by_hand(sets, least, npmi):
    n, single, both = len(sets), Counter(w for s in sets for w in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    return {p: c for p, c in both.items() if least <= c < n and math.log(n * c / (single[p[0]] * single[p[1]])) / math.log(n / c) >= npmi - 1e-12}


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_pairs_equal_brute_force(spark, small, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [[f"w{min(int(rng.exponential(12)), 60)}" for _ in range(rng.integers(1, 40))] + (["x", "y"] if i % 20 == 0 else []) for i in range(300)]
    rows = delivered(spark, [(i, w, 1) for i, w in enumerate(docs)] + [(900, None, 1), (901, [], 1), (902, [None, " "], 1), (0, docs[0], 9), (None, ["x", "y"], 1)])
    records = co.baskets(rows, "document", "doc_id", "words", "added_at")
    sets = [{r for r in x.items} for x in records.collect()]
    for block in (2048, 4):
        monkeypatch.setattr(co, "BLOCK", block)
        got = co.cooccurrence(records, least={"document": 5}, min_npmi=0.1, small_items=small).collect()
        assert {(r.word_a, r.word_b): r.n_ab for r in got} == pairs_by_hand(sets, 5, 0.1)
    found = {(r.word_a, r.word_b): r for r in got}[("x", "y")]
    assert found.surprising and found.log10_p < -6 and found.expected < 3


def test_surprise_equals_the_fitted_null(spark):
    """expected, log10_p and surprising of each pair, from the null's chances record by record."""
    rng = np.random.default_rng(8)
    docs = [sorted({f"w{min(int(rng.exponential(9)), 30)}" for _ in range(rng.integers(2, 20))} | ({"x", "y"} if i % 12 == 0 else set())) for i in range(240)]
    got = co.cooccurrence(co.baskets(delivered(spark, [(i, w, 1) for i, w in enumerate(docs)]), "document", "doc_id", "words", "added_at"), least={"document": 4}, min_npmi=0.0).collect()
    freq, sizes = Counter(w for d in docs for w in d), np.array([len(d) for d in docs])
    words, f = zip(*sorted(freq.items()))
    x, y = np.array(f) / np.sqrt(sizes.sum()), sizes / np.sqrt(sizes.sum())
    for _ in range(2000):  # every word and record on its own, no classes
        x, y = np.array(f) / (y / (1 + np.outer(x, y))).sum(1), sizes / (x[:, None] / (1 + np.outer(x, y))).sum(0)
    p = {w: r for w, r in zip(words, np.outer(x, y) / (1 + np.outer(x, y)))}
    tails = {}
    for r in got:
        q, dist = p[r.word_a] * p[r.word_b], np.array([1.0])
        for c in q:
            dist = np.convolve(dist, [1 - c, c])
        assert abs(r.expected - q.sum()) < 0.01 * q.sum() + 1e-6
        tails[(r.word_a, r.word_b)] = math.log10(max(dist[r.n_ab :].sum(), 1e-300))
        assert abs(r.log10_p - tails[(r.word_a, r.word_b)]) < 0.1 + 0.05 * abs(r.log10_p)
    tests, ranked = len(words) * (len(words) - 1) / 2, sorted(r.log10_p for r in got)
    cut = max((t for i, t in enumerate(ranked) if t <= math.log10(0.05 * (i + 1) / tests)), default=-math.inf)
    for r in got:
        assert r.surprising == (r.log10_p <= cut) or abs(r.log10_p - cut) < 0.02
    assert any(r.surprising for r in got) and not all(r.surprising for r in got)


def test_one_delivery_with_and_without_broadcast(spark):
    from pyspark.sql import functions as F

    from topicloom.llm._common import one_delivery

    rows = delivered(spark, AWKWARD)
    few, many = ({(r.doc_id, tuple(r.payload) if r.payload is not None else None) for r in one_delivery(rows, "doc_id", F.col("words"), "added_at", repeated=n).collect()} for n in (1_000_000, 0))
    assert few == many and len(few) == len({i for i, _, _ in AWKWARD if i is not None})


def test_no_pairs(spark):
    empty = co.baskets(delivered(spark, [(1, None, 1)]), "document", "doc_id", "words", None)
    assert co.cooccurrence(empty, least={"document": 1}, min_npmi=0.5).count() == 0
    same = co.baskets(delivered(spark, [(i, ["a", "b"], 1) for i in range(9)]), "document", "doc_id", "words", None)
    assert co.cooccurrence(same, least={"document": 1}, min_npmi=0.5).count() == 0  # in all records: no case


def test_tails_are_poisson_binomial():
    q, m = np.array([[0.01, 0.2, 0.05], [0.3, 0.02, 0.001]]), np.array([40.0, 10.0, 200.0])
    exact = []
    for row in q:
        p = np.array([1.0])
        for c, k in zip(row, m.astype(int)):
            for _ in range(k):
                p = np.convolve(p, [1 - c, c])
        exact.append(p)
    for n in (14, 20, 30):
        want = np.log([e[n + (i == 0) * 8 :].sum() for i, e in enumerate(exact)])
        got = co.log_tail(q, m, np.array([n + 8.0, n]))
        assert np.all(np.abs(got - want) < 0.25 + 0.05 * np.abs(want)), (n, got, want)


def test_null_keeps_frequencies_and_sizes():
    import pandas as pd

    items, sizes = pd.DataFrame({"n": [2.0, 10.0, 30.0], "m": [50.0, 20, 2]}), pd.DataFrame({"n": [4.0, 12.0], "m": [60.0, 10.0]})
    x, y = co.fit_null(items, sizes)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ sizes["m"], items["n"], rtol=0.01) and np.allclose(p.T @ items["m"], sizes["n"], rtol=0.01)
