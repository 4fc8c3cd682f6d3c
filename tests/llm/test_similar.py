"""Near duplicates and nearest vectors against brute force, with awkward rows."""

from itertools import combinations

import numpy as np
import pytest

from topicloom.llm import near_duplicates as nd
from topicloom.llm.neighbours import footrule, neighbours

DOCS = "doc_id long, words array<string>, added_at int, id int, rep int, payload int, h1 int, a int, b int, copies int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], DOCS)


def collection(rng, n=250):
    rows, names = [], [f"t{i}" for i in range(900)]
    for i in range(n):
        if i % 3 and rows:
            base = list(rows[rng.integers(0, len(rows))])
            for _ in range(rng.integers(0, 6)):
                base[rng.integers(0, len(base))] = str(rng.choice(names))
            rng.shuffle(base)
        else:
            base = [str(w) for w in rng.choice(names, rng.integers(5, 45))] + [f"s{j}" for j in range(6)]
        rows.append(base)
    return rows


def brute(sets, least):
    return {(i, j) for (i, a), (j, b) in combinations(sorted(sets.items()), 2) if len(a & b) >= least * len(a | b) - 1e-12}


def test_pairs_and_groups_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = collection(rng)
    given = docs(spark, [(i, [f" {w.upper()}\t" if i % 2 else w for w in r], 1) for i, r in enumerate(rows)] + [(0, rows[0], 9), (None, rows[0], 1), (900, None, 1), (901, [], 1), (902, [None, " "], 1), (903, ["one"], 1)])
    sets = {i: set(r) for i, r in enumerate(rows) if len(set(r)) >= 12}
    found = nd.NearDuplicates(given, least=0.7)
    got = [(r.doc_id_a, r.doc_id_b) for r in found.pairs().collect()]
    want = brute(sets, 0.7)
    assert len(got) == len(set(got)) and set(got) <= want and len(want - set(got)) <= len(want) * 0.005
    neighbours_, root = {i: set() for i in sets}, {i: i for i in sets}
    for a, b in got:
        neighbours_[a].add(b)
        neighbours_[b].add(a)
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in neighbours_[i])]) for i in sets}
    assert {(r.doc_id, r.class_id, r.n_links) for r in found.groups().collect()} == {(i, root[i], len(neighbours_[i])) for i in sets}


@pytest.mark.parametrize("others", [0, 100])
def test_a_template_with_rare_edits_is_found_whole(spark, others):
    template = [f"t{i}" for i in range(12)]
    rows = [[*template, f"a{i}", f"b{i}"] for i in range(50)] + [[f"o{i}_{j}" for j in range(14)] for i in range(others)]
    got = nd.NearDuplicates(docs(spark, [(i, r, 1) for i, r in enumerate(rows)]), least=0.7).pairs()
    assert {(r.doc_id_a, r.doc_id_b) for r in got.collect()} == set(combinations(range(50), 2))


def test_splitting_hot_bands_loses_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = collection(rng, 120)
    given = docs(spark, [(i, r, 1) for i, r in enumerate(rows)])
    want = {tuple(r) for r in nd.NearDuplicates(given, least=0.7).pairs().collect()}
    monkeypatch.setattr(nd, "HOT", 2)
    monkeypatch.setattr(nd, "SAMPLE", 1)
    split = nd.NearDuplicates(given, least=0.7)
    assert len(split._hot()) > 100 and {tuple(r) for r in split.pairs().collect()} == want == brute({i: set(r) for i, r in enumerate(rows) if len(set(r)) >= 12}, 0.7)


def test_bands_and_sketch_keep_the_miss_rate():
    for least in (0.3, 0.5, 0.7, 0.8, 0.95, 1.0):
        bands, rows = nd.band_shape(least)
        assert 1 <= bands <= nd.MAX_BANDS and (1 - least**rows) ** bands <= nd.MISS
    assert nd.band_shape(0.7) == (59, 5) and 19.2 + 4 * 4.04 < nd.sketch_limit(0.7) < 19.2 + 6 * 4.04


def test_many_copies_come_as_a_star(spark, monkeypatch):
    monkeypatch.setattr(nd, "ALL_PAIRS", 5)
    words = [f"w{i}" for i in range(20)]
    rows = [(i, words, 1) for i in range(40)] + [(100, [*words[:19], "other"], 1)]
    found = nd.NearDuplicates(docs(spark, rows), least=0.7)
    assert {(r.doc_id_a, r.doc_id_b) for r in found.pairs().collect()} == {(0, i) for i in [*range(1, 40), 100]}
    assert {(r.class_id, r.n_links) for r in found.groups().collect()} == {(0, 40)}


def test_no_records(spark):
    found = nd.NearDuplicates(docs(spark, [(1, None, 1)]), least=0.7)
    assert found.pairs().count() == 0 and found.groups().count() == 0


def test_signatures_estimate_weighted_similarity_and_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    k, size = 160, 400
    hashes = rng.integers(0, 2**63, size).astype(np.uint64)
    weights = rng.uniform(0.1, 6.9, size)
    a, b = np.arange(0, 60), np.arange(20, 80)
    record, element = np.r_[np.zeros(60, int), np.ones(60, int), np.full(3, 2)], np.r_[a, b, [300, 301, 302]]
    s = nd.signatures(record, element, hashes, weights, 3, k)
    true = weights[20:60].sum() / weights[:80].sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k) and not (s[0] == s[2]).any()
    alone = nd.signatures(np.zeros(60, int), a, hashes, weights, 1, k)
    assert (alone[0] == s[0]).mean() > 0.999 and not (s == nd._EMPTY).any()


VEC = "doc_id long, topic_dist array<float>, inferred_at int, id int, v int, cell int, half int, a int, b int, part int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, t, 1, 2, 3, 4, 5, 6, 7) for i, v, t in rows], VEC)


def test_similar_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centers = rng.dirichlet(np.full(8, 0.5), 60)
    x = np.concatenate([centers[rng.integers(0, 60, 500)] + rng.random((500, 8)) * 0.02, centers * 30])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x.astype(np.float32))]
    bad = [(2000, None, 1), (2001, [], 1), (2002, [1.0] * 7, 1), (2003, [float("nan")] * 8, 1), (2004, [0.0] * 8, 1), (2005, [None] * 8, 1), (2006, [float("inf")] * 8, 1), (None, rows[0][1], 1), (*rows[0][:2], 7)]
    got = neighbours(vectors(spark, rows + bad), dims=8, k=5, least=0.95).collect()
    f = x.astype(np.float32).astype(float)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    cos = f @ f.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(f)) for j in np.argsort(-cos[i], kind="stable")[:5] if cos[i, j] >= 0.95}
    pairs = {(r.id_a, r.id_b) for r in got}
    assert len(pairs & want) >= 0.9 * len(want) and all(abs(r.cosine - cos[r.id_a, r.id_b]) < 1e-6 for r in got)
    assert all(r.id_a != r.id_b for r in got) and max(r.rank_no for r in got) <= 5


def test_splitting_large_files_keeps_recall(spark, monkeypatch):
    from topicloom.llm import neighbours as nb

    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random((60, 4)), np.array([1.0, 0.2, 0.3, 0.4]) + rng.random((240, 4)) * 0.3]).astype(np.float32)
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    f = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = f @ f.T
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(f)) for j in np.argsort(-cos[i], kind="stable")[:3]}
    for block in (4096, 40, 10):  # whole files, files of pairs of pivots, blocks of those
        monkeypatch.setattr(nb, "BLOCK", block)
        got = {tuple(r) for r in neighbours(vectors(spark, rows), dims=4, k=3, max_pivots=12).select("id_a", "id_b").collect()}
        assert len(got & want) > 0.95 * len(want), block


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, 0.75], 1) for i in range(60)] + [(100 + i, [float(c) for c in v], 1) for i, v in enumerate(rng.random((40, 3)).astype(np.float32))]
    got = neighbours(vectors(spark, rows), dims=3, k=2, least=0.2).collect()
    of = {}
    for r in got:
        of.setdefault(r.id_a, []).append((r.rank_no, r.id_b))
    assert len(of) == 100 and sorted(of[59]) == sorted(of[2]) == [(1, 0), (2, 1)] and sorted(of[0]) == [(1, 1), (2, 2)] and sorted(of[1]) == [(1, 0), (2, 2)]


def test_equal_vectors_and_none(spark):
    same = vectors(spark, [(i, [1.0, 2.0], 1) for i in range(8)])
    got = sorted((r.id_a, r.rank_no, r.id_b) for r in neighbours(same, dims=2, k=2, least=0.5).collect())
    assert [g for g in got if g[0] == 3] == [(3, 1, 0), (3, 2, 1)] and [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours(vectors(spark, [(1, None, 1)]), dims=2).count() == 0
    assert neighbours(vectors(spark, [(1, [1.0, 1.0], 1)]), dims=2).count() == 0


def test_footrule_of_prefixes():
    a, b = np.array([[1, 2, 3]], np.int32), np.array([[1, 2, 3], [3, 2, 1], [7, 8, 9]], np.int32)
    d = footrule(a, b)[0].astype(int)
    assert d[0] < d[1] < d[2]
