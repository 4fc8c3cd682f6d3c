import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions.special import digamma, digamma_rising, lbfgs, legendre, legendre_values, lgamma, log_rising
from topicloom.operators import coherence, explore, labeling, readout
from topicloom.plans import catalog


def test_special_functions(spark):
    x = np.array([0.01, 0.5, 1, 3.7, 12, 4000.0])
    assert np.allclose(lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-10)
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10
    df = spark.createDataFrame([(0,), (1,), (137,), (5000,)], "n int")
    for r in df.select("n", log_rising(F.col("n"), F.lit(0.1)).alias("g"), digamma_rising(F.col("n"), F.lit(0.1)).alias("d")).collect():
        assert abs(r.g - (math.lgamma(r.n + 0.1) - math.lgamma(0.1))) < 1e-7 * max(1, abs(r.g))
        assert abs(r.d - (digamma(np.array([r.n + 0.1])) - digamma(np.array([0.1])))[0]) < 1e-8 * max(1, r.d)
    p = df.limit(1).select(*[legendre(F.lit(0.3), n).alias(str(n)) for n in range(4)]).first()
    assert np.allclose(p, [legendre_values(np.array(0.3), n) for n in range(4)])
    best = lbfgs(lambda vs: [(float(((v - 3) ** 2).sum()), 2 * (v - 3)) for v in vs], [np.zeros(4), np.ones(4)], steps=20)
    assert np.allclose(best, 3, atol=1e-4)


def assigned(spark):
    rows = [(0, 0, 0), (0, 1, 1), (0, 0, 1), (1, 2, 0), (1, 0, 0)]
    return spark.createDataFrame([(d, i, f"w{w}", w, z, 1.0) for i, (d, w, z) in enumerate(rows)], "doc_id long, pos int, word string, wid int, z int, w double")


def vocab(spark, n=3):
    return spark.createDataFrame([(f"w{i}", True, i) for i in range(n)], "word string, used boolean, wid int")


def test_distributions_add_up(spark):
    a, v = assigned(spark), vocab(spark)
    phi = readout.topic_word_dist(a, v, 3, 0.01)  # topic 2 has no words
    assert phi.count() == 9 and all(abs(r.s - 1) < 1e-12 for r in phi.groupBy("z").agg(F.sum("p").alias("s")).collect())
    theta = readout.doc_topic_dist(a, 3, 0.1)
    assert all(abs(r.s - 1) < 1e-12 for r in theta.groupBy("doc_id").agg(F.sum("p").alias("s")).collect())
    assert readout.topic_word_counts(a).agg(F.sum("n")).first()[0] == readout.doc_topic_counts(a).agg(F.sum("n")).first()[0] == 5
    ll = readout.ll_per_word(a, v, 3, 0.1, 0.01).first()
    assert abs(ll.perplexity - math.exp(-ll.ll_per_word)) < 1e-9


def test_sweeps_do_not_depend_on_partitions(spark):
    a, v = assigned(spark), vocab(spark)
    seed = F.col("doc_id") * 1009 + F.col("pos")
    got = [sorted(map(tuple, readout.jacobi_sweep(a.repartition(n), v, 3, 0.1, 0.01, seed).collect())) for n in (1, 4, 16)]
    assert got[0] == got[1] == got[2]


def test_sweeps_with_large_ids(spark):
    seeds = [0, 8_357_000_000, 8_359_000_000, 10**13, 2**62, -1, -(2**62)]
    got = spark.createDataFrame([(x,) for x in seeds], "x long").select(readout.uniform(F.col("x")).alias("u")).collect()
    assert [r.u for r in got] == [((x * 1103515245 + 12345) % 2**31 + 0.5) / 2**31 for x in seeds]
    a, v = assigned(spark), vocab(spark)
    moved = readout.jacobi_sweep(a.withColumn("doc_id", F.col("doc_id") + 10**10), v, 3, 0.1, 0.01, F.col("doc_id") * 1009 + F.col("pos") * 7 + 1)
    assert moved.count() == a.count() and moved.where("z between 0 and 2").count() == a.count()


def swept(tokens, v, seed, allowed=lambda doc, z: True):
    """tokens [(doc_id, pos, wid, z)] with new topics, one by one."""
    dk, wk, zk = Counter((d, z) for d, _, _, z in tokens), Counter((w, z) for _, _, w, z in tokens), Counter(z for *_, z in tokens)
    out = []
    for d, pos, w, z in tokens:
        p = [(dk[d, k] - (k == z) + catalog.ALPHA) * (wk[w, k] - (k == z) + catalog.ETA) / (zk[k] - (k == z) + v * catalog.ETA) * allowed(d, k) for k in range(catalog.K)]
        u = (((d * 1009 + pos * 7 + seed) * 1103515245 + 12345) % 2**31 + 0.5) / 2**31
        sums = np.cumsum(p)
        out.append((d, pos, w, int(np.argmax(sums > u * sums[-1]))))
    return sorted(out)


def far(spark, tmp_path):
    """A folder of documents whose ids are large, its tokens before the sweeps and the number of words."""
    rng = np.random.default_rng(3)
    rows = [(10**10 + i, " ".join(f"w{x}" for x in rng.integers(0, 16, 30)), "en", "s", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    a, v = catalog.read(spark, str(tmp_path))
    return str(tmp_path), [tuple(r) for r in a.select("doc_id", "pos", "wid", "z").collect()], v.where("used").count()


def test_two_sweeps_over_large_ids(spark, tmp_path):
    d, tokens, v = far(spark, tmp_path)
    wanted = Counter((z, w) for _, _, w, z in swept(swept(tokens, v, 1), v, 2))
    assert {(r.z, r.wid): r.n for r in catalog.QUERIES["jacobi_sweep_2"](spark, d).collect()} == wanted


def test_sweeps_of_documents_in_rows(spark):
    rng = np.random.default_rng(5)
    tokens = [(10**15 * (i % 3) + i // 4, int(p), int(w), int(z)) for i in range(40) for p, (w, z) in enumerate(zip(rng.integers(0, 8, 20), rng.integers(0, 5, 20)))]
    tokens = sorted({t[:2]: t for t in tokens}.values())
    v = spark.createDataFrame([(f"w{i}", i, True) for i in range(8)] + [("rare", None, False)], "word string, wid int, used boolean")
    t = spark.createDataFrame(tokens, "doc_id long, pos int, wid int, z int")
    halves = t.groupBy("doc_id", (F.col("pos") % 2).alias("half")).agg(F.array_sort(F.collect_list(F.struct("pos", "wid", "z"))).alias("t")).select("doc_id", "t.pos", "t.wid", "t.z")
    whole = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "wid", "z"))).alias("t")).select("doc_id", "t.pos", "t.wid", "t.z")
    wanted = swept(tokens, 8, 1)
    for docs in (whole.repartition(1), whole.repartition(7), halves):  # rows of one doc_id are one document
        for limit in (readout.MAX_COUNTS, 8):
            got = readout.sweep_lists(docs, v, catalog.K, catalog.ALPHA, catalog.ETA, lambda doc, pos: doc * 1009 + pos * 7 + 1, limit=limit)
            assert sorted(map(tuple, got.collect())) == wanted
    assert readout.sweep_lists(whole.limit(0), v.where("not used"), 5, 0.1, 0.01, lambda doc, pos: doc).collect() == []


def test_one_sweep_moves_no_tokens(spark, tmp_path):
    d, _, _ = far(spark, tmp_path)
    plan = catalog.QUERIES["jacobi_sweep_1"](spark, d)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Sort" not in plan


def test_one_sweep_over_large_ids(spark, tmp_path):
    d, tokens, v = far(spark, tmp_path)
    assert sorted(tuple(r) for r in catalog.QUERIES["jacobi_sweep_1"](spark, d).collect()) == swept(tokens, v, 1)


def test_a_masked_sweep_over_large_ids(spark, tmp_path):
    d, tokens, v = far(spark, tmp_path)
    wanted = swept(tokens, v, 3, lambda doc, z: z == 0 or z == 1 + doc % (catalog.K - 1))
    assert sorted(tuple(r) for r in catalog.QUERIES["labelled_mask_sweep"](spark, d).collect()) == wanted


def test_masked_sweeps_of_documents_in_rows(spark):
    rng = np.random.default_rng(6)
    tokens = [(i, p, int(w), int(z)) for i in range(12) for p, (w, z) in enumerate(zip(rng.integers(0, 8, 25), rng.integers(0, 5, 25)))]
    v = spark.createDataFrame([(f"w{i}", i, True) for i in range(8)], "word string, wid int, used boolean")
    docs = spark.createDataFrame(tokens, "doc_id long, pos int, wid int, z int").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "wid", "z"))).alias("t")).select("doc_id", "t.pos", "t.wid", "t.z")
    wanted = swept(tokens, 8, 2, lambda doc, z: z == doc % 5 or z == 4)
    ok = F.array(*[(F.col("doc_id") % 5 == i) | F.lit(i == 4) for i in range(5)])
    for limit in (readout.MAX_COUNTS, 8):
        got = readout.sweep_lists(docs.repartition(3), v, catalog.K, catalog.ALPHA, catalog.ETA, lambda doc, pos: doc * 1009 + pos * 7 + 2, ok, limit=limit)
        assert sorted(map(tuple, got.collect())) == wanted


def test_a_masked_sweep_moves_no_tokens(spark, tmp_path):
    d, _, _ = far(spark, tmp_path)
    plan = catalog.QUERIES["labelled_mask_sweep"](spark, d)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Sort" not in plan


def topics(spark, *words):
    return spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(words)], "topic int, rank_no int, word string")


def test_coherence_by_hand(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["b", "a", "c"]), (3, ["c"])], "doc_id long, words array<string>")
    got = coherence.coherence(topics(spark, "a", "b"), docs, ("document", "one_one", "pmi")).first().score
    assert abs(got - math.log(0.5 / (0.75 * 0.5))) < 1e-9
    assert coherence.coherence(topics(spark, "a", "none"), docs, ("document", "one_pre", "logcond")).first().score < -20
    for seg in coherence.SEGMENTATIONS:
        for m in coherence.CONFIRMS:
            assert coherence.coherence(topics(spark, "a", "b", "c"), docs, ("document", seg, m)).first().score is not None


def test_window_probabilities_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    docs = [[str(x) for x in rng.choice(list("abcd"), n)] for n in (3, 1, 12, 7)] + [["z"] * 5]
    w = 4
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, words array<string>")
    prob = coherence.Probabilities(topics(spark, "a", "b"), df, w)
    windows = [set(d[i : i + w]) for d in docs if {"a", "b"} & set(d) for i in range(max(len(d) - w + 1, 1))]
    for r in prob.single().collect():
        assert abs(r.p - sum(r.word in x for x in windows) / len(windows)) < 1e-12
    assert abs(prob.pair().first().pab - sum({"a", "b"} <= x for x in windows) / len(windows)) < 1e-12


def test_labels_with_one_topic(spark):
    docs = spark.createDataFrame([(i, ["w0", "w1", "w2"]) for i in range(6)], "doc_id long, words array<string>")
    dist = readout.topic_word_dist(assigned(spark).withColumn("z", F.lit(0)), vocab(spark), 1, 0.01)
    cands = spark.createDataFrame([(["w0", "w1"],)], "words array<string>")
    got = labeling.topic_labels(dist, cands, docs, k=1).collect()
    assert [r.label for r in got] == ["w0 w1"]


def test_exploring(spark):
    theta = readout.doc_topic_dist(assigned(spark), 3, 0.1)
    docs = spark.createDataFrame([(0, "A text", "en"), (1, "other", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in explore.filter_page(docs, theta, sort_topic=0, keywords=("text",)).collect()] == [0]
    assert explore.top1_by_metadata(theta, docs, "lang").count() == 2
    low, high = explore.density_interval([2.0, 5.0])[0]
    assert 0 < low < 2 / 7 < high < 1
