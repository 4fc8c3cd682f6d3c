import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom import models

THEMES = [["apple", "pear", "plum", "fig"], ["car", "bus", "tram", "bike"], ["rain", "snow", "wind", "hail"]]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        t = i % 3
        words = [str(w) for w in rng.choice(THEMES[t], 12)] + [str(rng.choice(THEMES[(t + 1) % 3])), ".", "and"]
        rows.append((i, words, f"m{t}", [f"l{t}"], [float(t == 0)], [float(i) / 90], i % 2))
    return spark.createDataFrame(rows, "doc_id long, words array<string>, metadata string, labels array<string>, y array<double>, numeric_metadata array<double>, timepoint int").cache()


CASES = [
    (models.LDA, {"k": 3}), (models.LDA, {"k": 3, "tw": "idf"}), (models.LDA, {"k": 3, "tw": "pmi"}), (models.LDA, {"k": 3, "alpha": [0.1, 0.2, 0.3]}),
    (models.DMR, {"k": 3}), (models.GDMR, {"k": 3, "degrees": [2]}), (models.LLDA, {}), (models.PLDA, {"latent_topics": 1}),
    (models.SLDA, {"k": 3, "vars": "l"}), (models.SLDA, {"k": 3, "vars": "b"}), (models.PA, {"k1": 2, "k2": 3}), (models.HPA, {"k1": 2, "k2": 3}),
    (models.MGLDA, {"k_g": 2, "k_l": 2}), (models.PT, {"k": 3, "p": 6}), (models.HDP, {"initial_k": 2}), (models.HLDA, {"depth": 3}),
    (models.CT, {"k": 3}), (models.DT, {"k": 3, "t": 2}),
]


@pytest.mark.parametrize(("cls", "args"), CASES, ids=[f"{c.__name__}-{i}" for i, (c, _) in enumerate(CASES)])
def test_every_model(spark, docs, tmp_path, cls, args):
    m = cls(rm_top=1, seed=3, **args).add(docs)
    m.train(4, sync_interval=2)
    assert m.global_step == 4
    phi = m.phi()
    assert np.allclose(phi.sum(1), 1) and phi.shape == (m.topics, m.v)
    theta = m.doc_topic_dist().collect()
    assert len(theta) == 90 and all(abs(sum(r.theta) - 1) < 1e-6 for r in theta)
    assert abs(m.n.sum() - m.rows.select(F.explode("w").alias("w")).agg(F.sum("w")).first()[0]) < 1e-3
    assert np.isfinite(m.state_ll())
    new = docs.limit(5).withColumn("words", F.concat("words", F.array(F.lit("unseen"))))
    assert all(abs(sum(r.theta) - 1) < 1e-6 for r in m.infer(new, 5).collect())
    m.save(str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    assert type(again) is cls and again.get_hash() == m.get_hash()
    again.train(1)
    assert again.global_step == 5


def test_planted_topics_are_found_and_likelihood_rises(spark, docs):
    m = models.LDA(3, rm_top=2, seed=1, optim_interval=0).add(docs)
    m.train(1)
    before = m.ll_per_word
    m.train(25)
    assert m.ll_per_word > before
    top = {}
    for r in m.topic_words(4).collect():
        top.setdefault(r.topic, set()).add(r.word)
    themes = [set(t) for t in THEMES]
    assert all(max(len(t & w) for w in top.values()) >= 3 for t in themes)


def test_same_topics_on_any_partitioning(spark, docs):
    got = []
    for n in (1, 4, 16):
        m = models.LDA(3, seed=9).add(docs.repartition(n))
        m.train(2)
        got.append(sorted((r.doc_id, r.place, r.topic) for r in m.token_topics().collect()))
    assert got[0] == got[1] == got[2]


def test_all_words_pruned_and_empty_documents(spark, docs):
    m = models.LDA(3, min_df=200, rm_top=200).add(docs)
    m.train(2)
    assert m.v == 0 and m.topic_words().count() == 0 and m.doc_topic_dist().count() == 0
    some = spark.createDataFrame([(0, ["a", "b"]), (1, []), (2, None), (3, [None, "a"])], "doc_id long, words array<string>")
    m = models.LDA(1).add(some)
    m.train(2)
    assert {r.doc_id for r in m.doc_topic_dist().collect()} == {0, 3}
    assert m.infer(spark.createDataFrame([(9, ["zzz"])], "doc_id long, words array<string>")).count() == 0


def test_errors_and_priors(spark, docs):
    with pytest.raises(ValueError):
        models.LDA(0)
    with pytest.raises(ValueError):
        models.LDA(2, alpha=[0.1, 0.2, 0.3])
    with pytest.raises(ValueError):
        models.HDP(alpha=[0.1, 0.1, 0.1])
    with pytest.raises(RuntimeError):
        models.LDA(2).phi()
    with pytest.raises(ValueError):
        models.DMR(2).add(docs.drop("metadata"))
    with pytest.raises(RuntimeError):
        models.HDP().set_word_prior("a", [1.0])
    m = models.LDA(3).add(docs)
    m.set_word_prior("apple", {0: 5.0})
    m.train(10)
    with pytest.raises(RuntimeError):
        m.add(docs)
    with pytest.raises(RuntimeError):
        m.set_word_prior("apple", {0: 5.0})
    assert int(np.argmax(m.phi()[:, m.vocab.where("word = 'apple'").first().wid])) == 0


def test_metadata_priors_differ_and_unknown_raise(spark, docs):
    m = models.DMR(3, seed=2, optim_interval=2, rm_top=2).add(docs)
    m.train(10)
    assert np.abs(m.topic_prior("m0") - m.topic_prior("m1")).max() > 0.05
    with pytest.raises(ValueError):
        m.topic_prior("none")


def test_a_sweep_equals_a_plain_sampler(spark):
    """The kernel of LDA against a token-by-token sampler with the same uniforms."""
    from topicloom.functions.hashing import uniforms
    from topicloom.operators import corpus

    rng = np.random.default_rng(3)
    words = [[f"w{x}" for x in rng.integers(0, 9, n)] for n in rng.integers(1, 15, 12)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, words array<string>")
    vocab = corpus.vocabulary(docs)
    wid = {r.word: r.wid for r in vocab.collect()}
    z = [[int(x) for x in rng.integers(0, 3, len(w))] for w in words]
    rows = [(i, [wid[x] for x in w], z[i]) for i, w in enumerate(words)]
    m = models.LDA(3, alpha=[0.1, 0.3, 0.5], eta=0.05, seed=11).adopt(vocab, spark.createDataFrame(rows, "doc_id long, wid array<int>, z array<int>"))
    n, alpha, v = m.n.copy(), m.alpha, m.v
    m.optim_interval = 0
    m.train(1)
    got = {r.doc_id: r.z for r in m.rows.select("doc_id", "z").collect()}
    for i, ids, zs in rows:
        u = uniforms(11, np.array([i]), max(len(x) for x in words), 1)[0]
        nd, zs = np.bincount(zs, minlength=3).astype(float), list(zs)
        for t, w in enumerate(ids):
            own = np.arange(3) == zs[t]
            nd -= own
            p = np.cumsum((nd + alpha) * (np.maximum(n[w] - own, 0) + 0.05) / (n.sum(0) - own + v * 0.05))
            zs[t] = int((p <= u[t] * p[-1]).sum())
            nd[zs[t]] += 1
        assert got[i] == zs


def test_bytes_classes_and_transform(spark, docs):
    plain = docs.select("doc_id", "words", F.col("metadata").alias("group"))
    m = models.DMR(2, seed=5).add(plain, transform=lambda d: d.withColumn("metadata", F.upper("group")))
    m.train(2)
    assert m.metadata_values == ["M0", "M1", "M2"] and m.metadata_counts["M0"] == 30 and "M1 30" in m.summary()
    again = models.loads_model(spark, m.saves())
    assert again.get_hash() == m.get_hash() and np.allclose(again.lam, m.lam) and models.DMR.loads(spark, m.saves(full=False)).rows is None
    with pytest.raises(ValueError):
        models.LDA.loads(spark, m.saves(full=False))
    assert m.lambdas.shape == (2, 4) and m.weights_of().count() == 8
    with pytest.raises(ValueError):
        models.LDA(2).add_doc("a string")
    one = models.SLDA(2, vars="l").add_doc(["a", "b", "a"], y=[1.0]).add_doc(["b", "c"], y=[2.0])
    one.train(2)
    assert one.estimate().count() == 2 and one.documents().count() == 2


def test_inference_alone_and_together(spark, docs):
    m = models.LDA(3, rm_top=2, seed=1).add(docs)
    m.train(10)
    before = m.n.copy()
    new = spark.createDataFrame([(7, THEMES[0] * 3), (8, THEMES[1] * 3), (9, ["none"])], "doc_id long, words array<string>")
    for together in (False, True):
        got = {r.doc_id: r for r in m.infer(m.make_docs(new), 6, together=together).collect()}
        assert set(got) == {7, 8} and all(r.ll < 0 and abs(sum(r.theta) - 1) < 1e-6 for r in got.values())
    assert (m.n == before).all()
    pa = models.PA(2, 3, seed=1).add(docs)
    pa.train(3)
    both = pa.infer(new, 4).first()
    assert len(both.theta) == 2 and len(both.sub) == 3 and abs(sum(both.sub) - 1) < 1e-6
    assert len(pa.sub_topics(0, 2)) == 2 and sum(r.n for r in pa.count_by_super_topic().collect()) == pa.n.sum() and pa.doc_sub_topics(2).count() == 90
    together = pa.infer(new, 4, together=True).collect()
    assert len(together) == 2
    s = models.SLDA(3, vars="l", seed=2).add(docs)
    s.train(6)
    y = {r.doc_id: r.y_hat[0] for r in s.estimate(new, 20).collect()}
    assert y[7] > y[8] and s.var_type(0) == "l" and s.regression_coef(0).shape == (3,)


def test_what_inference_adds_is_the_likelihood_of_the_document(spark, docs):
    """Words: the state with the document less the state without it."""
    m = models.LDA(3, seed=1).add(docs)
    m.train(3)
    made = m._inferred(docs.limit(1), 3)
    r = made.first()
    extra = np.zeros_like(m.n)
    np.add.at(extra, (r.wid, r.z), 1)
    before, n = m.word_ll(), m.n
    m.n = n + extra
    gain = m.word_ll() - before
    m.n = n
    nd = np.bincount(r.z, minlength=3)
    own = sum(math.lgamma(x + a) - math.lgamma(a) for x, a in zip(nd, m.alpha)) - math.lgamma(nd.sum() + m.alpha.sum()) + math.lgamma(m.alpha.sum())
    assert abs(r.ll - gain - own) < 1e-6


def test_tables_and_paths_agree_with_topics(spark, docs):
    m = models.HDP(3, seed=2).add(docs)
    m.train(6)
    seen = np.zeros(m.k)
    for r in m.rows.collect():
        topic = {}
        for t, z in zip(r.p, r.z):
            assert topic.setdefault(t, z) == z
        own = np.bincount(list(topic.values()), minlength=len(r.s))
        assert own.tolist() == r.s
        seen[: len(own)] += own
    assert (seen == m.tables).all() and m.num_tables == seen.sum() and 0.001 <= m.concentration <= 1e4
    assert m.n[:, m.tables == 0].sum() == 0
    h = models.HLDA(3, seed=2).add(docs)
    h.train(4)
    for r in h.rows.collect():
        assert set(r.z) <= set(r.p) and [h.level[k] for k in r.p] == [0, 1, 2] and h.parent[r.p[2]] == r.p[1]
    p = models.PT(2, p=4, seed=2).add(docs)
    p.train(11)
    assert p.sizes.sum() == 90 and abs(p.pseudo.sum() - p.n.sum()) < 1e-6 and p.pseudo_docs().count() == 90


def test_truncated_normals_and_densities():
    from topicloom.models.structured import normal_lls, truncated_normal

    u = (np.arange(20_000) + 0.5) / 20_000
    for a, b in ((-1.0, 2.0), (3.0, 8.0), (-8.0, -4.0), (0.5, 0.6)):
        x = truncated_normal(np.full(len(u), a), np.full(len(u), b), u)
        grid = np.linspace(a, b, 200_001)
        density = np.exp(-(grid**2) / 2)
        assert x.min() >= a and x.max() <= b and abs(x.mean() - (grid * density).sum() / density.sum()) < 2e-3
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    x, mean = np.array([[0.3, -1.0]]), np.array([0.1, 0.2])
    want = -0.5 * (x[0] - mean) @ np.linalg.solve(cov, x[0] - mean) - 0.5 * np.log(np.linalg.det(cov)) - np.log(2 * np.pi)
    assert abs(normal_lls(x, mean, np.linalg.inv(cov))[0] - want) < 1e-12


def test_coherence_at_a_point_of_time(spark, docs):
    from topicloom.operators.coherence import Coherence

    m = models.DT(2, t=2).add(docs)
    m.train(2)
    c = Coherence(docs, "c_npmi", model=m, top_n=4)
    scores = {r.topic: r.score for r in c.scores().collect()}
    assert abs(c.get_score(topic_id=1, timepoint=1) - scores[3]) < 1e-9 and abs(c.get_score() - np.mean(list(scores.values()))) < 1e-9
    with pytest.raises(ValueError):
        c.get_score(topic_id=1)
    assert abs(m.get_alpha(0).sum() - 1) < 1e-9 and abs(m.get_phi(0, 1).sum() - 1) < 1e-9 and len(m.topic_words_at(1, 1, 3)) == 3


def test_labels_restrict_topics(spark, docs):
    m = models.LLDA().add(docs)
    m.train(3)
    for r in m.doc_labels().groupBy("doc_id").agg(F.max_by("label", "p").alias("label")).collect():
        assert r.label == f"l{r.doc_id % 3}"


def test_dead_topics_go_and_hdp_becomes_lda(spark, docs):
    m = models.HDP(4, seed=4).add(docs)
    m.train(8)
    before = m.n[:, m.tables > 0].copy()
    live = m.live_k
    m.purge_dead_topics()
    assert m.k == live + 1 and np.allclose(m.n[:, :-1], before)
    lda, to = m.convert_to_lda(0.01)
    assert abs(lda.n.sum() - m.n.sum()) < 1e-6 and max(to) + 1 == lda.k
    lda.train(1)


def test_copies_do_not_share_training(spark, docs):
    m = models.LDA(2).add(docs)
    m.train(1)
    c = m.copy()
    c.train(2)
    assert m.global_step == 1 and c.global_step == 3 and m.doc_topic_dist().count() == 90


def test_callback_and_summary(spark, docs):
    seen = []
    m = models.LDA(2).add(docs)
    m.train(4, callback=lambda model, i, n: seen.append((i, n)), callback_interval=2)
    assert seen == [(2, 4), (4, 4)] and "topic 1 [" in m.summary()


def test_streaming_inference(spark, docs, tmp_path):
    from topicloom.streaming.documents import infer_stream, word_counts

    m = models.LDA(3).add(docs)
    m.train(2)
    docs.select("doc_id", "words").limit(10).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, words array<string>").parquet(str(tmp_path / "in"))
    q = infer_stream(m, stream, str(tmp_path / "out"), str(tmp_path / "ck"), iterations=3)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    spark.createDataFrame([("2024-01-01 00:10:00", "a b a"), ("2024-01-01 02:00:00", "a")], "t string, text string").selectExpr("cast(t as timestamp) as t", "text").write.parquet(str(tmp_path / "tx"))
    texts = spark.readStream.schema("t timestamp, text string").parquet(str(tmp_path / "tx"))
    q = word_counts(texts, time_col="t").writeStream.outputMode("complete").format("memory").queryName("words").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.word, r.n) for r in spark.table("words").collect()} == {("a", 2), ("b", 1), ("a", 1)}


def test_dynamic_topics_take_whole_langevin_steps():
    n, k, rate, var = 4000, 3, 0.01, 0.1
    block = SimpleNamespace(x=[[0.0]] * n, s=[None] * n, doc=np.arange(n), w=np.zeros((n, 0), int), counts=lambda k: np.zeros((n, k)))
    models.DT.kernel(block, {"alphas": np.zeros((1, k)), "like": None, "seed": 1, "var": var, "rate": rate}, 0)
    a = (1 - rate / 2 / var) ** 2
    assert abs(np.std(block.s) / np.sqrt(rate * (1 + a + a**2)) - 1) < 0.05
    m = models.DT(3, t=2, phi_var=1e6)
    m.logits = np.zeros((2, 2000, 3))
    m._drift(np.zeros((2, 2000, 3)), rate)
    assert abs(m.logits.std() / np.sqrt(5 * 2 * rate) - 1) < 0.05
