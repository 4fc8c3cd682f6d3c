import math
import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.operators import corpus, labeling, ngrams
from topicloom.plans import catalog


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def words(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, words array<string>")


def test_tokens_match_a_unicode_regex(spark):
    raw = ["Hello, World! x-y", None, "", " 　 a b\tc\x0bd ", "ÀÉ ß 中文 é"]
    got = corpus.tokens(texts(spark, *raw)).orderBy("doc_id", "pos").collect()
    pattern = re.compile(r"""[^\s.,;:'"?!<>(){}\[\]\\/`~@#$%^&*|]+""")
    assert [(r.doc_id, r.word) for r in got] == [(i, w.lower()) for i, t in enumerate(raw) for w in pattern.findall(t or "")]


def test_spans_cut_the_tokens_out(spark):
    raw = ["Hello,  World! \U0001f600 x", "  lead", "中文 (a)b"]
    t = texts(spark, *raw)
    got = corpus.spans(t).join(corpus.tokens(t, lowercase=False), ["doc_id", "pos"]).collect()
    assert got and all(raw[r.doc_id][r.start : r.start + r.len] == r.word for r in got)


def test_vocabulary_order_pruning_and_ties(spark):
    t = corpus.word_tokens(words(spark, ["b", "a", "a", "c"], ["a", "b", "d", None], ["a"]))
    v = {r.word: r for r in corpus.vocabulary(t, min_df=2, rm_top=1).collect()}
    assert v["a"].removed and not v["a"].used and v["b"].used and v["b"].wid == 0
    assert not v["c"].used and v["c"].wid is None and (v["a"].cf, v["a"].df) == (4, 3)
    assert corpus.vocabulary(t, min_df=200, rm_top=200).where("used").count() == 0
    tie = corpus.vocabulary(corpus.word_tokens(words(spark, ["z", "y"]))).orderBy("wid").collect()
    assert [r.word for r in tie] == ["z", "y"]
    assert corpus.vocabulary(t.limit(0)).count() == 0


def test_stopwords_as_list_predicate_and_table(spark):
    t = corpus.word_tokens(words(spark, ["a", "b", "c"], ["b"]))
    assert [r.word for r in corpus.without_stopwords(t, ["b"]).orderBy("doc_id", "pos").collect()] == ["a", "c"]
    assert corpus.without_stopwords(t, lambda w: w != "b").count() == 2
    holes = corpus.without_stopwords(t, t.where("word = 'b'"), keep_places=True).orderBy("doc_id", "pos").collect()
    assert [r.word for r in holes] == ["a", None, "c", None]


def test_tokenizer_merges_listed_phrases(spark):
    tok = corpus.SimpleTokenizer(stemmer=lambda w: w.rstrip("s"), ngram_list=["machine learning", "machine learning models"])
    got = tok.tokens(texts(spark, "Machines learning models, machine, learning")).orderBy("pos").collect()
    assert [r.word for r in got] == ["machine_learning_model", "machine", "learning"]
    assert (got[0].start, got[0].len) == (0, 24)
    with pytest.raises(ValueError):
        corpus.SimpleTokenizer(stemmer="no")


def test_collocations_of_the_small_corpus(spark):
    w = words(spark, *[x.split() for x in ("a b 0 d e", "a b 1 d e", "a b d e 2", "a b 3 d e", "a b 4 d e")])
    got = ngrams.extract_ngrams(w, min_cf=5, min_df=5, min_score=0.5, normalized=True).collect()
    assert {tuple(r.words): round(r.score, 9) for r in got} == {("a", "b"): 1.0, ("d", "e"): 1.0}
    hole = words(spark, *[["a", None, "b"]] * 5)
    assert ngrams.bigrams(hole, min_cf=1, min_df=1).count() == 0
    merged = corpus.merge_phrases(corpus.word_tokens(w), [tuple(r.words) for r in got]).where("doc_id = 0").orderBy("pos")
    assert [r.word for r in merged.collect()] == ["a_b", "0", "d_e"]


def test_phrase_concat_merges_every_phrase(spark, tmp_path):
    rng = random.Random(1)
    pairs = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(250)]
    texts = []
    for _ in range(12):
        rng.shuffle(pairs)
        texts.append(" ".join(f"first{p} second{p}" for p in pairs))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.word for r in catalog.QUERIES["phrase_concat"](spark, str(tmp_path)).select("word").distinct().collect()}
    assert got == {f"first{p}_second{p}" for p in pairs}
    with pytest.raises(ValueError):
        corpus.listed_phrases(spark.range(101).select(F.array(F.col("id").cast("string")).alias("words")), 100)


def test_longer_ngrams_and_short_documents(spark):
    w = words(spark, *[["x", "y", "z"]] * 4, ["x"], [])
    got = {tuple(r.words): r.cf for r in ngrams.ngrams(w, min_cf=2, min_df=2).collect()}
    assert got == {("x", "y", "z"): 4}


def test_branching_entropy_with_and_without_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    docs = [[rng.choice(["a", "b", "c", "d", "e", None]) for _ in range(rng.randint(0, 12))] for _ in range(60)] + [["x", "y"]] * 3
    rows = words(spark, *docs).repartition(5)
    pairs = {(r.w1, r.w2): ([], []) for r in ngrams.bigrams(rows, min_cf=3, min_df=2).collect()}
    for d in docs:
        for i in range(len(d) - 1):
            if (d[i], d[i + 1]) in pairs:
                pairs[d[i], d[i + 1]][0].append(d[i + 2] if i + 2 < len(d) else None)
                pairs[d[i], d[i + 1]][1].append(d[i - 1] if i else None)
    wanted = {k: [-sum(x.count(w) / len(x) * math.log(x.count(w) / len(x)) for w in set(x)) for x in sides] for k, sides in pairs.items()}
    for limit in (ngrams.MAX_LISTED, 0):
        monkeypatch.setattr(ngrams, "MAX_LISTED", limit)
        be = ngrams.branching_entropy(rows, min_cf=3, min_df=2)
        got = {(r.w1, r.w2): (r.rbe, r.lbe) for r in be.collect()}
        assert got.keys() == wanted.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], wanted[k]))
        assert got["x", "y"] == (0.0, 0.0)
        if limit:  # neighbours are counted inside the row: no token is joined, one small plan
            plan = be._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Window" not in plan and plan.count("Aggregate") == 2


def test_pmi_be_joins_pairs_only(spark):
    rng = random.Random(6)
    rows = words(spark, *[[rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(40)])
    made = ngrams.pmi_be(rows, min_cf=3, min_df=2)
    npmi = {(r.w1, r.w2): r for r in ngrams.scored_bigrams(rows, min_cf=3, min_df=2, normalized=True).collect()}
    be = {(r.w1, r.w2): r for r in ngrams.branching_entropy(rows, min_cf=3, min_df=2).collect()}
    got = {(r.w1, r.w2): r.score for r in made.collect()}
    assert got and got.keys() == npmi.keys() == be.keys()
    assert all(abs(got[k] - npmi[k].score * math.sqrt(be[k].rbe * be[k].lbe) / math.log(npmi[k].cf)) < 1e-9 for k in got)
    plan = made._jdf.queryExecution().optimizedPlan().toString()  # texts and pairs are read once, as tables
    assert plan.count("MapInArrow") == 2 and "Window" not in plan


def test_sentences_uids_and_concatenation(spark):
    t = words(spark, ["a", ".", "b", "c", None, ".", "d"])
    assert [(r.word, r.sent) for r in corpus.split_sentences(t, ".").orderBy("pos").collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    uid = spark.createDataFrame([("1",), ("1",), ("",), (None,), (None,), ("2",)], "uid string")
    assert {r.uid for r in corpus.uid_duplicates(uid).collect()} == {"1", ""}
    both = corpus.concat_corpora(words(spark, ["a"], ["b"]), words(spark, ["c"]))
    assert sorted(r.doc_id for r in both.collect()) == [0, 1, 2]


def test_count_words_by_weight(spark):
    t = corpus.word_tokens(words(spark, ["a", "a", "b"], ["b", "c"]))
    v = corpus.vocabulary(t)
    e = corpus.encode(t, v)
    idf = {r.word: r.w for r in corpus.with_idf(e).select("word", "w").distinct().collect()}
    assert round(idf["a"], 6) == 0.693147 and idf["b"] == 0
    assert corpus.count_vectors(e.withColumn("w", F.lit(1.0))).where("n = 2").count() == 1
    assert corpus.encode(corpus.word_tokens(words(spark, ["zzz"])), v).count() == 0


def random_lists(n=60, seed=1):
    rng = random.Random(seed)
    return [[rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(0, 14))] for _ in range(n)] + [[], ["a"]]


def test_counts_inside_rows_equal_counts_of_tokens(spark):
    rows = words(spark, *random_lists())
    both = [{tuple(r) for r in f.select("word", "cf", "df", "first_at").collect()} for f in (corpus.count_words(rows), corpus.cf_df(corpus.word_tokens(rows)))]
    assert both[0] == both[1] and corpus.count_words(rows.limit(0)).count() == 0


def test_lists_are_encoded_like_tokens(spark):
    rows = [(1, ["a", None, "b", "a"]), (2, []), (3, None), (4, ["c"]), (10**15, ["b", "c", "x", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, words array<string>")
    v = spark.createDataFrame([("a", 1, True), ("b", 0, True), ("c", None, False)], "word string, wid int, used boolean")
    for limit in (corpus.MAX_USED, 1):
        got = sorted(map(tuple, corpus.encode_lists(docs.repartition(2), v, limit=limit).collect()))
        assert got == [(1, [0, 2, 3], [1, 0, 1]), (10**15, [0, 3], [0, 1])]
    assert corpus.encode_lists(docs, v.where("not used")).collect() == []


def test_phrases_are_found_and_merged_like_one_by_one(spark):
    lists = random_lists(seed=2)
    rows = words(spark, *lists)
    phrases = [("a", "b"), ("a", "b", "c"), ("b", "c"), ("d", "d"), ("c",), ("x", "a")]
    want = {(i, j, p) for i, w in enumerate(lists) for p in phrases for j in range(len(w) - len(p) + 1) if tuple(w[j : j + len(p)]) == p}
    cand = spark.createDataFrame([(list(p),) for p in phrases], "words array<string>")
    assert {(r.doc_id, r.pos, tuple(r.words)) for r in ngrams.find_phrases(rows, cand).collect()} == want
    long = [p for p in phrases if len(p) > 1]
    merged = {r.doc_id: r.words for r in ngrams.Phraser(long)(rows).collect()}
    slow = corpus.word_documents(corpus.merge_phrases(corpus.word_tokens(rows), long))
    for r in slow.collect():
        assert merged[r.doc_id] == r.words, lists[r.doc_id]
    assert merged[len(lists) - 2] == [] and ngrams.find_phrases(rows, cand.limit(0)).count() == 0


def test_phrasers_are_saved(spark, tmp_path):
    p = ngrams.Phraser([("a", "b")], "+")
    p.save(str(tmp_path / "p"), spark)
    again = ngrams.Phraser.load(spark, str(tmp_path / "p"))
    assert again(words(spark, ["a", "b", "a"])).first().words == ["a+b", "a"] and again.find_all(words(spark, ["a", "b"])).count() == 1


def test_ngrams_and_labels_with_and_without_broadcast(spark, monkeypatch):
    from topicloom.operators import labeling

    lists = [[w or "e" for w in x] for x in random_lists(120, 3)]
    rows = words(spark, *lists)
    key = lambda df: sorted((tuple(r.words), r.cf) for r in df.collect())
    grams = ngrams.ngrams(rows, min_cf=3, min_df=2, max_len=4)
    cands = ngrams.bigrams(rows, min_cf=3, min_df=2).select(F.array("w1", "w2").alias("words"))
    dist = spark.createDataFrame([(z, i, w, 0.1 + 0.05 * ((i + z) % 3)) for z in range(2) for i, w in enumerate("abcde")], "z int, wid int, word string, p double")
    label = lambda: {(r.topic, r.label): round(r.score, 9) for r in labeling.topic_labels(dist, cands, rows, k=2, min_df=2).collect()}
    fast = key(grams), label()
    monkeypatch.setattr(ngrams, "MAX_LISTED", 0)
    monkeypatch.setattr(labeling, "MAX_DIST", 0)
    assert fast[0] and fast == (key(ngrams.ngrams(rows, min_cf=3, min_df=2, max_len=4)), label())


def test_names_and_html(spark):
    from topicloom.operators import explore, labeling

    t = texts(spark, "Deep learning, deep  Learning & Deep learning", "deep-learning", None)
    cand = spark.createDataFrame([(["deep", "learning"], 4)], "words array<string>, cf int")
    named = labeling.named_candidates(cand, labeling.surface_forms(t, cand)).first()
    assert named.name == "Deep learning" and set(named.names) == {"Deep learning", "deep  Learning"}
    rows = spark.createDataFrame([(1, "a <b> & c", [0, 3], [1, 1], [2, None]), (2, None, None, None, None)], "doc_id long, raw string, start array<int>, len array<int>, topic array<int>")
    got = {r.doc_id: r.html for r in explore.topic_html(rows).collect()}
    assert got == {1: '<span class="topic-2">a</span> &lt;b&gt; &amp; c', 2: None}


def test_names_of_phrases_that_fill_a_long_text(spark):
    t = texts(spark, "Ab cd " * 30_000, "ab, CD; 😀 ab  cd", "", "cd")  # copies of the text for all places are 5 GB
    cand = spark.createDataFrame([(["ab", "cd"],), (["cd", "ab"],), (["cd", "cd"],)], "words array<string>")
    forms = {(tuple(r.words), r.form): r.n for r in labeling.surface_forms(t, cand).collect()}
    assert forms == {(("ab", "cd"), "Ab cd"): 30_000, (("cd", "ab"), "cd Ab"): 29_999, (("ab", "cd"), "ab, CD"): 1, (("ab", "cd"), "ab  cd"): 1}
