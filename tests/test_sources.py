import pytest
from pyspark.sql import functions as F

from topicloom.sources.corpus import Corpus, export_csv


def test_corpus_of_raw_texts(spark, tmp_path):
    c = Corpus(spark, stopwords=["the"]).process([("The cat sat", "001"), ("", "e"), ("the dog sat", "abc")])
    assert len(c) == 2 and c["abc"].first().words == [None, "dog", "sat"] and c[0].first().uid == "001" and c[-1].first().uid == "abc"
    assert c[0:1].count() == 1 and c[["001", "abc"]].count() == 2
    with pytest.raises(KeyError):
        c["none"]
    with pytest.raises(IndexError):
        c[5]
    with pytest.raises(ValueError):
        c.process([("more", "001")])
    c.save(str(tmp_path / "c"))
    assert len(Corpus.load(spark, str(tmp_path / "c"))) == 2


def test_corpus_of_words_and_phrases(spark):
    rows = spark.createDataFrame([(i, x.split()) for i, x in enumerate(("a b 0 d e", "a b 1 d e", "a b d e 2", "a b 3 d e", "a b 4 d e"))], "doc_id long, words array<string>")
    c = Corpus(spark).add(rows)
    cands = c.extract_ngrams(min_cf=5, min_df=5, min_score=0.5, normalized=True)
    assert c.concat_ngrams(cands)[2].first().words == ["a_b", "d_e", "2"]
    both = c.add(rows)
    assert len(both) == 10
    with pytest.raises(ValueError):
        Corpus(spark).add(rows.withColumn("raw", F.lit("x")))


def test_corpus_from_functions_and_values(spark):
    def pairs(raw, user):
        return [(w, raw.index(w), len(w)) if w != "-" else None for w in raw.split()] + ([user] if user else [])

    c = Corpus(spark, pairs, stopwords=lambda w: w == "b").process((t for t in [("a - b c", "u1", {"metadata": "x", "labels": ["l"]}), ("d", "u2"), "e"]), batch=2)
    doc = c.document("u1")
    assert doc.words == ["a", None, None, "c", "u1"] and doc.metadata == "x" and doc.labels == ["l"] and len(doc) == 5 and doc[3] == "c" and doc.raw == "a - b c"
    assert c[1].first().words == ["d", "u2"] and c[-1].first().words == ["e"]
    assert len(c.add_doc(raw="f g", uid="u3")) == 4 and c["u3"].first().words == ["f", "g", "u3"]
    assert sorted(r["at"] for r in c.permuted(1).collect()) == [0, 1, 2, 3] and {r.word for r in c.vocab.collect()} >= {"a", "c", "f"}
    with pytest.raises(ValueError):
        c.add_doc(["a"], raw="a")
    with pytest.raises(ValueError):
        Corpus(spark).process([("a", "u", {"nothing": 1})])
    d = Corpus(spark).add(spark.createDataFrame([(0, "It is, so")], "doc_id long, raw string")).document(0)
    assert d.spans == [(0, 2), (3, 5), (7, 9)]


def test_csv(spark, tmp_path):
    export_csv(spark.createDataFrame([(1, "x,y")], "a int, b string"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().b == "x,y"
