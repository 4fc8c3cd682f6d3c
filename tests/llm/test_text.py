"""Tokens, mixing and reading levels, with awkward rows."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from topicloom.llm import mixing
from topicloom.llm.bpe import DEFAULT_VOCABULARY, SPLIT, Bpe, count_tokens, decode, encode
from topicloom.llm.reading_level import band, fit, fit_on, grade, reading_level, sentences, syllables

with open(DEFAULT_VOCABULARY, "rb") as f:
    LINES = f.read()
BPE = Bpe(LINES)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, LINES.splitlines())}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab theinTION'sré中\U0001f600 \n\t1<|>=_"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_and_round_trip(reference, text):
    assert BPE.encode(text) == reference.encode_ordinary(text) and BPE.decode(np.array(BPE.encode(text), int)) == text


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 9_000, " " * 4_000 + "x", "=-" * 5_000, "<|endoftext|>", "żółć" * 2_000, "0" * 9_999])
def test_long_and_odd_texts(reference, text):
    assert BPE.encode(text) == reference.encode_ordinary(text)


def test_encoding_rows(spark):
    rows = [(1, "Hello world", 0), (2, None, 0), (3, "", 0), (None, "x", 0), (1, "Hello world", 0), (4, "<|endoftext|>", 0), (5, " \n", 0), (6, "long " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = encode(df).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((i or 0, BPE.encode(t) if t else []) for i, t, _ in rows)
    back = {r.doc_id: r.text for r in decode(encode(df)).collect()}
    assert back[2] == back[3] == "" and back[4] == "<|endoftext|>" and back[6] == "long " * 20_000
    assert [r.n_tokens for r in count_tokens(df.where("doc_id in (2, 3)"), ["doc_id"]).collect()] == [0, 0]
    assert encode(df.limit(0)).count() == 0
    assert decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).orderBy("doc_id").collect() == [(1, None), (2, "")]
    with pytest.raises(FileNotFoundError):
        encode(df, vocabulary="/nowhere")


def test_another_vocabulary(spark):
    df = spark.createDataFrame([(1, "多言語 text")], "doc_id long, text string")
    path = DEFAULT_VOCABULARY.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    assert decode(encode(df, vocabulary=path), vocabulary=path).first().text == "多言語 text"


def mixed(spark, docs, weights):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int, h int")
    w = spark.createDataFrame(weights, "source string, target_share double, max_repeats int, tokens int")
    taken, report = mixing.mix(mixing.sized(d, w), w)
    return {r.doc_id: r.copies for r in taken.collect()}, {r.source: r for r in report.collect()}


def test_mixture_meets_budgets_and_marks_short_sources(spark):
    docs = [(i, "word " * 30, " Big" if i % 2 else "BIG ", 0, 0) for i in range(600)] + [(1000 + i, "word " * 30, "mid", 0, 0) for i in range(60)] + [(2000 + i, "word " * 30, "tiny", 0, 0) for i in range(3)]
    docs += [(3000, None, "big", 0, 0), (3001, "x", None, 0, 0), (3002, "x", "unlisted", 0, 0), (3003, "", "mid", 0, 0)]
    copies, report = mixed(spark, docs, [("big", 0.5, 1, 0), ("mid", 0.25, 4, 0), ("tiny", 0.2, 5, 0), ("none", 0.05, 2, 0), ("zero", 0.0, 1, 0)])
    one = len(BPE.encode("word " * 30))
    assert report["big"].all_tokens == 663 * one
    for s in ("big", "mid"):
        assert not report[s].short and 0 <= report[s].want - report[s].mixed_tokens < one
    assert report["tiny"].short and report["tiny"].mixed_tokens == 15 * one and report["none"].short and not report["zero"].short
    assert {c for i, c in copies.items() if 1000 <= i < 2000 and i != 3003} == {2, 3} and all(copies[2000 + i] == 5 for i in range(3))
    assert not {3001, 3002} & set(copies) and max(c for i, c in copies.items() if i < 600) == 1
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    fewer, _ = mixed(spark, docs, [("big", 0.3, 1, 0), ("mid", 0.25, 4, 0), ("tiny", 0.2, 5, 0)])
    assert {i for i in fewer if i < 600} <= {i for i in copies if i < 600}  # budgets are nested


def test_mixing_nothing(spark):
    copies, report = mixed(spark, [(1, None, None, 0, 0)], [("a", 0.5, None, 0), ("b", None, 2, 0)])
    assert not copies and not report["a"].short and report["a"].tokens == 0


EASY, HARD = "The cat sat on the mat. I like my red hat. We had fun at the big lake. He ran to me. ", "Heterogeneous identifiability characterises semantically inconsistent overdispersion, notwithstanding appropriately standardised methodological considerations. "
MIDDLE = "The older report was written in a hurry and should be checked again before the next meeting in town. "


def test_sentences_leave_markup_and_lists_out():
    text = "<p>One two e.g. three.</p> Four `code.x` five!\n- item one\nparam : int\n    desc, default 2.\niter=1 ll=2.\nv. 1.2 is six [4] seven?\x1b[0m\nno end"
    assert [" ".join(s) for s in sentences(text)] == ["one two eg three", "four five", "v is six seven"]
    assert sentences("") == [] and sentences("bro\r\nken wo​rd here.") == [["broken", "word", "here"]]
    assert [syllables(w) for w in ("cat", "make", "table", "reading", "the")] == [1, 1, 2, 2, 1]


def some_texts():
    rng = np.random.default_rng(6)
    parts = [EASY, MIDDLE, HARD]
    return ["".join(parts[k] for k in rng.choice(3, 6, p=p)) for p in rng.dirichlet([0.6] * 3, 300)]


def test_held_out_accuracy():
    texts = some_texts()
    model, errors, known = fit(texts[:200]), [], {}
    for t in texts[200:]:
        d = sentences(t)
        n = sum(map(len, d))
        errors.append(model.grades([d], known)[0] - grade(n / len(d), sum(syllables(w) for s in d for w in s) / n))
    assert np.sqrt(np.mean(np.square(errors))) < 1.0


def test_levels_of_rows(spark):
    rows = [(1, EASY * 4, "en", 0), (2, HARD * 6, "EN-us", 0), (3, MIDDLE * 5, " English ", 0), (4, EASY, "de", 0), (5, EASY, None, 0), (6, None, "en", 0), (7, "", "en", 0), (8, "- a\n- b", "en_GB", 0), (None, EASY * 500, "eng", 0), (1, EASY * 4, "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, grade int")
    taught = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(100 + i, t, "en") for i, t in enumerate(some_texts())], "doc_id long, text string, lang string"))
    got = reading_level(df, fit_on(taught)).withColumn("band", band(F.col("grade"))).collect()
    bands = {r.doc_id: r.band for r in got}
    assert len(got) == 8 and bands[1] == "basic" and bands[2] == "advanced" and bands[3] == "middle" and bands[6] is bands[7] is bands[8] is None
    assert reading_level(df.limit(0), fit([])).count() == 0
