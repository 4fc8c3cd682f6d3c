"""Queries on corpora, tokenizers, phrases and labels through their public objects, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import corpus, labeling, ngrams
from topicloom.operators.coherence import Coherence
from topicloom.plans.catalog import _IDF, _N4, _PAT, _TW, BG, STOP, TOK, WD, WS, _CONF, _DOCU, _PROB, docs, judged, query, read, word_docs
from topicloom.sources.corpus import Corpus
from topicloom.sources.tables import table, written

_STOPS = ", ".join(repr(w) for w in STOP)


@query("doc_id:bigint pos:int word:string", f"with {TOK} select doc_id, pos, case when word not in ({_STOPS}) then word end as word from tok")
def corpus_add_raw(spark, d):
    c = Corpus(spark, stopwords=STOP).add(docs(spark, d).select("doc_id", F.col("text").alias("raw")))
    return corpus.word_tokens(c.docs)


_NATION = f"n as (select n_nationkey as k, n_name as raw from nation order by n_nationkey), nw as (select row_number() over (order by k) - 1 as doc_id, cast(k as varchar) as uid, raw, list_transform(regexp_extract_all(raw, '{_PAT}'), lambda x: lower(x)) as words from n)"


def _nations(spark, d, tokenizer=None) -> Corpus:
    """A corpus fed from Python: the names of the nations, with uid and metadata."""
    feed = ((r["n_name"], str(r["n_nationkey"]), {"metadata": f"r{r['n_regionkey']}"}) for r in table(spark, d, "nation").orderBy("n_nationkey").toLocalIterator())
    return Corpus(spark, tokenizer).process(feed, batch=10)


@query("doc_id:bigint uid:string metadata:string words:string[]", f"with {_NATION} select nw.doc_id, uid, 'r' || n_regionkey as metadata, words from nw join nation on cast(n_nationkey as varchar) = uid")
def corpus_process(spark, d):
    return _nations(spark, d).docs


@query("uid:string words:string[]", f"with {_NATION} select uid, words from nw where doc_id in (3, 5, 7) or uid = '11'")
def corpus_index(spark, d):
    c = _nations(spark, d)
    return c[3:8:2].select("uid", "words").unionByName(c["11"].select("uid", "words"))


@query("uid:string words:string[]", "select cast(n_nationkey as varchar) as uid, [upper(n_name[1:2]), cast(n_nationkey as varchar)] as words from nation")
def tokenizer_callable(spark, d):
    """Words from a Python function of (raw, user data)."""
    return _nations(spark, d, lambda raw, uid: [(raw[:2].upper(), 0, 2), uid]).docs


@query("doc_id:bigint pos:int word:string start:int len:int", f"with g as (select doc_id, unnest(range(len(t))) as pos, unnest(t) as w, unnest(list_transform(s[1:len(t)], lambda x: length(x))) as gap from (select doc_id, regexp_extract_all(text, '{_PAT}') as t, string_split_regex(text, '{_PAT}') as s from documents where text is not null)) select doc_id, pos, regexp_replace(lower(w), '(ing|ed|s)$', '') as word, sum(gap + length(w)) over (partition by doc_id order by pos) - length(w) as start, length(w) as len from g")
def tokenizer_stemmed(spark, d):
    import re

    return corpus.SimpleTokenizer(stemmer=lambda w: re.sub("(ing|ed|s)$", "", w, count=1)).tokens(docs(spark, d))


_SPACED = "' ' || array_to_string(words, '  ') || ' '"


@query("doc_id:bigint words:string[]", f"with {WD}, j as (select doc_id, replace(replace({_SPACED}, ' of  the ', ' of_the '), ' the  same ', ' the_same ') as t from wd) select doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') as words from j")
def phraser_merge(spark, d):
    return ngrams.Phraser([("of", "the"), ("the", "same"), ("of", "the")])(word_docs(spark, d))


@query("words:string[] n:bigint docs:bigint", f"with {WD}, p as (select doc_id, unnest(words[1:n-1]) as a, unnest(words[2:n]) as b from wd where n > 1) select [a, b] as words, count(*) as n, count(distinct doc_id) as docs from p where a || ' ' || b in ('of the', 'in the', 'to be') group by a, b")
def phraser_find(spark, d):
    found = ngrams.Phraser([("of", "the"), ("in", "the"), ("to", "be")]).find_all(word_docs(spark, d))
    return found.groupBy("words").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("n:bigint least:double", f"select count(*) as n, min(score) as least from (select score from ({_N4}) where score >= 0.3 order by score desc limit 40)")
def ngram_capped(spark, d):
    found = ngrams.extract_ngrams(word_docs(spark, d), max_len=4, max_cand=40, min_score=0.3, normalized=True)
    return found.agg(F.count("*").alias("n"), F.min("score").alias("least"))


@query("entropy:double", f"with {_IDF}, s as (select w * n / (select sum(w * n) from idf) as p from idf) select -sum(p * ln(p + 1e-20)) as entropy from s")
def entropy_weighted(spark, d):
    a, _ = read(spark, d)
    return corpus.entropy(corpus.with_idf(a.drop("w")).groupBy("wid").agg(F.sum("w").alias("n")), "n")


@query("words:string[] name:string forms:bigint", f"""with {BG}, x as (select doc_id, text, unnest(range(len(t) - 1)) as i, t, list_transform(s[1:len(t)], lambda g: length(g)) as g from (select doc_id, text, regexp_extract_all(text, '{_PAT}') as t, string_split_regex(text, '{_PAT}') as s from documents where text is not null) where len(t) > 1),
 f as (select lower(t[i+1]) as w1, lower(t[i+2]) as w2, t[i+1] || substring(text, cast(list_sum(g[1:i+1]) + list_sum(list_transform(t[1:i+1], lambda q: length(q))) as bigint) + 1, g[i+2]) || t[i+2] as form from x),
 c as (select w1, w2, form, count(*) as n from f join bg using (w1, w2) where bg.cf >= 100 group by all), r as (select *, row_number() over (partition by w1, w2 order by n desc, form) as rn, count(*) over (partition by w1, w2) as forms from c) select [w1, w2] as words, form as name, forms from r where rn = 1""")
def label_names(spark, d):
    """The most frequent spelling of frequent pairs, and the number of spellings."""
    cands = written(ngrams.bigrams(word_docs(spark, d)).where("cf >= 100").select(F.array("w1", "w2").alias("words"), "cf", "df"), "candidates")  # read twice
    named = labeling.named_candidates(cands, labeling.surface_forms(docs(spark, d), cands))
    return named.select("words", "name", F.size("names").alias("forms"))


@query("topic:int score:double", f"with {_TW}, {_DOCU}, {_PROB} select topic, avg({_CONF['logcond']}) as score from mx where rb < ra and topic = 1 group by topic")
def coherence_of_words(spark, d):
    words = [r["word"] for r in judged(spark, d).where("topic = 1").orderBy("rank_no").collect()]
    score = Coherence(word_docs(spark, d), "u_mass").get_score(words=words)
    return spark.createDataFrame([(1, score)], "topic int, score double")


@query("word:string cf:bigint df:bigint", f"with {WS}, t as (select doc_id, unnest(words) as word from ws) select word, count(*) as cf, count(distinct doc_id) as df from t group by word")
def corpus_vocab(spark, d):
    return Corpus(spark).add(word_docs(spark, d)).vocab
