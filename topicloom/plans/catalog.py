"""Deterministic queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.special import legendre
from topicloom.functions.text import TOKEN_PATTERN, token_list
from topicloom.operators import coherence as coh
from topicloom.operators import corpus, explore, labeling, ngrams, readout
from topicloom.sources.tables import spread, table, written

K, ALPHA, ETA, MIN_DF, RM_TOP = 5, 0.1, 0.01, 5, 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_DUCK = {"string": "varchar", "string[]": "varchar[]"}
_SPARK = {"string[]": "array<string>"}


def query(spec: str, sql: str):
    """Register a builder (spark, folder) -> DataFrame and its SQL. spec: "column:type ..."; both sides
    are cast to it, doubles rounded to 6 digits."""
    cols = [c.split(":") for c in spec.split()]

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = build(spark, d)
            return df.select(*[(F.round(F.col(c).cast("double"), 6) if t == "double" else F.col(c).cast(_SPARK.get(t, t))).alias(c) for c, t in cols])

        QUERIES[build.__name__] = run
        if sql:
            outer = ", ".join(f"round(cast({c} as double), 6) as {c}" if t == "double" else f"cast({c} as {_DUCK.get(t, t)}) as {c}" for c, t in cols)
            SQL[build.__name__] = f"select {outer} from ({sql})"
        return build

    return add


# --- the corpus -------------------------------------------------------------------------------------


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars").where("text is not null"))


def toks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.tokens(docs(spark, d))


def word_docs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", token_list(F.col("text")).alias("words")).where(F.size("words") > 0)


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return corpus.vocabulary(word_docs(spark, d), min_df=MIN_DF, rm_top=RM_TOP)


def assigned(spark: SparkSession, d: str, v: DataFrame, k: int = K) -> DataFrame:
    """A fixed assignment of topics to the used tokens, which any engine can repeat."""
    z = F.pmod(F.col("doc_id") * 31 + F.col("pos") * 17 + F.col("wid"), F.lit(k)).cast("int")
    return corpus.encode(toks(spark, d), v).select("doc_id", "pos", "word", "wid", z.alias("z"), F.lit(1.0).alias("w"))


def read(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Assigned tokens, written once since most read-outs use them more than once, and vocabulary."""
    v = vocab(spark, d)
    return written(assigned(spark, d, v), "assigned"), v


def read_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The tokens of read in a row for each document, (doc_id, pos, wid, z), lists but the first; vocabulary."""
    v = vocab(spark, d)
    z = F.zip_with("pos", "wid", lambda pos, wid: F.pmod(F.col("doc_id") * 31 + pos * 17 + wid, F.lit(K)).cast("int"))
    return written(corpus.encode_lists(word_docs(spark, d), v).withColumn("z", z), "assigned"), v


_PAT = TOKEN_PATTERN.replace("'", "''")
WS = f"ws as (select doc_id, list_transform(regexp_extract_all(text, '{_PAT}'), lambda x: lower(x)) as words, text, lang, source, n_chars from documents where text is not null)"
WD = f"{WS}, wd as (select doc_id, words, len(words) as n from ws where len(words) > 0)"
TOK = f"{WS}, tok as (select doc_id, unnest(range(len(words))) as pos, unnest(words) as word from ws)"
VOC = f"""{TOK}, voc0 as (select word, count(*) as cf, count(distinct doc_id) as df, min(doc_id * 16777216 + pos) as first_at from tok group by word),
 voc1 as (select *, df >= {MIN_DF} as pass, row_number() over (order by (df >= {MIN_DF}) desc, cf desc, df desc, first_at) as rn from voc0),
 voc as (select word, cf, df, first_at, pass and rn > {RM_TOP} as used, rn <= {RM_TOP} as removed, case when pass and rn > {RM_TOP} then rn - {RM_TOP} - 1 end as wid from voc1)"""
ASG = f"{VOC}, asg as (select t.doc_id, t.pos, t.word, v.wid, (t.doc_id * 31 + t.pos * 17 + v.wid) % {K} as z from tok t join voc v on t.word = v.word where v.used)"
KS = f"ks as (select unnest(range({K})) as z), vv as (select count(*) as v from voc where used)"
PHI = f"""{ASG}, {KS}, nkw as (select z, wid, count(*) as n from asg group by z, wid), nk as (select ks.z, count(asg.wid) as n from ks left join asg on asg.z = ks.z group by ks.z),
 phi as (select ks.z, voc.wid, voc.word, (coalesce(nkw.n, 0) + {ETA}::double) / (nk.n + vv.v * {ETA}::double) as p from ks cross join (select * from voc where used) voc cross join vv join nk on nk.z = ks.z left join nkw on nkw.z = ks.z and nkw.wid = voc.wid)"""
THETA = f"""{ASG}, {KS}, ndk as (select doc_id, z, count(*) as n from asg group by doc_id, z), nd as (select doc_id, count(*) as n from asg group by doc_id),
 theta as (select nd.doc_id, ks.z, (coalesce(ndk.n, 0) + {ALPHA}::double) / (nd.n + {K} * {ALPHA}::double) as p from nd cross join ks left join ndk on ndk.doc_id = nd.doc_id and ndk.z = ks.z)"""
LG = f"(case when n > 0 then lgamma(n + {ALPHA}) - lgamma({ALPHA}) else 0 end)"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    v = vocab(spark, d)
    return v.where("used").orderBy("wid").limit(20).select("word", "cf", "df")


# --- tokens and vocabulary --------------------------------------------------------------------------


@query("word:string n:bigint", f"with {TOK} select word, count(*) as n from tok group by word")
def tok_counts(spark, d):
    return toks(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query("doc_id:bigint pos:int start:int len:int", f"""with g as (select doc_id, unnest(range(len(t))) as pos, unnest(list_transform(t, lambda x: length(x))) as len, unnest(list_transform(s[1:len(t)], lambda x: length(x))) as gap
 from (select doc_id, regexp_extract_all(text, '{_PAT}') as t, string_split_regex(text, '{_PAT}') as s from documents where text is not null))
 select doc_id, pos, sum(gap + len) over (partition by doc_id order by pos) - len as start, len from g""")
def tok_spans(spark, d):
    return corpus.spans(docs(spark, d))


STOP = ["the", "a", "of", "and", "to", "in", "is", "it"]


@query("doc_id:bigint pos:int word:string", f"with {TOK} select doc_id, pos, word from tok where word not in ({', '.join(repr(w) for w in STOP)})")
def tok_stopword_anti(spark, d):
    return corpus.without_stopwords(toks(spark, d), STOP)


@query("doc_id:bigint holes:bigint words:bigint", f"with {TOK} select doc_id, count(*) filter (where word in ({', '.join(repr(w) for w in STOP)})) as holes, count(*) filter (where word not in ({', '.join(repr(w) for w in STOP)})) as words from tok group by doc_id")
def tok_stopword_holes(spark, d):
    return corpus.without_stopwords(toks(spark, d), STOP, keep_places=True).groupBy("doc_id").agg(F.sum(F.col("word").isNull().cast("int")).alias("holes"), F.count("word").alias("words"))


@query("word:string cf:bigint df:bigint first_at:bigint", f"with {VOC} select * from voc0")
def vocab_cf_df(spark, d):
    return corpus.count_words(word_docs(spark, d))


@query("word:string wid:int cf:bigint df:bigint", f"with {VOC} select word, wid, cf, df from voc where used")
def vocab_used(spark, d):
    return vocab(spark, d).where("used")


@query("word:string cf:bigint", f"with {VOC} select word, cf from voc where removed")
def vocab_removed_top(spark, d):
    return vocab(spark, d).where("removed")


@query("num_docs:bigint num_words:bigint num_vocabs:bigint used_vocabs:bigint", f"with {ASG} select (select count(distinct doc_id) from asg) as num_docs, (select count(*) from asg) as num_words, (select count(*) from voc) as num_vocabs, (select count(*) from voc where used) as used_vocabs")
def corpus_sizes(spark, d):
    a, v = read(spark, d)
    n = a.agg(F.countDistinct("doc_id").alias("num_docs"), F.count("*").alias("num_words"))
    return n.crossJoin(v.agg(F.count("*").alias("num_vocabs"), F.sum(F.col("used").cast("long")).alias("used_vocabs")))


_IDF = f"{ASG}, idf as (select wid, ln((select count(distinct doc_id) from asg) / count(distinct doc_id)::double) as w, count(*) as n from asg group by wid)"
_PMI = f"""{ASG}, tf as (select doc_id, wid, count(*) as tf from asg group by doc_id, wid), ln_ as (select doc_id, count(*) as l from tok group by doc_id),
 pmi as (select tf.doc_id, tf.wid, tf.tf, greatest(ln(tf.tf / (voc.cf / (select sum(cf) from voc)::double) / ln_.l), 0) as w from tf join voc using (wid) join ln_ on ln_.doc_id = tf.doc_id where voc.used)"""


@query("wid:int w:double", f"with {_IDF} select wid, w from idf")
def weights_idf(spark, d):
    a, _ = read(spark, d)
    return corpus.with_idf(a.drop("w")).select("wid", "w").distinct()


@query("doc_id:bigint wid:int w:double", f"with {_PMI} select doc_id, wid, w from pmi")
def weights_pmi(spark, d):
    a, v = read(spark, d)
    return corpus.with_pmi(a.drop("w"), v, toks(spark, d)).select("doc_id", "wid", "w").distinct()


@query("wid:int n:double", f"with {_IDF} select wid, w * n as n from idf")
def weighted_vocab_freq(spark, d):
    a, _ = read(spark, d)
    return corpus.with_idf(a.drop("w")).groupBy("wid").agg(F.sum("w").alias("n"))


@query("entropy:double", f"with {VOC}, s as (select cf / (select sum(cf) from voc where used)::double as p from voc where used) select -sum(p * ln(p + 1e-20)) as entropy from s")
def vocab_entropy(spark, d):
    return corpus.entropy(vocab(spark, d).where("used"), "cf")


@query("word:string form:string n:bigint", f"with {VOC}, f as (select unnest(regexp_extract_all(text, '{_PAT}')) as form from documents where text is not null) select lower(form) as word, form, count(*) as n from f where lower(form) in (select word from voc where used) group by form")
def word_forms(spark, d):
    return corpus.word_forms(docs(spark, d), vocab(spark, d))


@query("doc_id:bigint wid:int n:double", f"with {ASG} select doc_id, wid, count(*) as n from asg group by doc_id, wid")
def doc_count_vector(spark, d):
    return corpus.count_vectors(read(spark, d)[0])


@query("doc_id:bigint rank_no:int word:string share:double", f"with {TOK}, c as (select doc_id, word, count(*) as c from tok group by doc_id, word), r as (select doc_id, word, c / sum(c) over (partition by doc_id)::double as share, row_number() over (partition by doc_id order by c desc, word) as rank_no from c) select * from r where rank_no <= 10")
def doc_top_words(spark, d):
    return corpus.doc_top_words(toks(spark, d))


@query("uid:string n:bigint", "select uid, count(*) as n from tmdocs where uid is not null group by uid having count(*) > 1 or uid = ''")
def uid_duplicates(spark, d):
    return corpus.uid_duplicates(table(spark, d, "tmdocs"))


_OWN = "o as (select doc_id, words from (select *, row_number() over (partition by doc_id order by added_at) as r from tmdocs where doc_id is not null) where r = 1 and len(words) > 0)"


@query("doc_id:bigint n:bigint", f"with {WD} select doc_id, n from wd union all select doc_id + 1 + (select max(doc_id) from wd), len(words) from (with {_OWN} select * from o)")
def corpus_concat(spark, d):
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("added_at")) == 1
    own = table(spark, d, "tmdocs").where("doc_id is not null").withColumn("_1", first).where("_1").where(F.size("words") > 0).select("doc_id", "words")
    both = corpus.concat_corpora(word_docs(spark, d), own)
    return both.select("doc_id", F.size("words").alias("n"))


@query("wid:int word:string other_wid:int", f"""with {VOC}, t2 as (select doc_id, lower(unnest(words)) as word from tmdocs where doc_id is not null),
 c2 as (select word, count(*) as cf, count(distinct doc_id) as df from t2 where word is not null group by word), o2 as (select word, row_number() over (order by cf desc, df desc, word) - 1 as wid from c2 where df >= 5)
 select voc.wid, voc.word, coalesce(o2.wid, -1) as other_wid from voc left join o2 using (word) where used""")
def vocab_remap_oov(spark, d):
    t2 = table(spark, d, "tmdocs").where("doc_id is not null").select("doc_id", F.explode("words").alias("word")).withColumn("word", F.lower("word")).where("word is not null")
    counted = t2.groupBy("word").agg(F.count("*").alias("cf"), F.countDistinct("doc_id").alias("df")).where("df >= 5")
    other = corpus.numbered(counted, F.desc("cf"), F.desc("df"), F.asc("word")).select("word", F.lit(True).alias("used"), (F.col("rn") - 1).alias("wid"))
    return corpus.remap(vocab(spark, d), other)


@query("doc_id:bigint pos:int word:string sent:int", f"with {TOK}, s as (select *, sum((word = 'and')::int) over (partition by doc_id order by pos) as sent from tok) select doc_id, pos, word, sent from s where word <> 'and'")
def sentence_split(spark, d):
    return corpus.split_sentences(word_docs(spark, d), "and")


@query("doc_id:bigint words:string[]", f"with {WD} select doc_id, words from wd")
def doc_words_in_order(spark, d):
    return corpus.word_documents(toks(spark, d))


@query("lang:string docs:bigint words:bigint least:bigint most:bigint mean:double deviation:double", f"with {WD} select lang, count(*) as docs, sum(n) as words, min(n) as least, max(n) as most, avg(n) as mean, stddev_pop(n) as deviation from wd join documents using (doc_id) group by lang")
def metadata_counts(spark, d):
    n = docs(spark, d).select("lang", F.size(token_list(F.col("text"))).alias("n")).where("n > 0")
    return n.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("words"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


# --- n-grams ----------------------------------------------------------------------------------------

BG = f"""{WD}, un as (select word, count(*) as cf, count(distinct doc_id) as df from (select doc_id, unnest(words) as word from wd) group by word),
 pr as (select doc_id, unnest(range(n - 1)) as pos, unnest(words[1:n-1]) as w1, unnest(words[2:n]) as w2 from wd where n > 1),
 bg as (select w1, w2, count(*) as cf, count(distinct doc_id) as df from pr where w1 in (select word from un where cf >= 10 and df >= 5) and w2 in (select word from un where cf >= 10 and df >= 5) group by w1, w2 having count(*) >= 10 and count(distinct doc_id) >= 5),
 nn as (select sum(cf)::double as n from un)"""
_PMI2 = f"with {BG} select w1, w2, bg.cf, bg.df, ln(bg.cf * n / a.cf / b.cf) as pmi, ln(n / bg.cf) as h from bg join un a on a.word = w1 join un b on b.word = w2, nn"


@query("w1:string w2:string cf:bigint df:bigint score:double", f"select w1, w2, cf, df, pmi as score from ({_PMI2})")
def bigram_pmi(spark, d):
    return ngrams.scored_bigrams(word_docs(spark, d))


@query("w1:string w2:string cf:bigint df:bigint score:double", f"select w1, w2, cf, df, pmi / h as score from ({_PMI2})")
def bigram_npmi(spark, d):
    return ngrams.scored_bigrams(word_docs(spark, d), normalized=True)


NG = f"""{BG}, tk as (select doc_id, unnest(range(n)) as pos, unnest(words) as w from wd),
 ok as (select pr.doc_id, pr.pos from pr join bg using (w1, w2)),
 g3 as (select [a.w, b.w, c.w] as words, count(*) as cf from ok p join ok q on q.doc_id = p.doc_id and q.pos = p.pos + 1 join tk a on a.doc_id = p.doc_id and a.pos = p.pos join tk b on b.doc_id = p.doc_id and b.pos = p.pos + 1 join tk c on c.doc_id = p.doc_id and c.pos = p.pos + 2 group by all having count(*) >= 10),
 g4 as (select [a.w, b.w, c.w, e.w] as words, count(*) as cf from ok p join ok q on q.doc_id = p.doc_id and q.pos = p.pos + 1 join ok r on r.doc_id = p.doc_id and r.pos = p.pos + 2 join tk a on a.doc_id = p.doc_id and a.pos = p.pos join tk b on b.doc_id = p.doc_id and b.pos = p.pos + 1 join tk c on c.doc_id = p.doc_id and c.pos = p.pos + 2 join tk e on e.doc_id = p.doc_id and e.pos = p.pos + 3 group by all having count(*) >= 10),
 gs as (select * from g3 union all select * from g4), gx as (select words, cf, unnest(words) as word from gs),
 gf as (select gx.words, gx.cf, sum(ln((select n from nn) / un.cf)) as s from gx join un using (word) group by gx.words, gx.cf),
 b2 as (select [w1, w2] as words, pmi / h as score, cf, df from ({_PMI2.replace('with ' + BG, '')}))
"""
_N4 = f"""with {NG} select words, score, cf, df from (select words, score, cf, df from b2 union all
 select words, (ln(cf) - ln((select n from nn)) + s) / ((ln((select n from nn)) - ln(cf)) * (len(words) - 1)), cf, 0 from gf)"""


@query("words:string[] score:double cf:bigint df:bigint", _N4)
def ngram_npmi(spark, d):
    return ngrams.extract_ngrams(word_docs(spark, d), max_len=4, max_cand=10_000_000, normalized=True)


@query("words:string[] score:double cf:bigint df:bigint", f"select * from ({_N4}) where score >= 0 union all (with {BG} select [word], 0, cf, df from un where cf >= 10 and df >= 5)")
def pmi_candidates_with_unigrams(spark, d):
    return ngrams.pmi_candidates(word_docs(spark, d), max_len=4, max_cand=10_000_000, normalized=True)


_BE = f"""with {BG}, ctx as (select doc_id, unnest(range(n - 1)) as pos, unnest(words[1:n-1]) as w1, unnest(words[2:n]) as w2, unnest(list_concat([null], words[1:n-2])) as b, unnest(list_concat(words[3:n], [null])) as a from wd where n > 1),
 cx as (select ctx.* from ctx join bg using (w1, w2)),
 r as (select w1, w2, -sum(p * ln(p)) as rbe from (select w1, w2, count(*) / sum(count(*)) over (partition by w1, w2)::double as p from cx group by w1, w2, a) group by w1, w2),
 l as (select w1, w2, -sum(p * ln(p)) as lbe from (select w1, w2, count(*) / sum(count(*)) over (partition by w1, w2)::double as p from cx group by w1, w2, b) group by w1, w2)"""


@query("w1:string w2:string rbe:double lbe:double", f"{_BE} select w1, w2, rbe, lbe from r join l using (w1, w2)")
def branching_entropy(spark, d):
    return ngrams.branching_entropy(word_docs(spark, d))


@query("w1:string w2:string score:double", f"{_BE} select w1, w2, pmi / h * sqrt(greatest(rbe * lbe, 0)) / ln(cf) as score from (select w1, w2, bg.cf, ln(bg.cf * n / x.cf / y.cf) as pmi, ln(n / bg.cf) as h from bg join un x on x.word = w1 join un y on y.word = w2, nn) join r using (w1, w2) join l using (w1, w2)")
def bigram_pmi_be(spark, d):
    return ngrams.pmi_be(word_docs(spark, d))


@query("doc_id:bigint pos:int word:string", "")
def phrase_concat(spark, d):
    found = ngrams.extract_ngrams(word_docs(spark, d), max_len=3, max_cand=corpus.MAX_PHRASES + 1, min_score=0.5, normalized=True)
    merged = ngrams.Phraser(corpus.listed_phrases(found))(word_docs(spark, d))
    return corpus.word_tokens(merged)


# --- read-outs --------------------------------------------------------------------------------------


@query("z:int wid:int n:double", f"with {ASG} select z, wid, count(*) as n from asg group by z, wid")
def topic_word_counts(spark, d):
    return readout.topic_word_counts(read(spark, d)[0])


@query("doc_id:bigint z:int n:double", f"with {ASG} select doc_id, z, count(*) as n from asg group by doc_id, z")
def doc_topic_counts(spark, d):
    return readout.doc_topic_counts(read(spark, d)[0])


@query("z:int wid:int word:string p:double", f"with {PHI} select * from phi")
def topic_word_dist(spark, d):
    a, v = read(spark, d)
    return readout.topic_word_dist(a, v, K, ETA)


_TOP = f"{PHI}, top as (select z, word, p, row_number() over (partition by z order by p desc, wid) as rank_no from phi)"


@query("z:int rank_no:int word:string p:double", f"with {_TOP} select * from top where rank_no <= 10")
def topic_top_words(spark, d):
    a, v = read(spark, d)
    return readout.topic_top_words(readout.topic_word_dist(a, v, K, ETA))


@query("doc_id:bigint z:int p:double", f"with {THETA} select * from theta")
def doc_topic_dist(spark, d):
    return readout.doc_topic_dist(read(spark, d)[0], K, ALPHA)


@query("doc_id:bigint rank_no:int z:int p:double", f"with {THETA} select * from (select doc_id, z, p, row_number() over (partition by doc_id order by p desc, z) as rank_no from theta) where rank_no <= 3")
def doc_top_topics(spark, d):
    return readout.doc_top_topics(readout.doc_topic_dist(read(spark, d)[0], K, ALPHA))


@query("z:int n:bigint", f"with {ASG} select z, count(*) as n from asg group by z")
def count_by_topics(spark, d):
    return readout.count_by_topics(read(spark, d)[0])


_DLL = f"{ASG}, dll as (select doc_id, sum({LG}) - (lgamma(sum(n) + {K * ALPHA}) - lgamma({K * ALPHA})) as ll from (select doc_id, z, count(*) as n from asg group by doc_id, z) group by doc_id)"
_SLL = f"""{_DLL}, sll as (select (select sum(lgamma(n + {ETA}) - lgamma({ETA})) from (select count(*) as n from asg group by z, wid)) - (select sum(lgamma(n + v * {ETA}) - lgamma(v * {ETA})) from (select count(*) as n from asg group by z), (select count(*) as v from voc where used)) as ll)"""


@query("doc_id:bigint ll:double", f"with {_DLL} select * from dll")
def doc_ll(spark, d):
    return readout.doc_ll(read(spark, d)[0], K, ALPHA)


@query("ll:double", f"with {_SLL} select ll from sll")
def state_ll(spark, d):
    a, v = read(spark, d)
    return readout.state_ll(a, v, ETA)


@query("ll_per_word:double perplexity:double", f"with {_SLL}, x as (select ((select sum(ll) from dll) + (select ll from sll)) / (select count(*) from asg) as ll_per_word) select ll_per_word, exp(-ll_per_word) as perplexity from x")
def perplexity(spark, d):
    a, v = read(spark, d)
    return readout.ll_per_word(a, v, K, ALPHA, ETA)


_MAXN = "(select max(c) from (select count(*) as c from asg group by doc_id))"
_DIG = f"""with {ASG}, cnt as (select doc_id, z, count(*) as n from asg group by doc_id, z), tot as (select doc_id, count(*) as n from asg group by doc_id), i as (select unnest(range({_MAXN})) as i),
 num as (select z, sum(case when i < n then 1 / ({ALPHA}::double + i) end) as s from cnt join i on i < n group by z), den as (select sum(1 / ({K * ALPHA}::double + i)) as s from tot join i on i < n)"""


@query("z:int alpha:double", f"{_DIG} select z, greatest(num.s / den.s * {ALPHA}::double, 1e-5) as alpha from num, den")
def alpha_fixed_point(spark, d):
    return readout.alpha_step(read(spark, d)[0], K, [ALPHA] * K)


def _sweep_sql(source: str, out: str, seed: str, allowed: str = "") -> str:
    mask = f"case when {allowed} then " if allowed else ""
    end = " else 0 end" if allowed else ""
    return f"""{out}_kw as (select z, wid, count(*) as n from {source} group by z, wid), {out}_dk as (select doc_id, z, count(*) as n from {source} group by doc_id, z), {out}_k as (select z, count(*) as n from {source} group by z),
 {out}_p as (select a.doc_id, a.pos, a.word, a.wid, ks.z as k, (({seed}) * 1103515245 + 12345) % 2147483648 as s, {mask}(coalesce(d.n, 0) - (a.z = ks.z)::int + {ALPHA}::double) * (coalesce(w.n, 0) - (a.z = ks.z)::int + {ETA}::double) / (coalesce(t.n, 0) - (a.z = ks.z)::int + vv.v * {ETA}::double){end} as p
  from {source} a cross join ks cross join vv left join {out}_kw w on w.wid = a.wid and w.z = ks.z left join {out}_dk d on d.doc_id = a.doc_id and d.z = ks.z left join {out}_k t on t.z = ks.z),
 {out}_c as (select *, sum(p) over (partition by doc_id, pos order by k rows unbounded preceding) as c from {out}_p), {out}_m as (select doc_id, pos, max(c) as m from {out}_c group by doc_id, pos),
 {out} as (select x.doc_id, x.pos, x.word, x.wid, min(x.k) as z from {out}_c x join {out}_m y on y.doc_id = x.doc_id and y.pos = x.pos where x.c > ((x.s + 0.5::double) / 2147483648.0::double) * y.m group by all)"""


def _number(doc, pos, step: int):
    return doc * 1009 + pos * 7 + step


def _seed(step: int):
    return _number(F.col("doc_id"), F.col("pos"), step)


@query("doc_id:bigint pos:int wid:int z:int", f"with {ASG}, {KS}, {_sweep_sql('asg', 's1', 'a.doc_id * 1009 + a.pos * 7 + 1')} select doc_id, pos, wid, z from s1")
def jacobi_sweep_1(spark, d):
    docs_, v = read_lists(spark, d)
    return readout.sweep_lists(docs_, v, K, ALPHA, ETA, partial(_number, step=1))


@query("z:int wid:int n:bigint", f"with {ASG}, {KS}, {_sweep_sql('asg', 's1', 'a.doc_id * 1009 + a.pos * 7 + 1')}, {_sweep_sql('s1', 's2', 'a.doc_id * 1009 + a.pos * 7 + 2')} select z, wid, count(*) as n from s2 group by z, wid")
def jacobi_sweep_2(spark, d):
    a, v = read(spark, d)
    one = written(readout.jacobi_sweep(a, v, K, ALPHA, ETA, _seed(1)), "sweep")
    return readout.jacobi_sweep(one, v, K, ALPHA, ETA, _seed(2)).groupBy("z", "wid").agg(F.count("*").alias("n"))


@query("doc_id:bigint pos:int wid:int z:int", f"with {ASG}, {KS}, {_sweep_sql('asg', 's1', 'a.doc_id * 1009 + a.pos * 7 + 3', f'(ks.z = 0 or ks.z = 1 + a.doc_id % {K - 1})')} select doc_id, pos, wid, z from s1")
def labelled_mask_sweep(spark, d):
    docs_, v = read_lists(spark, d)
    allowed = F.array(*[F.lit(True) if i == 0 else F.col("doc_id") % (K - 1) + 1 == i for i in range(K)])
    return readout.sweep_lists(docs_, v, K, ALPHA, ETA, partial(_number, step=3), allowed)


# --- coherence --------------------------------------------------------------------------------------

TOPN = 8


def judged(spark: SparkSession, d: str) -> DataFrame:
    a, v = read(spark, d)
    return readout.topic_top_words(readout.topic_word_dist(a, v, K, ETA), TOPN).select(F.col("z").alias("topic"), "rank_no", "word")


_EPS = "1e-12::double"
_TW = f"{_TOP}, tw as (select z as topic, rank_no, word from top where rank_no <= {TOPN}), wd as (select doc_id, words, len(words) as n from ws where len(words) > 0), toa as (select doc_id, n, unnest(range(n)) as pos, unnest(words) as word from wd)"
_DOCU = "u as (select distinct doc_id, 0::bigint as unit, word from toa where word in (select word from tw)), total as (select count(*)::double as n from wd)"


def _win(w: int) -> str:
    return f"""occ as (select * from toa where word in (select word from tw)), u as (select distinct doc_id, word, unnest(range(greatest(0, pos - {w} + 1), least(pos, greatest(n - {w}, 0)) + 1)) as unit from (select doc_id, word, n, case when n < {w} then 0 else pos end as pos from occ)),
 total as (select sum(greatest(n - {w} + 1, 1))::double as n from (select distinct doc_id, n from occ))"""


_PROB = """p1 as (select word, count(*) / (select n from total) as p from u group by word), tu as (select distinct tw.topic, u.doc_id, u.unit, u.word from u join tw using (word)),
 p2 as (select x.topic, x.word as a, y.word as b, count(*) / (select n from total) as p from tu x join tu y on x.topic = y.topic and x.doc_id = y.doc_id and x.unit = y.unit group by x.topic, x.word, y.word),
 mx as (select x.topic, x.word as a, x.rank_no as ra, y.word as b, y.rank_no as rb, coalesce(pa.p, 0) as pa, coalesce(pb.p, 0) as pb, coalesce(pab.p, 0) as pab, x.word = y.word as same from tw x join tw y on x.topic = y.topic left join p1 pa on pa.word = x.word left join p1 pb on pb.word = y.word left join p2 pab on pab.topic = x.topic and pab.a = x.word and pab.b = y.word)"""
_WO = "(case when same then 0 else pa - pab end)"
_RATIO = f"pab / (pb + {_EPS}) / ({_WO} + {_EPS}) * (1 - pb)"
_CONF = {
    "difference": f"case when same then -pa else pab / (pb + {_EPS}) - pa end",
    "ratio": f"case when same then 1 / (pa + {_EPS}) else pab / (pa * pb + {_EPS}) end",
    "likelihood": _RATIO,
    "loglikelihood": f"ln({_RATIO} + {_EPS})",
    "pmi": f"case when same then -ln(pa + {_EPS}) else ln((pab + {_EPS}) / (pa * pb + {_EPS})) end",
    "npmi": f"case when same then 1 else ln((pab + {_EPS}) / (pa * pb + {_EPS})) / -ln(pab + {_EPS}) end",
    "logcond": f"case when same then 0 else ln(pab / (pb + {_EPS}) + {_EPS}) end",
}


@query("topic:int score:double", f"with {_TW}, {_DOCU}, {_PROB} select topic, avg({_CONF['logcond']}) as score from mx where rb < ra group by topic")
def coh_u_mass(spark, d):
    return coh.coherence(judged(spark, d), word_docs(spark, d), "u_mass")


@query("topic:int score:double", f"with {_TW}, {_win(10)}, {_PROB} select topic, avg({_CONF['pmi']}) as score from mx where not same group by topic")
def coh_c_uci(spark, d):
    return coh.coherence(judged(spark, d), word_docs(spark, d), "c_uci")


@query("topic:int score:double", f"with {_TW}, {_win(10)}, {_PROB} select topic, avg({_CONF['npmi']}) as score from mx where not same group by topic")
def coh_c_npmi(spark, d):
    return coh.coherence(judged(spark, d), word_docs(spark, d), "c_npmi")


def _ind(measure: str) -> str:
    form = {"cosine": "sum(v.v * s.v) / sqrt(sum(v.v * v.v) * sum(s.v * s.v))", "dice": "sum(least(v.v, s.v)) / (sum(v.v) + sum(s.v))", "jaccard": "sum(least(v.v, s.v)) / sum(greatest(v.v, s.v))"}[measure]
    return f"select topic, avg(s) as score from (select v.topic, v.a, {form} as s from vec v join sv s on s.topic = v.topic and s.t = v.t group by v.topic, v.a) group by topic"


_VEC = f"vec as (select topic, a, b as t, {_CONF['npmi']} as v from mx), sv as (select topic, t, sum(v) as v from vec group by topic, t)"


@query("topic:int score:double", f"with {_TW}, {_win(110)}, {_PROB}, {_VEC} {_ind('cosine')}")
def coh_c_v(spark, d):
    return coh.coherence(judged(spark, d), word_docs(spark, d), "c_v")


def _grid(spark, d, measures: list[tuple[str, tuple]]) -> DataFrame:
    prob = coh.Probabilities(judged(spark, d), word_docs(spark, d), None)
    parts = [coh.coherence(prob.topics, None, m, prob=prob).withColumn("measure", F.lit(name)) for name, m in measures]
    return reduce(DataFrame.unionByName, parts)


@query("measure:string topic:int score:double", f"with {_TW}, {_DOCU}, {_PROB} " + " union all ".join(f"select '{m}' as measure, topic, avg({e}) as score from mx where not same group by topic" for m, e in _CONF.items()))
def coh_grid_confirm(spark, d):
    return _grid(spark, d, [(m, ("document", "one_one", m)) for m in coh.CONFIRMS])


_SETS = f"""sz as (select t1.topic, t1.word as a, t2.word as m, t1.word = t2.word as own from tw t1 join tw t2 on t1.topic = t2.topic),
 full_all as (select topic, a, count(*) / (select n from total) as p from (select sz.topic, sz.a, u.doc_id, u.unit from sz join u on u.word = sz.m group by all having count(distinct sz.m) = {TOPN}) group by topic, a),
 full_rest as (select topic, a, count(*) / (select n from total) as p from (select sz.topic, sz.a, u.doc_id, u.unit from sz join u on u.word = sz.m where not own group by all having count(distinct sz.m) = {TOPN - 1}) group by topic, a),
 st as (select tw.topic, tw.word as a, false as same, coalesce(p1.p, 0) as pa, coalesce(fa.p, 0) as pall, coalesce(fr.p, 0) as prest from tw left join p1 using (word) left join full_all fa on fa.topic = tw.topic and fa.a = tw.word left join full_rest fr on fr.topic = tw.topic and fr.a = tw.word)"""


@query("measure:string topic:int score:double", f"""with {_TW}, {_DOCU}, {_PROB}, {_SETS} select 'one_one' as measure, topic, avg({_CONF['npmi']}) as score from mx where not same group by topic
 union all select 'one_pre', topic, avg({_CONF['npmi']}) from mx where rb < ra group by topic union all select 'one_suc', topic, avg({_CONF['npmi']}) from mx where rb > ra group by topic
 union all select 'one_all', topic, avg({_CONF['npmi']}) from (select topic, a, same, pa, prest as pb, pall as pab from st) group by topic union all select 'one_set', topic, avg({_CONF['npmi']}) from (select topic, a, same, pa, pall as pb, pall as pab from st) group by topic""")
def coh_grid_segment(spark, d):
    return _grid(spark, d, [(m, ("document", m, "npmi")) for m in coh.SEGMENTATIONS])


@query("measure:string topic:int score:double", f"with {_TW}, {_DOCU}, {_PROB}, {_VEC} " + " union all ".join(f"select '{m}' as measure, topic, score from ({_ind(m)})" for m in ("cosine", "dice", "jaccard")))
def coh_grid_indirect(spark, d):
    return _grid(spark, d, [(m, ("document", "one_set", "npmi", m)) for m in coh.INDIRECTS])


# --- labels -----------------------------------------------------------------------------------------


def _labels(spark, d, window: int) -> DataFrame:
    a, v = read(spark, d)
    dist = written(readout.topic_word_dist(a, v, K, ETA), "dist")
    w = written(word_docs(spark, d), "words")
    cands = ngrams.bigrams(w, min_cf=20, min_df=10).select(F.array("w1", "w2").alias("words"))
    return labeling.topic_labels(dist, cands, w, k=K, min_df=5, window_size=window)


_LAB = f"""with {PHI}, wd as (select doc_id, words, len(words) as n from ws where len(words) > 0),
 un as (select word, count(*) as cf, count(distinct doc_id) as df from (select doc_id, unnest(words) as word from wd) group by word),
 pr as (select doc_id, n, unnest(range(n - 1)) as pos, unnest(words[1:n-1]) as w1, unnest(words[2:n]) as w2 from wd where n > 1),
 bg as (select w1, w2 from pr where w1 in (select word from un where cf >= 20 and df >= 10) and w2 in (select word from un where cf >= 20 and df >= 10) group by w1, w2 having count(*) >= 20 and count(distinct doc_id) >= 10)"""


def _label_sql(units_c: str, units_w: str, total: str) -> str:
    return f"""{_LAB}, uc as ({units_c}), uw as ({units_w}), tt as ({total}),
 dc as (select label, count(*) as dc from uc group by label having count(*) >= 5), df as (select word, count(*) as df from uw group by word),
 co as (select label, word, count(*) as c from uc join uw using (doc_id, unit) where label in (select label from dc) group by label, word),
 base as (select z, sum(p) as mass, sum(p * ln(df)) as logs from phi join df using (word) group by z),
 more as (select label, z, sum(p * ln((c + 0.01::double) / 0.01::double)) as m from co join phi using (word) group by label, z),
 s as (select dc.label, base.z, ln(0.01::double * tt.d / dc.dc) * mass - logs + coalesce(m, 0) as s from dc cross join base cross join tt left join more on more.label = dc.label and more.z = base.z)
 select z as topic, label, s * (1 + 0.25::double / {K - 1}) - sum(s) over (partition by label) * 0.25::double / {K - 1} as score from s"""


_W = 20


@query("topic:int label:string score:double", _label_sql("select distinct doc_id, 0 as unit, w1 || ' ' || w2 as label from pr join bg using (w1, w2)", "select distinct doc_id, 0 as unit, word from tok where word in (select word from voc where used)", "select count(*)::double as d from wd"))
def label_for_relevance(spark, d):
    return _labels(spark, d, -1)


@query("topic:int label:string score:double", _label_sql(
    f"select distinct doc_id, label, unnest(range(least(greatest(0, pos + 2 - {_W}), greatest(n - {_W}, 0)), least(pos, greatest(n - {_W}, 0)) + 1)) as unit from (select doc_id, pos, n, w1 || ' ' || w2 as label from pr join bg using (w1, w2))",
    f"select distinct doc_id, word, unnest(range(least(greatest(0, pos + 1 - {_W}), greatest(n - {_W}, 0)), least(pos, greatest(n - {_W}, 0)) + 1)) as unit from (select doc_id, n, unnest(range(n)) as pos, unnest(words) as word from wd) where word in (select word from voc where used)",
    f"select sum(greatest(n - {_W} + 1, 1))::double as d from wd"))
def label_for_relevance_window(spark, d):
    return _labels(spark, d, _W)


# --- exploring --------------------------------------------------------------------------------------


def theta(spark, d) -> DataFrame:
    return readout.doc_topic_dist(read(spark, d)[0], K, ALPHA)


@query("doc_id:bigint p:double", f"with {THETA}, t0 as (select doc_id from theta where z = 0 and p >= 0.15), t2 as (select doc_id, p from theta where z = 2) select doc_id, p from ws join t0 using (doc_id) join t2 using (doc_id) where contains(lower(text), 'model') and lang = 'en' and n_chars between 100 and 5000 order by p desc, doc_id desc limit 30 offset 10")
def explore_filter_page(spark, d):
    where = (F.col("lang") == "en") & F.col("n_chars").between(100, 5000)
    shares = written(theta(spark, d), "theta")
    page = explore.filter_page(docs(spark, d), shares, sort_topic=2, target=0, least=0.15, keywords=("model",), where=where, page=1, per_page=10)
    more = [explore.filter_page(docs(spark, d), shares, sort_topic=2, target=0, least=0.15, keywords=("model",), where=where, page=i, per_page=10) for i in (2, 3)]
    return page.unionByName(more[0]).unionByName(more[1])


@query("metadata:string z:int n:bigint", f"with {THETA}, t as (select doc_id, arg_min(z, z) filter (where p = m) as z from (select *, max(p) over (partition by doc_id) as m from theta) group by doc_id) select lang as metadata, z, count(*) as n from t join documents using (doc_id) group by lang, z")
def explore_top1_by_metadata(spark, d):
    return explore.top1_by_metadata(theta(spark, d), docs(spark, d), "lang")


@query("a:int b:int overlap:double", f"with {PHI} select x.z as a, y.z as b, sum(least(x.p, y.p)) as overlap from phi x join phi y on x.wid = y.wid and x.z < y.z group by x.z, y.z")
def explore_topic_overlap(spark, d):
    a, v = read(spark, d)
    return explore.topic_overlap(readout.topic_word_dist(a, v, K, ETA))


@query("z:int rank_no:int word:string p:double", f"with {PHI}, s as (select *, p * ln({K} / sum(p ** 0.5) over (partition by wid)) as s from phi), r as (select *, row_number() over (partition by z order by round(s, 12) desc, wid) as rank_no from s) select z, rank_no, word, p from r where rank_no <= 10")
def explore_pseudo_idf_words(spark, d):
    a, v = read(spark, d)
    return explore.pseudo_idf_words(readout.topic_word_dist(a, v, K, ETA), K, 0.5)


@query("metadata:string x:double density:double", "with g as (select unnest(range(33)) * 93.75 as x), s as (select lang as metadata, x, sum(exp(-(((x - n_chars) / 250.0::double) ** 2))) as d from documents cross join g where n_chars is not null group by lang, x) select metadata, x, d / max(d) over (partition by metadata) as density from s")
def explore_density(spark, d):
    return explore.density(table(spark, d, "documents"), "lang", "n_chars", low=0.0, high=3000.0, points=33, width=250.0)


@query("word:string topic_0:double topic_1:double topic_2:double topic_3:double topic_4:double", f"with {PHI} select word, " + ", ".join(f"max(case when z = {i} then p end) as topic_{i}" for i in range(K)) + " from phi group by wid, word")
def export_topic_words(spark, d):
    from topicloom.sources.corpus import wide_topic_words

    a, v = read(spark, d)
    return wide_topic_words(readout.topic_word_dist(a, v, K, ETA), K)


@query("doc_id:bigint z:int", f"with {THETA} select doc_id, min(z) as z from (select *, max(p) over (partition by doc_id) as m from theta) where p = m group by doc_id")
def export_top1_topic(spark, d):
    return explore.top1_topics(theta(spark, d))


# --- model formulas ---------------------------------------------------------------------------------


def _leg(x: str, n: int) -> str:
    return " + ".join(f"({(-1) ** (n + j) * math.comb(n, j) * math.comb(n + j, j)}::double * {x} ** {j})" for j in range(n + 1))


@query("doc_id:bigint t0:double t1:double t2:double t3:double t4:double t5:double", "with r as (select min(m[1]) as a, max(m[1]) as b, min(m[2]) as c, max(m[2]) as e from (select numeric_metadata as m from tmdocs where len(numeric_metadata) = 2)), s as (select distinct doc_id, (numeric_metadata[1] - a) / (b - a) as x, (numeric_metadata[2] - c) / (e - c) as y from tmdocs, r where doc_id is not null and len(numeric_metadata) = 2) select doc_id, " + ", ".join(f"({_leg('x', i)}) * ({_leg('y', j)}) as t{i * 2 + j}" for i in range(3) for j in range(2)) + " from s")
def gdmr_terms(spark, d):
    t = table(spark, d, "tmdocs").where(F.size("numeric_metadata") == 2).select("doc_id", F.get("numeric_metadata", F.lit(0)).alias("p"), F.get("numeric_metadata", F.lit(1)).alias("q"))
    r = t.agg(F.min("p").alias("a"), F.max("p").alias("b"), F.min("q").alias("c"), F.max("q").alias("e"))
    s = t.where("doc_id is not null").crossJoin(F.broadcast(r)).select("doc_id", ((F.col("p") - F.col("a")) / (F.col("b") - F.col("a"))).alias("x"), ((F.col("q") - F.col("c")) / (F.col("e") - F.col("c"))).alias("y")).distinct()
    return s.select("doc_id", *[(legendre(F.col("x"), i) * legendre(F.col("y"), j)).alias(f"t{i * 2 + j}") for i in range(3) for j in range(2)])


@query("x:double z:int p:double", "with g as (select unnest(range(11)) / 10.0::double as x), l as (select x, z, (0.3::double * z - 0.4::double) * 1 + (0.5::double - 0.2::double * z) * (2 * x - 1) + 0.1::double * z * (6 * x * x - 6 * x + 1) as s from g, (select unnest(range(4)) as z)) select x, z, exp(s) / sum(exp(s)) over (partition by x) as p from l")
def gdmr_tdf_grid(spark, d):
    from topicloom.models.metadata import tdf_grid

    lam = [[0.3 * z - 0.4, 0.5 - 0.2 * z, 0.1 * z] for z in range(4)]
    return tdf_grid(spark, lam, [2], [(0.0, 1.0)], [11]).select(F.col("x")[0].alias("x"), "z", "p")
