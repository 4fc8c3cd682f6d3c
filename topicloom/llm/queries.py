"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm._common import spread, table
from topicloom.llm.bpe import decode, encode
from topicloom.llm.cooccurrence import baskets, cooccurrence
from topicloom.llm.mixing import mix, sized
from topicloom.llm.near_duplicates import NearDuplicates
from topicloom.llm.neighbours import neighbours
from topicloom.llm.reading_level import band, fit_on, reading_level
from topicloom.llm.term_frequency import term_frequency
from topicloom.llm.top_n import top_n


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency(table(spark, d, "tmdocs")).where("mark is not null").select("word", "mark")


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency(table(spark, d, "tmdocs"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "topicwords"), "topic_id", "word", "weight", 10).where("topic_id is not null").select("topic_id", "rank_no", "word")


def _together(spark: SparkSession, d: str) -> DataFrame:
    docs = baskets(table(spark, d, "tmdocs"), "document", "doc_id", "words", "added_at")
    topics = baskets(table(spark, d, "topics"), "topic", "topic_id", "words", "exported_at")
    return cooccurrence(docs.unionByName(topics), least={"document": 10, "topic": 5}, min_npmi=0.7)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d).select("kind", "word_a", "word_b")


def p3_surprise(spark: SparkSession, d: str) -> DataFrame:
    return _together(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "tmdocs"), least=0.7).pairs()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "tmdocs"), least=0.7).groups()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours(table(spark, d, "doctopics"), dims=64, k=5, least=0.95)
    return near.select(F.least("id_a", "id_b").alias("doc_id_a"), F.greatest("id_a", "id_b").alias("doc_id_b")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(_documents(spark, d))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return decode(encode(_documents(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "mixweights")
    return mix(sized(_documents(spark, d), weights), weights)[1].where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "mixweights")
    return mix(sized(_documents(spark, d), weights), weights)[1]


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    weights = table(spark, d, "mixweights")
    return mix(sized(_documents(spark, d), weights), weights)[0]


def _graded(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return reading_level(docs, fit_on(docs)).withColumn("band", band(F.col("grade")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).where((F.col("n_words") >= 40) & F.col("band").isin("basic", "advanced")).select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p3_found, p3_surprise, p4_found, p4_groups, p5_found, p6_ids, p6_decoded, p7_found, p7_report, p7_mixture, p8_found, p8_levels)}

_DOC_WORDS = """one as (select doc_id, arg_min(words, added_at) as words from tmdocs where doc_id is not null group by doc_id),
 raw as (select doc_id, lower(trim(w, ' ' || chr(9))) as word from (select doc_id, unnest(words) as w from one) where w is not null),
 tok as (select doc_id, word from raw where word <> '')"""

_TERMS = f"""with {_DOC_WORDS}, n as (select count(distinct doc_id) as n from tok),
 c as (select word, count(*) as n_occurrences, count(distinct doc_id) as n_docs from tok group by word)
 select word, n_occurrences, n_docs, case when n_docs < 3 then 'rare' when n_docs > 0.2::double * n then 'common' end as mark from c, n"""

_PAIRS = """with d1 as (select doc_id, arg_min(words, added_at) as words from tmdocs where doc_id is not null group by doc_id),
 raw as (select 'document' as kind, cast(doc_id as varchar) as rec, unnest(words) as w from d1
   union all select 'topic', cast(topic_id as varchar), unnest(words) from topics where topic_id is not null),
 tok as (select distinct kind, rec, lower(trim(w, ' ' || chr(9))) as word from raw where w is not null and trim(w, ' ' || chr(9)) <> ''),
 total as (select kind, count(distinct rec) as n from tok group by kind),
 f as (select kind, word, count(*) as c from tok group by kind, word having count(*) >= case kind when 'document' then 10 else 5 end),
 t as (select kind, rec, word, c from tok join f using (kind, word)),
 p as (select x.kind, x.word as word_a, y.word as word_b, any_value(x.c) as n_a, any_value(y.c) as n_b, count(*) as n_ab
   from t x join t y on x.kind = y.kind and x.rec = y.rec and x.word < y.word group by x.kind, x.word, y.word)
 select p.kind, word_a, word_b from p join total using (kind)
 where n_ab >= case p.kind when 'document' then 10 else 5 end and n_ab < n
   and ln(n * n_ab::double / (n_a::double * n_b)) / ln(n / n_ab::double) >= 0.7 - 1e-12"""

_SIMILAR = f"""{_DOC_WORDS}, w as (select distinct doc_id, word from tok), z as (select doc_id, count(*) as n from w group by doc_id having count(*) >= 12),
 t as (select doc_id, word, n from w join z using (doc_id)),
 p as (select x.doc_id as doc_id_a, y.doc_id as doc_id_b, any_value(x.n) as n_a, any_value(y.n) as n_b, count(*) as n_ab from t x join t y on x.word = y.word and x.doc_id < y.doc_id group by x.doc_id, y.doc_id),
 similar_ as (select doc_id_a, doc_id_b from p where n_ab >= (0.7::double - 1e-12::double) * (n_a + n_b - n_ab))"""

SQL: dict[str, str] = {
    "p1_found": f"select word, mark from ({_TERMS}) where mark is not null",
    "p1_terms": _TERMS,
    "p2_found": """select topic_id, cast(rn as integer) as rank_no, word from (
 select topic_id, word, row_number() over (partition by topic_id order by w desc, word) as rn from (
  select topic_id, word, max(weight) as w from topicwords where word is not null and isfinite(weight) and topic_id is not null group by topic_id, word)) where rn <= 10""",
    "p3_found": _PAIRS,
    "p4_found": f"with {_SIMILAR} select doc_id_a, doc_id_b from similar_",
    "p4_groups": f"""with recursive {_SIMILAR}, e as (select doc_id_a as a, doc_id_b as b from similar_ union all select doc_id_b, doc_id_a from similar_),
 r(node, label) as (select doc_id, doc_id from z union select e.b, r.label from r join e on e.a = r.node)
 select node as doc_id, min(label) as class_id, (select count(*) from e where e.a = node) as n_links from r group by node""",
    "p5_found": """with v as (select doc_id, arg_min(cast(topic_dist as double[]), inferred_at) as v from doctopics
  where doc_id is not null and len(topic_dist) = 64 and len(list_filter(topic_dist, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(topic_dist, lambda x: x <> 0)) > 0 group by doc_id),
 c as (select x.doc_id as a, y.doc_id as b, list_cosine_similarity(x.v, y.v) as c from v x join v y on x.doc_id <> y.doc_id),
 r as (select a, b, row_number() over (partition by a order by c desc, b) as r from c where c >= 0.95)
 select distinct least(a, b) as doc_id_a, greatest(a, b) as doc_id_b from r where r <= 5""",
}
