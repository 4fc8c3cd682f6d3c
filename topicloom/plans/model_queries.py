"""Queries on the models' own code with topics that are given instead of drawn, and the SQL that must
give the same rows. The topics are those of catalog.assigned()."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom import models
from topicloom.plans.catalog import _DLL, _IDF, _PMI, _SLL, _TOP, ALPHA, ASG, ETA, KS, MIN_DF, PHI, RM_TOP, THETA, VOC, K, docs, query, read, word_docs
from topicloom.sources.tables import table


def lists(a: DataFrame, z: Column | None = None, sent: Column | None = None, **of_doc: Column) -> DataFrame:
    """Rows for adopt(): wid, z and sent as lists by place, and columns made of doc_id."""
    fields = [F.col("pos"), F.col("wid"), (F.col("z") if z is None else z).cast("int").alias("z"), *([sent.cast("int").alias("sent")] if sent is not None else [])]
    t = a.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("t"))
    names = ["wid", "z", *(["sent"] if sent is not None else [])]
    part = lambda c: F.transform("t", lambda x: x[c]).alias(c)
    return t.select("doc_id", *map(part, names), *[c.alias(n) for n, c in of_doc.items()])


def lda(spark, d, **kw) -> models.LDA:
    a, v = read(spark, d)
    return models.LDA(K, alpha=ALPHA, eta=ETA, **kw).adopt(v, lists(a))


def one(spark, **values) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) for x in values.values())], ", ".join(f"{n} double" for n in values))


def lg(n: str, a: str) -> str:
    return f"(lgamma({n} + {a}) - lgamma({a}))"


def words_ll(asg: str = "asg", z: str = "z", eta: str = f"{ETA}::double", topics: str = "") -> str:
    """SQL: log-likelihood of the words of asg given their topics."""
    return f"((select sum({lg('n', eta)}) from (select count(*) as n from {asg} group by {z}, wid)) - (select sum({lg('n', f'(v * {eta})')}) from (select count(*) as n from {asg} group by {z}), (select count(*) as v from voc where used)))"


# --- LDA ---------------------------------------------------------------------------------------------


@query("topic:int wid:int word:string p:double", f"with {PHI} select z as topic, wid, word, p from phi")
def model_topic_word_dist(spark, d):
    return lda(spark, d).topic_word_dist()


@query("topic:int rank_no:int word:string p:double", f"with {_TOP} select z as topic, rank_no, word, p from top where rank_no <= 10")
def model_topic_words(spark, d):
    return lda(spark, d).topic_words(10)


@query("doc_id:bigint z:int p:double", f"with {THETA} select * from theta")
def model_doc_topic_dist(spark, d):
    return lda(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p"))


@query("doc_id:bigint rank_no:int z:int p:double", f"with {THETA} select * from (select doc_id, z, p, row_number() over (partition by doc_id order by p desc, z) as rank_no from theta) where rank_no <= 3")
def model_doc_topics(spark, d):
    each = lda(spark, d).doc_topics(3).select("doc_id", F.posexplode("topics").alias("i", "t"))
    return each.select("doc_id", (F.col("i") + 1).alias("rank_no"), F.col("t.topic").alias("z"), F.col("t.p").alias("p"))


@query("doc_id:bigint place:int wid:int topic:int", f"with {ASG} select doc_id, row_number() over (partition by doc_id order by pos) - 1 as place, wid, z as topic from asg")
def model_token_topics(spark, d):
    return lda(spark, d).token_topics()


@query("topic:int n:bigint", f"with {ASG} select z as topic, count(*) as n from asg group by z")
def model_count_by_topics(spark, d):
    return lda(spark, d).count_by_topics()


@query("doc_id:bigint ll:double", f"with {_DLL} select * from dll")
def model_doc_lls(spark, d):
    return lda(spark, d).doc_lls_of()


@query("ll_per_word:double perplexity:double", f"with {_SLL}, x as (select ((select sum(ll) from dll) + (select ll from sll)) / (select count(*) from asg) as ll_per_word) select ll_per_word, exp(-ll_per_word) as perplexity from x")
def model_ll_per_word(spark, d):
    m = lda(spark, d)
    return one(spark, ll_per_word=m.ll_per_word, perplexity=m.perplexity)


@query("z:int alpha:double", f"""with {ASG}, cnt as (select doc_id, z, count(*) as n from asg group by doc_id, z), tot as (select doc_id, count(*) as n from asg group by doc_id), i as (select unnest(range((select max(n) from tot))) as i),
 num as (select z, sum(1 / ({ALPHA}::double + i)) as s from cnt join i on i < n group by z), den as (select sum(1 / ({K * ALPHA}::double + i)) as s from tot join i on i < n) select z, greatest(num.s / den.s * {ALPHA}::double, 1e-5) as alpha from num, den""")
def model_alpha_step(spark, d):
    from topicloom.models.base import count_histogram, fixed_point

    m = lda(spark, d)
    alpha = fixed_point(m.alpha, *count_histogram(m.rows, K), steps=1)
    return spark.createDataFrame([(i, float(a)) for i, a in enumerate(alpha)], "z int, alpha double")


@query("ll:double", f"""with {ASG}, n as (select z, wid, count(*) as n from asg group by z, wid), nk as (select z, sum(n) as n from n group by z), vv as (select count(*) as v from voc where used),
 e as (select n.n, case when z = 1 and wid = 0 then 5 else {ETA}::double end as e from n), t as (select nk.n, v * {ETA}::double + case when z = 1 then 5 - {ETA}::double else 0 end as s from nk, vv)
 select (select sum({lg('n', 'e')}) from e) - (select sum({lg('n', 's')}) from t) as ll""")
def model_word_prior_ll(spark, d):
    a, v = read(spark, d)
    m = models.LDA(K, alpha=ALPHA, eta=ETA)
    prior = np.full((v.where("used").count(), K), ETA)
    prior[0, 1] = 5.0
    return one(spark, ll=m.adopt(v, lists(a), prior=prior).state_ll())


def prepared(spark, d, tw: str) -> models.LDA:
    m = models.LDA(K, tw=tw, min_df=MIN_DF, rm_top=RM_TOP).add(word_docs(spark, d))
    m.prepare()
    return m


def _weights(m: models.LDA) -> DataFrame:
    return m.rows.select("doc_id", F.explode(F.arrays_zip("wid", "w")).alias("t")).select("doc_id", "t.wid", F.round(F.col("t.w").cast("double"), 4).alias("w")).distinct()


@query("doc_id:bigint wid:int w:double", f"with {_IDF} select distinct doc_id, wid, round(w::float::double, 4) as w from asg join idf using (wid)")
def model_idf_rows(spark, d):
    return _weights(prepared(spark, d, "idf"))


@query("doc_id:bigint wid:int w:double", f"with {_PMI} select doc_id, wid, round(w::float::double, 4) as w from pmi")
def model_pmi_rows(spark, d):
    return _weights(prepared(spark, d, "pmi"))


@query("wid:int word:string cf:bigint df:bigint weight:double", f"with {_IDF} select wid, word, cf, df, round(w::float::double * n, 1) as weight from voc join idf using (wid)")
def model_used_words(spark, d):
    return prepared(spark, d, "idf").used_words().withColumn("weight", F.round("weight", 1))


_NEW = "new as (select doc_id, unnest(words) as w from (select distinct doc_id, words from tmdocs where doc_id is not null)), known as (select doc_id, lower(trim(w, ' ' || chr(9))) as word from new where w is not null)"


@query("doc_id:bigint words:bigint wids:bigint", f"with {VOC}, {_NEW} select doc_id, count(*) as words, sum(wid) as wids from known join voc using (word) where used group by doc_id")
def model_make_docs(spark, d):
    from topicloom.plans.trained import records

    a, v = read(spark, d)
    made = models.LDA(K).adopt(v, lists(a)).make_docs(records(spark, d).select("doc_id", "words"))
    return made.select("doc_id", F.size("wid").alias("words"), F.aggregate("wid", F.lit(0).cast("long"), lambda s, x: s + x).alias("wids"))


# --- metadata and labels -----------------------------------------------------------------------------

_LANG = "lg as (select lang, row_number() over (order by lang) as f from (select distinct lang from documents where text is not null and lang is not null)), dl as (select doc_id, f from documents left join lg using (lang) where text is not null)"
_LAM = "(0.1::double * (({f} * 3 + z * 7) % 11) - 0.5 + 0.05::double * z)"
_ALPHA_D = f"ad as (select doc_id, z, exp({_LAM.format(f='0')} + case when f is null then 0 else {_LAM.format(f='f')} end) + 1e-10::double as a from dl cross join ks)"


def dmr(spark, d) -> models.DMR:
    a, v = read(spark, d)
    m = models.DMR(K, alpha=ALPHA, eta=ETA)
    meta = docs(spark, d).select("doc_id", F.col("lang").alias("metadata"))
    m.learn(meta)
    lam = np.array([[0.1 * ((f * 3 + z * 7) % 11) - 0.5 + 0.05 * z for f in range(m.width())] for z in range(K)])
    return m.adopt(v, lists(a), meta, lam=lam)


@query("metadata:string z:int alpha:double", f"with {_LANG} select lang as metadata, z, exp({_LAM.format(f='0')} + {_LAM.format(f='f')}) + 1e-10::double as alpha from lg, (select unnest(range({K})) as z)")
def dmr_alpha_by_metadata(spark, d):
    m = dmr(spark, d)
    return spark.createDataFrame([(v, z, float(x)) for v in m.metadata_values for z, x in enumerate(m.topic_prior(v))], "metadata string, z int, alpha double")


@query("metadata:string n:bigint", "select lang as metadata, count(*) as n from documents where text is not null and lang is not null group by lang")
def dmr_metadata_counts(spark, d):
    return spark.createDataFrame(list(dmr(spark, d).metadata_counts.items()), "metadata string, n long")


@query("kind:string value:string topic:int lam:double", f"with {_LANG} select case when f = 0 then 'constant' else 'metadata' end as kind, lang as value, z as topic, {_LAM.format(f='f')} as lam from (select lang, f from lg union all select null, 0), (select unnest(range({K})) as z)")
def dmr_weights(spark, d):
    return dmr(spark, d).weights_of().select("kind", "value", "topic", F.get("lam", F.lit(0)).alias("lam"))


_DMR = f"{ASG}, {KS}, {_LANG}, {_ALPHA_D}, nz as (select doc_id, z, count(*) as n from asg group by doc_id, z), dz as (select ad.doc_id, ad.z, a, coalesce(n, 0) as n from ad left join nz on nz.doc_id = ad.doc_id and nz.z = ad.z where ad.doc_id in (select doc_id from asg))"


@query("doc_id:bigint z:int p:double", f"with {_DMR} select doc_id, z, (n + a) / sum(n + a) over (partition by doc_id) as p from dz")
def dmr_doc_topic_dist(spark, d):
    return dmr(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p"))


@query("doc_id:bigint ll:double", f"with {_DMR} select doc_id, sum({lg('n', 'a')}) - {lg('sum(n)', 'sum(a)')} as ll from dz group by doc_id")
def dmr_doc_lls(spark, d):
    return dmr(spark, d).doc_lls_of()


@query("ll:double", f"with {_DMR}, p as (select sum(power({_LAM.format(f='f')} - case when f = 0 then ln({ALPHA}::double) else 0 end, 2)) / 2 as s from (select f from lg union all select 0), ks) select {words_ll()} - s as ll from p")
def dmr_state_ll(spark, d):
    return one(spark, ll=dmr(spark, d).state_ll())


_NUM = "(select distinct doc_id, numeric_metadata as m from tmdocs where doc_id is not null and len(numeric_metadata) = 2 and len(list_filter(numeric_metadata, lambda x: x is not null and isfinite(x))) = 2)"


def gdmr(spark, d) -> tuple[models.GDMR, DataFrame]:
    t = table(spark, d, "tmdocs").where("doc_id is not null").where((F.size("numeric_metadata") == 2) & F.forall("numeric_metadata", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = t.select("doc_id", F.col("numeric_metadata")).distinct().withColumn("metadata", F.lit("all"))
    m = models.GDMR(3, degrees=[2, 1])
    m.learn(rows)
    m.spark = spark
    return m, rows


@query("i:int low:double high:double mean:double deviation:double", f"select i - 1 as i, min(m[i]) as low, max(m[i]) as high, avg(m[i]) as mean, stddev_pop(m[i]) as deviation from {_NUM}, (select unnest([1, 2]) as i) group by i")
def gdmr_numeric_stats(spark, d):
    m, _ = gdmr(spark, d)
    return spark.createDataFrame([(i, *(float(x) for x in s)) for i, s in enumerate(m.numeric_stats)], "i int, low double, high double, mean double, deviation double")


def _leg(x: str, n: int) -> str:
    return ("1", f"(2 * {x} - 1)", f"(6 * {x} * {x} - 6 * {x} + 1)")[n]


_GD = f"r as (select min(m[1]) as a, max(m[1]) as b, min(m[2]) as c, max(m[2]) as e from {_NUM}), u as (select doc_id, (m[1] - a) / (b - a) as x, (m[2] - c) / (e - c) as y from {_NUM}, r)"


@query("doc_id:bigint i:int v:double", f"with {_GD} select doc_id, i, v from u, lateral (select unnest(range(12)) as i, unnest([{', '.join(f'{_leg("x", n)} * {_leg("y", k)}' for _ in range(2) for n in range(3) for k in range(2))}]) as v)")
def gdmr_features(spark, d):
    m, rows = gdmr(spark, d)
    x = rows.select("doc_id", *m.features(rows))
    at = F.explode(F.sequence(F.lit(0), (F.size("x") / 2 - 1).cast("int"))).alias("i")
    return x.select("doc_id", "x", at).select("doc_id", F.get("x", F.col("i").cast("int") * 2).alias("i"), F.get("x", F.col("i").cast("int") * 2 + 1).alias("v"))


@query("z:int p:double", f"""with {_GD}, s as (select z, sum((0.1::double * ((j + 2 * z) % 5) + 0.2::double * ((j + z) % 3)) * t) as s from (select unnest(range(3)) as z), lateral (select unnest(range(6)) as j, unnest([{', '.join(f'{_leg("0.25", n)} * {_leg("0.5", k)}' for n in range(3) for k in range(2))}]) as t) group by z)
 select z, exp(s) / sum(exp(s)) over () as p from s""")
def gdmr_tdf_point(spark, d):
    m, _ = gdmr(spark, d)
    m.lam = np.array([[0.1 * ((j + 2 * z) % 5) if f == 0 else 0.2 * ((j + z) % 3) for f in range(2) for j in range(6)] for z in range(3)])
    at = [low + (high - low) * q for (low, high), q in zip(m.metadata_range, (0.25, 0.5))]
    return spark.createDataFrame([(z, float(p)) for z, p in enumerate(m.tdf(at, "all"))], "z int, p double")


_LAB = f"{ASG}, {_LANG}, kk as (select unnest(range((select greatest(count(*), {K}) from lg))) as z), nz as (select doc_id, z, count(*) as n from asg group by doc_id, z)"


def llda(spark, d) -> models.LLDA:
    a, v = read(spark, d)
    labels = docs(spark, d).select("doc_id", F.filter(F.array("lang"), lambda x: x.isNotNull()).alias("labels"))
    return models.LLDA(K, alpha=ALPHA).adopt(v, lists(a), labels)


_LMASK = f"m as (select ids.doc_id, kk.z, coalesce(n, 0) as n, case when f is null or f - 1 = kk.z or kk.z >= (select count(*) from lg) then {ALPHA}::double else 0 end as a from (select distinct doc_id from asg) ids join dl using (doc_id) cross join kk left join nz on nz.doc_id = ids.doc_id and nz.z = kk.z), th as (select doc_id, z, (n + a) / sum(n + a) over (partition by doc_id) as p from m)"


@query("doc_id:bigint z:int p:double", f"with {_LAB}, {_LMASK} select * from th where p > 0")
def llda_doc_topic_dist(spark, d):
    return llda(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p")).where("p > 0")


@query("doc_id:bigint label:string p:double", f"with {_LAB}, {_LMASK} select doc_id, lang as label, p from th join lg on f - 1 = z where p > 0")
def llda_doc_labels(spark, d):
    return llda(spark, d).doc_labels().where("p > 0")


@query("doc_id:bigint z:int p:double", f"""with {_LAB.replace(f'greatest(count(*), {K})', f'greatest(2 * count(*) + 1, {K})')}, m as (select ids.doc_id, kk.z, coalesce(n, 0) as n, case when (f is not null and (2 * f - 2 = kk.z or 2 * f - 1 = kk.z)) or kk.z = 2 * (select count(*) from lg) then {ALPHA}::double else 0 end as a from (select distinct doc_id from asg) ids join dl using (doc_id) cross join kk left join nz on nz.doc_id = ids.doc_id and nz.z = kk.z)
 select doc_id, z, (n + a) / sum(n + a) over (partition by doc_id) as p from m where n + a > 0""")
def plda_doc_topic_dist(spark, d):
    a, v = read(spark, d)
    labels = docs(spark, d).select("doc_id", F.filter(F.array("lang"), lambda x: x.isNotNull()).alias("labels"))
    m = models.PLDA(latent_topics=1, topics_per_label=2, alpha=ALPHA).adopt(v, lists(a), labels)
    return m.doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p")).where("p > 0")


# --- responses ---------------------------------------------------------------------------------------

_Y = f"{ASG}, {KS}, nz as (select doc_id, z, count(*) as n from asg group by doc_id, z), nd as (select doc_id, count(*) as n, case when doc_id % 5 = 0 then null else (doc_id % 7) / 7.0::double end as y from asg group by doc_id), sh as (select nd.doc_id, ks.z, coalesce(nz.n, 0) as c, coalesce(nz.n, 0) / nd.n::double as p, y, nd.n from nd cross join ks left join nz on nz.doc_id = nd.doc_id and nz.z = ks.z)"


def slda(spark, d) -> models.SLDA:
    a, v = read(spark, d)
    y = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise((F.col("doc_id") % 7) / 7)
    return models.SLDA(K, vars="l", alpha=ALPHA, eta=ETA).adopt(v, lists(a, x=F.array(y.cast("double"))), coef=np.array([[0.1 * k - 0.2 for k in range(K)]]))


@query("i:int j:int s:double", f"with {_Y} select a.z as i, b.z as j, sum(a.p * b.p) as s from sh a join sh b on a.doc_id = b.doc_id where a.y is not null group by a.z, b.z union all select z, {K}, sum(p * y) from sh group by z")
def slda_gram_matrix(spark, d):
    gram, moment = slda(spark, d).normal_equations(0)
    return spark.createDataFrame([(i, j, float(x)) for i, row in enumerate(np.c_[gram, moment]) for j, x in enumerate(row)], "i int, j int, s double")


@query("i:int residual:double", f"select unnest(range({K})) as i, 0.0::double as residual")
def slda_coef_residual(spark, d):
    """What is left of the normal equations at the fitted coefficients: nothing."""
    m = slda(spark, d)
    gram, moment = m.normal_equations(0)
    m.merge()
    left = (gram + np.eye(K)) @ m.coef[0] - moment
    return spark.createDataFrame([(i, abs(round(float(x), 6))) for i, x in enumerate(left)], "i int, residual double")


@query("doc_id:bigint y_hat:double", f"with {_Y} select doc_id, sum(p * (0.1::double * z - 0.2::double)) as y_hat from sh group by doc_id")
def slda_estimate(spark, d):
    return slda(spark, d).estimate().select("doc_id", F.get("y_hat", F.lit(0)).alias("y_hat"))


@query("doc_id:bigint ll:double", f"with {_Y} select doc_id, sum({lg('c', f'{ALPHA}::double')}) - {lg('any_value(n)', f'{K * ALPHA}::double')} - coalesce(power(any_value(y) - sum(p * (0.1::double * z - 0.2::double)), 2) / 2, 0) as ll from sh group by doc_id")
def slda_doc_lls(spark, d):
    return slda(spark, d).doc_lls_of()


# --- hierarchies -------------------------------------------------------------------------------------

_PA = f"{ASG}, {KS}, s as (select doc_id, wid, z as z1, (wid + pos) % 4 as z2 from asg), k4 as (select unnest(range(4)) as z2), ids as (select doc_id, count(*) as n from s group by doc_id)"


def pa(spark, d) -> models.PA:
    a, v = read(spark, d)
    m = models.PA(K, 4, alpha=ALPHA, eta=ETA, subalpha=0.1373)
    return m.adopt(v, lists(a, F.col("z") * 4 + F.pmod(F.col("wid") + F.col("pos"), F.lit(4))))


@query("doc_id:bigint z2:int p:double", f"with {_PA}, c as (select doc_id, z2, count(*) as n from s group by all) select ids.doc_id, k4.z2, (coalesce(c.n, 0) + {K} * 0.1373::double) / (ids.n + {4 * K} * 0.1373::double) as p from ids cross join k4 left join c on c.doc_id = ids.doc_id and c.z2 = k4.z2")
def pa_sub_topic_dist(spark, d):
    return pa(spark, d).sub_topic_dist().select("doc_id", F.posexplode("sub").alias("z2", "p"))


@query("doc_id:bigint z:int p:double", f"with {THETA} select * from theta")
def pa_super_topic_dist(spark, d):
    return pa(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p"))


@query("topic:int n:bigint", f"with {ASG} select z as topic, count(*) as n from asg group by z")
def pa_count_by_super_topic(spark, d):
    return pa(spark, d).count_by_super_topic()


@query("topic:int wid:int p:double", f"with {_PA}, c as (select z2, wid, count(*) as n from s group by all), t as (select z2, count(*) as n from s group by z2) select k4.z2 as topic, voc.wid, (coalesce(c.n, 0) + {ETA}::double) / (t.n + v * {ETA}::double) as p from k4 cross join (select wid from voc where used) voc cross join vv join t using (z2) left join c on c.z2 = k4.z2 and c.wid = voc.wid")
def pa_topic_word_dist(spark, d):
    return pa(spark, d).topic_word_dist()


@query("docs:double state:double", f"""with {_PA}, c as (select k.z as z1, k4.z2, (select count(*) from s where s.z1 = k.z and s.z2 = k4.z2) as n from ks k cross join k4), d as ({_DLL.split('dll as (', 1)[1][:-1]})
 select (select sum(ll) from d) as docs, (select sum({lg('n', '0.1373::double')}) from c) - (select sum({lg('n', '(4 * 0.1373::double)')}) from (select sum(n) as n from c group by z1)) + {words_ll('s', 'z2')} as state""")
def pa_ll(spark, d):
    m = pa(spark, d)
    return one(spark, docs=m.doc_ll(), state=m.state_ll())


_HPA = f"{ASG}, s as (select doc_id, wid, (wid + pos) % 3 as level, z, (wid * 3 + pos) % 4 as z2, case (wid + pos) % 3 when 0 then 0 when 1 then 1 + z else 1 + {K} + (wid * 3 + pos) % 4 end as topic from asg)"


def hpa(spark, d) -> models.HPA:
    a, v = read(spark, d)
    level, z2 = F.pmod(F.col("wid") + F.col("pos"), F.lit(3)), F.pmod(F.col("wid") * 3 + F.col("pos"), F.lit(4))
    z = F.when(level == 0, 0).when(level == 1, 1 + F.col("z")).otherwise(1 + K + F.col("z") * 4 + z2)
    return models.HPA(K, 4, alpha=ALPHA, eta=ETA, subalpha=0.2).adopt(v, lists(a, z))


@query("topic:int n:bigint", f"with {_HPA} select topic, count(*) as n from s group by topic")
def hpa_level_counts(spark, d):
    return hpa(spark, d).count_by_topics()


@query("doc_id:bigint topic:int p:double", f"with {_HPA} select doc_id, topic, count(*) / sum(count(*)) over (partition by doc_id)::double as p from s group by doc_id, topic")
def hpa_doc_topic_dist(spark, d):
    return hpa(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("topic", "p")).where("p > 0")


@query("doc_id:bigint ll:double", f"with {_HPA}, c as (select doc_id, case when level = 0 then -1 else z end as u, count(*) as n from s group by all) select doc_id, sum({lg('n', f'{ALPHA}::double')}) - {lg('sum(n)', f'{(K + 1) * ALPHA}::double')} as ll from c group by doc_id")
def hpa_doc_lls(spark, d):
    return hpa(spark, d).doc_lls_of()


@query("state:double", f"with {_HPA}, c as (select z, case level when 1 then -1 else z2 end as b, count(*) as n from s where level > 0 group by all) select (select sum({lg('n', '0.2::double')}) from c) - (select sum({lg('n', '(5 * 0.2::double)')}) from (select sum(n) as n from c group by z)) + {words_ll('s', 'topic')} as state")
def hpa_state_ll(spark, d):
    return one(spark, state=hpa(spark, d).state_ll())


_MG = f"{ASG}, s as (select doc_id, wid, pos // 20 as sent, (pos + wid) % 3 as v, z, z >= 3 as low from asg), ms as (select doc_id, max(sent) + 1 as n from s group by doc_id)"


def mglda(spark, d) -> models.MGLDA:
    a, v = read(spark, d)
    z = F.pmod(F.col("pos") + F.col("wid"), F.lit(3)) * 5 + F.col("z")
    return models.MGLDA(3, 2, 3, alpha_g=0.1, alpha_l=0.2, alpha_mg=0.3, alpha_ml=0.4, eta_g=0.01, eta_l=0.02, gamma=0.5).adopt(v, lists(a, z, F.floor(F.col("pos") / 20)))


@query("doc_id:bigint ll:double", f"""with {_MG}, g as (select doc_id, z, count(*) as n from s where not low group by all), gl as (select doc_id, sum({lg('n', '0.1::double')}) - {lg('sum(n)', '0.3::double')} as ll from g group by doc_id),
 w as (select doc_id, sent + v as w, count(*) filter (where not low) as g, count(*) filter (where low) as l, count(*) as n from s group by all), wl as (select doc_id, sum({lg('g', '0.3::double')} + {lg('l', '0.4::double')} - {lg('n', '0.7::double')}) as ll from w group by doc_id),
 t as (select doc_id, sent + v as w, z, count(*) as n from s where low group by all), tl as (select doc_id, sum(ll) as ll from (select doc_id, w, sum({lg('n', '0.2::double')}) - {lg('sum(n)', '0.4::double')} as ll from t group by all) group by doc_id),
 q as (select doc_id, sent, v, count(*) as n from s group by all), ql as (select doc_id, sum(ll) as ll from (select doc_id, sent, sum({lg('n', '0.5::double')}) - {lg('sum(n)', '1.5::double')} as ll from q group by all) group by doc_id)
 select doc_id, coalesce(gl.ll, 0) + wl.ll + coalesce(tl.ll, 0) + ql.ll as ll from wl join ql using (doc_id) left join gl using (doc_id) left join tl using (doc_id)""")
def mglda_doc_lls(spark, d):
    return mglda(spark, d).doc_lls_of()


@query("doc_id:bigint topic:int p:double", f"with {_MG} select doc_id, z as topic, count(*) / sum(count(*)) over (partition by doc_id)::double as p from s group by doc_id, z")
def mglda_doc_topic_dist(spark, d):
    return mglda(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("topic", "p")).where("p > 0")


@query("ll:double", f"with {_MG}, a as (select * from s where not low), b as (select * from s where low) select {words_ll('a')} + {words_ll('b', eta='0.02::double')} as ll")
def mglda_state_ll(spark, d):
    return one(spark, ll=mglda(spark, d).state_ll())


# --- correlations, pseudo documents, time ------------------------------------------------------------

_CT = f"{THETA}, x as (select doc_id, z, ln(p) as x from theta)"


def ct(spark, d) -> models.CT:
    a, v = read(spark, d)
    n = a.groupBy("doc_id").agg(F.array(*[F.log((F.sum((F.col("z") == i).cast("double")) + ALPHA) / (F.count("*") + K * ALPHA)) for i in range(K)]).alias("s"))
    return models.CT(K, smoothing_alpha=ALPHA, eta=ETA).adopt(v, lists(a).join(n, "doc_id"))


_CTM = f"{_CT}, dd as (select count(distinct doc_id) as n from x), mu as (select z, avg(x) as m from x group by z), sc as (select a.z as i, b.z as j, sum((a.x - ma.m) * (b.x - mb.m)) as s from x a join x b on a.doc_id = b.doc_id join mu ma on ma.z = a.z join mu mb on mb.z = b.z group by a.z, b.z), cv as (select i, j, ((i = j)::int + s) / (n - 1) + 1e-6::double * (i = j)::int as c from sc, dd)"


@query("i:int j:int mean:double cov:double corr:double", f"with {_CTM} select cv.i, cv.j, m as mean, cv.c as cov, cv.c / sqrt(a.c * b.c) as corr from cv join mu on mu.z = cv.i join cv a on a.i = cv.i and a.j = cv.i join cv b on b.i = cv.j and b.j = cv.j")
def ct_moments(spark, d):
    m = ct(spark, d)
    m.optimize()
    corr = m.correlations()
    rows = [(i, j, float(m.prior_mean[i]), float(m.prior_cov[i, j]), float(corr[i, j])) for i in range(K) for j in range(K)]
    return spark.createDataFrame(rows, "i int, j int, mean double, cov double, corr double")


@query("doc_id:bigint ll:double", f"with {_CT}, c as (select x.doc_id, x.z, x.x, coalesce(n.n, 0) + {ALPHA}::double as n from x left join (select doc_id, z, count(*) as n from asg group by all) n on n.doc_id = x.doc_id and n.z = x.z) select doc_id, sum(x * n - lgamma(n + 1)) + lgamma(sum(n) + 1) - sum(x * x) / 2 - {K} / 2.0::double * ln(2 * pi()) as ll from c group by doc_id")
def ct_doc_lls(spark, d):
    return ct(spark, d).doc_lls_of()


_PT = f"{ASG}, {KS}, s as (select doc_id, doc_id % 7 as p, z, wid from asg), np as (select p, z, count(*) as n from s group by all), pp as (select p, count(distinct doc_id) as docs, count(*) as n from s group by p)"


def pt(spark, d) -> models.PT:
    a, v = read(spark, d)
    m = models.PT(K, p=7, alpha=ALPHA, eta=ETA).adopt(v, lists(a, p=F.array(F.pmod("doc_id", F.lit(7)).cast("int"))))
    m.merge()
    return m


@query("doc_id:bigint z:int p:double", f"with {_PT}, th as (select pp.p, ks.z, (coalesce(np.n, 0) + {ALPHA}::double) / (pp.n + {K * ALPHA}::double) as t from pp cross join ks left join np on np.p = pp.p and np.z = ks.z) select doc_id, z, t as p from (select distinct doc_id, p from s) join th using (p)")
def pt_from_pseudo_doc(spark, d):
    return pt(spark, d).doc_topic_dist(from_pseudo_doc=True).select("doc_id", F.posexplode("theta").alias("z", "p"))


@query("ll:double", f"with {_PT} select (select sum({lg('docs', '0.01::double')}) - {lg('sum(docs)', '0.07::double')} from pp) + (select sum({lg('n', f'{ALPHA}::double')}) from np) - (select sum({lg('n', f'{K * ALPHA}::double')}) from pp) + {words_ll()} as ll")
def pt_state_ll(spark, d):
    return one(spark, ll=pt(spark, d).state_ll())


_DT = f"{ASG}, {KS}, s as (select doc_id, doc_id % 3 as t, z, wid from asg), tt as (select unnest(range(3)) as t)"


def dt(spark, d) -> models.DT:
    a, v = read(spark, d)
    used = v.where("used").count()
    t, w, k = np.meshgrid(range(3), range(used), range(K), indexing="ij")
    eta = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda z: (F.pmod(F.col("doc_id") + z, F.lit(4)) * 0.25).cast("double"))
    rows = lists(a, x=F.array(F.pmod("doc_id", F.lit(3)).cast("double")), s=eta)
    return models.DT(K, t=3, eta=ETA, alpha_var=0.2, eta_var=0.3, phi_var=0.4).adopt(v, rows, logits=((w * 7 + k * 3 + t) % 11) * 0.1, alphas=np.array([[0.1 * t - 0.05 * k for k in range(K)] for t in range(3)]))


@query("topic:int n:bigint", f"with {_DT} select z + {K} * t as topic, count(*) as n from s group by all")
def dt_counts_by_time(spark, d):
    return dt(spark, d).count_by_topics()


@query("timepoint:int n:bigint", f"with {_DT} select t as timepoint, count(distinct doc_id) as n from s group by t")
def dt_docs_by_timepoint(spark, d):
    return dt(spark, d).docs_by_timepoint()


_DTP = f"{_DT}, lt as (select t, z, wid, ((wid * 7 + z * 3 + t) % 11) * 0.1::double as l from tt cross join ks cross join (select wid from voc where used)), so as (select t, z, wid, l, l - ln(sum(exp(l)) over (partition by t, z)) as lp from lt), nn as (select t, z, wid, count(*) as n from s group by all), nt as (select t, z, count(*) as n from s group by all)"


@query("topic:int wid:int p:double", f"with {_DTP} select so.z + {K} * so.t as topic, so.wid, (exp(lp) + (coalesce(nn.n, 0) + {ETA}::double) / (nt.n + v * {ETA}::double)) / 2 as p from so cross join vv join nt on nt.t = so.t and nt.z = so.z left join nn on nn.t = so.t and nn.z = so.z and nn.wid = so.wid")
def dt_topic_word_dist(spark, d):
    return dt(spark, d).topic_word_dist()


@query("doc_id:bigint ll:double", f"with {_DT}, e as (select doc_id, doc_id % 3 as t, z, ((doc_id + z) % 4) * 0.25::double as e from (select distinct doc_id from asg) cross join ks), l as (select *, e - ln(sum(exp(e)) over (partition by doc_id)) as lp from e), n as (select doc_id, z, count(*) as n from asg group by all) select l.doc_id, sum(coalesce(n, 0) * lp) - sum(power(e - (0.1::double * t - 0.05::double * l.z), 2)) / 0.6::double - {K} / 2.0::double * ln(2 * pi() * 0.3::double) as ll from l left join n on n.doc_id = l.doc_id and n.z = l.z group by l.doc_id")
def dt_doc_lls(spark, d):
    return dt(spark, d).doc_lls_of()


@query("ll:double", f"with {_DTP}, mv as (select sum(power(b.l - a.l, 2)) as s, count(*) as c from lt a join lt b on b.t = a.t + 1 and b.z = a.z and b.wid = a.wid) select (select sum(n * lp) from nn join so using (t, z, wid)) - s / 0.8::double - c / 2.0::double * ln(2 * pi() * 0.4::double) - {2 * K} * 0.01::double / 0.4::double - {K} * ln(2 * pi() * 0.2::double) as ll from mv")
def dt_state_ll(spark, d):
    return one(spark, ll=dt(spark, d).state_ll())


@query("timepoint:int topic:int p:double", f"select t as timepoint, z as topic, exp(0.1::double * t - 0.05::double * z) / sum(exp(0.1::double * t - 0.05::double * z)) over (partition by t) as p from (select unnest(range(3)) as t), (select unnest(range({K})) as z)")
def dt_alpha(spark, d):
    m = dt(spark, d)
    return spark.createDataFrame([(t, k, float(p)) for t in range(3) for k, p in enumerate(m.get_alpha(t))], "timepoint int, topic int, p double")


# --- models that grow --------------------------------------------------------------------------------

_HDP = f"{ASG}, s as (select doc_id, wid, z, z * 2 + pos % 2 as tb from asg), tb as (select doc_id, z, tb, count(*) as n from s group by all), m as (select z, count(*) as m from tb group by z)"


def hdp(spark, d) -> models.HDP:
    a, v = read(spark, d)
    seats = a.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "z"))), lambda x: (x["z"] * 2 + x["pos"] % 2).cast("int")).alias("p"))
    return models.HDP(K, alpha=0.3, eta=ETA, gamma=0.7).adopt(v, lists(a).join(seats, "doc_id"))


@query("doc_id:bigint ll:double", f"with {_HDP} select doc_id, count(*) * ln(0.3::double) - lgamma(sum(n) + 0.3) + lgamma(0.3::double) + sum(lgamma(n)) as ll from tb group by doc_id")
def hdp_doc_lls(spark, d):
    return hdp(spark, d).doc_lls_of()


@query("ll:double", f"with {_HDP} select (select sum(lgamma(m)) + count(*) * ln(0.7::double) - lgamma(sum(m) + 0.7) + lgamma(0.7::double) from m) + {words_ll()} as ll")
def hdp_state_ll(spark, d):
    return one(spark, ll=hdp(spark, d).state_ll())


@query("doc_id:bigint tables:int", f"with {_HDP} select doc_id, count(*) as tables from tb group by doc_id")
def hdp_doc_tables(spark, d):
    return hdp(spark, d).doc_tables()


@query("topic:int tables:bigint live:boolean", f"with {_HDP} select k as topic, coalesce(m, 0) as tables, coalesce(m, 0) > 0 as live from (select unnest(range({K + 1})) as k) left join m on z = k")
def hdp_live_topics(spark, d):
    m = hdp(spark, d)
    return spark.createDataFrame([(k, int(m.tables[k]), m.is_live_topic(k)) for k in range(m.k)], "topic int, tables long, live boolean")


@query("doc_id:bigint topic:int p:double", f"with {_HDP} select doc_id, z as topic, count(*) / sum(count(*)) over (partition by doc_id)::double as p from s group by doc_id, z")
def hdp_doc_topic_dist(spark, d):
    return hdp(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("topic", "p")).where("p > 0")


@query("new:int n:bigint", f"with {_HDP}, c as (select z, count(*) as n from s group by z) select row_number() over (order by n desc, z) - 1 as new, n from c")
def hdp_convert_to_lda(spark, d):
    lda_, _ = hdp(spark, d).convert_to_lda(0.0)
    return lda_.count_by_topics().select(F.col("topic").alias("new"), "n")


_HLDA = f"{ASG}, s as (select doc_id, wid, 1 + doc_id % 3 as leaf, (wid + pos) % 2 as level, case (wid + pos) % 2 when 0 then 0 else 1 + doc_id % 3 end as topic from asg), cu as (select leaf, count(distinct doc_id) as c from s group by leaf)"


def hlda(spark, d) -> models.HLDA:
    a, v = read(spark, d)
    leaf = 1 + F.pmod("doc_id", F.lit(3))
    rows = lists(a, F.when(F.pmod(F.col("wid") + F.col("pos"), F.lit(2)) == 0, 0).otherwise(leaf), p=F.array(F.lit(0), leaf.cast("int")))
    return models.HLDA(2, alpha=ALPHA, eta=ETA, gamma=0.4).adopt(v, rows, parent=np.array([-1, 0, 0, 0]), level=np.array([0, 1, 1, 1]))


@query("topic:int parent:int level:int docs:bigint", f"with {_HLDA} select 0 as topic, -1 as parent, 0 as level, sum(c) as docs from cu union all select leaf, 0, 1, c from cu")
def hlda_nodes(spark, d):
    return hlda(spark, d).nodes()


@query("doc_id:bigint ll:double", f"with {_HLDA}, n as (select doc_id, leaf, level, count(*) as n from s group by all), l as (select doc_id, leaf, sum({lg('n', f'{ALPHA}::double')}) - {lg('sum(n)', f'{2 * ALPHA}::double')} as ll from n group by all) select doc_id, ll + ln(c / ((select sum(c) from cu) + 0.4::double)) as ll from l join cu using (leaf)")
def hlda_doc_lls(spark, d):
    return hlda(spark, d).doc_lls_of()


@query("ll:double", f"with {_HLDA} select {words_ll('s', 'topic')} as ll")
def hlda_state_ll(spark, d):
    return one(spark, ll=hlda(spark, d).state_ll())


@query("doc_id:bigint level:int p:double", f"with {_HLDA}, lv as (select unnest([0, 1]) as level), n as (select doc_id, level, count(*) as n from s group by all), ids as (select doc_id, count(*) as t from s group by doc_id) select ids.doc_id, lv.level, (coalesce(n, 0) + {ALPHA}::double) / (t + {2 * ALPHA}::double) as p from ids cross join lv left join n on n.doc_id = ids.doc_id and n.level = lv.level")
def hlda_doc_level_dist(spark, d):
    return hlda(spark, d).doc_topic_dist().select("doc_id", F.posexplode("theta").alias("level", "p"))


@query("topic:int n:bigint", f"with {_HLDA} select topic, count(*) as n from s group by topic")
def hlda_count_by_topics(spark, d):
    return hlda(spark, d).count_by_topics()
