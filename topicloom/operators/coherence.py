"""Topic coherence: probabilities from documents or windows, segmentations, confirmation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.operators.intervals import contexts, length, overlap
from topicloom.sources.tables import written

SEGMENTATIONS = ("one_one", "one_pre", "one_suc", "one_all", "one_set")
CONFIRMS = ("difference", "ratio", "likelihood", "loglikelihood", "pmi", "npmi", "logcond")
INDIRECTS = ("cosine", "dice", "jaccard")
#: Name -> probabilities, window, segmentation, confirmation, indirect confirmation.
PRESETS = {
    "u_mass": ("document", 0, "one_pre", "logcond", None),
    "c_v": ("window", 110, "one_set", "npmi", "cosine"),
    "c_uci": ("window", 10, "one_one", "pmi", None),
    "c_npmi": ("window", 10, "one_one", "npmi", None),
}


def confirm(measure: str, pa: Column, pb: Column, pab: Column, same: Column, eps: float) -> Column:
    """How much b confirms a. same: a and b are the same word."""
    without = F.when(same, 0.0).otherwise(pa - pab)
    ratio = pab / (pb + eps) / (without + eps) * (1 - pb)
    joint = F.log((pab + eps) / (pa * pb + eps))
    forms = {
        "difference": F.when(same, -pa).otherwise(pab / (pb + eps) - pa),
        "ratio": F.when(same, 1 / (pa + eps)).otherwise(pab / (pa * pb + eps)),
        "likelihood": ratio,
        "loglikelihood": F.log(ratio + eps),
        "pmi": F.when(same, -F.log(pa + eps)).otherwise(joint),
        "npmi": F.when(same, 1.0).otherwise(joint / -F.log(pab + eps)),
        "logcond": F.when(same, 0.0).otherwise(F.log(pab / (pb + eps) + eps)),
    }
    return forms[measure]


class Probabilities:
    """P of the words of topics(topic, rank_no, word), of pairs within a topic, and of sets, from
    word_docs(doc_id, words array). window: None for whole documents.

    With windows, documents without any of the words don't count; with documents they do.
    """

    def __init__(self, topics: DataFrame, word_docs: DataFrame, window: int | None) -> None:
        self.topics, self.window = written(topics, "judged"), window
        topics = self.topics
        self._matrix: DataFrame | None = None
        targets = F.broadcast(topics.select("word").distinct())  # topics times top words
        at = word_docs.select("doc_id", F.size("words").alias("len"), F.posexplode("words").alias("pos", "word")).join(targets, "word")
        occurrences = at.withColumn("size", F.lit(1))
        self.spans = contexts(occurrences, "word", window)
        if window:
            docs = occurrences.select("doc_id", "len").distinct()
            self.total = docs.agg(F.sum(F.greatest(F.col("len") - window + 1, F.lit(1))).alias("units"))
        else:
            self.total = word_docs.agg(F.count("*").alias("units"))

    def _share(self, counts: DataFrame, name: str) -> DataFrame:
        return counts.crossJoin(F.broadcast(self.total)).withColumn(name, F.col("c") / F.col("units")).drop("c", "units")

    def single(self) -> DataFrame:
        """(word, p)."""
        return self._share(self.spans.groupBy("word").agg(F.sum(length()).alias("c")), "p")

    def pair(self) -> DataFrame:
        """(topic, a, b, pab) of the pairs a < b of a topic that share a context."""
        own = self.spans.join(F.broadcast(self.topics.select("topic", "word")), "word")
        met = own.alias("x").join(own.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.topic") == F.col("y.topic")) & (F.col("x.word") < F.col("y.word")))
        met = met.select(F.col("x.topic").alias("topic"), F.col("x.word").alias("a"), F.col("y.word").alias("b"), overlap("x", "y").alias("o")).where("o > 0")
        return self._share(met.groupBy("topic", "a", "b").agg(F.sum("o").alias("c")), "pab")

    def sets(self, members: DataFrame) -> DataFrame:
        """(topic, name, p): contexts that hold all words of a set. members(topic, name, word)."""
        sized = members.groupBy("topic", "name").agg(F.countDistinct("word").alias("size"))
        units = self.spans.select("doc_id", "word", F.explode(F.sequence("lo", "hi")).alias("unit"))
        met = units.join(F.broadcast(members.distinct()), "word").groupBy("topic", "name", "doc_id", "unit").agg(F.count("*").alias("n"))
        full = met.join(F.broadcast(sized), ["topic", "name"]).where("n = size").groupBy("topic", "name").agg(F.count("*").alias("c"))
        every = sized.select("topic", "name").join(full, ["topic", "name"], "left").select("topic", "name", F.coalesce("c", F.lit(0)).alias("c"))
        return self._share(every, "p")

    def matrix(self) -> DataFrame:
        """(topic, a, ra, b, rb, pa, pb, pab, same) of all ordered pairs of a topic's words; made once."""
        if self._matrix is None:
            self._matrix = written(self._pairs_of_topics(), "pairs")
        return self._matrix

    def _pairs_of_topics(self) -> DataFrame:
        x = self.topics.select("topic", F.col("word").alias("a"), F.col("rank_no").alias("ra"))
        y = self.topics.select("topic", F.col("word").alias("b"), F.col("rank_no").alias("rb"))
        p = self.single()
        m = x.join(y, "topic").join(p.select(F.col("word").alias("a"), F.col("p").alias("pa")), "a", "left").join(p.select(F.col("word").alias("b"), F.col("p").alias("pb")), "b", "left")
        m = m.withColumn("_x", F.least("a", "b")).withColumn("_y", F.greatest("a", "b"))
        m = m.join(self.pair().select("topic", F.col("a").alias("_x"), F.col("b").alias("_y"), "pab"), ["topic", "_x", "_y"], "left").drop("_x", "_y")
        same = F.col("a") == F.col("b")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return m.select("topic", "a", "ra", "b", "rb", zero("pa").alias("pa"), zero("pb").alias("pb"), F.when(same, zero("pa")).otherwise(zero("pab")).alias("pab"), same.alias("same"))


def coherence(topics: DataFrame, word_docs: DataFrame | None, measure: str | tuple = "u_mass", *, window_size: int = 0, eps: float = 1e-12, gamma: float = 1.0, prob: Probabilities | None = None) -> DataFrame:
    """(topic, score). topics(topic, rank_no, word): the words to judge, best first. measure: a name
    of PRESETS or (probabilities, segmentation, confirm[, indirect]).

    gamma is applied as sign(v) * |v| ** gamma. one_suc takes each word with those behind it. A topic
    of a single word has no pairs and no score from the pairwise segmentations. prob: probabilities
    of the same topics to use again, instead of word_docs.
    """
    if isinstance(measure, str):
        if measure not in PRESETS:
            raise ValueError(f"unknown coherence {measure!r}")
        how, window, segmentation, direct, indirect = PRESETS[measure]
    else:
        how, segmentation, direct, indirect = (*measure, None)[:4]
        window = 0
    if segmentation not in SEGMENTATIONS or direct not in CONFIRMS or indirect not in (None, *INDIRECTS) or how not in ("document", "window"):
        raise ValueError(f"unknown coherence {measure!r}")
    window = (window_size or window or 10) if how == "window" else None
    prob = prob or Probabilities(topics, word_docs, window)
    topics = prob.topics
    if indirect:
        return _indirect(prob, segmentation, direct, indirect, eps, gamma)
    if segmentation in ("one_one", "one_pre", "one_suc"):
        pairs = prob.matrix().where({"one_one": "not same", "one_pre": "rb < ra", "one_suc": "rb > ra"}[segmentation])
        value = confirm(direct, F.col("pa"), F.col("pb"), F.col("pab"), F.col("same"), eps)
        return pairs.groupBy("topic").agg(F.avg(value).alias("score"))
    words = topics.select("topic", F.col("word").alias("a"), "rank_no")
    other = topics.select("topic", "word")
    if segmentation == "one_all":
        members = words.join(other, "topic").where("a <> word").select("topic", F.concat(F.lit("-"), F.col("a")).alias("name"), "word")
    else:
        members = words.join(other, "topic").select("topic", F.concat(F.lit("-"), F.col("a")).alias("name"), "word")
    both = members.unionByName(words.select("topic", F.concat(F.lit("-"), F.col("a")).alias("name"), F.col("a").alias("word"))).distinct()
    b = prob.sets(members).select("topic", F.expr("substring(name, 2)").alias("a"), F.col("p").alias("pb"))
    ab = prob.sets(both).select("topic", F.expr("substring(name, 2)").alias("a"), F.col("p").alias("pab"))
    j = words.join(b, ["topic", "a"]).join(ab, ["topic", "a"]).join(prob.single().select(F.col("word").alias("a"), F.col("p").alias("pa")), "a", "left").withColumn("pa", F.coalesce("pa", F.lit(0.0)))
    return j.groupBy("topic").agg(F.avg(confirm(direct, F.col("pa"), F.col("pb"), F.col("pab"), F.lit(False), eps)).alias("score"))


def _indirect(prob: Probabilities, segmentation: str, direct: str, indirect: str, eps: float, gamma: float) -> DataFrame:
    """Confirmation between vectors of direct confirmations with all words of the topic; a set's
    vector is the sum of its words' vectors."""
    v = confirm(direct, F.col("pa"), F.col("pb"), F.col("pab"), F.col("same"), eps)
    m = prob.matrix().select("topic", "a", "ra", F.col("b").alias("t"), (F.signum(v) * F.pow(F.abs(v), F.lit(gamma))).alias("v"))
    vectors = m.groupBy("topic", "a", "ra").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("v"))
    x, y = vectors.alias("x"), vectors.alias("y")
    joined = x.join(y, F.col("x.topic") == F.col("y.topic")).select(F.col("x.topic").alias("topic"), F.col("x.a").alias("a"), F.col("x.ra").alias("ra"), F.col("x.v").alias("va"), F.col("y.a").alias("b"), F.col("y.ra").alias("rb"), F.col("y.v").alias("vb"))
    chosen = joined.where({"one_one": "a <> b", "one_pre": "rb < ra", "one_suc": "rb > ra", "one_all": "a <> b", "one_set": "true"}[segmentation])
    if segmentation in ("one_all", "one_set"):
        parts = chosen.select("topic", "a", "va", F.posexplode("vb").alias("i", "v")).groupBy("topic", "a", "va", "i").agg(F.sum("v").alias("v"))
        chosen = parts.groupBy("topic", "a", "va").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("vb"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, z: s + z)
    zipped = lambda f: total(F.zip_with("va", "vb", f))
    square = lambda c: total(F.transform(c, lambda z: z * z))
    forms = {
        "cosine": zipped(lambda p, q: p * q) / F.sqrt(square("va") * square("vb")),
        "dice": zipped(lambda p, q: F.least(p, q)) / (total(F.col("va")) + total(F.col("vb"))),
        "jaccard": zipped(lambda p, q: F.least(p, q)) / zipped(lambda p, q: F.greatest(p, q)),
    }
    return chosen.groupBy("topic").agg(F.avg(forms[indirect]).alias("score"))


class Coherence:
    """Coherence of the topics of a model, or of given words, over documents(doc_id, words)."""

    def __init__(self, docs: DataFrame, measure: str | tuple = "u_mass", *, model=None, window_size: int = 0, top_n: int = 10, eps: float = 1e-12, gamma: float = 1.0) -> None:
        self.docs, self.measure, self.model, self.top_n = docs.select("doc_id", "words"), measure, model, top_n
        self.options = {"window_size": window_size, "eps": eps, "gamma": gamma}

    def scores(self) -> DataFrame:
        """(topic, score) of all topics of the model; a topic of a model with time points is that of
        one point."""
        return coherence(self.model.topic_words(self.top_n).select("topic", "rank_no", "word"), self.docs, self.measure, **self.options)

    def get_score(self, words: list[str] | None = None, topic_id: int | None = None, timepoint: int | None = None) -> float:
        """The score of the words; of a topic of the model, at a point of time if it has those; or the
        mean of all topics."""
        spark = self.docs.sparkSession
        if words is not None:
            top = spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(words)], "topic int, rank_no int, word string")
        elif topic_id is None and timepoint is None:
            return float(self.scores().agg(F.avg("score")).first()[0])
        else:
            timed = hasattr(self.model, "docs_by_timepoint")
            if timed != (timepoint is not None) or topic_id is None:
                raise ValueError("give topic_id, and timepoint if the model has points of time")
            wanted = topic_id + self.model.k * timepoint if timed else topic_id
            top = self.model.topic_words(self.top_n).where(F.col("topic") == wanted).select("topic", "rank_no", "word")
        return float(coherence(top, self.docs, self.measure, **self.options).agg(F.avg("score")).first()[0])
