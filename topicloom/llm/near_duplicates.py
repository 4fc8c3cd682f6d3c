"""Near-duplicate records: DartMinHash signatures, banded joining, exact check, groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.hashing import mix
from topicloom.llm._common import batches_of, one_delivery, parted, parts_for, small, word_sets, written
from topicloom.sources.tables import dropped

#: A pair at the threshold shares no band with this probability at most; as many bands as that takes, up to MAX_BANDS.
MISS, MAX_BANDS = 2e-5, 64
#: Bits of a sketch, and the probability at most that the sketches of a pair at the threshold rule it out.
SKETCH, SKETCH_MISS = 128, 1e-6
#: Bands of about HOT records or more, as a sample of 1/SAMPLE of the records shows, are split by words.
HOT, SAMPLE = 4096, 64
#: The hot bands, and the counts of words that order them, are broadcast: so many at most.
MAX_HOT, MAX_COUNTS = 50_000, 50_000
#: Classes of exact copies up to this size come out as all their pairs, larger ones as a star.
ALL_PAIRS = 256
#: Keys of a part of the band shuffle, about, and records that are signed together.
PART_KEYS, SIGNED = 1_000_000, 2000
#: Strips, each TALL high, above an element, at first and at most; a dart's value takes 9 bits for
#: its strip and 23 for its place in it.
TALL, STRIPS, MAX_STRIPS = 16, 16, 512
#: Elements whose darts a task keeps.
KEPT = 30_000
#: Darts in a piece of a strip of width 1 (a Poisson variable of mean TALL) by the first 16 bits of
#: the piece's hash.
_DARTS = np.searchsorted(np.cumsum(np.exp(-TALL + np.r_[0.0, np.cumsum(np.log(TALL / np.arange(1.0, 80)))])), (np.arange(2**16) + 0.5) / 2**16).astype(np.int64)
_EMPTY = np.uint32(2**32 - 1)
_WORDS = SKETCH // 64


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place) for i repeated counts[i] times, places 0, 1, ... of each."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def throw(elements: np.ndarray, weights: np.ndarray, strips: int, k: int) -> np.ndarray:
    """[elements, k] uint32: the earliest dart at each coordinate that hits the element's region
    [0, weight) x [0, strips * TALL); _EMPTY where none does.

    The plane of an element (a 64-bit hash) is covered with pieces of strips, 1 wide and TALL high;
    each holds Poisson(TALL) darts at places hashed from element and piece. So the same darts fall
    wherever the element occurs, whatever the batch. A dart's value, which orders darts by height, has
    its strip in the high bits and its place in the strip in the low.
    """
    wide = np.ceil(weights).astype(np.int64)
    e, place = _each(wide * strips)
    strip, column = (place // wide[e], place % wide[e]) if (wide > 1).any() else (place, np.zeros_like(place))
    seed = mix(elements[e] ^ mix((column << 32).view(np.uint64) + strip.view(np.uint64) + np.uint64(1)))
    piece, no = _each(_DARTS[seed >> np.uint64(48)])
    own = mix(seed[piece] + (no.view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    if (weights != wide).any():
        hit = column[piece] + (mix(own) >> np.uint64(44)).astype(np.float64) / 2**20 < weights[e[piece]]
        piece, own = piece[hit], own[hit]
    out = np.full(len(elements) * k, _EMPTY)
    value = (strip.astype(np.uint32) << np.uint32(23))[piece] | (own >> np.uint64(41)).astype(np.uint32)
    coordinate = ((own & np.uint64(2**32 - 1)) * np.uint64(k) >> np.uint64(32)).view(np.int64)
    np.minimum.at(out, (e * k)[piece] + coordinate, value)
    return out.reshape(-1, k)


class Thrown:
    """Rows of throw() of elements seen before, kept up to KEPT elements."""

    def __init__(self, k: int) -> None:
        self.k, self.at, self.rows = k, {}, np.zeros((0, k), np.uint32)

    def of(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The place in self.rows of each of the different elements."""
        if len(self.at) > KEPT:
            self.at, self.rows = {}, np.zeros((0, self.k), np.uint32)
        asked = list(zip(hashes.tolist(), weights.tolist()))
        new = [i for i, x in enumerate(asked) if x not in self.at]
        if new:
            n = len(self.at)
            if n + len(new) > len(self.rows):
                grown = np.empty((max(n + len(new), 2 * len(self.rows)), self.k), np.uint32)
                grown[:n] = self.rows[:n]
                self.rows = grown
            for a in range(0, len(new), 4000):
                some = new[a : a + 4000]
                self.rows[n + a : n + a + len(some)] = throw(hashes[some], weights[some], STRIPS, self.k)
            self.at.update((asked[i], n + j) for j, i in enumerate(new))
        return np.fromiter((self.at[x] for x in asked), np.int64, len(asked))


def signatures(record: np.ndarray, element: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_records: int, k: int, kept: Thrown | None = None) -> np.ndarray:
    """[n_records, k]: the earliest dart at each coordinate. record and element: the pairs (record,
    index into hashes and weights), by record. The share of coordinates on which two records agree
    estimates the weighted Jaccard similarity of their elements."""
    kept = kept or Thrown(k)
    out = _earliest(record, kept.of(hashes, weights)[element], kept.rows, n_records)
    strips = STRIPS
    while strips < MAX_STRIPS:  # light records, which few darts hit, get more
        strips *= 2
        short = np.flatnonzero((out == _EMPTY).any(1) & (np.bincount(record, minlength=n_records) > 0))
        for r in np.array_split(short, -(-len(short) * strips // 6000) or 1):
            if len(r):
                mine = np.isin(record, r)
                used, to = np.unique(element[mine], return_inverse=True)
                out[r] = _earliest(np.searchsorted(r, record[mine]), to, throw(hashes[used], weights[used], strips, k), len(r))
    return out


def _earliest(record: np.ndarray, row: np.ndarray, rows: np.ndarray, n_records: int) -> np.ndarray:
    """[n_records, k]: the least of the rows of each record: of the first element of each record, the
    longest record first, then the second, and so on."""
    size = np.bincount(record, minlength=n_records)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    out = np.full((n_records, rows.shape[1]), _EMPTY)
    for a in range(0, n_records, 250):
        some = order[a : a + 250]
        left = len(some)
        best = out[a : a + 250]
        for j in range(int(size[some[0]])):
            while size[some[left - 1]] <= j:
                left -= 1
            np.minimum(best[:left], rows[row[start[some[:left]] + j]], out=best[:left])
    back = np.empty_like(out)
    back[order] = out
    return back


def band_shape(least: float) -> tuple[int, int]:
    """(bands, rows): the most coordinates a band can have with MAX_BANDS bands for which a pair of
    similarity `least` shares none with probability MISS at most."""
    at = min(max(least, 0.01), 0.99)

    def bands(rows: int) -> int:
        return math.ceil(math.log(MISS) / math.log1p(-(at**rows)))

    rows = 1
    while rows < 16 and bands(rows + 1) <= MAX_BANDS:
        rows += 1
    return bands(rows), rows


def sketch_limit(least: float) -> int:
    """The bits in which the sketches of a pair of similarity `least` may differ: more only with
    probability SKETCH_MISS. Each bit differs with probability (1 - least) / 2."""
    p, above = (1 - least) / 2, 1.0
    for c in range(SKETCH):
        above -= math.comb(SKETCH, c) * p**c * (1 - p) ** (SKETCH - c)
        if above <= SKETCH_MISS:
            return c
    return SKETCH


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[records, bands] uint64: a hash of each band's coordinates and its number."""
    by_band = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), by_band.shape[:2])
    for i in range(0, rows, 2):  # two coordinates at a time
        both = by_band[:, :, i].astype(np.uint64) + (by_band[:, :, min(i + 1, rows - 1)].astype(np.uint64) << np.uint64(32))
        key = mix(key ^ both) + np.uint64(i)
    return mix(key)


def sketch(signature: np.ndarray) -> np.ndarray:
    """[records, SKETCH / 64] uint64: a bit of each of the first SKETCH coordinates."""
    bits = (mix(signature[:, :SKETCH].astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def split_hot(keys: np.ndarray, hot: np.ndarray, least: float, record: np.ndarray, hashes: np.ndarray, counts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys of each record) in which a hot key is replaced by one for each word of the
    record's prefix: its size - ceil(least * size) + 1 words of least count. Two records of
    similarity `least` have a word of both prefixes in common, so they still meet. record, hashes,
    counts: of the pairs of record and word."""
    is_hot = np.isin(keys, hot)
    order = np.lexsort((hashes, counts, record))
    place = np.arange(len(record)) - np.repeat(np.cumsum(size) - size, size)
    prefix = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
    first = order[place < prefix[record]]  # pairs, by record
    start = np.cumsum(prefix) - prefix
    r, band = np.nonzero(is_hot)
    at, no = _each(prefix[r])
    split = mix(keys[r, band][at] ^ mix(hashes[first[start[r[at]] + no]]))
    cold, cold_band = np.nonzero(~is_hot)
    owner = np.r_[cold, r[at]]
    by_record = np.argsort(owner, kind="stable")
    return np.r_[keys[cold, cold_band], split][by_record], np.bincount(owner, minlength=len(keys))


def _keyed(least: float, hot, counts):
    """A function of batches of (id, words): (ids, sizes, sketches, keys, keys of each record) of
    some records at a time. hot, counts: broadcasts of the keys to split (sorted) and of the counts
    of the words that have one; counts is None if there are no hot keys."""
    bands, rows = band_shape(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        import xxhash

        k = max(bands * rows, SKETCH)
        kept = Thrown(k)
        for batch in batches:
            for a in range(0, batch.num_rows, SIGNED):
                part = batch.slice(a, SIGNED)
                words = part.column(1)
                size = np.diff(words.offsets.to_numpy(zero_copy_only=False)).astype(np.int64)
                encoded = words.flatten().dictionary_encode()
                distinct = encoded.dictionary.to_pylist()
                hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
                record, element = np.repeat(np.arange(len(size)), size), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                signature = signatures(record, element, hashes, np.ones(len(distinct)), len(size), k, kept)
                keys, of_each = band_keys(signature, bands, rows), np.full(len(size), bands)
                if counts is not None:
                    known = np.fromiter((counts.value.get(w, 0) for w in distinct), np.int64, len(distinct))
                    keys, of_each = split_hot(keys, hot.value, least, record, hashes[element], known[element], size)
                yield part.column(0).to_numpy(), size.astype(np.int32), sketch(signature), keys.ravel(), of_each

    return run


_PACKED = ["key", "id", "size", *(f"sketch{i}" for i in range(_WORDS))]
_KINDS = [np.uint64, np.int64, np.int32, *[np.uint64] * _WORDS]


def _packed(least: float, hot, counts, parts: int):
    """mapInArrow function: (id, words) -> the keys of all bands with their records, packed by part."""
    keyed = _keyed(least, hot, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            return parted(columns[0], parts, dict(zip(_PACKED, columns)))

        n = 0
        for ids, size, bits, keys, of_each in keyed(batches):
            at = np.repeat(np.arange(len(ids)), of_each)
            held.append([keys, ids.astype(np.int64)[at], size[at], *(bits[at, i] for i in range(_WORDS))])
            n += len(keys)
            if n > PART_KEYS:
                yield out()
                n = 0
        if held:
            yield out()

    return run


def _key_samples(least: float):
    """mapInArrow function: (id, words) -> the keys of all bands."""
    keyed = _keyed(least, None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, keys, _of_each in keyed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return run


def _met(least: float):
    """mapInArrow function over the packed keys of a part: (a, b), a < b, of the records that share a
    key, unless their sizes or sketches rule them out. A run of equal keys is compared at distance 1,
    2, ... all at once; nothing but what passes is handed on, a pair once from each part."""

    limit = sketch_limit(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, size, *bits in batches_of(batches, _KINDS, 1 << 62):  # a part is bounded
            order = np.argsort(key)
            key = key[order]
            alone = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
            order, key = order[~alone], key[~alone]
            ids, size, bits = ids[order], size[order], [x[order] for x in bits]
            got: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], ids[:0])]
            at, d = np.arange(len(key)), 0
            while len(at):
                d += 1
                at = at[: np.searchsorted(at, len(key) - d)]
                at = at[key[at] == key[at + d]]
                x, y = size[at], size[at + d]
                near = at[(x >= least * y - 1e-9) & (y >= least * x - 1e-9) & (ids[at] != ids[at + d])]
                differ = sum(np.bitwise_count(b[near] ^ b[near + d]).astype(np.int16) for b in bits)
                near = near[differ <= limit]
                got.append((np.minimum(ids[near], ids[near + d]), np.maximum(ids[near], ids[near + d])))
            a, b = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    return run


class NearDuplicates:
    """The similarity join of the records of docs: pairs of different texts, and classes of copies.

    similarity: Jaccard index of the sets of different words, at least `least`; records of fewer
    than min_words different words take no part (nor do null ids and null or empty lists). Words are
    compared in lower case without surrounding blanks and tabs; order and repetition don't matter.
    A record delivered again counts once. Ids are integers. Other columns of docs are not read,
    whatever their names.

    1. Records with the same word set form a class, whose smallest id stands for all.
    2. Each class gets a DartMinHash signature of its word set, all words with the same weight.
    3. Classes that share a band are candidates, unless their sizes or sketches rule them out. The
       bands' keys are shuffled as packed arrays, about PART_KEYS a part. A band of about HOT classes
       or more (many share frequent words) is split by the rarest words of each, which loses no pair:
       similar sets share one of those.
    4. Candidates are checked exactly.

    With `least` 0.7 there are 59 bands of 5: a pair of similarity s is missed with probability
    (1 - s**5)**59, 2e-5 at 0.7 and 5e-8 at 0.75; the sketch loses another 1e-6 at most. Other
    thresholds have as many bands as keep it below MISS. Nothing else is left out.
    """

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", words_col: str = "words", order_col: str | None = "added_at", least: float = 0.8, min_words: int = 12) -> None:
        self.spark, self.least = docs.sparkSession, least
        one = one_delivery(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, F.col(words_col), order_col)
        sets = word_sets(one, min_words).select(F.col(id_col).alias("id"), "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "words").alias("h2"))
        self.sets = written(sets, "sets")
        shared = self.sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
        #: (h1, h2, rep, copies) of classes of more than one record; the smallest id stands for all.
        self.shared = written(shared, "shared")
        self.members = written(self.sets.select("id", "h1", "h2").join(small(self.shared), ["h1", "h2"]).select("id", "rep", "copies"), "members")
        others = self.members.where("id <> rep").select("id")
        #: (id, words, h1, h2) of one record of each class
        self.classes = self.sets.join(small(others), "id", "left_anti")
        self.links = written(self._checked(written(self._candidates(), "candidates")), "links")

    def _hot(self) -> np.ndarray:
        """The keys of the hot bands, sorted; of more than MAX_HOT the largest."""
        sample = self.classes.where(F.pmod("h1", F.lit(SAMPLE)) == 0).select("id", "words").mapInArrow(_key_samples(self.least), "key long")
        large = sample.groupBy("key").count().where(F.col("count") >= max(2, HOT // SAMPLE))
        return np.sort(np.array([r["key"] for r in large.orderBy(F.desc("count"), "key").limit(MAX_HOT).collect()], np.int64).view(np.uint64))

    def _counts(self) -> dict[str, int]:
        """Words in so many classes that there can't be more than MAX_COUNTS, with their counts."""
        total = self.classes.agg(F.sum(F.size("words"))).first()[0] or 0
        frequent = self.classes.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") >= max(2, total / MAX_COUNTS))
        return {r["w"]: r["count"] for r in frequent.toLocalIterator()}

    def _candidates(self) -> DataFrame:
        hot, context = self._hot(), self.spark.sparkContext
        parts = parts_for(self.classes.count() * band_shape(self.least)[0], PART_KEYS, context.defaultParallelism)
        shared = (context.broadcast(hot), context.broadcast(self._counts())) if len(hot) else (None, None)
        columns = ", ".join(f"{c} binary" for c in _PACKED)
        packed = self.classes.select("id", "words").mapInArrow(_packed(self.least, *shared, parts), f"part int, {columns}")
        return packed.repartitionById(parts, F.col("part")).mapInArrow(_met(self.least), "a long, b long").distinct()

    def _checked(self, pairs: DataFrame) -> DataFrame:
        """(a, b, jaccard) of the pairs that are similar, by all their words, of which 64-bit hashes are
        compared. Only the words of candidates are moved."""
        ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
        asked = self.classes.join(small(ends), "id", "left_semi").select("id", F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
        a, b = (asked.select(F.col("id").alias(x), F.col("words").alias(f"w{x}")) for x in "ab")
        both = F.size(F.array_intersect("wa", "wb"))
        jaccard = both / (F.size("wa") + F.size("wb") - both)
        return pairs.join(a, "a").join(b, "b").withColumn("jaccard", jaccard).where(F.col("jaccard") >= self.least - 1e-12).select("a", "b", "jaccard")

    def pairs(self) -> DataFrame:
        """(doc_id_a, doc_id_b), the smaller id first: every pair of similar records. Of a class of
        more than ALL_PAIRS copies, its members are paired with the one that stands for it, and only
        that one with others; groups() has every record."""
        few = self.members.where(F.col("copies") <= ALL_PAIRS).select("id", "rep")
        stars = self.members.where((F.col("copies") > ALL_PAIRS) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
        within = few.alias("x").join(few.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))
        between = self.links.select("a", "b").join(few.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a", "left").join(few.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b", "left")
        between = between.select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
        every = within.unionByName(stars).unionByName(between)
        return every.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))

    def groups(self) -> DataFrame:
        """(doc_id, class_id, n_links): each record that takes part with the smallest id it is
        connected to through similar records, and the number of other records similar to it."""
        label = components(self.links.select("a", "b"))
        ends = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        times = self.shared.select("rep", "copies")
        linked = ends.join(small(times.withColumnRenamed("rep", "b")), "b", "left").groupBy(F.col("a").alias("id")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("linked"))
        every = self.sets.select("id").join(small(self.members), "id", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
        of_rep = label.join(linked, label["node"] == linked["id"]).select(F.col("node").alias("rep"), "label", "linked")
        every = every.join(of_rep, "rep", "left")
        return every.select(F.col("id").alias("doc_id"), F.coalesce("label", "rep").alias("class_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node connected with each node of links(a, b). Rounds of taking the
    smallest label among neighbours and then the label's label, each written to the shared folder,
    until nothing changes; the tables of the round before are deleted."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "label")
    while True:
        nearby = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("nearby"))
        lower = label.join(nearby, "node").select("node", F.least("label", "nearby").alias("new"), F.col("label").alias("old"))
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("far"))
        after = written(lower.join(jump, "new", "left").select("node", F.least("new", "far").alias("label"), "old"), "label")
        before, label = label, after.select("node", "label")
        dropped(before)
        if after.where("label <> old").limit(1).count() == 0:
            dropped(both)
            return label
