"""Items that appear together more often than chance: exact pair counts against a fitted
bipartite configuration null."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.hashing import mix
from topicloom.llm._common import batches_of, one_delivery, parted, parts_for, word_sets, written

#: Items are broadcast up to so many rows (about 100 bytes each); beyond, they are joined by shuffle.
SMALL_ITEMS = 1_000_000
#: A basket of more items is cut into blocks of first items, which different tasks pair.
BLOCK = 2048
#: Pairs counted in memory before they are handed on; pairs of a part at most, about, since those that
#: frequencies rule out are counted too when the parts are planned.
HELD_PAIRS, PART_PAIRS = 4_000_000, 8_000_000
#: Item frequencies and basket sizes above this share classes 1 % wide in the null model.
EXACT_CLASSES = 4096


def baskets(rows: DataFrame, kind: str, id_col: str, words_col: str, order_col: str | None) -> DataFrame:
    """(kind, rec, items): the different words of each record that has any."""
    one = word_sets(one_delivery(rows, id_col, F.col(words_col), order_col))
    return one.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("rec"), F.col("words").alias("items"))


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """df with code int, 0, 1, 2, ..., written. Only a count for each partition reaches the driver."""
    at = written(df, label).withColumn("_at", F.monotonically_increasing_id())
    sizes = {r["p"]: r["n"] for r in at.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    if total >= 2**31:
        raise ValueError("more than 2**31 frequent items")
    start = F.element_at(F.lit(starts or [0]), (F.shiftright("_at", 33) + 1).cast("int"))
    return written(at.withColumn("code", (start + F.col("_at").bitwiseAND(2**33 - 1)).cast("int")).drop("_at"), label)


def _pairs(rows: pa.Table, most: np.ndarray, power: float) -> Iterator[np.ndarray]:
    """Keys code * 2**31 + code of the pairs of whole baskets: rows of (basket, kind, block, code, n).

    most[kind] * n ** power bounds the frequency of the other, more frequent item."""
    basket, kind, block, code, n = (rows.column(i).to_numpy() for i in range(5))
    run = np.cumsum(np.r_[True, basket[1:] != basket[:-1]]) - 1
    order = np.lexsort((code, n, run))
    run, kind, block, code, n = run[order], kind[order], block[order], code[order].astype(np.int64), n[order]
    at = np.arange(len(run))
    key = run * 2**40 + np.minimum(n, 2**40 - 1)
    bound = np.floor(most[kind] * n.astype(float) ** power * (1 + 1e-9) + 1e-6)
    end = np.searchsorted(key, run * 2**40 + np.minimum(bound, 2**40 - 1).astype(np.int64), side="right")
    first = np.searchsorted(run, run)
    mine = (at - first) // BLOCK == block  # a basket of one block has no other
    count = np.where(mine, np.maximum(end - at - 1, 0), 0)
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HELD_PAIRS, side="right")))
        c = count[a:b]
        left = np.repeat(at[a:b], c)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(c) - c, c)
        x, y = code[left], code[right]
        yield np.minimum(x, y) * 2**31 + np.maximum(x, y)
        a = b


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different keys, rising; the sum of each one's counts)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], (np.diff(np.r_[first, len(keys)]) if counts is None else np.add.reduceat(counts, first) if len(first) else counts).astype(np.int32 if counts is None else np.int64)


def _counted(most: list[float], power: float, parts: int):
    """mapInArrow function: (basket, kind, block, code, n), each basket in one run of rows -> packed
    pair counts (part, pairs, counts)."""
    bounds = np.array(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        open_: list[pa.RecordBatch] = []  # the last basket may go on in the next batch
        size = 0

        def out() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate(held) if held else np.zeros(0, np.int64))
            held.clear()
            return parted(mix(keys.view(np.uint64)), parts, {"pairs": keys, "counts": counts})

        def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal size
            for keys in _pairs(rows, bounds, power):
                held.append(keys)
                size += len(keys)
                if size > HELD_PAIRS:
                    yield out()
                    size = 0

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            others = np.flatnonzero(ids != ids[-1])
            last = int(others[-1]) + 1 if len(others) else 0  # where the batch's last basket begins
            if last or (open_ and open_[-1].column(0)[0].as_py() != ids[0]):
                whole = pa.Table.from_batches([*open_, batch.slice(0, last)])
                open_.clear()
                if whole.num_rows:
                    yield from add(whole)
            open_.append(batch.slice(last))
        if open_:
            yield from add(pa.Table.from_batches(open_))
        yield out()

    return run


def _merged(least: int):
    """mapInArrow function: the packed pair counts of a part -> (pair, n_ab) of pairs in at least
    `least` records. Counts are summed as they come: no more than the part's different pairs are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, c in batches_of(batches, [np.int64, np.int32], HELD_PAIRS):
            keys, counts = _summed(np.r_[keys, k], np.r_[counts, c])
        enough = counts >= least
        yield pa.RecordBatch.from_arrays([pa.array(keys[enough]), pa.array(counts[enough])], ["pair", "n_ab"])

    return run


def degree_class(n: Column) -> Column:
    """n itself up to EXACT_CLASSES; above, the number of a class 1 % wide."""
    return F.when(n <= EXACT_CLASSES, n).otherwise(EXACT_CLASSES + F.floor(F.log(n / F.lit(EXACT_CLASSES)) / math.log(1.01)) + 1).cast("long")


def _classes(df: DataFrame, n: Column) -> dict[str, pd.DataFrame]:
    """By kind: class, mean n, number. At most some thousands of rows each, whatever the data."""
    got = df.groupBy("kind", degree_class(n).alias("cls")).agg(F.avg(n).alias("n"), F.count("*").alias("m")).toPandas()
    return {k: g.sort_values("cls").reset_index(drop=True) for k, g in got.groupby("kind")}


def fit_null(items: pd.DataFrame, sizes: pd.DataFrame, *, rounds: int = 500, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """x by item class and y by basket class, so that with P(item in basket) = x*y / (1 + x*y) items
    have their frequency and baskets their size on average (fixed-point iteration)."""
    d, c = items["n"].to_numpy(float), items["m"].to_numpy(float)
    s, m = sizes["n"].to_numpy(float), sizes["m"].to_numpy(float)
    edges = max((d * c).sum(), 1e-300)
    x, y = d / np.sqrt(edges), s / np.sqrt(edges)
    for _ in range(rounds):
        new_x = d / ((m * y) / (1 + np.outer(x, y))).sum(1)
        new_y = s / ((c * new_x)[:, None] / (1 + np.outer(new_x, y))).sum(0)
        change = max(np.abs(new_x / x - 1).max(initial=0), np.abs(new_y / y - 1).max(initial=0))
        x, y = np.minimum(new_x, 1e12), np.minimum(new_y, 1e12)
        if change < tolerance:
            break
    return x, y


_erfc = np.frompyfunc(math.erfc, 1, 1)


def log_tail(q: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(X >= n) for X the sum over classes of Binomial(m, q): a Poisson-binomial upper tail, by
    the Lugannani-Rice saddlepoint with lattice correction. q: a row for each n. Near and below the
    mean the normal approximation is used."""
    mean, var = q @ m, (q * (1 - q)) @ m
    t = np.log(np.maximum(n, 1e-9) / np.maximum(mean, 1e-300))
    hi = np.full(len(n), 700.0)
    lo = np.zeros(len(n))
    t = np.clip(t, 1e-9, 699)
    for _ in range(60):
        e = q * np.exp(np.minimum(t, 600))[:, None]
        p = e / (1 - q + e)
        k1, k2 = p @ m, (p * (1 - p)) @ m
        hi, lo = np.where(k1 > n, t, hi), np.where(k1 > n, lo, t)
        step = t - (k1 - n) / np.maximum(k2, 1e-300)
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        if np.abs(new - t).max(initial=0) < 1e-10:
            break
        t = new
    e = q * np.exp(np.minimum(t, 600))[:, None]
    p = e / (1 - q + e)
    k0, k2 = np.log1p(q * np.expm1(np.minimum(t, 600))[:, None]) @ m, (p * (1 - p)) @ m
    w = np.sqrt(2 * np.maximum(t * n - k0, 1e-300))
    u = -np.expm1(-t) * np.sqrt(np.maximum(k2, 1e-300))
    mills = np.where(w < 30, np.sqrt(np.pi / 2) * _erfc(np.minimum(w, 30) / np.sqrt(2)).astype(float) * np.exp(np.minimum(w, 30) ** 2 / 2), 1 / w - 1 / w**3)
    far = -(w**2) / 2 - 0.5 * np.log(2 * np.pi) + np.log(np.maximum(mills + 1 / u - 1 / w, 1e-300))
    z = (n - 0.5 - mean) / np.sqrt(np.maximum(var, 1e-300))
    near = np.log(np.maximum(0.5 * _erfc(np.clip(z, -37, 37) / np.sqrt(2)).astype(float), 1e-300))
    return np.minimum(np.where(n > mean + 0.5 * np.sqrt(var) + 1e-6, far, near), 0)


def cooccurrence(records: DataFrame, *, least: dict[str, int], min_npmi: float, fdr: float = 0.05, small_items: int = SMALL_ITEMS) -> DataFrame:
    """(kind, word_a, word_b, n_a, n_b, n_ab, n, npmi, expected, log10_p, surprising) of every pair
    of different items of a kind that is in at least least[kind] records and whose
    ln(n*n_ab/(n_a*n_b)) / ln(n/n_ab) is min_npmi (0 or more) or above; pairs in all n records are
    no case. word_a < word_b by code point. records: as of baskets().

    Counts are exact. Items in fewer than least records, and pairs whose frequencies alone rule
    min_npmi out (n_ab can't pass the smaller one, so the larger one is at most
    n**(1-t) * n_a**t), are never paired. Pairs are summed within a task, shuffled as packed arrays,
    and summed again; a record of more than BLOCK items is cut into blocks that several tasks pair.

    expected and log10_p: mean and upper tail of n_ab under the bipartite configuration null, fitted
    to all item frequencies and record sizes of the kind. surprising: rejected by Benjamini and
    Hochberg at level fdr with the number of all pairs of items of the kind as the number of tests,
    but with ranks among the pairs returned only. Pairs below min_npmi or least are not ranked, so
    the cut is at most that of all pairs: what is surprising here is so among all, while borderline
    pairs may be missing.
    """
    kinds = sorted(least)
    records = written(records.where(F.col("kind").isin(kinds)), "baskets")
    counts = records.select("kind", F.explode("items").alias("item")).groupBy("kind", "item").agg(F.count("*").alias("n"))
    counts = written(counts, "items")
    sizes = _classes(records, F.size("items"))
    degrees = _classes(counts, F.col("n"))
    n = {k: int(sizes[k]["m"].sum()) if k in sizes else 0 for k in kinds}

    enough = F.lit(False)
    for k in kinds:
        enough = enough | ((F.col("kind") == k) & (F.col("n") >= least[k]))
    items = _numbered(counts.where(enough), "coded")
    small = items.count() <= small_items
    hinted = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    kind_no = F.array_position(F.lit(kinds), F.col("kind")).cast("int") - 1
    blocks = F.floor((F.size("items") - 1) / BLOCK).cast("int")
    one = records.where(F.size("items") <= BLOCK).select("kind", F.lit(0).alias("block"), "items")
    many = records.where(F.size("items") > BLOCK).select("kind", F.explode(F.sequence(F.lit(0), blocks)).alias("block"), "items").repartition("block", F.xxhash64("items"))
    each = one.unionByName(many).withColumn("basket", F.monotonically_increasing_id())
    tokens = each.select("basket", "kind", "block", F.explode("items").alias("item")).join(hinted(items), ["kind", "item"]).select("basket", kind_no.alias("k"), "block", "code", "n")
    if not small:  # the join has scattered the baskets
        tokens = tokens.repartition("basket").sortWithinPartitions("basket")
    most = [float(max(n[k], 1)) ** (1 - min_npmi) for k in kinds]
    held = {k: float((degrees[k]["n"] * degrees[k]["m"]).sum()) for k in kinds if n[k]}  # items in records
    part_of = {k: float((degrees[k]["n"] * degrees[k]["m"])[degrees[k]["n"] >= least[k]].sum()) / max(held[k], 1) for k in held}
    expected = sum(part_of[k] ** 2 * float((sizes[k]["n"] ** 2 * sizes[k]["m"]).sum()) / 2 for k in held)  # pairs, about
    parts = parts_for(int(expected), PART_PAIRS, records.sparkSession.sparkContext.defaultParallelism)
    packed = tokens.mapInArrow(_counted(most, min_npmi, parts), "part int, pairs binary, counts binary")
    pairs = packed.repartitionById(parts, F.col("part")).mapInArrow(_merged(min(least.values())), "pair long, n_ab long")

    def side(x: str) -> DataFrame:
        return hinted(items.select(F.col("code").alias(f"code_{x}"), F.col("kind").alias(f"kind_{x}"), F.col("item").alias(f"item_{x}"), F.col("n").alias(f"f_{x}")))

    both = pairs.select(F.shiftright("pair", 31).cast("int").alias("code_x"), F.col("pair").bitwiseAND(2**31 - 1).cast("int").alias("code_y"), "n_ab")
    named = both.join(side("x"), "code_x").join(side("y"), "code_y").withColumnRenamed("kind_x", "kind")
    ahead = F.col("item_x") < F.col("item_y")
    total, asked = (F.element_at(F.lit(x), F.array_position(F.lit(kinds), F.col("kind")).cast("int")) for x in ([n[k] for k in kinds], [least[k] for k in kinds]))
    named = named.select("kind", F.when(ahead, F.col("item_x")).otherwise(F.col("item_y")).alias("word_a"), F.when(ahead, F.col("item_y")).otherwise(F.col("item_x")).alias("word_b"), F.when(ahead, F.col("f_x")).otherwise(F.col("f_y")).alias("n_a"), F.when(ahead, F.col("f_y")).otherwise(F.col("f_x")).alias("n_b"), "n_ab", total.cast("long").alias("n"), asked.alias("_least"))
    named = named.where((F.col("n_ab") >= F.col("_least")) & (F.col("n_ab") < F.col("n"))).drop("_least")
    npmi = F.log(F.col("n") * F.col("n_ab").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))) / F.log(F.col("n") / F.col("n_ab"))
    found = named.withColumn("npmi", npmi).where(F.col("npmi") >= min_npmi - 1e-12)

    fitted = {k: (degrees[k], sizes[k], *fit_null(degrees[k], sizes[k])) for k in kinds if n[k]}
    shared = records.sparkSession.sparkContext.broadcast(fitted)
    schema = T.StructType([*found.schema.fields, T.StructField("expected", T.DoubleType()), T.StructField("log10_p", T.DoubleType())])

    def cls(f: np.ndarray) -> np.ndarray:
        return np.where(f <= EXACT_CLASSES, f, EXACT_CLASSES + np.floor(np.log(f / EXACT_CLASSES) / math.log(1.01)) + 1).astype(np.int64)

    def tails(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for kind, g in frame.groupby("kind"):
                items_of, sizes_of, x, y = shared.value[kind]
                m = sizes_of["m"].to_numpy(float)
                for a in range(0, len(g), 1000):
                    part = g.iloc[a : a + 1000]
                    xa, xb = (x[np.clip(np.searchsorted(items_of["cls"].to_numpy(), cls(part[c].to_numpy(float))), 0, len(x) - 1)] for c in ("n_a", "n_b"))
                    pa_, pb_ = (np.outer(v, y) / (1 + np.outer(v, y)) for v in (xa, xb))
                    q = np.clip(pa_ * pb_, 0, 1 - 1e-12)
                    yield part.assign(expected=q @ m, log10_p=log_tail(q, m, part["n_ab"].to_numpy(float)) / math.log(10))

    tested = written(found.mapInPandas(tails, schema), "tested")
    width = 0.01
    bins = tested.groupBy("kind", F.floor(-F.col("log10_p") / width).alias("b")).agg(F.count("*").alias("c")).toPandas()
    cuts = {k: float("inf") for k in kinds}
    for k, g in bins.groupby("kind"):  # from the smallest tail up; a bin counts with its largest tail
        g = g.sort_values("b", ascending=False)
        v = float(degrees[k]["m"].sum())
        ok = -g["b"].to_numpy() * width + math.log10(max(v * (v - 1) / 2, 1)) <= np.log10(fdr * g["c"].cumsum().to_numpy())
        if ok.any():
            cuts[k] = float(g["b"].to_numpy()[np.flatnonzero(ok)[-1]])
    cut = F.element_at(F.lit([cuts[k] for k in kinds]), F.array_position(F.lit(kinds), F.col("kind")).cast("int"))
    return tested.withColumn("surprising", F.floor(-F.col("log10_p") / width) >= cut)
