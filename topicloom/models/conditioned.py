"""Models whose document prior depends on metadata or labels, or that explain a response."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.hashing import uniforms
from topicloom.functions.special import digamma, lbfgs, legendre
from topicloom.models.base import LDA, Block, dirichlet_lls, sample, shares
from topicloom.models.metadata import exponents, tdf_grid
from topicloom.models.regression import ridge

#: Categories and labels become columns of a design held by the driver: no more than these.
MAX_VALUES = 20_000


def _values(docs: DataFrame, column: Column) -> dict[str, int]:
    """Values in order with the number of documents that have them."""
    found = docs.select(column.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy("v").limit(MAX_VALUES + 1).collect()
    if len(found) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} different values")
    return {r["v"]: r["n"] for r in found}


def _strings(values: list[str]) -> Column:
    return F.lit(values) if values else F.array().cast("array<string>")


def partial_sums(rows: DataFrame, f, size: int, read=None) -> np.ndarray:
    """Sum over batches of f(x, nd, s), a vector of the size: partial in each task, then one row. x, nd
    and s are matrices by document; read makes x of the column instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f((read or _matrix)(batch.column(0)), *(_matrix(batch.column(i)) for i in (1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    got = rows.select("x", "nd", "s").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("v").to_numpy()
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column))


class Features:
    """Sparse features of documents: lists of index, value, index, value, ..."""

    def __init__(self, lists: list[np.ndarray]) -> None:
        flat = np.concatenate(lists) if lists else np.zeros(0)
        self.n = len(lists)
        self.doc = np.repeat(np.arange(self.n), [len(x) // 2 for x in lists])
        self.index, self.value = flat[::2].astype(np.int64), flat[1::2]

    @classmethod
    def of(cls, column: pa.ListArray) -> Features:
        offsets = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        return cls([flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])])

    def dot(self, lam: np.ndarray) -> np.ndarray:
        """[documents, topics] of lam [topics, width]."""
        out = np.zeros((self.n, len(lam)))
        np.add.at(out, self.doc, lam.T[self.index] * self.value[:, None])
        return out

    def outer(self, slope: np.ndarray, width: int) -> np.ndarray:
        """[topics, width]: sums over documents of slope [documents, topics] times features."""
        out = np.zeros((width, slope.shape[1]))
        np.add.at(out, self.index, slope[self.doc] * self.value[:, None])
        return out.T


class DMR(LDA):
    """Dirichlet-multinomial regression: a document's prior is exp(lambda . features) + epsilon, the
    features being a constant, its category (metadata) and its tags (multi_metadata). Weights are
    fitted from the current ones and from random ones, all in the same passes."""

    needs = ("metadata",)
    asymmetric_alpha = False
    #: Random starts of a fit beside the current weights, and steps of each.
    restarts, fit_steps = 2, 10

    def __init__(self, k: int = 1, *, sigma: float = 1.0, alpha_epsilon: float = 1e-10, **kw) -> None:
        super().__init__(k, **kw)
        self.sigma, self.alpha_epsilon = sigma, alpha_epsilon
        self.metadata_values: list[str] = []
        self.multi_values: list[str] = []
        self.metadata_counts: dict[str, int] = {}
        self.multi_counts: dict[str, int] = {}

    def learn(self, docs: DataFrame) -> None:
        self.metadata_counts = _values(docs, F.col("metadata"))
        self.multi_counts = _values(docs, F.explode(F.array_distinct("multi_metadata"))) if "multi_metadata" in docs.columns else {}
        self.metadata_values, self.multi_values = list(self.metadata_counts), list(self.multi_counts)

    def _categories(self) -> Column:
        """array<int>: the numbers of the constant (0), the category and the tags."""
        at = lambda values, v: F.array_position(_strings(values), v).cast("int")
        one = F.filter(F.array(F.when(F.col("metadata").isNotNull(), at(self.metadata_values, F.col("metadata")))), lambda i: i > 0)
        out = F.concat(F.array(F.lit(0)), one)
        if self.multi_values:
            many = F.filter(F.transform(F.array_distinct(F.coalesce("multi_metadata", F.array().cast("array<string>"))), lambda v: at(self.multi_values, v)), lambda i: i > 0)
            out = F.concat(out, F.transform(many, lambda i: i + len(self.metadata_values)))
        return out

    def features(self, docs: DataFrame) -> list[Column]:
        return [F.flatten(F.transform(self._categories(), lambda c: F.array(c.cast("double"), F.lit(1.0)))).alias("x")]

    def _needed(self, docs: DataFrame) -> DataFrame:
        self.needs = ("metadata", *(("multi_metadata",) if "multi_metadata" in docs.columns else ()), *type(self).needs[1:])
        return super()._needed(docs)

    def width(self) -> int:
        return 1 + len(self.metadata_values) + len(self.multi_values)

    def begin(self) -> None:
        self.lam = np.zeros((self.k, self.width()))
        self.lam[:, 0] = np.log(self.alpha)
        self.center = self.lam[:, 0].copy()

    def spread(self) -> np.ndarray:
        """Standard deviation of the prior of each feature's weight."""
        return np.full(self.width(), self.sigma)

    def state(self) -> dict:
        return {**super().state(), "lam": self.lam, "eps": self.alpha_epsilon}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        alpha = np.exp(np.minimum(Features(block.x).dot(g["lam"]), 30)) + g["eps"]
        nd = sample(block, g, sweep, lambda n, a: n + alpha[:a])
        block.s = list(alpha)
        return nd

    def _center(self) -> np.ndarray:
        center = np.zeros((self.k, self.width()))
        center[:, 0] = self.center
        return center

    def optimize(self) -> None:
        k, w, eps = self.k, self.width(), self.alpha_epsilon
        sd, center = self.spread(), self._center()

        def f(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
            lams = [p.reshape(k, w) for p in points]
            good = [i for i, lam in enumerate(lams) if np.abs(lam).max() <= 30]

            def part(x: Features, nd: np.ndarray, _: np.ndarray) -> np.ndarray:
                out = []
                for i in good:
                    e = np.exp(x.dot(lams[i]))
                    a = e + eps
                    s, n = a.sum(1), nd.sum(1)
                    slope = (digamma(s) - digamma(s + n))[:, None] + digamma(nd + a) - digamma(a)
                    out.append(np.r_[dirichlet_lls(nd, a).sum(), x.outer(slope * e, w).ravel()])
                return np.concatenate(out)

            size = 1 + k * w
            got = partial_sums(self.rows, part, size * len(good), Features.of).reshape(-1, size) if good else []
            answers: list[tuple[float, np.ndarray]] = [(float("inf"), p) for p in points]
            for i, sums in zip(good, got):
                off = (lams[i] - center) / sd**2
                answers[i] = (-sums[0] + float((off * (lams[i] - center)).sum()) / 2, -sums[1:] + off.ravel())
            return answers

        noise = np.random.Generator(np.random.Philox(key=[self.seed, self.global_step])).standard_normal((self.restarts, k, w))
        starts = [self.lam.ravel(), *((center + np.minimum(sd, 1.0) * 0.5 * x).ravel() for x in noise)]
        self.lam = lbfgs(f, starts, steps=self.fit_steps).reshape(k, w)

    def attributes(self) -> dict[str, Column]:
        return {"alpha": F.col("s"), "features": F.col("x")}

    def theta_expr(self) -> Column:
        return shares(F.col("nd"), F.col("s"))

    @staticmethod
    def settle(block: Block, g: dict) -> None:
        block.s = list(np.exp(np.minimum(Features(block.x).dot(g["lam"]), 30)) + g["eps"])

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        alpha = np.exp(np.minimum(Features(block.x).dot(g["lam"]), 30)) + g["eps"]
        return dirichlet_lls(block.counts(len(g["lam"])), alpha)

    def state_ll(self) -> float:
        """Words given topics, and the weights given their normal prior."""
        return self.word_ll() - float((((self.lam - self._center()) / self.spread()) ** 2).sum()) / 2

    def more_facts(self) -> dict[str, object]:
        tell = lambda counts: ", ".join(f"{v} {n}" for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20])
        return {"metadata": f"{len(self.metadata_counts)}: {tell(self.metadata_counts)}", **({"multi_metadata": f"{len(self.multi_counts)}: {tell(self.multi_counts)}"} if self.multi_counts else {})}

    def _numbers(self, metadata: str | None, multi_metadata: tuple[str, ...]) -> list[int]:
        out = [0]
        for v, known, at in [(metadata, self.metadata_values, 1), *((m, self.multi_values, 1 + len(self.metadata_values)) for m in multi_metadata)]:
            if v is not None:
                if v not in known:
                    raise ValueError(f"unknown metadata {v!r}")
                out.append(at + known.index(v))
        return out

    def topic_prior(self, metadata: str | None = None, multi_metadata: tuple[str, ...] = (), raw: bool = False) -> np.ndarray:
        """Prior of a document with the metadata; raw: its logarithm without epsilon."""
        self._trained()
        logs = self.lam[:, self._numbers(metadata, multi_metadata)].sum(1)
        return logs if raw else np.exp(logs) + self.alpha_epsilon

    @property
    def lambdas(self) -> np.ndarray:
        """[topics, features]: constant, categories, tags."""
        self._trained()
        return self.lam

    def weights_of(self) -> DataFrame:
        """(kind, value, topic, lam): the weights by what they stand for; kind constant, metadata or
        multi_metadata."""
        names = [("constant", None), *(("metadata", v) for v in self.metadata_values), *(("multi_metadata", v) for v in self.multi_values)]
        each = self.lam.shape[1] // len(names)
        rows = [(kind, v, t, [float(x) for x in self.lam[t, i * each : (i + 1) * each]]) for i, (kind, v) in enumerate(names) for t in range(self.k)]
        return self.spark.createDataFrame(rows, "kind string, value string, topic int, lam array<double>")


class GDMR(DMR):
    """Generalised DMR: weights are polynomials (shifted Legendre) of numeric metadata, one polynomial
    for the constant and one more for each category and tag."""

    needs = ("metadata", "numeric_metadata")

    def __init__(self, k: int = 1, *, degrees: list[int] | None = None, sigma0: float = 3.0, decay: float = 0.0, metadata_range: list[tuple[float, float]] | None = None, **kw) -> None:
        super().__init__(k, **kw)
        self.degrees, self.sigma0, self.decay = list(degrees or []), sigma0, decay
        self.metadata_range = metadata_range

    def learn(self, docs: DataFrame) -> None:
        super().learn(docs)
        n = len(self.degrees)
        bad = docs.where(F.col("numeric_metadata").isNull() | (F.size("numeric_metadata") != n)).limit(1).count()
        if bad:
            raise ValueError(f"numeric_metadata must have {n} numbers")
        stats = (F.min, F.max, F.avg, F.stddev_pop)
        found = docs.agg(*[f(F.get("numeric_metadata", F.lit(i))).alias(f"{f.__name__}{i}") for i in range(n) for f in stats]).first() if n else {}
        self.numeric_stats = [[found[f"{f.__name__}{i}"] for f in stats] for i in range(n)]
        if self.metadata_range is None:
            self.metadata_range = [(low, high) for low, high, *_ in self.numeric_stats]

    def more_facts(self) -> dict[str, object]:
        named = {f"numeric metadata {i}": f"from {low:g} to {high:g}, mean {mean:g}, deviation {sd:g}" for i, (low, high, mean, sd) in enumerate(self.numeric_stats)}
        return {**super().more_facts(), **named}

    def _terms(self) -> Column:
        unit = [(F.get("numeric_metadata", F.lit(i)) - low) / max(high - low, 1e-300) for i, (low, high) in enumerate(self.metadata_range)]
        out = []
        for powers in exponents(self.degrees):
            t = F.lit(1.0)
            for x, n in zip(unit, powers):
                t = t * legendre(x, n)
            out.append(t)
        return F.array(*out)

    def features(self, docs: DataFrame) -> list[Column]:
        n = len(exponents(self.degrees))
        return [F.flatten(F.transform(self._categories(), lambda c: F.flatten(F.transform(self._terms(), lambda t, j: F.array((c * n + j).cast("double"), t))))).alias("x")]

    def width(self) -> int:
        return super().width() * len(exponents(self.degrees))

    def spread(self) -> np.ndarray:
        terms = exponents(self.degrees)
        one = np.array([self.sigma0 if not any(p) else self.sigma / math.prod((n + 1) ** self.decay for n in p) for p in terms])
        return np.tile(one, self.width() // len(terms))

    def tdf(self, numeric_metadata: list[float], metadata: str | None = None, multi_metadata: tuple[str, ...] = ()) -> np.ndarray:
        """Topic shares at a point."""
        from topicloom.functions.special import legendre_values

        unit = [(v - a) / max(b - a, 1e-300) for v, (a, b) in zip(numeric_metadata, self.metadata_range)]
        terms = np.array([math.prod(float(legendre_values(np.array(x), n)) for x, n in zip(unit, p)) for p in exponents(self.degrees)])
        s = self._of(metadata, multi_metadata) @ terms
        e = np.exp(s - s.max())
        return e / e.sum()

    def _of(self, metadata: str | None, multi_metadata: tuple[str, ...] = ()) -> np.ndarray:
        """[topics, terms]: weights of the constant plus those of the category and the tags."""
        lam = self.lam.reshape(self.k, -1, len(exponents(self.degrees)))
        return lam[:, self._numbers(metadata, multi_metadata)].sum(1)

    def tdf_linspace(self, points: list[int], metadata: str | None = None, multi_metadata: tuple[str, ...] = ()) -> DataFrame:
        """(x array, z, p): topic shares on a grid over the metadata range."""
        return tdf_grid(self.spark, self._of(metadata, multi_metadata).tolist(), self.degrees, [tuple(r) for r in self.metadata_range], points)

    def topic_prior(self, *a, **kw):
        raise RuntimeError("the prior depends on numbers here; use tdf()")


class LLDA(LDA):
    """Labelled LDA: a document's topics are those of its labels; topics beyond the labels are open to
    all, and a document without labels to all topics."""

    needs = ("labels",)

    def __init__(self, k: int = 1, **kw) -> None:
        super().__init__(k, **kw)
        self.label_names: list[str] = []

    def learn(self, docs: DataFrame) -> None:
        self.label_names = list(_values(docs, F.explode("labels")))
        self.k = max(self.k, len(self.label_names))
        self.alpha = np.full(self.k, self.alpha[0])

    def _has(self) -> Column:
        return F.transform(_strings(self.label_names), lambda v: F.coalesce(F.array_contains("labels", v), F.lit(False)).cast("double"))

    def features(self, docs: DataFrame) -> list[Column]:
        extra = self.k - len(self.label_names)
        mask = F.concat(self._has(), F.array_repeat(F.lit(1.0), extra))
        none = F.coalesce(F.size(F.filter("labels", lambda v: v.isNotNull() & F.array_contains(_strings(self.label_names), v))), F.lit(0)) <= 0
        return [F.when(none, F.array_repeat(F.lit(1.0), self.k)).otherwise(mask).alias("x")]

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        mask = np.stack(block.x)
        return sample(block, g, sweep, lambda n, a: (n + g["alpha"]) * mask[:a])

    def attributes(self) -> dict[str, Column]:
        return {"mask": F.col("x")}

    def theta_expr(self) -> Column:
        return shares(F.col("nd"), F.zip_with(F.lit(self.alpha.tolist()), F.col("x"), lambda a, m: a * m))

    def topic_labels(self) -> list[str | None]:
        """The label of each topic."""
        return [*self.label_names, *[None] * (self.k - len(self.label_names))]

    def topic_label_dict(self) -> list[str]:
        return list(self.label_names)

    def doc_labels(self) -> DataFrame:
        """(doc_id, label, p): share of each label's topics in a document."""
        names = F.lit([x if x is not None else "" for x in self.topic_labels()])
        each = self.doc_topic_dist().select("doc_id", F.posexplode("theta").alias("z", "p")).withColumn("label", F.element_at(names, F.col("z") + 1)).where("label <> ''")
        return each.groupBy("doc_id", "label").agg(F.sum("p").alias("p"))


class PLDA(LLDA):
    """Partially labelled LDA: topics_per_label topics for each label and latent_topics open to all.
    A document without labels has the latent topics only; in inference, all."""

    def __init__(self, *, latent_topics: int = 0, topics_per_label: int = 1, **kw) -> None:
        super().__init__(1, **kw)
        self.latent_topics, self.topics_per_label = latent_topics, topics_per_label

    def learn(self, docs: DataFrame) -> None:
        self.label_names = list(_values(docs, F.explode("labels")))
        self.k = len(self.label_names) * self.topics_per_label + self.latent_topics
        if not self.k:
            raise ValueError("neither labels nor latent topics")
        self.alpha = np.full(self.k, self.alpha[0])

    def features(self, docs: DataFrame) -> list[Column]:
        mask = F.concat(F.flatten(F.transform(self._has(), lambda m: F.array_repeat(m, self.topics_per_label))), F.array_repeat(F.lit(1.0), self.latent_topics))
        empty = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m) == 0
        open_ = F.when(F.coalesce(F.size("labels"), F.lit(0)) <= 0, F.array_repeat(F.lit(1.0), self.k)).otherwise(mask) if self.n is not None else mask
        return [F.when(empty, F.array_repeat(F.lit(1.0), self.k)).otherwise(open_).alias("x")]

    def topic_labels(self) -> list[str | None]:
        return [*(x for x in self.label_names for _ in range(self.topics_per_label)), *[None] * self.latent_topics]


class SLDA(LDA):
    """Supervised LDA: y (one number for each of vars, 'l' linear or 'b' binary) is explained by the
    shares of a document's topics. Missing (null or NaN) y are left out."""

    needs = ("y",)

    def __init__(self, k: int = 1, *, vars: str = "", mu: list[float] | None = None, nu_sq: list[float] | None = None, glm_param: list[float] | None = None, **kw) -> None:
        super().__init__(k, **kw)
        if set(vars) - set("lb"):
            raise ValueError("vars may hold 'l' and 'b'")
        f = len(vars)
        self.vars = vars
        self.mu, self.nu_sq, self.glm_param = (np.array(v if v else [d] * f, float) for v, d in ((mu, 0.0), (nu_sq, 1.0), (glm_param, 1.0)))

    def features(self, docs: DataFrame) -> list[Column]:
        y = F.transform(F.sequence(F.lit(0), F.lit(len(self.vars) - 1)), lambda i: F.coalesce(F.get("y", i).cast("double"), F.lit(float("nan")))) if self.vars else F.array().cast("array<double>")
        return [(y if "y" in docs.columns else F.array_repeat(F.lit(float("nan")), len(self.vars))).alias("x")]

    def make_docs(self, docs: DataFrame) -> DataFrame:
        return super().make_docs(docs if "y" in docs.columns else docs.withColumn("y", F.lit(None).cast("array<double>")))

    def begin(self) -> None:
        self.coef = np.tile(self.mu[:, None], (1, self.k)) if self.vars else np.zeros((0, self.k))

    def state(self) -> dict:
        return {**super().state(), "coef": self.coef, "vars": self.vars, "noise": self.glm_param}

    def attributes(self) -> dict[str, Column]:
        return {"y": F.col("x")}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        y, coef, size = np.stack(block.x), g["coef"], np.maximum(block.weight.sum(1), 0.01)
        omega = np.stack([s if s is not None and len(s) else np.full(len(g["vars"]), 0.25) for s in block.s])

        def factor(n: np.ndarray, a: int) -> np.ndarray:
            logs = np.zeros((a, len(g["alpha"])))
            for f, kind in enumerate(g["vars"]):
                m = (n @ coef[f])[:, None] / size[:a, None] + coef[f][None, :] / size[:a, None]
                known = ~np.isnan(y[:a, f])
                target = np.where(known, y[:a, f], 0)[:, None]
                ll = -((target - m) ** 2) / (2 * g["noise"][f]) if kind == "l" else (target - 0.5) * m - omega[:a, f : f + 1] * m * m / 2
                logs += np.where(known[:, None], ll, 0)
            return (n + g["alpha"]) * np.exp(logs - logs.max(1, keepdims=True))

        nd = sample(block, g, sweep, factor)
        for f, kind in enumerate(g["vars"]):
            if kind == "b":  # a Polya-Gamma(1, m) variable as a sum of exponentials
                m = (nd @ coef[f]) / size
                e = -np.log(uniforms(g["seed"], block.doc, 64, sweep, 10 + f))
                at = (np.arange(64) + 0.5) ** 2 + (m[:, None] / (2 * np.pi)) ** 2
                omega[:, f] = (e / at).sum(1) / (2 * np.pi**2)
        block.s = list(omega)
        return nd

    def merge(self) -> None:
        super().merge()
        for f, kind in enumerate(self.vars):
            gram, moment = self.normal_equations(f)
            noise = 1.0 if kind == "b" else self.glm_param[f]
            self.coef[f] = ridge(gram / noise, moment / noise, np.full(self.k, self.mu[f]), np.full(self.k, self.nu_sq[f]))

    def normal_equations(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the documents whose y[f] is known of z z' and z y, z the shares of topics; binary
        ones are weighted and centred."""
        k, kind = self.k, self.vars[f]

        def part(x: np.ndarray, nd: np.ndarray, s: np.ndarray) -> np.ndarray:
            known = ~np.isnan(x[:, f])
            z = nd[known] / np.maximum(nd[known].sum(1, keepdims=True), 0.01)
            y = x[known, f]
            w = s[known, f] if kind == "b" else np.ones(len(y))
            return np.r_[((z * w[:, None]).T @ z).ravel(), z.T @ (y - 0.5 if kind == "b" else y)]

        got = partial_sums(self.rows, part, k * k + k)
        return got[: k * k].reshape(k, k), got[k * k :]

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Topics given the prior, and the known responses given the topics."""
        n, y = block.counts(len(g["alpha"])), np.stack(block.x)
        out = dirichlet_lls(n, g["alpha"])
        for f, kind in enumerate(g["vars"]):
            m = n @ g["coef"][f] / np.maximum(n.sum(1), 0.01)
            known = ~np.isnan(y[:, f])
            target = np.where(known, y[:, f], 0)
            out = out + np.where(known, -((target - m) ** 2) / (2 * g["noise"][f]) if kind == "l" else target * m - np.logaddexp(0, m), 0)
        return out

    def state_ll(self) -> float:
        """Words given topics, and the coefficients given their normal prior."""
        return self.word_ll() - float((((self.coef - self.mu[:, None]) ** 2) / (2 * self.nu_sq[:, None])).sum())

    def regression_coef(self, var: int | None = None) -> np.ndarray:
        return self.coef if var is None else self.coef[var]

    def var_type(self, var: int) -> str:
        return self.vars[var]

    def estimate(self, docs: DataFrame | None = None, iterations: int = 100) -> DataFrame:
        """(doc_id, y_hat array): expected responses of the training documents, or of unseen ones."""
        self._trained()
        rows = self.rows if docs is None else self._inferred(docs, iterations)
        total = F.aggregate("nd", F.lit(0.0), lambda s, x: s + x)
        out = []
        for f, kind in enumerate(self.vars):
            m = F.aggregate(F.zip_with("nd", F.lit(self.coef[f].tolist()), lambda n, c: n * c), F.lit(0.0), lambda s, x: s + x) / F.greatest(total, F.lit(0.01))
            out.append(1 / (1 + F.exp(-m)) if kind == "b" else m)
        return rows.select("doc_id", F.array(*out).alias("y_hat"))
