"""Models with more structure than one topic a token: hierarchies, grains, correlations, time."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.hashing import normals, uniforms
from topicloom.functions.special import digamma, lgamma
from topicloom.models.base import LDA, Block, count_histogram, dirichlet_lls, draw, fixed_point, sample, shares


def _vector(mean: np.ndarray) -> Column:
    return F.lit(np.asarray(mean, float).tolist())


def joint(block: Block, g: dict, sweep: int, states: int, topic: np.ndarray, chance, move) -> np.ndarray:
    """One sweep over joint states; topic[state] is the row of counts of a state. chance(rows, t):
    document part of the chances, [rows, states]; move(rows, z, weights): book a token in or out."""
    u = uniforms(g["seed"], block.doc, block.w.shape[1], sweep)
    n, nk, like = g["n"], g["nk"] + g["total"], g["like"]
    by_word = not np.isscalar(g["prior"])
    if not block.new:
        for t in range(block.w.shape[1]):
            a = block.active[t]
            move(block.rows[:a], block.z[:a, t], block.weight[:a, t], t)
    for t in range(block.w.shape[1]):
        a = block.active[t]
        r, w, c = block.rows[:a], block.w[:a, t], block.weight[:a, t]
        words = like[w]
        if not block.new:
            z = block.z[:a, t]
            move(r, z, -c, t)
            if not g.get("infer"):
                k = topic[z]
                own = g["prior"][w, k] if by_word else g["prior"]
                words[r, k] = (np.maximum(n[w, k] - c, 0) + own) / np.maximum(nk[k] - c, 1e-12)
        elif not g.get("infer"):
            words = np.ones_like(words)
        z = draw(chance(r, t) * words[:, topic], u[:a, t])
        move(r, z, c, t)
        block.z[:a, t] = z
    return block.counts(states)


class PA(LDA):
    """Pachinko allocation: a token has a super topic (of k1) and a sub topic (of k2)."""

    def __init__(self, k1: int = 1, k2: int = 1, *, subalpha: float = 0.1, **kw) -> None:
        super().__init__(k1, **kw)
        self.k1, self.k2 = k1, k2
        self.subalpha = np.full((k1, k2), float(subalpha))
        self.optim_interval = 1

    @property
    def topics(self) -> int:
        return self.k2

    def topic_of(self, z: Column) -> Column:
        return F.pmod(z, F.lit(self.k2))

    @property
    def topic_array(self):
        k2 = self.k2
        return lambda block: block.z % k2

    def _states(self) -> int:
        return self.k1 * self.k2

    def state(self) -> dict:
        return {**super().state(), "sub": self.subalpha}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        k1, k2 = g["sub"].shape
        n = np.zeros((len(block.doc), k1, k2))

        def move(r, z, c, t):
            n[r, z // k2, z % k2] += c

        def chance(r, t):
            own = np.maximum(n[r], 0)
            sup = own.sum(2)
            return ((sup + g["alpha"])[:, :, None] * (own + g["sub"]) / (sup + g["sub"].sum(1))[:, :, None]).reshape(len(r), -1)

        return joint(block, g, sweep, k1 * k2, np.tile(np.arange(k2), k1), chance, move)

    def _below(self, i: int) -> Column:
        """Counts of a document below super topic i."""
        return F.slice("nd", i * self.k2 + 1, self.k2)

    def optimize(self) -> None:
        """A fixed-point step of each super topic's prior over sub topics."""
        for i, alpha in enumerate(self._stepped(1)):
            self.subalpha[i] = alpha

    def _stepped(self, steps: int) -> list[np.ndarray]:
        size = self.subalpha.shape[1]
        values, weights, _, _ = count_histogram(self.rows, (size + 1) * self.k1, F.concat(*[F.concat(self._below(i), F.array(F.aggregate(self._below(i), F.lit(0.0), lambda s, x: s + x))) for i in range(self.k1)]))
        at = range(0, (size + 1) * self.k1, size + 1)
        return [fixed_point(self.subalpha[i], values[a : a + size], weights[a : a + size], values[a + size], weights[a + size], steps) for i, a in enumerate(at)]

    def _nd_sums(self) -> np.ndarray:
        """Counts of all documents by state."""
        got = self.rows.select(F.posexplode("nd").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(self._states())
        out[got.column("i").to_numpy()] = got.column("n").to_numpy()
        return out

    def _super(self) -> Column:
        k2 = self.k2
        return F.transform(F.sequence(F.lit(0), F.lit(self.k1 - 1)), lambda i: F.aggregate(F.slice("nd", i * k2 + 1, k2), F.lit(0.0), lambda s, x: s + x))

    def attributes(self) -> dict[str, Column]:
        return {"super_topics": F.transform("z", lambda z: F.floor(z / self.k2).cast("int"))}

    def theta_expr(self) -> Column:
        return shares(self._super(), _vector(self.alpha))

    def _sub(self) -> Column:
        """array<double>: shares of sub topics of a row: (n + subalpha) summed over super topics."""
        k1, k2 = self.k1, self.k2
        both = F.zip_with("nd", _vector(self.subalpha.ravel()), lambda n, a: n + a)
        sums = F.transform(F.sequence(F.lit(0), F.lit(k2 - 1)), lambda j: F.aggregate(F.filter(both, lambda _, i: F.pmod(i, F.lit(k2)) == j), F.lit(0.0), lambda s, x: s + x))
        total = F.aggregate("nd", F.lit(float(self.subalpha.sum())), lambda s, x: s + x)
        return F.transform(sums, lambda x: x / total) if k1 else sums

    def sub_topic_dist(self) -> DataFrame:
        """(doc_id, sub array<double>) of the training documents."""
        self._trained()
        return self.rows.select("doc_id", self._sub().alias("sub"))

    def doc_sub_topics(self, top_n: int = 10) -> DataFrame:
        """(doc_id, topics array<struct<p, topic>>): the largest sub topics, ties by topic."""
        ranked = F.array_sort(F.transform("sub", lambda p, i: F.struct((-p).alias("n"), i.alias("topic"))))
        return self.sub_topic_dist().select("doc_id", F.transform(F.slice(ranked, 1, top_n), lambda x: F.struct((-x["n"]).alias("p"), x["topic"].alias("topic"))).alias("topics"))

    def _read_inferred(self, rows: DataFrame) -> DataFrame:
        """(doc_id, theta, sub, ll): shares of super and of sub topics."""
        return rows.select("doc_id", self.theta_expr().alias("theta"), self._sub().alias("sub"), "ll")

    def sub_topics(self, super_topic: int | None = None, top_n: int = 10) -> np.ndarray | list[tuple[int, float]]:
        """[k1, k2]: each super topic's shares of sub topics, or the largest of one as (topic, share)."""
        share = self.subalpha / self.subalpha.sum(1, keepdims=True)
        if super_topic is None:
            return share
        return [(int(i), float(share[super_topic, i])) for i in np.argsort(-share[super_topic], kind="stable")[:top_n]]

    def count_by_super_topic(self) -> DataFrame:
        """(topic, n): tokens of each super topic."""
        self._trained()
        z = self.rows.select(F.explode("z").alias("z"))
        return z.groupBy(F.floor(F.col("z") / self.k2).cast("int").alias("topic")).agg(F.count("*").alias("n"))

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        k1, k2 = g["sub"].shape
        return dirichlet_lls(block.counts(k1, block.z // k2), g["alpha"])

    def state_ll(self) -> float:
        """Sub topics given super topics, and words given sub topics."""
        return float(dirichlet_lls(self._nd_sums().reshape(self.k1, self.k2), self.subalpha).sum()) + self.word_ll()


class HPA(PA):
    """Hierarchical pachinko allocation: a token is drawn by the root topic (0), a super topic (1 to
    k1) or a sub topic (k1 + 1 on)."""

    supports_word_prior = False

    def __init__(self, k1: int = 1, k2: int = 1, *, subalpha: float = 0.1, **kw) -> None:
        super().__init__(k1, k2, subalpha=subalpha, **kw)
        self.alpha = np.full(k1 + 1, self.alpha[0])
        self.subalpha = np.full((k1, k2 + 1), float(subalpha))

    @property
    def topics(self) -> int:
        return 1 + self.k1 + self.k2

    def topic_of(self, z: Column) -> Column:
        return F.when(z <= self.k1, z).otherwise(1 + self.k1 + F.pmod(z - 1 - self.k1, F.lit(self.k2)))

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        k1, k2 = g["sub"].shape[0], g["sub"].shape[1] - 1
        states = 1 + k1 + k1 * k2
        root, n = np.zeros(len(block.doc)), np.zeros((len(block.doc), k1, k2 + 1))  # place 0: the super topic itself
        sup = np.r_[0, np.arange(k1), np.repeat(np.arange(k1), k2)]
        sub = np.r_[0, np.zeros(k1, int), 1 + np.tile(np.arange(k2), k1)]
        topic = np.r_[0, 1 + np.arange(k1), 1 + k1 + np.tile(np.arange(k2), k1)]

        def move(r, z, c, t):
            np.add.at(root, r, np.where(z == 0, c, 0))
            n[r, sup[z], sub[z]] += np.where(z == 0, 0, c)

        def chance(r, t):
            own = np.maximum(n[r], 0)
            s = own.sum(2)
            below = (s + g["alpha"][1:])[:, :, None] * (own + g["sub"]) / (s + g["sub"].sum(1))[:, :, None]
            return np.concatenate([(np.maximum(root[r], 0) + g["alpha"][0])[:, None], below[:, :, 0], below[:, :, 1:].reshape(len(r), -1)], 1)

        return joint(block, g, sweep, states, topic, chance, move)

    @property
    def topic_array(self):
        k1, k2 = self.k1, self.k2
        return lambda block: np.where(block.z <= k1, block.z, 1 + k1 + (block.z - 1 - k1) % k2)

    def _states(self) -> int:
        return 1 + self.k1 + self.k1 * self.k2

    def _below(self, i: int) -> Column:
        """Counts of super topic i itself and of the sub topics below it."""
        return F.concat(F.slice("nd", 2 + i, 1), F.slice("nd", 2 + self.k1 + i * self.k2, self.k2))

    def optimize(self) -> None:
        """Fixed-point steps of both priors: over the root and the super topics, and below each."""
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        upper = F.concat(F.slice("nd", 1, 1), F.array(*[total(self._below(i)) for i in range(self.k1)]))
        subs = self._stepped(10)
        self.alpha = fixed_point(self.alpha, *count_histogram(self.rows, self.k1 + 1, upper))
        for i, alpha in enumerate(subs):
            self.subalpha[i] = alpha

    def attributes(self) -> dict[str, Column]:
        return {"states": F.col("z")}

    def theta_expr(self) -> Column:
        """[1 + k1 + k2]: root, super and sub topics; shares of the tokens."""
        k1, k2 = self.k1, self.k2
        subs = F.transform(F.sequence(F.lit(0), F.lit(k2 - 1)), lambda j: F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k1 - 1)), lambda i: F.get("nd", 1 + k1 + i * k2 + j)), F.lit(0.0), lambda s, x: s + x))
        total = F.greatest(F.aggregate("nd", F.lit(0.0), lambda s, x: s + x), F.lit(1e-300))
        return F.transform(F.concat(F.slice("nd", 1, 1 + k1), subs), lambda x: x / total)

    def _read_inferred(self, rows: DataFrame) -> DataFrame:
        return LDA._read_inferred(self, rows)

    def sub_topic_dist(self) -> DataFrame:
        raise RuntimeError("sub topics of a document are part of its topic distribution here")

    def count_by_super_topic(self) -> DataFrame:
        """(topic, n): tokens of each super topic and of the sub topics below it."""
        self._trained()
        z = self.rows.select(F.explode("z").alias("z")).where("z > 0")
        below = F.floor((F.col("z") - 1 - self.k1) / self.k2)
        return z.groupBy(F.when(F.col("z") <= self.k1, F.col("z") - 1).otherwise(below).cast("int").alias("topic")).agg(F.count("*").alias("n"))

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        k1, k2 = g["sub"].shape[0], g["sub"].shape[1] - 1
        upper = np.where(block.z == 0, 0, np.where(block.z <= k1, block.z, 1 + (block.z - 1 - k1) // k2))
        return dirichlet_lls(block.counts(k1 + 1, upper), g["alpha"])

    def state_ll(self) -> float:
        """What stands below each super topic, and words given topics."""
        n = self._nd_sums()
        below = np.concatenate([n[1 : 1 + self.k1, None], n[1 + self.k1 :].reshape(self.k1, self.k2)], 1)
        return float(dirichlet_lls(below, self.subalpha).sum()) + self.word_ll()


class MGLDA(LDA):
    """Multi-grain LDA: a token takes one of t windows over its sentence, then a global topic (0 to
    k_g - 1) or one of the window's local topics. delimiter is the word that ends a sentence."""

    asymmetric_alpha = False

    def __init__(self, k_g: int = 1, k_l: int = 1, t: int = 3, *, alpha_g: float = 0.1, alpha_l: float = 0.1, alpha_mg: float = 0.1, alpha_ml: float = 0.1, eta_g: float = 0.01, eta_l: float = 0.01, gamma: float = 0.1, delimiter: str = ".", **kw) -> None:
        super().__init__(k_g + k_l, eta=eta_g, **kw)
        self.k_g, self.k_l, self.t, self.delimiter = k_g, k_l, t, delimiter
        self.alpha_g, self.alpha_l, self.alpha_mg, self.alpha_ml, self.eta_g, self.eta_l, self.gamma = alpha_g, alpha_l, alpha_mg, alpha_ml, eta_g, eta_l, gamma

    def countable(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.filter("words", lambda w: w != self.delimiter).alias("words"))

    def topic_of(self, z: Column) -> Column:
        return F.pmod(z, F.lit(self.k_g + self.k_l))

    @property
    def topic_array(self):
        k = self.k_g + self.k_l
        return lambda block: block.z % k

    def _states(self) -> int:
        return self.k_g + self.k_l

    @property
    def folded(self):
        k = self.k_g + self.k_l
        return lambda z: z % k

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Global topics of the document; grain and local topics of each window over its sentences;
        windows of each sentence."""
        kg, kl, t_, ag, al, amg, aml, gamma = g["m"]
        k, b, s_ = kg + kl, len(block.doc), int(block.sent.max(initial=0)) + 1
        d = np.broadcast_to(block.rows[:, None], block.z.shape)[block.inside]
        s, z, c = block.sent[block.inside], block.z[block.inside], block.weight[block.inside]
        v, topic = z // k, z % k
        low = topic >= kg
        count = lambda keys, n, w: np.bincount(keys, w, n)
        windows = s_ + t_ - 1
        grain = count(((d * windows + s + v) * 2 + low), b * windows * 2, c).reshape(b, windows, 2)
        local = count((d * windows + s + v)[low] * kl + topic[low] - kg, b * windows * kl, c[low]).reshape(b, windows, kl)
        of_sent = count((d * s_ + s) * t_ + v, b * s_ * t_, c).reshape(b, s_, t_)
        upper = count(d[~low] * kg + topic[~low], b * kg, c[~low]).reshape(b, kg)
        return dirichlet_lls(upper, np.full(kg, ag)) + dirichlet_lls(grain, np.array([amg, aml])).sum(1) + dirichlet_lls(local, np.full(kl, al)).sum(1) + dirichlet_lls(of_sent, np.full(t_, gamma)).sum(1)

    def state(self) -> dict:
        s = super().state()
        if self.prior is None:
            eta = np.r_[np.full(self.k_g, self.eta_g), np.full(self.k_l, self.eta_l)]
            s |= {"prior": np.broadcast_to(eta, self.n.shape).copy(), "total": eta * self.v}
        return {**s, "m": (self.k_g, self.k_l, self.t, self.alpha_g, self.alpha_l, self.alpha_mg, self.alpha_ml, self.gamma)}

    def attributes(self) -> dict[str, Column]:
        return {"sentences": F.col("sent"), "windows": F.transform("z", lambda z: F.floor(z / (self.k_g + self.k_l)).cast("int"))}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        kg, kl, t_, ag, al, amg, aml, gamma = g["m"]
        k, b = kg + kl, len(block.doc)
        s_ = int(block.sent.max(initial=0)) + 1
        sv, wg, wl, dg = np.zeros((b, s_, t_)), np.zeros((b, s_ + t_)), np.zeros((b, s_ + t_, kl)), np.zeros((b, kg))

        def move(r, z, c, t):
            s, v, topic = block.sent[r, t], z // k, z % k
            is_g = topic < kg
            sv[r, s, v] += c
            wg[r, s + v] += np.where(is_g, c, 0)
            dg[r, np.where(is_g, topic, 0)] += np.where(is_g, c, 0)
            wl[r, s + v, np.where(is_g, 0, topic - kg)] += np.where(is_g, 0, c)

        def chance(r, t):
            s = block.sent[r, t]
            at = s[:, None] + np.arange(t_)[None, :]
            window = np.maximum(sv[r, s], 0) + gamma
            g_, l_ = np.maximum(wg[r[:, None], at], 0), np.maximum(wl[r[:, None], at], 0)
            ll = l_.sum(2)
            both = g_ + ll + amg + aml
            own = np.maximum(dg[r], 0)
            top = (window * (g_ + amg) / both)[:, :, None] * ((own + ag) / (own.sum(1, keepdims=True) + kg * ag))[:, None, :]
            low = (window * (ll + aml) / both)[:, :, None] * (l_ + al) / (ll[:, :, None] + kl * al)
            return np.concatenate([top, low], 2).reshape(len(r), -1)

        joint(block, g, sweep, t_ * k, np.tile(np.arange(k), t_), chance, move)
        return block.counts(k, block.z % k)

    def optimize(self) -> None:
        """The priors are kept, as they are given."""

    def theta_expr(self) -> Column:
        total = F.greatest(F.aggregate("nd", F.lit(0.0), lambda s, x: s + x), F.lit(1e-300))
        return F.transform("nd", lambda x: x / total)


class CT(LDA):
    """Correlated topics: log weights of a document's topics are normal with a full covariance."""

    def __init__(self, k: int = 1, *, smoothing_alpha: float = 0.1, num_beta_samples: int = 5, **kw) -> None:
        super().__init__(k, alpha=smoothing_alpha, **kw)
        self.smoothing_alpha, self.num_beta_samples, self.optim_interval = smoothing_alpha, num_beta_samples, 2

    def begin(self) -> None:
        self.prior_mean, self.prior_cov = np.zeros(self.k), np.eye(self.k)

    def state(self) -> dict:
        return {**super().state(), "mean": self.prior_mean, "precision": np.linalg.inv(self.prior_cov), "rounds": self.num_beta_samples}

    def attributes(self) -> dict[str, Column]:
        return {"beta": F.col("s")}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        k, mean, precision = len(g["mean"]), g["mean"], g["precision"]
        beta = np.stack([s if s is not None and len(s) else mean for s in block.s])
        e = np.exp(beta - beta.max(1, keepdims=True))
        nd = sample(block, g, sweep, lambda n, a: e[:a])
        size = nd.sum(1)
        u = uniforms(g["seed"], block.doc, 3 * k * g["rounds"], sweep, 1).reshape(len(beta), g["rounds"], k, 3)
        sd = 1 / np.sqrt(np.diag(precision))
        for i in range(g["rounds"]):
            for j in range(k):  # auxiliary bounds of the topic's share, then a truncated normal draw
                others = np.delete(beta, j, 1)
                top = others.max(1) if k > 1 else np.zeros(len(beta))
                rest = top + np.log(np.exp(others - top[:, None]).sum(1)) if k > 1 else np.full(len(beta), -30.0)
                p = 1 / (1 + np.exp(np.clip(rest - beta[:, j], -30, 30)))
                low = p * np.where(nd[:, j] > 0, u[:, i, j, 0] ** (1 / np.maximum(nd[:, j], 1e-9)), 0)
                out = size - nd[:, j]
                high = 1 - (1 - p) * np.where(out > 0, u[:, i, j, 1] ** (1 / np.maximum(out, 1e-9)), 0)
                logit = lambda x: np.log(np.clip(x, 1e-12, 1 - 1e-12) / (1 - np.clip(x, 1e-12, 1 - 1e-12)))
                center = mean[j] - ((beta - mean) @ precision[j] - (beta[:, j] - mean[j]) * precision[j, j]) / precision[j, j]
                a, b = ((np.clip((logit(x) + rest - center) / sd[j], -8, 8)) for x in (low, high))
                beta[:, j] = center + sd[j] * truncated_normal(a, np.maximum(a, b), u[:, i, j, 2])
        block.s = list(beta)
        return nd

    def optimize(self) -> None:
        """Mean and covariance of the documents' log weights, from Spark sums."""
        k = self.k
        b = [F.get("s", F.lit(i)) for i in range(k)]
        got = self.rows.agg(F.count("*").alias("n"), *[F.sum(b[i]).alias(f"m{i}") for i in range(k)], F.array(*[F.sum(b[i] * b[j]) for i in range(k) for j in range(k)]).alias("c")).first()
        n = got["n"]
        if n > 1:
            self.prior_mean = np.array([got[f"m{i}"] for i in range(k)]) / n
            scatter = np.array(got["c"]).reshape(k, k) - n * np.outer(self.prior_mean, self.prior_mean)
            self.prior_cov = (np.eye(k) + scatter) / (n - 1) + 1e-6 * np.eye(k)

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Topics given the smoothed weights, and the weights given their normal prior."""
        mean, precision = g["mean"], g["precision"]
        x = np.stack([s if s is not None and len(s) else mean for s in block.s])
        top = x.max(1, keepdims=True)
        logs = x - top - np.log(np.exp(x - top).sum(1, keepdims=True))
        n = block.counts(x.shape[1]) + g["alpha"]
        topics = (logs * n - lgamma(n + 1)).sum(1) + lgamma(n.sum(1) + 1)
        return topics + normal_lls(x, mean, precision)

    def correlations(self, topic: int | None = None) -> np.ndarray:
        if topic is not None:
            return self.correlations()[topic]
        d = np.sqrt(np.diag(self.prior_cov))
        return self.prior_cov / np.outer(d, d)


def normal_lls(x: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """By row, the log density of a multivariate normal distribution."""
    off = x - mean
    return (np.linalg.slogdet(precision)[1] - x.shape[1] * math.log(2 * math.pi) - ((off @ precision) * off).sum(1)) / 2


#: The normal distribution below 0, on a grid that is interpolated.
_GRID = np.linspace(-8.5, 0, 17_001)
_BELOW = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in _GRID])


def truncated_normal(a: np.ndarray, b: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Standard normal variables between a and b (8 deviations at most), from uniforms u. Intervals
    mostly above 0 are mirrored, so that tails keep their precision."""
    flip = a + b > 0
    low, high = np.where(flip, -b, a), np.where(flip, -a, b)
    below = lambda x: np.where(x <= 0, np.interp(x, _GRID, _BELOW), 1 - np.interp(-x, _GRID, _BELOW))
    p = below(low) + u * (below(high) - below(low))
    x = np.where(p <= 0.5, np.interp(p, _BELOW, _GRID), -np.interp(1 - p, _BELOW, _GRID))
    x = np.clip(x, low, high)
    return np.where(flip, -x, x)


class PT(LDA):
    """Pseudo-document topics for short texts: documents share the topic counts of one of p pseudo
    documents, to which they are assigned anew every 10 sweeps."""

    def __init__(self, k: int = 1, *, p: int | None = None, lam: float = 0.01, **kw) -> None:
        super().__init__(k, **kw)
        self.p, self.lam = p or 10 * k, lam

    def begin(self) -> None:
        self.pseudo, self.sizes = np.zeros((self.p, self.k)), np.zeros(self.p)

    def state(self) -> dict:
        return {**super().state(), "pseudo": self.pseudo, "sizes": self.sizes, "lam": self.lam}

    def attributes(self) -> dict[str, Column]:
        return {"pseudo_doc": F.get("p", F.lit(0))}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        k, pseudo, sizes = len(g["alpha"]), g["pseudo"], g["sizes"]
        u = uniforms(g["seed"], block.doc, 1, sweep, 2)[:, 0]
        at = np.array([p[0] if p else -1 for p in block.p])
        trained = at >= 0 if not g.get("infer") else np.zeros(len(at), bool)
        at = np.where(at < 0, (u * len(sizes)).astype(int), at)
        old = np.zeros((len(at), k)) if block.new else block.counts(k)
        own = np.where(trained[:, None], old, 0)
        others = np.maximum(pseudo[at] - own, 0)
        nd = sample(block, g, sweep, lambda n, a: n + others[:a] + g["alpha"])
        if not block.new and (sweep % 10 == 0 or g.get("infer")):
            a, s = g["alpha"], g["alpha"].sum()
            n, step = pseudo.sum(1), max(1, 2_000_000 // pseudo.size)

            def gain(base: np.ndarray, size: np.ndarray, mine: np.ndarray) -> np.ndarray:
                return (lgamma(base + mine + a) - lgamma(base + a)).sum(-1) - lgamma(size + mine.sum(-1) + s) + lgamma(size + s)

            for i in range(0, len(at), step):  # some documents against all pseudo documents
                part = slice(i, i + step)
                logs = gain(pseudo[None], n[None], nd[part, None]) + np.log(np.maximum(sizes, 0) + g["lam"])
                rest = np.maximum(pseudo[at[part]] - own[part], 0)  # the own one, without the document
                here = gain(rest, rest.sum(1), nd[part]) + np.log(np.maximum(sizes[at[part]] - trained[part], 0) + g["lam"])
                logs[np.arange(len(here)), at[part]] = here
                at[part] = draw(np.exp(logs - logs.max(1, keepdims=True)), u[part])
        block.p = [[int(x)] for x in at]
        return nd

    def merge(self) -> None:
        super().merge()
        self.pseudo, self.sizes = np.zeros((self.p, self.k)), np.zeros(self.p)
        each = [F.sum(F.get("nd", F.lit(i))) for i in range(self.k)]
        for r in self.rows.groupBy(F.get("p", F.lit(0)).alias("p")).agg(F.count("*").alias("c"), F.array(*each).alias("n")).toLocalIterator():  # at most p rows
            self.pseudo[r["p"]], self.sizes[r["p"]] = r["n"], r["c"]

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Documents have no part of their own: their pseudo documents have (state_ll)."""
        return np.zeros(len(block.doc))

    def state_ll(self) -> float:
        """Documents in pseudo documents, topics in those, and words given topics."""
        return float(dirichlet_lls(self.sizes, np.full(self.p, self.lam)) + dirichlet_lls(self.pseudo, self.alpha).sum()) + self.word_ll()

    def pseudo_docs(self) -> DataFrame:
        """(doc_id, pseudo_doc)."""
        self._trained()
        return self.rows.select("doc_id", F.get("p", F.lit(0)).alias("pseudo_doc"))

    def doc_topic_dist(self, from_pseudo_doc: bool = False) -> DataFrame:
        if not from_pseudo_doc:
            return super().doc_topic_dist()
        theta = (self.pseudo + self.alpha) / (self.pseudo + self.alpha).sum(1, keepdims=True)
        table = self.spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(theta)], "p int, theta array<double>")
        return self.rows.select("doc_id", F.get("p", F.lit(0)).alias("p")).join(table, "p").select("doc_id", "theta")


class DT(LDA):
    """Dynamic topics: t points of time; topic word weights and document priors drift from each point
    to the next. Weights move by stochastic gradient Langevin steps. Counts row k + K * time."""

    needs = ("timepoint",)
    supports_word_prior = False

    def __init__(self, k: int = 1, *, t: int = 1, alpha_var: float = 0.1, eta_var: float = 0.1, phi_var: float = 0.1, lr_a: float = 0.01, lr_b: float = 0.1, lr_c: float = 0.55, **kw) -> None:
        super().__init__(k, **kw)
        self.t, self.alpha_var, self.eta_var, self.phi_var, self.lr_a, self.lr_b, self.lr_c = t, alpha_var, eta_var, phi_var, lr_a, lr_b, lr_c

    @property
    def topics(self) -> int:
        return self.k * self.t

    def learn(self, docs: DataFrame) -> None:
        got = {r["timepoint"] for r in docs.select("timepoint").distinct().limit(self.t + 2).collect()}
        if got != set(range(self.t)):
            raise ValueError(f"every time point from 0 to {self.t - 1} needs documents, and no other may have any")

    def features(self, docs: DataFrame) -> list[Column]:
        return [F.array(F.col("timepoint").cast("double")).alias("x")]

    def begin(self) -> None:
        self.logits = np.zeros((self.t, self.v, self.k))
        self.alphas = np.zeros((self.t, self.k))

    def _rate(self) -> float:
        return self.lr_a * (self.lr_b + 1 + self.global_step) ** -self.lr_c

    def state(self) -> dict:
        e = np.exp(self.logits - self.logits.max(1, keepdims=True)) if self.v else self.logits
        return {**super().state(), "like": e / np.maximum(e.sum(1, keepdims=True), 1e-300), "alphas": self.alphas, "var": self.eta_var, "rate": self._rate()}

    def attributes(self) -> dict[str, Column]:
        return {"eta": F.col("s"), "timepoint": F.get("x", F.lit(0)).cast("int")}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        time = np.array([int(x[0]) for x in block.x])
        mean = g["alphas"][time]
        eta = np.stack([s if s is not None and len(s) else m for s, m in zip(block.s, mean)])
        k = mean.shape[1]
        like = g["like"]  # [time, word, topic]
        u = uniforms(g["seed"], block.doc, block.w.shape[1], sweep)
        e = np.exp(eta - eta.max(1, keepdims=True))
        for t in range(block.w.shape[1]):
            a = block.active[t]
            block.z[:a, t] = draw(e[:a] * like[time[:a], block.w[:a, t]], u[:a, t])
        nd = block.counts(k)
        for i in range(3):
            share = np.exp(eta - eta.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            slope = (mean - eta) / g["var"] + nd - nd.sum(1, keepdims=True) * share
            noise = normals(g["seed"], block.doc, k, sweep, 1 + i)
            eta = np.clip(eta + g["rate"] / 2 * slope + np.sqrt(g["rate"]) * noise, -20, 20)
        block.s = list(eta)
        return nd

    def _counted(self) -> np.ndarray:
        flat = self.rows.select(F.get("x", F.lit(0)).cast("int").alias("t"), F.explode(F.arrays_zip("wid", "z", "w")).alias("v")).select("t", "v.wid", "v.z", "v.w")
        got = flat.groupBy("t", "wid", "z").agg(F.sum("w").alias("n")).toArrow()
        n = np.zeros((self.v, self.topics))
        n[got.column("wid").to_numpy(), got.column("z").to_numpy() + self.k * got.column("t").to_numpy()] = got.column("n").to_numpy()
        return n

    def merge(self) -> None:
        super().merge()
        if not self.v:
            return
        self._drift(self.n.reshape(self.v, self.t, self.k).transpose(1, 0, 2), self._rate())
        self._priors()

    def _priors(self) -> None:
        """Draw the document prior of each point of time, given its documents' weights and the priors
        before and after: a normal distribution. The first point's own prior is wide."""
        got = self.rows.groupBy(F.get("x", F.lit(0)).cast("int").alias("t")).agg(F.count("*").alias("c"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(self.k)]).alias("m")).collect()  # a row for each time point
        noise = np.random.Generator(np.random.Philox(key=[self.seed, self.global_step + 2**32])).standard_normal((self.t, self.k))
        of = {r["t"]: (r["c"], np.array(r["m"])) for r in got}
        for t in range(self.t):
            count, total = of.get(t, (0, np.zeros(self.k)))
            weight, pull = count / self.eta_var, total / self.eta_var
            if t == 0:
                weight = weight + 1 / (10 * self.alpha_var)
            for near in (t - 1, t + 1):
                if 0 <= near < self.t:
                    weight, pull = weight + 1 / self.alpha_var, pull + self.alphas[near] / self.alpha_var
            self.alphas[t] = pull / weight + noise[t] / math.sqrt(weight)

    def _drift(self, n: np.ndarray, rate: float) -> None:
        """Langevin steps of the topic word weights, given the counts n [time, word, topic]."""
        rng = np.random.Generator(np.random.Philox(key=[self.seed, self.global_step]))
        for _ in range(5):
            e = np.exp(self.logits - self.logits.max(1, keepdims=True))
            share = e / e.sum(1, keepdims=True)
            ahead, behind = np.roll(self.logits, -1, 0), np.roll(self.logits, 1, 0)
            pull = np.zeros_like(self.logits)
            pull[:-1] += (ahead - self.logits)[:-1] / self.phi_var
            pull[1:] += (behind - self.logits)[1:] / self.phi_var
            pull[0] -= self.logits[0] / (10 * self.phi_var)
            step = rate / (1 + n.sum(1, keepdims=True).mean() * 0.01)
            noise = math.sqrt(2 * step) * rng.standard_normal(self.logits.shape)
            self.logits = np.clip(self.logits + step * (pull + n - n.sum(1, keepdims=True) * share) + noise, -20, 20)

    def optimize(self) -> None:
        """Priors move with every merge."""

    def phi(self) -> np.ndarray:
        """[K * time, words]: mean of the drifting weights and the shares observed."""
        self._trained()
        e = np.exp(self.logits - self.logits.max(1, keepdims=True))
        soft = (e / e.sum(1, keepdims=True)).transpose(0, 2, 1).reshape(self.topics, self.v)
        seen = ((self.n + self.eta) / (self.n.sum(0) + self.eta * self.v)).T
        return (soft + seen) / 2

    def docs_by_timepoint(self) -> DataFrame:
        return self.rows.groupBy(F.get("x", F.lit(0)).cast("int").alias("timepoint")).agg(F.count("*").alias("n"))

    def count_by_topics(self) -> DataFrame:
        """(topic, n) with topic = k + K * time."""
        z = self.rows.select(F.get("x", F.lit(0)).cast("int").alias("t"), F.explode("z").alias("z"))
        return z.groupBy((F.col("z") + self.k * F.col("t")).alias("topic")).agg(F.count("*").alias("n"))

    @property
    def topic_array(self):
        k = self.k
        return lambda block: block.z + k * np.array([int(x[0]) for x in block.x])[:, None]

    def get_alpha(self, timepoint: int) -> np.ndarray:
        """Topic shares that documents of a point of time have on average: softmax of its prior."""
        e = np.exp(self.alphas[timepoint] - self.alphas[timepoint].max())
        return e / e.sum()

    def get_phi(self, topic: int, timepoint: int) -> np.ndarray:
        """[words]: the drifting word shares of a topic at a point of time."""
        x = self.logits[timepoint, :, topic]
        e = np.exp(x - x.max())
        return e / e.sum()

    def topic_words_at(self, topic: int, timepoint: int, top_n: int = 10) -> list[tuple[str, float]]:
        words = self.topic_words(top_n).where(F.col("topic") == topic + self.k * timepoint).orderBy("rank_no").collect()
        return [(r["word"], r["p"]) for r in words]

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Topics given the document's weights, and those given the prior of its point of time."""
        mean = g["alphas"][np.array([int(x[0]) for x in block.x])]
        eta = np.stack([s if s is not None and len(s) else m for s, m in zip(block.s, mean)])
        top = eta.max(1, keepdims=True)
        logs = eta - top - np.log(np.exp(eta - top).sum(1, keepdims=True))
        k = eta.shape[1]
        return (block.counts(k) * logs).sum(1) - ((eta - mean) ** 2).sum(1) / (2 * g["var"]) - k / 2 * math.log(2 * math.pi * g["var"])

    def state_ll(self) -> float:
        """Words given the drifting weights, and the drift of those and of the priors."""
        if not self.v:
            return 0.0
        top = self.logits.max(1, keepdims=True)
        logs = self.logits - top - np.log(np.exp(self.logits - top).sum(1, keepdims=True))
        n = self.n.reshape(self.v, self.t, self.k).transpose(1, 0, 2)

        def drift(x: np.ndarray, var: float) -> float:
            moves = np.diff(x, axis=0)
            return float(-(moves**2).sum() / (2 * var) - moves.size / 2 * math.log(2 * math.pi * var))

        return float((n * logs).sum()) + drift(self.logits, self.phi_var) + drift(self.alphas, self.alpha_var)

    @staticmethod
    def word_lls(block: Block, g: dict, topic: np.ndarray) -> np.ndarray:
        """The words given the drifting weights."""
        time = np.array([int(x[0]) for x in block.x])[:, None]
        logs = np.log(np.maximum(g["like"][time, block.w, block.z], 1e-300)) * block.weight
        return np.where(block.inside, logs, 0).sum(1)
