"""Models that find the number of topics: HDP and hierarchical LDA."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.hashing import uniforms
from topicloom.functions.special import lgamma
from topicloom.models.base import LDA, Block, count_histogram, dirichlet_lls, draw
from topicloom.sources.tables import dropped, written


class HDP(LDA):
    """Hierarchical Dirichlet process as a Chinese restaurant franchise: each token sits at a table of
    its document, each table has a topic. One open topic (the last) stands for all that don't exist
    yet; documents that draw it in the same sweep found one topic together, and another is opened.

    Rows keep a token's topic (z) and table (p), and tables by topic (s).
    """

    supports_word_prior = False
    asymmetric_alpha = False

    def __init__(self, initial_k: int = 2, *, gamma: float = 0.1, **kw) -> None:
        super().__init__(initial_k + 1, **kw)
        self.initial_k, self.gamma = initial_k, gamma
        self.concentration = float(self.alpha[0])
        self.optim_interval = 1

    def begin(self) -> None:
        self.tables = np.zeros(self.k)

    def state(self) -> dict:
        frozen = getattr(self, "frozen", False) and self.tables.sum() > 0
        return {**super().state(), "tables": self.tables, "conc": self.concentration, "gamma": 0.0 if frozen else self.gamma, "initial": self.initial_k}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        """Tables of the tokens one after the other, then topics of the tables. Counts of other
        documents' words and tables are those of the last merge."""
        b, n = block.w.shape
        k, conc = g["n"].shape[1], g["conc"]
        like = g["like"]
        u = uniforms(g["seed"], block.doc, n, sweep)
        pick = uniforms(g["seed"], block.doc, n, sweep, 1)
        table = np.zeros((b, n), np.int64)
        if not block.new:
            for i, p in enumerate(block.p):
                table[i, : block.len[i]] = p
        room = int(table.max(initial=0)) + 2
        size, topic = np.zeros((b, room)), np.zeros((b, room), np.int64)  # of each table
        others = np.maximum(g["tables"], 0) + np.zeros((b, 1))  # tables by topic, with the document's own
        if not block.new:
            d = np.broadcast_to(block.rows[:, None], table.shape)[block.inside]
            np.add.at(size, (d, table[block.inside]), block.weight[block.inside])
            topic[d, table[block.inside]] = block.z[block.inside]
            if g.get("infer"):  # the trained tables don't have them
                np.add.at(others, (np.repeat(block.rows, room), topic.ravel()), (size > 0).ravel())
        elif not g["tables"].any():  # the first topics of all
            others[:, : g["initial"]] = 1.0

        for t in range(n):
            a = block.active[t]
            r, w, c = block.rows[:a], block.w[:a, t], block.weight[:a, t]
            if not block.new:
                at = table[:a, t]
                size[r, at] -= c
                gone = size[r, at] <= 1e-9
                size[r[gone], at[gone]] = 0
                others[r[gone], topic[r[gone], at[gone]]] = np.maximum(others[r[gone], topic[r[gone], at[gone]]] - 1, 0)
            if not (size[:a, -1] == 0).all():  # room for one more
                size, topic = np.concatenate([size, np.zeros_like(size)], 1), np.concatenate([topic, np.zeros_like(topic)], 1)
            of_word = like[w]
            mass = others[:a].copy()
            mass[:, -1] = 0.0 if g.get("infer") else g["gamma"]
            fresh = mass * of_word  # topic of a new table
            old = size[:a] * np.take_along_axis(of_word, topic[:a], 1)
            new = conc * fresh.sum(1) / np.maximum(mass.sum(1), 1e-300)
            at = draw(np.concatenate([old, new[:, None]], 1), u[:a, t])
            opened = at == old.shape[1]
            free = np.argmax(size[:a] == 0, 1)
            at = np.where(opened, free, at)
            chosen = draw(fresh, pick[:a, t])
            o = r[opened]
            topic[o, at[opened]] = chosen[opened]
            others[o, chosen[opened]] += 1
            size[r, at] += c
            table[:a, t] = at
        if not block.new:
            topic = HDP._topics_of_tables(block, g, sweep, table, size, topic, others)
        block.z = np.take_along_axis(topic, table, 1)
        block.p = [table[i, : block.len[i]].tolist() for i in range(b)]
        seated = np.zeros((b, k))
        np.add.at(seated, (np.repeat(block.rows, size.shape[1]), topic.ravel()), (size > 0).ravel())
        block.s = list(seated)
        return block.counts(k)

    @staticmethod
    def _topics_of_tables(block: Block, g: dict, sweep: int, table: np.ndarray, size: np.ndarray, topic: np.ndarray, others: np.ndarray) -> np.ndarray:
        """A topic for each table anew, by the likelihood of its words."""
        b, room = size.shape
        logs = np.log(np.maximum(g["like"], 1e-300))
        key = np.broadcast_to(block.rows[:, None], table.shape)[block.inside] * room + table[block.inside]
        used, where = np.unique(key, return_inverse=True)
        score = np.zeros((len(used), logs.shape[1]))
        w, c = block.w[block.inside], block.weight[block.inside]
        for a in range(0, len(w), 50_000):
            np.add.at(score, where[a : a + 50_000], logs[w[a : a + 50_000]] * c[a : a + 50_000, None])
        d, at = used // room, used % room
        mass = others[d]
        mass[np.arange(len(d)), topic[d, at]] -= 1
        mass = np.maximum(mass, 0)
        mass[:, -1] = 0.0 if g.get("infer") else g["gamma"]
        score += np.log(np.maximum(mass, 1e-300))
        u = uniforms(g["seed"], block.doc, room, sweep, 2)
        new = draw(np.exp(score - score.max(1, keepdims=True)), u[d, at])
        topic = topic.copy()
        topic[d, at] = new
        return topic

    def adopt(self, vocab: DataFrame, rows: DataFrame, docs: DataFrame | None = None, **state) -> HDP:
        """As for all models; tables of the tokens come as p."""
        super().adopt(vocab, rows, docs, **state)
        self.tables = self._tables()
        return self

    def _tables(self) -> np.ndarray:
        sums = self.rows.select(F.posexplode("s").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m")).toArrow()  # a row for each topic
        out = np.zeros(self.k)
        out[sums.column("i").to_numpy()] = sums.column("m").to_numpy()
        return out

    def merge(self) -> None:
        super().merge()
        self.tables = self._tables()
        if self.tables[-1] > 0:
            self.k += 1
            self._fits()
            self.n = np.concatenate([self.n, np.zeros((self.v, 1))], 1)
            self.tables = np.r_[self.tables, 0.0]
            self.alpha = np.full(self.k, self.alpha[0])
        self._concentrations()

    def _concentrations(self) -> None:
        """Draw both concentrations from their distributions given the tables and a Gamma(1, 1) prior,
        on a grid. Of the documents only the histogram of their lengths is needed."""
        total, live = float(self.tables.sum()), int((self.tables > 0).sum())
        if not total:
            return
        _, _, sizes, documents = count_histogram(self.rows, 1, F.array(F.aggregate("w", F.lit(0.0), lambda s, x: s + x)))
        u = np.random.Generator(np.random.Philox(key=[self.seed, self.global_step + 1])).random(2)
        grid = np.exp(np.linspace(np.log(1e-3), np.log(1e4), 800))
        alone = -grid + np.log(grid)  # the prior, by equal steps of the logarithm

        def drawn(logs: np.ndarray, at: float) -> float:
            c = np.cumsum(np.exp(logs - logs.max()))
            return float(grid[min(int(np.searchsorted(c, at * c[-1])), len(grid) - 1)])

        rising = sum(c * (lgamma(n + grid) - lgamma(grid)) for n, c in zip(sizes, documents))
        self.concentration = drawn(alone + total * np.log(grid) - rising, u[0])
        self.gamma = drawn(alone + live * np.log(grid) - lgamma(total + grid) + lgamma(grid), u[1])

    def optimize(self) -> None:
        """Concentrations are drawn with every merge."""

    @staticmethod
    def settle(block: Block, g: dict) -> None:
        block.s = []
        for i, p in enumerate(block.p):
            seats = np.unique(np.stack([block.z[i, : block.len[i]], p]), axis=1)
            block.s.append(np.bincount(seats[0], minlength=g["n"].shape[1]).astype(float))

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Tokens at tables."""
        conc, top = g["conc"], max((max(p, default=0) for p in block.p if p is not None), default=0) + 1
        size = np.zeros((len(block.doc), top))
        for i, p in enumerate(block.p):
            np.add.at(size[i], p, block.weight[i, : block.len[i]])
        n = size.sum(1)
        return (size > 0).sum(1) * np.log(conc) - lgamma(n + conc) + lgamma(np.array(conc)) + np.where(size > 0, lgamma(np.where(size > 0, size, 1.0)), 0).sum(1)

    def state_ll(self) -> float:
        """Tables at topics, and words given the topics."""
        m = self.tables[self.tables > 0]
        total = m.sum()
        return float(lgamma(m).sum() + len(m) * np.log(self.gamma) - lgamma(np.array(total + self.gamma)) + lgamma(np.array(self.gamma))) + self.word_ll(self.tables > 0)

    def attributes(self) -> dict[str, Column]:
        return {"tables": F.col("p"), "tables_by_topic": F.col("s")}

    def theta_expr(self) -> Column:
        total = F.greatest(F.aggregate("nd", F.lit(0.0), lambda s, x: s + x), F.lit(1e-300))
        return F.transform("nd", lambda x: x / total)

    def doc_tables(self) -> DataFrame:
        """(doc_id, tables): the number of tables of each document."""
        self._trained()
        return self.rows.select("doc_id", F.aggregate("s", F.lit(0.0), lambda s, x: s + x).cast("int").alias("tables"))

    def is_live_topic(self, topic: int) -> bool:
        return bool(self.tables[topic] > 0)

    @property
    def live_k(self) -> int:
        return int((self.tables > 0).sum())

    @property
    def num_tables(self) -> int:
        return int(self.tables.sum())

    def purge_dead_topics(self) -> list[int]:
        """Renumber the live topics without gaps; where each topic went, -1 for dead ones."""
        to = np.where(self.tables > 0, np.cumsum(self.tables > 0) - 1, -1)
        keep = np.flatnonzero(to >= 0)
        moved = F.lit(to.tolist())
        pick = lambda c: F.array(*[F.get(c, F.lit(int(i))) for i in keep], F.lit(0.0))
        old = self.rows
        self.rows = written(old.withColumn("z", F.transform("z", lambda z: F.get(moved, z).cast("int"))).withColumn("nd", pick("nd")).withColumn("s", pick("s")), "purged")
        dropped(old)
        self.n = np.concatenate([self.n[:, keep], np.zeros((self.v, 1))], 1)
        self.tables = np.r_[self.tables[keep], 0.0]
        self.k = len(keep) + 1
        self.alpha = np.full(self.k, self.alpha[0])
        return to.tolist()

    def convert_to_lda(self, topic_threshold: float = 0.0) -> tuple[LDA, list[int]]:
        """An LDA with the topics by falling size; those with a share of the tokens up to the threshold
        lose their tokens to topics drawn at random. Also where each topic went (-1: nowhere)."""
        self._trained()
        size = self.n.sum(0)
        share = size / max(size.sum(), 1e-300)
        order = [int(i) for i in np.argsort(-size, kind="stable") if share[i] > topic_threshold and size[i] > 0]
        to = [-1] * self.k
        for new, i in enumerate(order):
            to[i] = new
        out = LDA(max(len(order), 1), alpha=0.1, eta=self.eta, tw=self.tw, min_cf=self.min_cf, min_df=self.min_df, rm_top=self.rm_top, seed=self.seed)
        out.spark, out.vocab, out.v, out.docs = self.spark, self.vocab, self.v, self.docs
        fallback = F.pmod(F.xxhash64("doc_id", "t.wid", "place"), F.lit(out.k)).cast("int")
        each = self.rows.select("*", F.posexplode(F.arrays_zip("wid", "z")).alias("place", "t"))
        z = F.get(F.lit(to), F.col("t.z"))
        again = each.select("doc_id", "place", F.when(z >= 0, z).otherwise(fallback).cast("int").alias("z"), F.get("w", F.col("place")).alias("c")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "z"))), lambda x: x["z"]).alias("z"), F.array(*[F.sum(F.when(F.col("z") == i, F.col("c")).otherwise(0.0)).cast("double") for i in range(out.k)]).alias("nd"))
        out.rows = written(self.rows.drop("z", "nd", "s").join(again, "doc_id").withColumn("s", F.lit(None).cast("array<double>")).withColumn("p", F.lit(None).cast("array<int>")).select(*self.rows.columns), "converted")
        out.n = out._counted()
        out.global_step = self.global_step
        return out, to


class HLDA(LDA):
    """Hierarchical LDA: a document has a path of depth topics through a tree grown by a nested Chinese
    restaurant process; each token a level of the path.

    Under every inner topic one open child stands for those that don't exist yet; documents that take
    it in the same sweep found one topic together, and the driver opens another. The tree is small
    and held by the driver.
    """

    supports_word_prior = False

    def __init__(self, depth: int = 2, *, gamma: float = 0.1, **kw) -> None:
        alpha = kw.pop("alpha", 0.1)
        super().__init__(depth, alpha=alpha, **kw)
        self.depth, self.gamma = depth, gamma
        self.parent, self.level = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def topics(self) -> int:
        return max(len(self.parent), 1)

    def _open(self, parent: int) -> None:
        """A chain of open topics below parent, down to the last level."""
        level = self.level[parent] + 1
        while level < self.depth:
            self.parent, self.level = np.r_[self.parent, parent], np.r_[self.level, level]
            parent, level = len(self.parent) - 1, level + 1
        self.customers = np.r_[self.customers, np.zeros(len(self.parent) - len(self.customers))]

    def begin(self) -> None:
        self.parent, self.level, self.customers = np.array([-1]), np.array([0]), np.zeros(1)
        self._open(0)
        self.n = np.zeros((self.v, len(self.parent)))

    def state(self) -> dict:
        return {**super().state(), "parent": self.parent, "level": self.level, "customers": self.customers, "gamma": self.gamma, "depth": self.depth, "frozen": getattr(self, "frozen", False)}

    @staticmethod
    def kernel(block: Block, g: dict, sweep: int) -> np.ndarray:
        parent, level, customers, depth, n = g["parent"], g["level"], g["customers"], g["depth"], g["n"]
        nodes, eta, v = len(parent), g["prior"], n.shape[0]
        leaves = np.flatnonzero(level == depth - 1)
        paths = np.zeros((len(leaves), depth), np.int64)
        paths[:, -1] = leaves
        for j in range(depth - 2, -1, -1):
            paths[:, j] = parent[paths[:, j + 1]]
        u = uniforms(g["seed"], block.doc, 2, sweep, 4)
        u_level = uniforms(g["seed"], block.doc, block.w.shape[1], sweep, 5)
        nk, docs = g["nk"], len(block.doc)
        closed = g["frozen"] or bool(g.get("infer"))
        path = np.array([p if p else [0] * depth for p in block.p]).reshape(docs, depth)
        at = (u_level * depth).astype(int) if block.new else level[block.z]
        mine = not block.new and not g.get("infer")  # the counts hold the documents' own

        count = np.broadcast_to(customers, (docs, nodes)).copy()
        if mine:
            np.subtract.at(count, (np.repeat(block.rows, depth), path.ravel()), 1)
        score = np.zeros((docs, nodes))
        d, w, c, l_ = np.broadcast_to(block.rows[:, None], block.w.shape)[block.inside], block.w[block.inside], block.weight[block.inside], at[block.inside]
        for j in range(1, depth):
            here, on = np.flatnonzero(level == j), l_ == j
            pair, where = np.unique(d[on] * v + w[on], return_inverse=True)
            if not len(pair):
                continue
            m = np.bincount(where, c[on], len(pair))
            row, word = pair // v, pair % v
            own = np.searchsorted(here, path[row, j]) if mine else None
            for a in range(0, len(pair), max(1, 2_000_000 // len(here))):
                part = slice(a, a + max(1, 2_000_000 // len(here)))
                base = n[np.ix_(word[part], here)]
                if mine:
                    base[np.arange(len(base)), own[part]] -= m[part]
                base = np.maximum(base, 0)
                gain = lgamma(base + m[part, None] + eta) - lgamma(base + eta)
                first = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
                score[np.ix_(row[part][first], here)] += np.add.reduceat(gain, first, axis=0)
            size = np.bincount(row, m, docs)
            total = np.broadcast_to(nk[here], (docs, len(here))).copy()
            if mine:
                total[block.rows, np.searchsorted(here, path[:, j])] -= size
            total = np.maximum(total, 0)
            score[:, here] -= lgamma(total + size[:, None] + v * eta) - lgamma(total + v * eta)
        logs = np.zeros((docs, len(leaves)))
        for j in range(1, depth):
            k, up = paths[:, j], paths[:, j - 1]
            chance = np.where(count[:, k] <= 0, 0.0 if closed else g["gamma"], count[:, k]) / (np.maximum(count[:, up], 0) + g["gamma"])
            logs += np.log(np.maximum(chance, 1e-300)) + score[:, k]
        path = paths[draw(np.exp(logs - logs.max(1, keepdims=True)), u[:, 0])]
        # levels, one token of each document after the other
        nd = np.zeros((docs, depth))
        np.add.at(nd, (d, l_), c)
        for t in range(block.w.shape[1]):
            a = block.active[t]
            r, z, c = block.rows[:a], at[:a, t], block.weight[:a, t]
            nd[r, z] -= c
            like = (n[block.w[:a, t, None], path[:a]] + eta) / (nk[path[:a]] + v * eta)
            z = draw((np.maximum(nd[:a], 0) + g["alpha"]) * like, u_level[:a, t])
            nd[r, z] += c
            at[:a, t] = z
            block.z[:a, t] = path[r, z]
        block.p = path.tolist()
        return np.maximum(nd, 0)

    @property
    def topic_array(self):
        return lambda block: block.z

    def _states(self) -> int:
        return self.depth

    @property
    def folded(self):
        level = self.level
        return lambda z: level[z]

    def adopt(self, vocab: DataFrame, rows: DataFrame, docs: DataFrame | None = None, **state) -> HLDA:
        """As for all models; the tree comes as parent and level of each topic in state, paths as p."""
        super().adopt(vocab, rows, docs, **state)
        self.customers = self._customers()
        return self

    def _customers(self) -> np.ndarray:
        out = np.zeros(len(self.parent))
        for r in self.rows.select(F.explode("p").alias("k")).groupBy("k").agg(F.count("*").alias("c")).toLocalIterator():  # a row for each topic
            out[r["k"]] = r["c"]
        return out

    @staticmethod
    def doc_lls(block: Block, g: dict) -> np.ndarray:
        """Paths through the tree, and levels of the tokens."""
        path = np.array(block.p)
        customers = g["customers"]
        steps = np.log(customers[path[:, 1:]] / (customers[path[:, :-1]] + g["gamma"])).sum(1)
        return steps + dirichlet_lls(block.counts(g["depth"], g["level"][block.z]), g["alpha"])

    def state_ll(self) -> float:
        return self.word_ll(self.customers > 0)

    def merge(self) -> None:
        self.n = self._counted()
        self.customers = self._customers()
        if not getattr(self, "frozen", False):
            for k in np.flatnonzero((self.level < self.depth - 1) & ((self.customers > 0) | (self.level == 0))):
                children = np.flatnonzero(self.parent == k)
                if not (self.customers[children] <= 0).any():
                    self._open(int(k))
        self._fits()
        self.n = np.concatenate([self.n, np.zeros((self.v, len(self.parent) - self.n.shape[1]))], 1)

    def attributes(self) -> dict[str, Column]:
        return {"path": F.col("p")}

    def is_live_topic(self, topic: int) -> bool:
        return bool(self.customers[topic] > 0)

    @property
    def live_k(self) -> int:
        return int((self.customers > 0).sum())

    def nodes(self) -> DataFrame:
        """(topic, parent, level, docs) of the live topics."""
        rows = [(int(k), int(self.parent[k]), int(self.level[k]), int(self.customers[k])) for k in np.flatnonzero(self.customers > 0)]
        return self.spark.createDataFrame(rows, "topic int, parent int, level int, docs int")

    def children_topics(self, topic: int) -> list[int]:
        return [int(k) for k in np.flatnonzero((self.parent == topic) & (self.customers > 0))]

    def parent_topic(self, topic: int) -> int:
        return int(self.parent[topic])
