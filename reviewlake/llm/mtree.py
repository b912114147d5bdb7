"""Exact top-k by inner product: best-first search in paged metric trees.

The root page has up to ``PIVOTS`` routing vectors; each row belongs to the nearest, and large cells are split evenly,
so that no task gets more than about ``CELL`` rows. Each part is built into a tree of pages, written as rows: a routing
vector, the covering radius, the distance to the parent's routing vector, the largest norm below, and in leaves the vectors
with their distances to the routing vector.

Inner products are bounded by distances: ``2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2``. By the triangle inequality ``d(q, x)`` is at
least ``d(q, router) - radius``, and at least ``|d(q, parent) - d(parent, x)|``, which is stored: such pages and entries are
passed over without computing their distance. A page that cannot reach the tenth best score found is not opened. Each
query first searches one part near itself, and takes its tenth score as the bar for all others.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import written

PIVOTS = 64
CELL = 4096
LEAF = 48
FANOUT = 16
QUERIES = 1024
_PAGES = (
    "part long, page int, parent int, leaf boolean, router binary, radius double, up double, norm double,"
    " ids array<long>, vectors binary, gaps array<double>"
)


def integer_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` of each component, for the vectors that take part.

    Rows without id, null vectors, and vectors with null or non-finite components do not; nor do vectors of another length
    than the most common one (ties: the shorter). Of several rows of one id, the least vector counts.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    rows = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not lengths:
        return rows
    return rows.where(F.size("v") == lengths[0]["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def build_pages(part: int, ids: np.ndarray, x: np.ndarray) -> pd.DataFrame:
    """A tree over some vectors, from the leaves up; page 0 is the root, which holds all."""
    norms = np.sqrt((x * x).sum(1))
    rows: list[dict] = []
    # levels of groups of rows, each led by one of its vectors
    groups = [np.arange(len(x))]
    leaders = [int(np.argmin(np.abs(norms - np.median(norms))))]
    parents = [-1]
    while groups:
        below, next_leaders, next_parents = [], [], []
        for members, leader, parent in zip(groups, leaders, parents, strict=True):
            page = len(rows)
            gaps = _distances(x[members], x[leader][None])[:, 0]
            leaf = len(members) <= LEAF
            up = 0.0 if parent < 0 else float(np.sqrt(((x[leader] - np.frombuffer(rows[parent]["router"])) ** 2).sum()))
            rows.append({
                "part": part, "page": page, "parent": parent, "leaf": leaf, "router": x[leader].tobytes(), "radius": float(gaps.max()), "up": up,
                "norm": float(norms[members].max()), "ids": ids[members].tolist() if leaf else [],
                "vectors": x[members].tobytes() if leaf else b"", "gaps": gaps.tolist() if leaf else [],
            })
            if not leaf:
                # routing vectors far from each other; each member goes to the nearest
                chosen = [int(np.argmax(gaps))]
                near = _distances(x[members], x[members[chosen[0]]][None])[:, 0]
                owner = np.zeros(len(members), int)
                while len(chosen) < FANOUT and near.max() > 0:
                    chosen.append(int(np.argmax(near)))
                    d = _distances(x[members], x[members[chosen[-1]]][None])[:, 0]
                    owner[d < near] = len(chosen) - 1
                    near = np.minimum(near, d)
                if len(chosen) == 1:  # equal vectors: split as they come
                    owner = np.arange(len(members)) // LEAF
                for g in range(int(owner.max()) + 1):
                    own = members[owner == g]
                    if len(own):
                        below.append(own)
                        next_leaders.append(int(members[chosen[g]]) if len(chosen) > 1 else int(own[0]))
                        next_parents.append(page)
        groups, leaders, parents = below, next_leaders, next_parents
    return pd.DataFrame(rows)


class Tree:
    """The pages of one part, ready for queries."""

    def __init__(self, pages: pd.DataFrame):
        pages = pages.sort_values("page")
        self.leaf = pages["leaf"].to_numpy()
        self.router = np.stack([np.frombuffer(r) for r in pages["router"]])
        self.radius, self.up, self.norm = (pages[c].to_numpy(float) for c in ("radius", "up", "norm"))
        parent = pages["parent"].to_numpy()
        self.children = [np.flatnonzero(parent == p) if not leaf else None for p, leaf in enumerate(self.leaf)]
        self.ids = [np.array(v, np.int64) for v in pages["ids"]]
        self.gaps = [np.array(v, float) for v in pages["gaps"]]
        self.vectors = [np.frombuffer(v).reshape(-1, self.router.shape[1]) for v in pages["vectors"]]
        self.squares = [(v * v).sum(1) for v in self.vectors]
        self.computed = 0

    def search(self, ids: np.ndarray, q: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
        """For each query the ``k`` best (score, id), none below its bar; ties to smaller ids, without the query's own id.

        A block of queries goes through the tree together: the page opened next is the one with the best bound of any
        query, and it is opened for those queries alone whose bound there reaches what they have found so far.
        """
        n = len(ids)
        qq = (q * q).sum(1)
        length = np.sqrt(qq)
        bar = np.full(n, -math.inf) if bars is None else bars.astype(float)
        top = np.full((n, k), -math.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        every = np.arange(n)
        heap = [(-math.inf, 0, every, np.full(n, math.inf), np.sqrt(((q - self.router[0]) ** 2).sum(1)))]
        while heap:
            _, page, rows, bound, d = heapq.heappop(heap)
            live = bound >= bar[rows] - 0.5
            rows, d = rows[live], d[live]
            if not len(rows):
                continue
            if self.leaf[page]:
                gap = np.abs(d[:, None] - self.gaps[page])
                wanted = (qq[rows][:, None] + self.squares[page] - gap * gap) / 2 >= bar[rows][:, None] - 0.5
                wanted &= self.ids[page] != ids[rows][:, None]
                some = np.flatnonzero(wanted.any(axis=1))
                members = np.flatnonzero(wanted.any(axis=0))
                if not len(some):
                    continue
                rows, wanted = rows[some], wanted[np.ix_(some, members)]
                self.computed += wanted.size
                scores = np.where(wanted, q[rows] @ self.vectors[page][members].T, -math.inf)
                hit = (scores >= bar[rows][:, None] - 0.5) & wanted
                i, j = np.nonzero(hit)
                found.append((rows[i], scores[i, j], self.ids[page][members[j]]))
                both = np.concatenate([top[rows], scores], axis=1)
                top[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                bar[rows] = np.maximum(bar[rows], top[rows].min(axis=1))
                continue
            for child in self.children[page].tolist():
                far = np.maximum(np.abs(d - self.up[child]) - self.radius[child], 0)
                near = np.flatnonzero((qq[rows] + self.norm[child] ** 2 - far * far) / 2 >= bar[rows] - 0.5)
                if not len(near):
                    continue
                own = rows[near]
                self.computed += len(own)
                apart = np.sqrt(((q[own] - self.router[child]) ** 2).sum(1))
                far = np.maximum(apart - self.radius[child], 0)
                most = np.minimum((qq[own] + self.norm[child] ** 2 - far * far) / 2, q[own] @ self.router[child] + length[own] * self.radius[child])
                heapq.heappush(heap, (-float(most.max()), child, own, most, apart))
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if found:
            row, score, other = (np.concatenate(c) for c in zip(*found, strict=True))
            good = score >= bar[row] - 0.5
            row, score, other = row[good], score[good], other[good]
            order = np.lexsort((other, -score, row))
            for r, s, o in zip(row[order].tolist(), score[order].tolist(), other[order].tolist(), strict=True):
                if len(out[r]) < k:
                    out[r].append((round(s), int(o)))
        return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` of the highest inner product with each query.

    Both have ``vec_id`` and ``v``, whole numbers in arrays of one length whose products sum to less than 2^52. The row of the
    query's own id is left out; ties go to the smaller id; a query gets all rows if there are fewer. Empty tables give no row.
    """
    pivots = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()]
    out = "query_id long, rank int, vec_id long, score long"
    if not pivots:
        return vectors.sparkSession.createDataFrame([], out)
    routers = np.array(pivots, float)

    @F.pandas_udf("cell int, far double, norm double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        x = _matrix(v)
        d = _distances(x, routers)
        at = d.argmin(1)
        return pd.DataFrame({"cell": at.astype("int32"), "far": d[np.arange(len(at)), at], "norm": np.sqrt((x * x).sum(1))})

    placed = vectors.select("vec_id", "v", nearest("v").alias("p")).select("vec_id", "v", "p.*")
    root = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    sizes = {r["cell"]: -(-r["n"] // CELL) for r in root}
    splits = F.create_map(*[F.lit(x) for c, n in sorted(sizes.items()) for x in (c, n)])
    most = max(sizes.values())
    part = lambda cell, split: cell.cast("long") * most + split
    parts = placed.select(part(F.col("cell"), F.pmod(F.xxhash64("vec_id"), splits[F.col("cell")])).alias("part"), "vec_id", "v")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return build_pages(int(rows["part"].iloc[0]), rows["vec_id"].to_numpy(), _matrix(rows["v"]))

    pages = written(parts.groupBy("part").applyInPandas(build, _PAGES), "mtree-pages")

    cells = np.array([r["cell"] for r in root])
    far, norm = np.array([r["far"] for r in root]), np.array([r["norm"] for r in root])

    @F.pandas_udf("array<int>")
    def reachable(v: pd.Series, bar: pd.Series) -> pd.Series:
        """Cells whose bound reaches the bar; the nearest alone where there is no bar yet."""
        q = _matrix(v)
        d = _distances(q, routers[cells])
        low = np.maximum(d - far, 0)
        bound = np.minimum(((q * q).sum(1)[:, None] + norm**2 - low**2) / 2, q @ routers[cells].T + np.sqrt((q * q).sum(1))[:, None] * far)
        return pd.Series([cells[[row.argmin()]] if np.isnan(b) else cells[up >= b - 0.5] for row, up, b in zip(d, bound, bar, strict=True)])

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))

    def search(key, own: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(own) and len(ask):
            asked = ask["query_id"].to_numpy(np.int64)
            bars = ask["bar"].fillna(-math.inf).to_numpy(float)
            for i, found in zip(asked.tolist(), Tree(own).search(asked, _matrix(ask["q"]), k, bars), strict=True):
                rows += [(i, v, s) for s, v in found]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    def searched(ask: DataFrame) -> DataFrame:
        """Results of rows of ``part, block, query_id, q, bar``."""
        todo = ask.select(F.col("part").alias("of_part"), F.col("block").alias("of_block")).distinct()
        wanted = pages.join(todo, pages["part"] == todo["of_part"]).drop("of_part").withColumnRenamed("of_block", "for_block")
        return wanted.groupBy("part", "for_block").cogroup(ask.groupBy("part", "block")).applyInPandas(search, "query_id long, vec_id long, score long")

    none = F.lit(math.nan)
    home = asked.withColumn("bar", none).withColumn("cell", F.explode(reachable("q", "bar")))
    home = home.withColumn("part", part(F.col("cell"), F.pmod(F.xxhash64("query_id", "block"), splits[F.col("cell")])))
    first = written(searched(home.select("part", "block", "query_id", "q", "bar")), "mtree-first")
    bars = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("bar"))
    rest = asked.join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(-math.inf)))
    rest = rest.withColumn("cell", F.explode(reachable("q", "bar")))
    rest = rest.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), splits[F.col("cell")].cast("int") - 1), lambda s: part(F.col("cell"), s))))
    rest = rest.join(home.select("query_id", "part"), ["query_id", "part"], "left_anti").select("part", "block", "query_id", "q", "bar")
    both = first.union(searched(rest))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    vectors = written(integer_vectors(table(spark, sf_dir, "embeddings")), "mtree-vectors")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""
