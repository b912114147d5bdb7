"""Embedding near-duplicates through a robust-pruned flat graph.

* Vectors are compared within their label only. Exact copies are one vector with a multiplicity. The vectors of a label
  are dealt to cells around centroids fitted on a bounded sample; a vector that lies within ``margin`` of the boundary
  to another cell is a guest there, so that the shards overlap. Cells above ``SHARD`` vectors are split, and each pair
  of their parts is a shard.
* On each shard a graph is built by robust pruning: going through all others by distance, a neighbour is kept unless one kept
  before is nearer to it. With all vectors of the shard as candidates and no bound on degrees, from any vector a
  neighbour nearer to any other one can be found. The adjacency lists of all shards are united per vector.
* In each shard every vector is searched from the medoid: greedy steps, then an expansion over all vectors within twice
  the range, which holds a path to each one in range. Cosines are computed in double precision before a pair counts.
* Recall is measured for a bounded set of vectors against all others; if it is below ``RECALL``, the margin doubles, up to half the
  range: the distances of a pair's vectors from the boundary between their cells are no more together than the pair is apart, so
  that one of them is a guest of the other's cell, and every pair shares a shard.

A pair that meets in several shards counts in the first of them. Shards give the number of links of each vector and a
spanning set of links, from which the components follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import written
from reviewlake.llm.components import components

LEAST = 0.98
PER_CELL = 200
SHARD = 1024
CENTROIDS = 16_384  # of all labels together: what is broadcast
SAMPLE = 8  # vectors of the sample for each centroid
AUDITED = 200
RECALL = 0.99
BLOCK = 128  # vectors of a shard that are worked on at once
_SCALE = 1_000_000


def _unit(values) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in values])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _doubles() -> Column:
    return F.transform("embedding", lambda x: x.cast("double"))


def can_link() -> Column:
    """Whether a row's vector can link: id, label and vector are there, and all components finite and not all zero. Never null."""
    v = _doubles()
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < F.lit(math.inf)) & ~F.isnan(x), F.lit(False)))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(there & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def valid_vectors(table: DataFrame) -> DataFrame:
    """``vec_id, family, v`` of the vectors that can link; ``family`` is the label with the length."""
    family = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    return table.where(can_link()).select(F.col("vec_id").cast("long").alias("vec_id"), family.alias("family"), _doubles().alias("v"))


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row: nearest first, without those that are nearer to a neighbour already kept."""
    d = np.maximum(2 - 2 * (x @ x.T), 0).astype(np.float32)
    kept: list[np.ndarray] = []
    for a in range(0, len(x), BLOCK):
        kept += _prune(d, np.arange(a, min(a + BLOCK, len(x))))
    return kept


def _prune(d: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """``robust_prune`` of the rows ``own``: over whole rows while many candidates are open, then over a list of those."""
    far = d[own]
    open_ = far.copy()
    at = np.arange(len(own))
    open_[at, own] = np.inf
    rows, bests = [], []
    while (left := np.isfinite(open_)).sum() * 8 > left.size:
        best = open_.argmin(axis=1)
        more = at[left.any(axis=1)]
        rows.append(more)
        bests.append(best[more])
        np.copyto(open_, np.inf, where=d[best] < far)
        open_[at, best] = np.inf
    row, other = np.nonzero(left)
    far = far[row, other]
    while len(row):
        start = np.flatnonzero(np.diff(row, prepend=-1))
        group = np.repeat(np.arange(len(start)), np.diff(start, append=len(row)))
        least = np.flatnonzero(far == np.minimum.reduceat(far, start)[group])
        first = least[np.searchsorted(group[least], np.arange(len(start)))]
        rows.append(row[first])
        bests.append(other[first])
        best = other[first][group]
        go = (d[best, other] >= far) & (other != best)
        row, other, far = row[go], other[go], far[go]
    if not rows:
        return [np.array([], int) for _ in own]
    row, best = np.concatenate(rows), np.concatenate(bests)
    order = np.argsort(row, kind="stable")
    return np.split(best[order], np.searchsorted(row[order], at[1:]))


def _search(c: np.ndarray, medoid: int, near: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, other) in range, by greedy search from the medoid and expansion over twice the range; ``c`` holds the cosines."""
    width = max(1, max(map(len, near)))
    table = np.tile(np.arange(len(c))[:, None], (1, width))
    for i, k in enumerate(near):
        table[i, : len(k)] = k
    wide = 1 - 4 * (1 - least)  # cosine at twice the chord
    for a in range(0, len(c), BLOCK):
        block = np.arange(a, min(a + BLOCK, len(c)))
        at = np.full(len(block), medoid)
        here = c[block, at]
        while True:
            around = table[at]
            cosine = c[block[:, None], around]
            best = cosine.argmax(axis=1)
            top = cosine[np.arange(len(block)), best]
            better = top > here + 1e-12
            if not better.any():
                break
            at[better], here[better] = around[np.arange(len(block)), best][better], top[better]
        seen = np.zeros((len(block), len(c)), bool)
        front = np.zeros_like(seen)
        front[np.arange(len(block)), at] = True
        front[np.arange(len(block)), block] = True
        while front.any():
            seen |= front
            row, node = np.nonzero(front)
            cosine = c[block[row], node]
            hit = (cosine >= least) & (node != block[row])
            yield block[row[hit]], node[hit]
            go = cosine >= wide - 1e-9
            front = np.zeros_like(seen)
            front[row[go][:, None], table[node[go]]] = True
            front &= ~seen


def _centroids(reps: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of the families with several cells, at most ``CENTROIDS`` in all, from a bounded sample."""
    sizes = reps.groupBy("family").agg(F.count("*").alias("n"))
    total = reps.count()
    share = CENTROIDS / max(total, 1)
    cells = F.least(F.ceil(F.col("n") / PER_CELL), F.floor(F.col("n") * share)).cast("int")
    large = sizes.withColumn("k", cells).where("k > 1").select("family", "n", "k")
    odds = F.col("k").cast("long") * SAMPLE * _SCALE / F.col("n")  # an int would not hold it from 269 cells on
    sample = reps.join(large, "family").where(F.pmod(F.xxhash64("rep"), F.lit(_SCALE)) < odds)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        x, k = _unit(rows["v"]), int(rows["k"].iloc[0])
        c = x[:: max(1, len(x) // k)][:k].copy()
        for _ in range(6):
            owner = (x @ c.T).argmax(axis=1)
            for j in range(len(c)):
                own = x[owner == j]
                if len(own):
                    m = own.sum(axis=0)
                    c[j] = m / max(np.sqrt((m * m).sum()), 1e-12)
        return pd.DataFrame({"family": rows["family"].iloc[0], "c": [row.tolist() for row in np.unique(c, axis=0)]})

    found: dict[str, list] = {}
    for r in sample.groupBy("family").applyInPandas(fit, "family string, c array<double>").collect():
        found.setdefault(r["family"], []).append(r["c"])
    return {f: np.array(sorted(c)) for f, c in found.items()}


def _shards(reps: DataFrame, centroids: dict[str, np.ndarray], margin: float) -> DataFrame:
    """``family, cell, x, y, sub, cells, rep, m, v``: a row for each shard that a vector is in."""
    shared = reps.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def cells(family: pd.Series, v: pd.Series) -> pd.Series:
        out: list = [[0]] * len(v)
        for name, own in v.groupby(family.to_numpy()):
            c = shared.value.get(name)
            if c is None:
                continue
            score = _unit(own) @ c.T
            home = score.argmax(axis=1)
            apart = np.sqrt(np.maximum(2 - 2 * c @ c.T, 1e-12))[home]
            boundary = (score[np.arange(len(own)), home][:, None] - score) / apart
            for i, row in zip(own.index, boundary <= margin, strict=True):
                out[i] = np.flatnonzero(row).tolist()
        return pd.Series(out)

    placed = reps.withColumn("cells", cells("family", "v")).withColumn("cell", F.explode("cells"))
    sizes = placed.groupBy("family", "cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("splits"))
    sub = F.pmod(F.xxhash64("rep"), F.col("splits")).cast("int")
    dealt = placed.join(sizes, ["family", "cell"]).withColumn("sub", sub)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    return dealt.select(
        "family", "cell", F.least("sub", "other").alias("x"), F.greatest("sub", "other").alias("y"), "sub", "cells", "rep", "m", "v"
    )


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The position of the list of each element, and all elements in order."""
    return np.repeat(np.arange(len(lists)), lists.map(len)), np.concatenate([np.asarray(k, np.int64) for k in lists])


def _links(shards: DataFrame, least: float) -> DataFrame:
    """``rep, links, root``: for each shard, the vectors linked with (copies counted), and a vector joined with."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        ids = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": ids, "near": [ids[k].tolist() for k in robust_prune(_unit(rows["v"]))]})

    lists = shards.groupBy("family", "cell", "x", "y").applyInPandas(build, "rep long, near array<long>")
    graph = written(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        ids, m, sub = rows["rep"].to_numpy(), rows["m"].to_numpy(), rows["sub"].to_numpy()
        cell, across = int(rows["cell"].iloc[0]), int(rows["x"].iloc[0]) != int(rows["y"].iloc[0])
        x = _unit(rows["v"])
        owner, k = _flat(rows["near"])
        at = np.minimum(np.searchsorted(ids, k), len(ids) - 1)
        here = ids[at] == k
        near = np.split(at[here], np.searchsorted(owner[here], np.arange(1, len(ids))))
        owner, other = _flat(rows["cells"])
        earlier = other < cell
        names, place = np.unique(other[earlier], return_inverse=True)
        below = np.zeros((len(ids), len(names)), bool)
        below[owner[earlier], place] = True
        below = np.packbits(below, axis=1)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        pairs = []
        for a, b in _search(x @ x.T, int((x @ x.mean(axis=0)).argmax()), near, least):
            ok = ~(below[a] & below[b]).any(axis=1) & ((sub[a] != sub[b]) | (not across))
            a, b = a[ok], b[ok]
            np.add.at(links, a, m[b])
            if len(a):
                pairs.append((a, b))
        changed = bool(pairs)
        while changed:
            before = root.copy()
            for a, b in pairs:
                np.minimum.at(root, a, root[b])
                np.minimum.at(root, b, root[a])
            root = root[root]
            changed = bool((root != before).any())
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": ids[some], "links": links[some], "root": ids[root[some]]})

    members = shards.join(graph, "rep")
    return written(members.groupBy("family", "cell", "x", "y").applyInPandas(search, "rep long, links long, root long"), "graph-links")


def recall(reps: DataFrame, found: DataFrame, least: float) -> float:
    """Part of the links of ``AUDITED`` vectors, the first by hash of those with a link or near one, that were found."""
    sample = [(r["rep"], r["family"], r["v"]) for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(AUDITED).select("rep", "family", "v").collect()]
    if not sample:
        return 1.0
    ids, families, q = np.array([r[0] for r in sample]), np.array([r[1] for r in sample]), [_unit([r[2]])[0] for r in sample]

    @F.pandas_udf("array<long>")
    def linked(rep: pd.Series, family: pd.Series, v: pd.Series) -> pd.Series:
        out: list = [[]] * len(v)
        for name, own in v.groupby(family.to_numpy()):
            asked = np.flatnonzero(families == name)
            if len(asked):
                hit = (_unit(own) @ np.stack([q[i] for i in asked]).T >= least) & (rep[own.index].to_numpy()[:, None] != ids[asked])
                for i, row in zip(own.index, hit, strict=True):
                    out[i] = ids[asked[row]].tolist()
        return pd.Series(out)

    true = reps.select("m", F.explode(linked("rep", "family", "v")).alias("rep")).groupBy("rep").agg(F.sum("m").alias("t"))
    both = true.join(found.groupBy("rep").agg(F.sum("links").alias("f")), "rep", "left")
    row = both.agg(F.sum("t").alias("t"), F.sum(F.least("t", F.coalesce("f", F.lit(0)))).alias("f")).first()
    return 1.0 if not row["t"] else row["f"] / row["t"]


def near_duplicates(table: DataFrame, least: float = LEAST) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table`` (``vec_id, embedding, label``; others ignored).

    Vectors that are null, zero or hold null or non-finite components, and those without label or id, link with nothing and
    are kept; a null id has no component. Vectors link if their labels and lengths are equal and their cosine is
    ``least`` or more. Repeated rows are vectors of their own that link with each other.
    """
    vectors = written(valid_vectors(table), "graph-vectors")
    reps = written(vectors.groupBy("family", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "graph-reps")
    centroids = _centroids(reps)
    reach = math.sqrt(2 - 2 * least)
    margin, most = reach * 0.3, reach * 0.5 * (1 + 1e-9)
    while True:
        found = _links(written(_shards(reps, centroids, margin), "graph-shards"), least)
        if margin >= most or recall(reps, found, least) >= RECALL:
            break
        margin = min(most, margin * 2)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "family", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id")
    )
    linked = vectors.join(named, ["family", "v"]).select("vec_id", "n_links", "component_id")
    alone = table.where(~can_link()).select(F.col("vec_id").cast("long").alias("vec_id"))
    every = linked.union(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return every.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reviewlake.llm.common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN counted USING (vec_id) JOIN least USING (vec_id)
"""
