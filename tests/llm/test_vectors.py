"""Vector operators against brute force."""

import numpy as np
from pyspark.sql import functions as F

from reviewlake.llm import mtree, neargraph
from reviewlake.llm.components import components, joined_components

ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [None] + [1.0] * 7, 1), (904, [float("nan")] + [1.0] * 7, 1), (905, [float("inf")] + [1.0] * 7, 1), (906, [1.0] * 5, 1), (907, [1.0] * 8, None), (None, [1.0] * 8, 1)]


def table(spark, n=700, d=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:160] = x[100] + rng.normal(size=(60, d)) * 0.05
    x[200:215] = x[200]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(v)) for v in row], i % 2 if not 100 <= i < 215 else 0) for i, row in enumerate(x)]
    return spark.createDataFrame([(*r, 5) for r in rows + ODD], "vec_id long, embedding array<float>, label int, n_links int")


def expected_links(rows):
    usable = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    links = {r.vec_id: set() for r in rows}
    for a in usable:
        for b in usable:
            if a.vec_id != b.vec_id and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = np.array(a.embedding, float), np.array(b.embedding, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a.vec_id].add(b.vec_id)
    return links


def reach(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return min(seen)


def check_graph(spark, monkeypatch, **limits):
    for name, value in limits.items():
        monkeypatch.setattr(neargraph, name, value)
    data = table(spark, 330)
    links = expected_links(data.collect())
    found = neargraph.near_duplicates(data).collect()
    assert len(found) == 339
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        else:
            least = reach(links, r.vec_id)
            assert (r.n_links, r.component_id, r.kept) == (len(links[r.vec_id]), least, r.vec_id == least), r


def test_graph(spark, monkeypatch):
    check_graph(spark, monkeypatch)


def test_graph_with_many_small_shards(spark, monkeypatch):
    check_graph(spark, monkeypatch, PER_CELL=20, SHARD=16)


def test_nothing_is_missed_at_half_the_range(spark, monkeypatch):
    margins = []
    shards = neargraph._shards
    monkeypatch.setattr(neargraph, "_shards", lambda reps, centroids, margin: margins.append(margin) or shards(reps, centroids, margin))
    check_graph(spark, monkeypatch, PER_CELL=20, RECALL=2)
    assert len(margins) == 2 and abs(margins[1] - np.sqrt(2 - 2 * neargraph.LEAST) / 2) < 1e-6


def test_graph_with_many_cells_of_a_label(spark, monkeypatch):
    monkeypatch.setattr(neargraph, "PER_CELL", 1)
    rows = [(r.vec_id, r.embedding, 0) for r in table(spark, 330).collect() if r.vec_id is not None and r.vec_id < 300]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    reps = neargraph.valid_vectors(data).groupBy("family", "v").agg(F.min("vec_id").alias("rep"))
    assert len(neargraph._centroids(reps)["0:8"]) == reps.count() > 268  # the odds of the sample do not fit an int


def plain_prune(x):
    d = np.maximum(2 - 2 * (x @ x.T), 0).astype(np.float32)
    kept = []
    for i in range(len(x)):
        own, left = [], [j for j in np.argsort(d[i], kind="stable") if j != i]
        while left:
            own.append(left[0])
            left = [j for j in left[1:] if d[own[-1], j] >= d[i, j]]
        kept.append(own)
    return kept


def test_pruning_and_search():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(150, 6)), np.eye(40), np.repeat(rng.normal(size=(1, 5)), 4, axis=0), rng.normal(size=(1, 5)), rng.normal(size=(150, 3))):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = neargraph.robust_prune(x)
        assert [k.tolist() for k in near] == plain_prune(x)
        c = x @ x.T
        pairs = {(int(a), int(b)) for p in neargraph._search(c, 0, near, 0.98) for a, b in zip(*p, strict=True)}
        np.fill_diagonal(c, -1)
        assert pairs == set(map(tuple, np.argwhere(c >= 0.98).tolist()))


def test_rows_without_a_vector_keep_their_row_beside_one_of_the_same_id(spark):
    one = [0.0, 1.0]
    rows = [(1, one, 0), (1, None, 0), (2, one, 0), (2, [0.0, 0.0], 0), (3, None, None)]
    found = neargraph.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 0, 1, True), (1, 1, 1, True), (2, 0, 2, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_graph_of_nothing(spark):
    assert neargraph.near_duplicates(table(spark, 220).where("false")).count() == 0
    assert neargraph.near_duplicates(table(spark, 220).where("vec_id = 902")).collect()[0]["n_links"] == 0


def check_top(spark, k=10):
    data = table(spark)
    vectors = mtree.integer_vectors(data)
    found = {(r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), k).collect()}
    rows = [(r.vec_id, np.floor(np.array(r.embedding, float) * 1024)) for r in data.collect() if r.vec_id is not None and (r.vec_id < 900 or r.vec_id in (902, 907))]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    expected = set()
    for q in np.flatnonzero(ids % 50 == 0):
        others = np.flatnonzero(ids != ids[q])
        s = (x[others] @ x[q]).astype(int)
        for rank, o in enumerate(np.lexsort((ids[others], -s))[:k], 1):
            expected.add((int(ids[q]), rank, int(ids[others[o]]), int(s[o])))
    assert found == expected


def test_top_k(spark):
    check_top(spark)


def test_top_k_in_small_parts(spark, monkeypatch):
    for name, value in (("PIVOTS", 7), ("CELL", 40), ("LEAF", 5), ("FANOUT", 3), ("QUERIES", 4)):
        monkeypatch.setattr(mtree, name, value)
    check_top(spark)


def test_top_k_of_little(spark):
    assert mtree.top_k(mtree.integer_vectors(table(spark).where("false")), mtree.integer_vectors(table(spark).where("false"))).count() == 0
    few = mtree.integer_vectors(table(spark).where("vec_id in (0, 1, 2)"))
    assert mtree.top_k(few, few.where("vec_id = 0")).count() == 2
    again = mtree.integer_vectors(table(spark).where("vec_id in (0, 1)").union(table(spark).where("vec_id = 1")))
    assert mtree.top_k(again, again.where("vec_id = 0")).count() == 1


def test_tree_passes_over_far_pages():
    rng = np.random.default_rng(4)
    x = np.floor(np.concatenate([rng.normal(size=(300, 6)) * 5 + c for c in rng.normal(size=(12, 6)) * 300]))
    tree = mtree.Tree(mtree.build_pages(0, np.arange(len(x)), x))
    best = tree.search(np.array([0]), x[:1], 10)[0]
    s = x @ x[0]
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != 0][:10]
    assert [i for _, i in best] == [int(i) for i in order]
    assert tree.computed < len(x) / 2
    for i, found in enumerate(tree.search(np.arange(40), x[:40], 10)):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:10]
        assert found == [(int(s[j]), int(j)) for j in order]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (200, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    more = joined_components(components(spark.createDataFrame(edges, "a long, b long")), spark.createDataFrame([(60, 101), (300, 301), (301, 100)], "a long, b long"))
    assert {r.node: r.label for r in more.collect()} == {i: 0 for i in [*range(61), 100, 101, 300, 301]}
    assert components(spark.createDataFrame(edges, "a long, b long").where("false")).select(F.col("node")).count() == 0
