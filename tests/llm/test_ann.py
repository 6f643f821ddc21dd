import numpy as np
from pyspark.sql import functions as F

from strandlake.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in zip(ids, x)], SCHEMA)


def brute(ids, x, query, k=10):
    d = np.sqrt(((x - x[ids.index(query)]) ** 2).sum(axis=1))
    rest = sorted((float(v), i) for i, v in zip(ids, d) if i != query)
    return rest[:k]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    out = ann.nearest_neighbours(frame(spark, x), F.col("vec_id") % 50 == 0).collect()
    x64, ids, hit = x.astype(np.float64), list(range(3000)), 0
    for q in range(0, 3000, 50):
        got = sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in got] == sorted((r.score, r.vec_id) for r in got)
        for r in got:
            assert abs(r.score - np.sqrt(((x64[r.vec_id] - x64[q]) ** 2).sum())) < 1e-12
        hit += len({i for _, i in brute(ids, x64, q)} & {r.vec_id for r in got})
    assert hit / 600 >= 0.9


def test_small_odd_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 0.0], 0), (2, None, 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [0.0, 2.0], 0), (6, [0.0, 2.0], 0), (None, [1.0, 1.0], 0), (7, [1.0, 2.0, 3.0], 0), (0, [1.0, 0.0], 0), (8, [float("inf"), 0.0], 0)]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in out] == [(0, 1, 5), (0, 2, 6), (5, 1, 6), (5, 2, 0), (5, 3, 0)]
    assert ann.nearest_neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_common_vector(spark):
    x = np.ones((5000, 4))
    x[:2500] = np.random.default_rng(0).standard_normal((2500, 4))
    out = ann.nearest_neighbours(frame(spark, x), F.col("vec_id") % 1000 == 0)
    same = [(r["rank"], r.vec_id, r.score) for r in out.where("query_id = 3000").orderBy("rank").collect()]
    assert same == [(k + 1, 2500 + k, 0.0) for k in range(10)]


def test_tree_covers_all_rows():
    x = np.random.default_rng(1).standard_normal((700, 5))
    tree = ann.fit_tree(x, leaf=20)
    assert set(tree.assign(x)) <= set(range(tree.leaves)) and sorted(tree.visits(x[0])) == list(range(tree.leaves))


def test_large_leaves_are_split(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 8)) + rng.integers(0, 4, (6000, 1)) * 6
    df = frame(spark, x)
    rows = df.selectExpr("vec_id AS _id", "cast(embedding AS array<double>) AS _vec", "false AS _query")
    top = ann.fit_tree(x[:40].astype(np.float32).astype(np.float64), leaf=20)
    indexed, tree, held = ann._grown(rows, top, 300, 10_000)
    assert top.leaves < tree.leaves and max(held.values()) <= 300 and sum(held.values()) == 6000
    got = {r._id: r._leaf for r in indexed.collect()}
    x32 = x.astype(np.float32).astype(np.float64)
    assert list(got[i] for i in range(6000)) == tree.assign(x32).tolist() and sorted(tree.visits(x32[0])) == list(range(tree.leaves))
    out = ann.nearest_neighbours(df, F.col("vec_id") % 50 == 0, sample=40, leaf_rows=300).collect()
    ids, hit = list(range(6000)), 0
    for q in range(0, 6000, 50):
        hit += len({i for _, i in brute(ids, x32, q)} & {r.vec_id for r in out if r.query_id == q})
    assert hit / 1200 >= 0.9 and len(out) == 1200


def test_blocks_of_rows_and_queries(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 16)
    x = np.random.default_rng(3).standard_normal((800, 4)).astype(np.float32)
    df = frame(spark, x).withColumn("_leaf", F.lit(1)).withColumn("_query", F.lit("x")).withColumn("query_id", F.lit(2))
    out = ann.nearest_neighbours(df, F.col("vec_id") % 4 == 0, target=1.0)
    x64, ids, hit = x.astype(np.float64), list(range(800)), 0
    rows = out.collect()
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and len(rows) == 2000 and len({(r.query_id, r.vec_id) for r in rows}) == 2000
    for q in range(0, 800, 4):
        hit += len({i for _, i in brute(ids, x64, q)} & {r.vec_id for r in rows if r.query_id == q})
    assert hit / 2000 > 0.97


def test_visits_are_best_first():
    x = np.random.default_rng(5).standard_normal((500, 6))
    tree = ann.fit_tree(x, leaf=10)
    parent = {k: n for n, kids in enumerate(tree.children) for k in kids}
    for q in x[:20]:
        far, done, order = ((tree.centres - q) ** 2).sum(axis=1), {0}, []
        queue = [0]
        while queue:
            node = min(queue, key=lambda n: (far[n] if n else 0.0, n))
            queue.remove(node)
            if tree.leaf[node] >= 0:
                order.append(tree.leaf[node])
            queue += tree.children[node]
            done |= set(tree.children[node])
        assert list(tree.visits(q)) == order and all(parent[n] in done for n in done if n)
