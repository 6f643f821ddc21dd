"""Approximate nearest neighbours: hierarchical k-means tree, best-bin-first search.

The tree's top is fitted on a bounded sample of all rows; leaves that hold
many rows are split further, each on a bounded sample of its own rows, until
they are small or the tree has MAX_LEAVES. Every row is indexed. A query walks
the tree through a priority queue of nodes by distance to their centres and
visits leaves in that order. How many leaves it visits is calibrated: sampled
queries are searched exactly over all rows, and visits are widened until the
leaves they would have reached hold the target share of true neighbours.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.common import discard, hashed_sample, small_batches, stored

SAMPLE = 16_384  # rows the top of the tree is fitted on, at most
BRANCH = 8
LEAF = 64  # sampled rows a leaf holds, at most
LEAF_ROWS = 4096  # a leaf with more rows than this is split on SPLIT of them
SPLIT = 1024
MAX_LEAVES = 32_768  # no leaf is split beyond this many: 16 MB a 64-component tree, which is broadcast
CALIBRATION = 256  # queries searched exactly, at most
TARGET = 0.95
BLOCK = 4096  # rows of a leaf, and queries, that meet in one task


@dataclass
class Tree:
    """Centres of all nodes; children of inner nodes; leaf number of leaves (-1 for inner nodes)."""

    centres: np.ndarray
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: at every node the child with the nearest centre."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                kids = self.children[node]
                near = squared(x[rows], self.centres[kids]).argmin(axis=1)
                todo += [(k, rows[near == i]) for i, k in enumerate(kids)]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order; a node's children are measured when it is opened."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield self.leaf[node]
            else:
                kids = self.children[node]
                far = self.centres[kids] - q
                for d, k in zip(np.einsum("ij,ij->i", far, far).tolist(), kids):
                    heapq.heappush(heap, (d, k))

    def grafted(self, parts: dict[int, Tree]) -> Tree:
        """This tree with some leaves replaced by trees; leaves are numbered anew."""
        centres, children, leaf = [self.centres], [list(c) for c in self.children], list(self.leaf)
        for node in [n for n, at in enumerate(self.leaf) if at in parts]:
            part, base = parts[self.leaf[node]], len(children) - 1
            children[node] = [base + c for c in part.children[0]]  # the part's root is this node
            children += [[base + c for c in kids] for kids in part.children[1:]]
            leaf[node] = part.leaf[0]
            leaf += part.leaf[1:]
            centres.append(part.centres[1:])
        ends = iter(range(len(leaf)))
        return Tree(np.concatenate(centres), children, [next(ends) if at >= 0 else -1 for at in leaf])


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = squared(x, centres).argmin(axis=1)
        for i in range(k):
            if (own := label == i).any():
                centres[i] = x[own].mean(axis=0)
    return label


def fit_tree(x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 3) -> Tree:
    """Splits by k-means until a node has few rows or cannot be split (all rows equal)."""
    rng = np.random.default_rng(seed)
    tree, centres, leaves = Tree(np.empty((0, x.shape[1]))), [], 0
    todo = [(np.arange(len(x)), None)]
    while todo:
        rows, parent = todo.pop()
        node = len(centres)
        centres.append(x[rows].mean(axis=0) if len(rows) else np.zeros(x.shape[1]))
        tree.children.append([])
        tree.leaf.append(-1)
        if parent is not None:
            tree.children[parent].append(node)
        parts = []
        if len(rows) > leaf:
            label = _kmeans(x[rows], min(branch, len(rows)), rng)
            parts = [p for i in range(branch) if len(p := rows[label == i])]
        if len(parts) > 1:
            todo += [(p, node) for p in parts]
        else:
            tree.leaf[node] = leaves
            leaves += 1
    tree.centres = np.array(centres)
    return tree


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda v: v != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from differences."""
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        d = x - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _nearest(qi: np.ndarray, q: np.ndarray, xi: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest rows of x to each q, rows of the query's own id left out; ``at``: their places in x."""
    if len(q) > 512:
        return pd.concat([_nearest(qi[i : i + 512], q[i : i + 512], xi, x, k) for i in range(0, len(q), 512)])
    far = squared(q, x)  # to choose; distances given are exact
    far[qi[:, None] == xi[None, :]] = np.inf
    rows = []
    for i in range(len(q)):
        pick = np.arange(len(xi))
        if len(pick) > 4 * k:
            near = np.partition(far[i], k)[k]
            pick = np.flatnonzero(far[i] <= near + 1e-6 * (1.0 + abs(near) + float((q[i] * q[i]).sum())))
        pick = pick[xi[pick] != qi[i]]
        if len(pick):
            d = _exact(q[i : i + 1], x[pick])[0]
            best = np.lexsort((xi[pick], d))[:k]
            rows.append((np.full(len(best), qi[i]), xi[pick][best], d[best], pick[best]))
    if not rows:
        rows = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "at"), map(np.concatenate, zip(*rows)))))


def _grown(rows: DataFrame, tree: Tree, leaf_rows: int, max_leaves: int) -> tuple[DataFrame, Tree, dict[int, int]]:
    """Rows with their ``_leaf``, the tree with large leaves split, and how many rows each leaf holds."""
    while True:
        index = lambda batches, t=tree: (pdf.assign(_leaf=t.assign(_matrix(pdf["_vec"]))) for pdf in batches if len(pdf))
        indexed = stored(rows.mapInPandas(index, "_id long, _vec array<double>, _query boolean, _leaf long"), "ann-index")
        held = {r["_leaf"]: r["n"] for r in indexed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
        big = sorted((leaf for leaf, n in held.items() if n > leaf_rows), key=lambda leaf: -held[leaf])
        room = (max_leaves - tree.leaves) // max(SPLIT // LEAF * 2, 1)
        if not big or room <= 0:
            return indexed, tree, held
        share = rows.sparkSession.createDataFrame([(leaf, min(1.0, 1.5 * SPLIT / held[leaf])) for leaf in big[:room]], "_leaf long, _share double")
        dice = F.pmod(F.xxhash64("_id", F.lit(77)), F.lit(1 << 20)) / float(1 << 20)
        chosen = indexed.join(F.broadcast(share), "_leaf").where(dice < F.col("_share")).select("_leaf", "_id", "_vec")
        fitted = chosen.groupBy("_leaf").applyInPandas(_fitted, "_leaf long, tree binary").collect()
        parts = {r["_leaf"]: pickle.loads(r["tree"]) for r in fitted}
        parts = {leaf: part for leaf, part in parts.items() if part.leaves > 1}  # a leaf of equal rows cannot be split
        if not parts:
            return indexed, tree, held
        tree = tree.grafted(parts)
        discard(indexed)


def _fitted(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_id").head(SPLIT)
    return pd.DataFrame({"_leaf": pdf["_leaf"].iloc[:1].to_numpy(), "tree": [pickle.dumps(fit_tree(_matrix(pdf["_vec"])))]})


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    target: float = TARGET,
    sample: int = SAMPLE,
    calibration: int = CALIBRATION,
    leaf_rows: int = LEAF_ROWS,
    max_leaves: int = MAX_LEAVES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest rows found, nearest first, ties to the smaller id.

    ``is_query`` marks the query rows; every other-id row is a candidate.
    Vectors that are null, empty, all zero, or hold null or non-finite
    components take no part, nor do rows with a null id; vectors must have one
    length (others than the most common one, to which no distance is defined,
    take no part). Repeated ids: each row is a candidate, a query is asked
    once (its first vector by value), and no row of the query's id is among
    its answers. Fewer candidates than k: all are returned. Empty table: empty
    result. Other columns, of any name, are not read.

    The fit samples and the calibration queries are chosen by hash of the id.
    The rows of a leaf and the queries that visit it meet in blocks of BLOCK
    each, so what is shuffled grows with the rows and with the visits; leaves
    no query visits are not shuffled. Leaves stay near ``leaf_rows`` until the
    tree has ``max_leaves``; beyond about leaf_rows * max_leaves rows leaves,
    and with them a query's work, grow with the table.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = stored(
        vectors.where(F.col(id_col).isNotNull() & _usable(F.col(vec_col))).select(
            F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"), F.coalesce(is_query, F.lit(False)).alias("_query")
        ),
        "ann-rows",
    )
    empty = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.size("_vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("_vec") == common["d"])
    tree = fit_tree(_matrix(hashed_sample(rows, sample, common["count"]).toPandas()["_vec"]))
    indexed, tree, held = _grown(rows, tree, leaf_rows, max_leaves)
    queries = indexed.where("_query").groupBy("_id").agg(F.min("_vec").alias("_vec"))
    queries = stored(queries, "ann-queries")

    probe = hashed_sample(queries, calibration, queries.count()).toPandas()
    if not len(probe):
        return spark.createDataFrame([], empty)
    pi, px = probe["_id"].to_numpy(), _matrix(probe["_vec"])

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = _nearest(pi, px, pdf["_id"].to_numpy(), _matrix(pdf["_vec"]), k)
                yield found.assign(_leaf=pdf["_leaf"].to_numpy()[found["at"]]).drop(columns="at")

    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    truth = (
        indexed.mapInPandas(brute, "query_id long, vec_id long, score double, _leaf long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .groupBy("query_id")
        .agg(F.collect_list("_leaf").alias("leaves"))
        .collect()
    )
    order = {q: {leaf: r for r, leaf in enumerate(tree.visits(x))} for q, x in zip(pi, px)}
    need = np.sort([order[r["query_id"]][leaf] for r in truth for leaf in r["leaves"]])
    width = int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)]) + 1 if len(need) else tree.leaves

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, leaves = [], []
            for i, vec in zip(pdf["_id"], pdf["_vec"]):
                seen = 0
                for n, leaf in enumerate(tree.visits(np.asarray(vec, np.float64))):
                    if n >= width and seen > k + 1:
                        break
                    if leaf in held:
                        ids.append(i)
                        leaves.append(leaf)
                        seen += held[leaf]
            yield pd.DataFrame({"_id": np.array(ids, np.int64), "_leaf": np.array(leaves, np.int64)})

    # a leaf's rows and the queries that visit it, each dealt into blocks of BLOCK; one row a leaf, MAX_LEAVES at most
    visits = stored(queries.mapInPandas(route, "_id long, _leaf long"), "ann-visits")
    asked = {r["_leaf"]: r["n"] for r in visits.groupBy("_leaf").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = F.broadcast(spark.createDataFrame([(leaf, -(-held[leaf] // BLOCK), -(-n // BLOCK)) for leaf, n in asked.items()], "_leaf long, _blocks int, _askers int"))
    own = lambda n, *of: F.pmod(F.xxhash64(*of), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = visits.join(blocks, "_leaf").withColumn("_qb", own("_askers", "_id")).withColumn("_block", each("_blocks")).join(queries, "_id")
    answering = indexed.select("_leaf", "_id", "_vec").join(blocks, "_leaf").withColumn("_block", own("_blocks", "_id", "_vec")).withColumn("_qb", each("_askers"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = _nearest(left["_id"].to_numpy(), _matrix(left["_vec"]), right["_id"].to_numpy(), _matrix(right["_vec"]), k)
        return found.drop(columns="at")

    key = ["_leaf", "_block", "_qb"]
    by = lambda d: d.select(*[F.col(c).alias(c) for c in (*key, "_id", "_vec")]).groupBy(*key)
    found = by(asking).cogroup(by(answering)).applyInPandas(search, "query_id long, vec_id long, score double")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
