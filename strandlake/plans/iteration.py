"""Driver loops whose state is a DataFrame: each round is written to the shared folder and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.session import workers_find_package


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; on a local master, where that is unset, a temporary one of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="strandlake-"))
        base = _own_dir[0]
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that its lineage ends here."""
    path = f"{shared_dir(df.sparkSession)}/strandlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`stored` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], name: str, most: int = 100) -> DataFrame:
    """Applies ``step`` until row count and row hashes no longer change; an error if ``most`` rounds do not suffice."""
    mark = None
    state = stored(state, name)
    for _ in range(most):
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*state.columns).cast("decimal(38,0)"))).first()
        if now == mark:
            return state
        mark, last = now, state
        state = stored(step(last), name)
        discard(last)
    raise RuntimeError(f"{name}: not stable after {most} rounds")


LINKS = 100_000  # nodes a task holds at once while it joins up its links


def _joined_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from each node to the smallest it reaches over links of the task: union-find with path halving, LINKS nodes at a time."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pd.DataFrame:
        return pd.DataFrame({"u": list(root), "v": [find(x) for x in root]}).query("u != v")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            x, y = find(u), find(v)
            root[max(x, y)] = min(x, y)
            if len(root) >= LINKS:
                yield stars()
                root.clear()
    if root:
        yield stars()


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(``node``, ``component``): the smallest node reachable, for every node on an edge.

    In each round tasks first join up the links they hold, which leaves stars
    around their smallest nodes. Then every node points to the first of itself
    and its neighbours -- the smallest in the first round, so stars are done
    at once; by a hash that differs from round to round after that, so chains
    shrink by a constant share; the smallest again once one task has held all
    links -- and the links between what is pointed to are left for the next
    round. Pointers are then followed round by round. Each round is written to
    the shared folder; a hub's links are combined map-side or split.
    """
    workers_find_package(edges.sparkSession)
    kind = edges.schema[a].dataType.simpleString()
    links = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    maps, smallest = [], True
    while (left := links.count()) or not maps:
        tasks = max(1, -(-left // LINKS))
        stars = stored(links.coalesce(tasks).mapInPandas(_joined_up, f"u {kind}, v {kind}"), "stars")
        by_hash = bool(maps) and tasks > 1
        smallest &= not by_hash
        order = lambda v, k=len(maps), h=by_hash: F.xxhash64(v, F.lit(k)) if h else v
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        best = both.groupBy("u").agg(F.min(F.struct(order(F.col("v")).alias("o"), F.col("v").alias("w"))).alias("s"))
        own = F.struct(order(F.col("u")).alias("o"), F.col("u").alias("w"))
        point = stored(best.select("u", F.least("s", own)["w"].alias("m")), "pointers")
        maps.append(point)
        to = lambda c, n: point.select(F.col("u").alias(c), F.col("m").alias(n))  # noqa: E731, B023
        ends = stars.join(to("u", "mu"), "u").join(to("v", "mv"), "v")
        rest = stored(ends.select(F.greatest("mu", "mv").alias("u"), F.least("mu", "mv").alias("v")).where("u <> v").distinct(), "links")
        discard(links, stars)
        links = rest
    label = maps[0].select(F.col("u").alias("node"), F.col("m").alias("component"))
    for point in maps[1:]:
        label = label.join(point.withColumnRenamed("u", "component"), "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    if smallest:  # every pointer has gone to a smaller node
        return label
    label = stored(label, "labels")
    least = stored(label.groupBy("component").agg(F.min("node").alias("least")), "least")
    return label.join(least, "component").select("node", F.col("least").alias("component"))


def _paths(edges: DataFrame, child: str, parent: str, best: Callable, acyclic: bool) -> DataFrame:
    """(``node``, ``ancestor``, ``steps``), the best number of edges of all paths between them; the node itself at 0.

    Paths double in each round: a best path of more than ``n`` edges, ``n`` a
    power of two, begins with a best path of just ``n``, so only pairs at
    ``n`` are joined to all pairs, until there are none.
    """
    links = edges.select(F.col(child).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL AND up IS NOT NULL").distinct()
    nodes = links.select("node").unionByName(links.select(F.col("up").alias("node"))).distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("steps"))
    one = links.select("node", F.col("up").alias("ancestor"), F.lit(1).alias("steps"))
    merged = lambda reach: reach.groupBy("node", "ancestor").agg(best("steps").cast("int").alias("steps"))
    reach, n = stored(merged(own.unionByName(one)), "closure"), 1
    while True:
        if acyclic and not reach.where("node = ancestor AND steps > 0").isEmpty():
            raise ValueError("the relation has a cycle: longest paths are not defined")
        front = reach.where(F.col("steps") == n)
        if front.isEmpty():
            return reach
        on = reach.where("steps > 0").select(F.col("node").alias("ancestor"), F.col("ancestor").alias("up"), F.col("steps").alias("more"))
        further = front.join(on, "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        last, reach = reach, stored(merged(reach.unionByName(further)), "closure")
        discard(last)
        n *= 2


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(``node``, ``ancestor``, ``steps``): every ancestor with the least number of edges, the node itself at 0."""
    return _paths(edges, child, parent, F.min, False)


def longest_paths(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(``node``, ``ancestor``, ``steps``): every ancestor with the largest number of edges; an error if there is a cycle."""
    return _paths(edges, child, parent, F.max, True)
