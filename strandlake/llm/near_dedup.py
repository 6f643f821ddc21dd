"""Near-duplicate components with HyperMinHash sketches.

A text's words (after lower-casing A-Z) are runs of characters other than
space and tab to carriage return; its set is its distinct five-word shingles,
or its whole word sequence if shorter. Documents whose sets have a Jaccard
similarity of 0.75 or more are linked, and the result is the connected
components of that graph.

Sketch: the top bits of a shingle's hash pick one of REGISTERS buckets; a
bucket stores the smallest remaining hash as its count of leading zeros and
the MANTISSA bits that follow. Empty buckets borrow from others in a fixed
pseudo-random probe order, so that two sets agree in a register with
probability equal to their similarity whatever their size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import discard, mix64, salted_groups, small_batches, span_hashes, spread_join, stored, tidy
from strandlake.plans.iteration import components as connected

WORDS = 5
REGISTERS = 128
MANTISSA = 10
BAND = 4  # registers in a band: 32 bands miss a link at 0.75 with probability (1 - 0.75**4)**32 = 5e-6 if registers
# are independent; where most are borrowed (sets just above TINY) misses are more frequent, see the README
SIGMAS = 5.0  # a candidate is dropped before verification only that far below the threshold
NUMERATOR, DENOMINATOR = 75, 100
SALTS = 64
TINY = 12  # sets up to this size are also bucketed by each of their shingles
BATCH_BYTES = 1 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIXERS = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC13FA9A902A6328F, 0x91E10DA5C79E7B1D, 0xD1342543DE82EF95], np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, whole texts, a few at a time in memory."""
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < BATCH_BYTES):
            group.append((texts[at] or "").encode("utf-8", "surrogatepass").translate(_LOWER))
            size += len(group[-1]) + 1
            at += 1
        yield from _sets_of(group)


def _sets_of(group: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b" ".join(group) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, ends = edge[::2], edge[1::2]
    words = span_hashes(data, starts, ends)
    doc_ends = np.cumsum([len(g) + 1 for g in group])
    cut = np.searchsorted(starts, doc_ends)
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= WORDS:
        for k in range(WORDS):
            full[: n - WORDS + 1] += words[k : n - WORDS + 1 + k] * _MIXERS[k]
    full = mix64(full)
    begin = 0
    for end in cut:
        m = end - begin
        if m >= WORDS:
            own = np.sort(full[begin : end - WORDS + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif m:
            with np.errstate(over="ignore"):
                yield mix64(np.array([(words[begin:end] * _MIXERS[:m]).sum() + np.uint64(m)], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        begin = end


_BITS = REGISTERS.bit_length() - 1
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BITS))
_PROBES = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row for each (non-empty) set."""
    low = np.zeros((len(sets), REGISTERS), np.uint64)
    filled = np.zeros((len(sets), REGISTERS), bool)
    for i, s in enumerate(sets):
        at = np.searchsorted(s, _EDGES)
        filled[i] = np.diff(at, append=len(s)) > 0
        low[i] = s[np.minimum(at, len(s) - 1)]
    rest = low << np.uint64(_BITS)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 63).astype(np.uint64)
    mantissa = (rest << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    regs = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    need = ~filled
    rows = np.flatnonzero(need.any(axis=1))
    if len(rows):
        own, have, out, todo = regs[rows], filled[rows], regs[rows].copy(), need[rows]
        for probe in _PROBES.T:
            hit = todo & have[:, probe]
            out = np.where(hit, own[:, probe], out)
            todo &= ~hit
            if not todo.any():
                break
        regs[rows] = out
    return regs


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    parts = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), -1)  # four 16-bit registers
    return mix64(mix64(parts) + mix64(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1)))


def jaccard_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity from agreeing registers, less the agreements expected by chance.

    Unrelated registers agree when both leading-zero counts and all mantissa
    bits do: the sum over counts of the two probabilities of that count, over
    2**MANTISSA.
    """
    agree = (a == b).mean(axis=1)
    z = np.arange(40)[:, None]
    load = lambda n: np.maximum(n[None, :] / REGISTERS, 1.0)
    share = lambda v: (1 - 2.0 ** -(z + 1)) ** v - (1 - 2.0**-z) ** v
    chance = (share(load(na)) * share(load(nb))).sum(axis=0) / 2**MANTISSA
    return (agree - chance) / (1 - chance)


def margin(n: np.ndarray) -> np.ndarray:
    """How far below the threshold an estimate may fall: SIGMAS deviations, by the registers a set of n fills itself."""
    own = REGISTERS * -np.expm1(n * np.log1p(-1.0 / REGISTERS))
    return SIGMAS * np.sqrt(0.1875 / np.maximum(own, 1.0))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether sizes allow the threshold and the estimate is not clearly below it."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    sizes = DENOMINATOR * small >= NUMERATOR * large
    return sizes & (jaccard_estimate(a, b, na, nb) >= NUMERATOR / DENOMINATOR - margin(small))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


@tidy
def _sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        sizes, hash1, hash2, tiny = [], [], [], []
        regs = np.zeros((len(pdf), REGISTERS), np.uint16)
        flush: list[np.ndarray] = []
        base = 0

        def drain() -> None:
            nonlocal base
            full = [i for i, s in enumerate(flush) if len(s)]
            if full:
                regs[[base + i for i in full]] = sketches([flush[i] for i in full])
            base += len(flush)
            flush.clear()

        total = 0
        for s in shingle_sets(pdf["_text"].tolist()):
            sizes.append(len(s))
            h = mix64(s)
            hash1.append(h.sum(dtype=np.uint64))
            hash2.append(mix64(h + np.uint64(1)).sum(dtype=np.uint64))
            tiny.append(s.tobytes() if len(s) <= TINY else b"")
            flush.append(s)
            total += len(s)
            if total > 1 << 19:
                drain()
                total = 0
        drain()
        yield pd.DataFrame(
            {
                "_id": pdf["_id"],
                "_has": pdf["_has"],
                "_n": np.array(sizes, np.int64),
                "_h1": _signed(np.array(hash1, np.uint64)),
                "_h2": _signed(np.array(hash2, np.uint64)),
                "_regs": [r.tobytes() for r in regs],
                "_tiny": tiny,
            }
        )


@tidy
def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        for lo in range(0, len(pdf), 4096):
            part = pdf.iloc[lo : lo + 4096]
            keys = band_keys(np.frombuffer(b"".join(part["_regs"]), np.uint16).reshape(-1, REGISTERS))
            ids = part["_id"].to_numpy()
            small = np.frombuffer(b"".join(part["_tiny"]), np.uint64)
            keys, ids = (
                np.concatenate((keys.ravel(), mix64(small + np.uint64(1)))),
                np.concatenate((np.repeat(ids, keys.shape[1]), np.repeat(ids, part["_tiny"].map(len).to_numpy() // 8))),
            )
            yield pd.DataFrame({"_key": _signed(keys), "_id": ids})


@tidy
def _set_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pd.DataFrame({"_id": pdf["_id"], "_set": [s.tobytes() for s in shingle_sets(pdf["_text"].tolist())]})


@tidy
def _estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        a, b = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(-1, REGISTERS) for c in ("_ra", "_rb"))
        ok = plausible(a, b, pdf["_na"].to_numpy(), pdf["_nb"].to_numpy())
        yield pdf.loc[ok, ["_a", "_b"]]


@tidy
def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if not len(pdf):
            continue
        ok = np.zeros(len(pdf), bool)
        for i, (x, y) in enumerate(zip(pdf["_sa"], pdf["_sb"])):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((u, v))
            both.sort(kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok[i] = DENOMINATOR * shared >= NUMERATOR * (len(u) + len(v) - shared)
        yield pdf.loc[ok, ["_a", "_b"]]


def verified_links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of (``_a``, ``_b``) pairs, those linked: sketch estimate first, then full sets."""
    side = lambda df, c, kept: df.select(F.col("_id").alias(f"_{c}"), *[F.col(x).alias(y) for x, y in kept])
    near = stored(
        pairs.join(side(nodes, "a", [("_regs", "_ra"), ("_n", "_na")]), "_a")
        .join(side(nodes, "b", [("_regs", "_rb"), ("_n", "_nb")]), "_b")
        .select("_a", "_b", "_ra", "_rb", "_na", "_nb")
        .mapInPandas(_estimated, "_a long, _b long"),
        "near-estimated",
    )
    full = (
        near.join(side(sets, "a", [("_set", "_sa")]), "_a")
        .join(side(sets, "b", [("_set", "_sb")]), "_b")
        .select("_a", "_b", "_sa", "_sb")
    )
    return stored(full.mapInPandas(_verified, "_a long, _b long"), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(``_id``, ``_comp``): the smallest id reachable, for every id in (``_a``, ``_b``) links."""
    found = connected(links, "_a", "_b")
    return found.select(F.col("node").alias("_id"), F.col("component").alias("_comp"))


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "_id", "left").withColumn("_comp", F.coalesce("_comp", "_id"))


BLOCK = 128  # documents of a cell on each side that meet in one task
CLASS = math.log(1.34)  # sets of linked documents differ in the log of their size by less than this, so in their class by 1 at most


def shared_counts(x: np.ndarray, vocabulary: np.ndarray, first: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many of a set's shingles each of n sets holds; shingle k of the vocabulary is held by ``owners[first[k]:first[k + 1]]``."""
    at = np.searchsorted(vocabulary, x)
    inside = at < len(vocabulary)
    at = at[inside]
    at = at[vocabulary[at] == x[inside]]
    size = first[at + 1] - first[at]
    run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.bincount(owners[np.repeat(first[at], size) + run], minlength=n)


def _cell_block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Links, on full sets, of a block of a cell's documents outside its main component and a block of all its documents.

    Of the links of one document into one component one is returned.
    """
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(left) and len(right):
        sets = [np.frombuffer(x, np.uint64) for x in right["_set"]]
        sizes = np.array([len(x) for x in sets])
        vocabulary, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        owners = np.repeat(np.arange(len(sets)), sizes)[order]
        first = np.searchsorted(inverse[order], np.arange(len(vocabulary) + 1))
        ids, comps = right["_id"].to_numpy(), right["_comp"].to_numpy()
        for i, comp, raw in zip(left["_id"].tolist(), left["_comp"].tolist(), left["_set"]):
            x = np.frombuffer(raw, np.uint64)
            shared = shared_counts(x, vocabulary, first, owners, len(sets))
            hit = np.flatnonzero((DENOMINATOR * shared >= NUMERATOR * (len(x) + sizes - shared)) & (comps != comp))
            _, one = np.unique(comps[hit], return_index=True)
            a.append(np.minimum(i, ids[hit[one]]))
            b.append(np.maximum(i, ids[hit[one]]))
    return pd.DataFrame({"_a": np.concatenate(a), "_b": np.concatenate(b)})


def _links_in_cells(cells: DataFrame, comp: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between the components of a cell (``_id``, ``_cell``), found on full sets, block by block.

    Of two linked documents of different components one at least is outside
    the cell's largest component: it meets the cell's documents of its own and
    the two neighbouring classes of set size. Where a class of a cell has
    documents of one component only, nothing is compared.
    """
    size = F.floor(F.log(F.col("_n").cast("double")) / CLASS).cast("int").alias("_k")
    rows = stored(_labelled(cells, comp).join(nodes.select("_id", size), "_id").select("_id", "_cell", "_comp", "_k"), "near-cell-rows")
    per = rows.groupBy("_cell", "_comp").agg(F.count(F.lit(1)).alias("_c"))
    main = (
        per.groupBy("_cell")
        .agg(F.max_by("_comp", F.struct("_c", "_comp")).alias("_main"), F.sum("_c").alias("_size"), F.max("_c").alias("_most"))
        .where("_size > _most")
        .select("_cell", "_main", "_size")
    )
    rows = spread_join(rows, stored(main, "near-main"), ["_cell"], "_size", ["_id"])
    rows = stored(rows.select("_id", "_cell", "_comp", "_k", (F.col("_comp") != F.col("_main")).alias("_left")), "near-mixed")
    both = rows.select("_cell", "_k", "_comp", F.lit(0).alias("_l"), F.lit(1).alias("_r")).unionByName(
        rows.where("_left").select("_cell", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1)).alias("_k"), "_comp", F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    )
    blocks = stored(
        both.groupBy("_cell", "_k")
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.min("_comp").alias("_a"), F.max("_comp").alias("_b"))
        .where("_l > 0 and _r > 0 and _a < _b")
        .select("_cell", "_k", "_l", "_r", F.ceil(F.col("_l") / BLOCK).cast("int").alias("_lefts"), F.ceil(F.col("_r") / BLOCK).cast("int").alias("_rights")),
        "near-blocks",
    )
    rows = stored(rows.join(sets, "_id"), "near-open")
    own = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    meet = lambda d, n, other: spread_join(d, blocks.drop(other), ["_cell", "_k"], n, ["_id"])
    left = meet(rows.where("_left").withColumn("_k", F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1))), "_l", "_r")
    left = left.withColumn("_lb", own("_lefts")).withColumn("_rb", each("_rights"))
    right = meet(rows, "_r", "_l").withColumn("_rb", own("_rights")).withColumn("_lb", each("_lefts"))
    key = ["_cell", "_k", "_lb", "_rb"]
    by = lambda d: d.select(*[F.col(c).alias(c) for c in (*key, "_id", "_comp", "_set")]).groupBy(*key)
    return stored(by(left).cogroup(by(right)).applyInPandas(_cell_block, "_a long, _b long").distinct(), "near-cell-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row: ``id_col, n_shingles, component_id, kept, n_links``.

    1. Sketch every whole text; texts with equal sets become one node.
    2. Bucket the nodes by band (and sets of up to TINY shingles, where bands
       are least certain, by each shingle); in each bucket test every node
       against the one of the smallest id: sketch estimate, then full sets.
    3. Nodes joined by buckets form cells. In a cell of several components,
       documents outside the largest are compared on full sets with those of
       the cell whose size allows a link, in blocks that list links only. Pairs inside one component are
       never listed, so a large group of copies costs one test a member, and
       no link between components is lost.

    ``n_links`` counts the links tested and confirmed with the row's node as
    the larger id. Null or word-less texts have no shingles and are alone.
    Rows with a null id are returned alone (component_id null, kept). Rows
    that share an id are one document: a link of one is a link of all. Other
    columns are not looked at; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = stored(
        docs.select(
            F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"),
            F.col(id_col).isNotNull().alias("_has"),
            F.col(text_col).alias("_text"),
        ).mapInPandas(_sketch_rows, "_id long, _has boolean, _n long, _h1 long, _h2 long, _regs binary, _tiny binary"),
        "near-sketches",
    )
    whole = rows.where("_n > 0 and _has")
    salted = whole.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    same = stored(
        salted_groups(salted, ["_h1", "_h2"], {"_rep": ("min", "_id"), "_largest": ("max", "_id")}, "_salt",
                      F.col("_rep") < F.col("_largest")).drop("_largest"),
        "near-same",
    )
    named = stored(
        salted.select("_id", "_h1", "_h2", "_salt").join(same, ["_h1", "_h2", "_salt"]).select("_id", "_rep").distinct(),
        "near-named",
    )
    copies = named.where("_id <> _rep").select("_id").distinct()
    nodes = stored(whole.join(copies, "_id", "left_anti").select("_id", "_n", "_regs", "_tiny"), "near-nodes")

    bands = stored(nodes.select("_id", "_regs", "_tiny").mapInPandas(_band_rows, "_key long, _id long"), "near-bands")
    pivots = stored(
        bands.groupBy("_key")
        .agg(F.min("_id").alias("_pivot"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_rows"))
        .where("_pivot < _last")
        .drop("_last"),
        "near-pivots",
    )
    buckets = stored(spread_join(bands, pivots, ["_key"], "_rows", ["_id"]).drop("_part"), "near-buckets")
    discard(bands, pivots)
    wanted = stored(buckets.select("_id").distinct(), "near-wanted")
    sets = stored(
        docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
        .join(wanted, "_id", "left_semi")
        .mapInPandas(_set_rows, "_id long, _set binary"),
        "near-sets",
    )

    first = stored(buckets.select(F.col("_pivot").alias("_a"), F.col("_id").alias("_b")).where("_a < _b").distinct(), "near-first")
    links = verified_links(first, nodes, sets)
    comp = components(links)
    cells = stored(components(first).withColumnRenamed("_comp", "_cell"), "near-cells")
    more = _links_in_cells(cells, comp, nodes, sets)
    links = links.unionByName(more)
    if not more.isEmpty():
        # components that a late link joins: their roots are the nodes of a smaller graph
        of = lambda c: comp.select(F.col("_id").alias(c), F.col("_comp").alias(f"{c}c"))
        ends = more.join(of("_a"), "_a", "left").join(of("_b"), "_b", "left")
        roots = components(ends.select(F.coalesce("_ac", "_a").alias("_a"), F.coalesce("_bc", "_b").alias("_b")))
        known = comp.unionByName(roots.join(comp, "_id", "left_anti").select("_id", F.col("_id").alias("_comp")))
        comp = known.join(roots.select(F.col("_id").alias("_comp"), F.col("_comp").alias("_root")), "_comp", "left").select(
            "_id", F.coalesce("_root", "_comp").alias("_comp")
        )
    degree = links.groupBy(F.col("_b").alias("_id")).agg(F.count(F.lit(1)).alias("_links"))
    facts = stored(comp.join(degree, "_id", "left"), "near-facts")
    # a copy has the component of the node that stands for it
    ofcopy = named.where("_id <> _rep").join(facts.withColumnRenamed("_id", "_rep"), "_rep", "left")
    ofcopy = ofcopy.select("_id", F.coalesce("_comp", "_rep").alias("_comp"), F.lit(1).cast("long").alias("_links"))
    facts = stored(facts.unionByName(ofcopy), "near-facts")
    discard(nodes, buckets, wanted, sets, first)
    found = rows.where("_has").select("_id", "_n").join(facts, "_id", "left").select(
        F.col("_id").alias(id_col),
        F.col("_n").alias("n_shingles"),
        F.coalesce("_comp", "_id").alias("component_id"),
        F.coalesce(F.col("_comp") == F.col("_id"), F.lit(True)).alias("kept"),
        F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"),
    )
    lone = F.lit(None).cast("long")
    return found.unionByName(
        rows.where("not _has").select(lone.alias(id_col), F.col("_n").alias("n_shingles"), lone.alias("component_id"), F.lit(True).alias("kept"), F.lit(0).cast("long").alias("n_links"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component; columns unchanged."""
    gone = stored(
        near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias("_gone")).distinct(),
        "near-dropped",
    )
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
