"""Sequence alignment of pairs, and mappings of atoms onto chains and alignments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.models import assignment
from strandlake.session import workers_find_package


def align(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, gap_open: float = -1.0, gap_extend: float = -0.1, local: bool = False) -> tuple[str, str, float]:
    """Best alignment of two sequences with affine gaps: both texts with gaps, and the score.

    Ties go to aligning letters, then to a gap in ``b``. Local alignments
    return the aligned stretch alone.
    """
    n, m = len(a), len(b)
    low = -1e30
    best = np.full((3, n + 1, m + 1), low)  # ends in: letters, gap in b, gap in a
    back = np.zeros((3, n + 1, m + 1), np.int8)
    best[0, 0, 0] = 0.0
    if local:
        best[0, :, 0] = best[0, 0, :] = 0.0
        back[0, :, 0] = back[0, 0, :] = 3
    else:
        best[1, 1:, 0] = gap_open + gap_extend * np.arange(n)
        best[2, 0, 1:] = gap_open + gap_extend * np.arange(m)
        back[1, 2:, 0] = 1
        back[2, 0, 2:] = 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score = match if a[i - 1] == b[j - 1] else mismatch
            k = int(best[:, i - 1, j - 1].argmax())
            best[0, i, j], back[0, i, j] = best[k, i - 1, j - 1] + score, k
            if local and best[0, i, j] <= 0:
                best[0, i, j], back[0, i, j] = 0.0, 3
            for s, (p, q) in ((1, (i - 1, j)), (2, (i, j - 1))):
                cost = best[:, p, q] + gap_open
                cost[s] = best[s, p, q] + gap_extend
                k = int(cost.argmax())
                best[s, i, j], back[s, i, j] = cost[k], k
    i, j = (np.unravel_index(best[0].argmax(), best[0].shape)) if local else (n, m)
    s = 0 if local else int(best[:, n, m].argmax())
    score, x, y = float(best[s, i, j]), [], []
    while i or j:
        k = int(back[s, i, j])
        if local and s == 0 and k == 3:
            break
        if s == 0:
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
        elif s == 1:
            i -= 1
            x.append(a[i])
            y.append("-")
        else:
            j -= 1
            x.append("-")
            y.append(b[j])
        s = k
    return "".join(reversed(x)), "".join(reversed(y)), score


def aligned_pairs(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", local: bool = False) -> DataFrame:
    """Rows with ``aligned_a``, ``aligned_b``, ``score`` and ``identity`` (equal letters over the shorter sequence, in percent)."""
    workers_find_package(pairs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [align(x, y, local=local) for x, y in zip(pdf[a], pdf[b])]
            same = [100.0 * sum(p == q != "-" for p, q in zip(x, y)) / max(1, min(len(u), len(v))) for (x, y, _), u, v in zip(out, pdf[a], pdf[b])]
            yield pdf.assign(aligned_a=[o[0] for o in out], aligned_b=[o[1] for o in out], score=[o[2] for o in out], identity=same)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).mapInPandas(run, f"{kinds}, aligned_a string, aligned_b string, score double, identity double")


def index_map(pairs: DataFrame, key: Sequence[str], a: str = "aligned_a", b: str = "aligned_b") -> DataFrame:
    """(key, ``index_a``, ``index_b``) of aligned letters, both counted from 0 without gaps."""
    x, y = F.split(a, ""), F.split(b, "")
    cells = F.transform(F.arrays_zip(x.alias("p"), y.alias("q")), lambda s: s)
    seen = lambda s, k, n: F.size(F.filter(F.slice(s, 1, k + 1), lambda c: (c != "-") & (c != ""))) - n
    each = pairs.select(*key, x.alias("_x"), y.alias("_y"), F.posexplode(cells).alias("_k", "_c")).where("_c.p not in ('-', '') and _c.q not in ('-', '')")
    return each.select(*key, seen(F.col("_x"), F.col("_k"), 1).alias("index_a"), seen(F.col("_y"), F.col("_k"), 1).alias("index_b"))


def star_alignment(sequences: DataFrame, key: str = "label", seq: str = "seq") -> DataFrame:
    """Alignment rows (``label``, ``seq``): every sequence aligned to the longest one, whose columns are kept.

    Letters that would open a column of their own are left out; each pair is
    aligned by itself, so rows are aligned in parallel.
    """
    centre = sequences.orderBy(F.desc(F.length(seq)), key).limit(1).select(F.col(seq).alias("seq_a"))
    pairs = aligned_pairs(sequences.select(F.col(key).alias("label"), F.col(seq).alias("seq_b")).crossJoin(F.broadcast(centre)))
    cells = F.arrays_zip(F.split("aligned_a", "").alias("p"), F.split("aligned_b", "").alias("q"))
    kept = F.transform(F.filter(cells, lambda s: (s["p"] != "-") & (s["p"] != "")), lambda s: s["q"])
    return pairs.select("label", F.array_join(kept, "").alias("seq"))


def mapped_atoms(atoms: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """Target atoms in order with the atom of equal name in the mapped residue: (``position``, ``atom_index``), null where there is none.

    ``atoms`` and ``target`` have (residue, name, atom_index); ``mapping`` has
    (index_a: residue of atoms, index_b: residue of target).
    """
    other = atoms.select(F.col("residue").alias("index_a"), "name", "atom_index")
    want = target.select(F.col("atom_index").alias("position"), F.col("residue").alias("index_b"), "name")
    return want.join(mapping, "index_b", "left").join(other, ["index_a", "name"], "left").select("position", "atom_index")


def combined_maps(maps: DataFrame, impossible: float = 1e6) -> DataFrame:
    """One chain for each target chain by least total cost of 1 - coverage: (``target``, ``chain``); pairs without a mapping are left out.

    ``maps`` has (``target``, ``chain``, ``coverage`` in percent).
    """
    workers_find_package(maps.sparkSession)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t, c = sorted(pdf["target"].unique()), sorted(pdf["chain"].unique())
        cost = np.full((len(t), len(c)), impossible)
        for r in pdf.itertuples():
            cost[t.index(r.target), c.index(r.chain)] = 1 - r.coverage / 100
        return pd.DataFrame([(t[i], c[j]) for i, j in assignment(cost) if cost[i, j] < impossible], columns=["target", "chain"])

    return maps.groupBy(F.lit("all")).applyInPandas(lambda pdf: solve(pdf), "target string, chain string")
