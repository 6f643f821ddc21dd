"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic classifier on surface features gives a document's evidence. Hosts
and paths (below a host) get posterior rates of good documents: a path's
documents are shrunk toward its host's rate and a host's toward the global
rate, with prior weights estimated from the spread between groups. The
document's log-odds then move by those of its path over the global ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import hashed_sample, small_batches, stored

SAMPLE = 20_000  # labelled documents the classifier is fitted on, at most
CLIP = 8.0  # log-odds of one document's evidence, at most
MAX_PRIOR = 1000.0  # documents a prior weighs, at most
THRESHOLD = 0.5

FEATURES = (
    "log_chars", "log_words", "word_chars", "upper", "digit", "symbol", "mark_end", "shout_end", "pipe", "unique",
    "repeat_next", "top_word", "line_words", "repeat_line", "stop", "not_ascii",
)
_MARKS = re.compile(r"[*%$&#]{2,}")
_LETTERS_OFF = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"*%$&#@^~|<>{}[]=_\\"


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; an empty one gives zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n, w = len(raw), max(len(words), 1)
    letters = max(n - len(raw.translate(None, _LETTERS_OFF)), 1)
    lines = text.split("\n")
    counts = Counter(words)
    return [
        np.log1p(n),
        np.log1p(len(words)),
        n / w,
        (n - len(raw.translate(None, _UPPER))) / letters,
        (n - len(raw.translate(None, b"0123456789"))) / n,
        (n - len(raw.translate(None, _SYMBOLS))) / n,
        len(_MARKS.findall(text)) / w,
        text.count("!!") / w,
        text.count("|") / w,
        len(counts) / w,
        sum(map(str.__eq__, words, words[1:])) / w,
        max(counts.values(), default=0) / w,
        np.log1p(w / len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(c for x, c in counts.items() if len(x) <= 3) / w,
        (n - len(text)) / n,
    ]


class Logistic:
    """Ridge logistic regression on standardised features and their squares, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._basis(x)
        self.coef = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))
            slope = z.T @ (y - p) - penalty * self.coef
            curve = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(curve, slope)
            self.coef += move
            if np.abs(move).max() < 1e-6:
                break

    def _basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((len(z), 1)), z, z * z), axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._basis(x) @ self.coef, -CLIP, CLIP)


def _feature_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="_text").assign(_x=[features(t) for t in pdf["_text"]])


def _prior_weight(groups: DataFrame, rate: str, n: str, around: Column) -> float:
    """Beta prior weight by moments: how far group rates spread beyond what their sizes explain."""
    within = around * (1 - around)
    r = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(rate) - around, 2)).alias("spread"),
        F.sum(within).alias("chance"),
        F.sum(F.when(F.col(n) > 1, within * (F.col(n) - 1))).alias("room"),
    ).first()
    if not r["room"] or r["spread"] is None:
        return MAX_PRIOR
    ratio = (r["spread"] - r["chance"]) / r["room"]  # between-group variance over that of one document
    return float(np.clip(1 / ratio - 1, 1.0, MAX_PRIOR)) if ratio > 0 else MAX_PRIOR


def quality(
    docs: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id_col, host, path, doc_score, host_rate, path_rate, quality_score, kept``: one row per row of ``docs``.

    The classifier is fitted on at most ``sample`` labelled documents chosen
    by hash of the id, then label; site rates are sums over all documents. A document's
    own probability is left out of the rates that move it (leave-one-out).
    Only sums per host and path are joined back, so a host with a third of all
    rows costs one row.

    Null or empty text has zero features; null host or path forms a group of
    its own, shown as null; a null id is never labelled; rows repeated under
    one id are scored each, and conflicting labels of an id all count.
    Without labels of both kinds the evidence is 0 and every score 0.5 or
    above is kept. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("_id"),
        F.col(id_col).isNotNull().alias("_has"),
        host.cast("string").alias("host"),
        path.cast("string").alias("path"),
        F.col(text_col).alias("_text"),
    )
    shape = "_id long, _has boolean, host string, path string, _x array<double>"
    rows = stored(rows.mapInPandas(_feature_rows, shape), "quality-features")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("_lid"), F.col(label_col).cast("double").alias("_y")
    )
    labelled = rows.where("_has").join(known, F.col("_id") == F.col("_lid"))
    chosen = hashed_sample(labelled.select("_id", "_y", "_x"), sample, labelled.count()).toPandas()
    model = Logistic(np.stack(chosen["_x"]), chosen["_y"].to_numpy()) if chosen["_y"].nunique() > 1 else None

    @F.pandas_udf("double")
    def evidence(x: pd.Series) -> pd.Series:
        return pd.Series(model.log_odds(np.stack(x.to_numpy())) if model and len(x) else np.zeros(len(x)))

    scored = stored(
        rows.select("_id", "_has", "host", "path", evidence("_x").alias("_e")).withColumn("_p", 1 / (1 + F.exp(-F.col("_e")))),
        "quality-evidence",
    )
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_pn"), F.sum("_p").alias("_ps")), "quality-paths")
    hosts = stored(paths.groupBy("host").agg(F.sum("_pn").alias("_hn"), F.sum("_ps").alias("_hs")), "quality-hosts")
    whole = hosts.agg(F.sum("_hs").alias("s"), F.sum("_hn").alias("n")).first()
    rate = min(max((whole["s"] or 0.0) / max(whole["n"] or 1, 1), 1e-3), 1 - 1e-3)
    hosts = hosts.withColumn("_hr", F.col("_hs") / F.col("_hn"))
    host_weight = _prior_weight(hosts, "_hr", "_hn", F.lit(rate))
    sites = paths.withColumnsRenamed({"host": "_h", "path": "_path"}).join(hosts.withColumnRenamed("host", "_hh"), F.col("_h").eqNullSafe(F.col("_hh")))
    host_rate = (F.col("_hs") + host_weight * rate) / (F.col("_hn") + host_weight)
    sites = stored(
        sites.withColumn("_prior", host_rate).withColumn("_pr", F.col("_ps") / F.col("_pn")).drop("_hh", "_hr"), "quality-sites"
    )
    path_weight = _prior_weight(sites, "_pr", "_pn", F.col("_prior"))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_path")))
    others_host = (F.col("_hs") - F.col("_p") + host_weight * rate) / (F.col("_hn") - 1 + host_weight)
    others_path = (F.col("_ps") - F.col("_p") + path_weight * others_host) / (F.col("_pn") - 1 + path_weight)
    clip = F.least(F.greatest(others_path, F.lit(1e-3)), F.lit(1 - 1e-3))
    odds = F.col("_e") + F.log(clip / (1 - clip)) - float(np.log(rate / (1 - rate)))
    score = 1 / (1 + F.exp(-odds))
    return joined.select(
        F.when(F.col("_has"), F.col("_id")).alias(id_col),
        "host",
        "path",
        F.col("_p").alias("doc_score"),
        others_host.alias("host_rate"),
        others_path.alias("path_rate"),
        score.alias("quality_score"),
        (score >= threshold).alias("kept"),
    )
