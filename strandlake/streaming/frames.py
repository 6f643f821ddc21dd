"""Frame statistics that read batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_statistics(frames: DataFrame, at: str, width: str, keys: Sequence[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count, mean and extremes in tumbling (or sliding) windows; ``late`` is the watermark of a stream."""
    if late is not None:
        frames = frames.withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = frames.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "min", "max")


def sessions(frames: DataFrame, at: str, gap: str, keys: Sequence[str], value: str, late: str | None = None) -> DataFrame:
    """Runs of frames with less than ``gap`` between them."""
    if late is not None:
        frames = frames.withWatermark(at, late)
    out = frames.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def with_atoms(frames: DataFrame, atoms: DataFrame, key: str) -> DataFrame:
    """Frame rows joined to a static atom table."""
    return frames.join(atoms, key)


def running_moments(frames: DataFrame, key: str, vector: str) -> DataFrame:
    """A stream's running count, mean and population covariance of fixed-length vectors, per key.

    State per key: n, the mean and the products about it, so it grows with the
    vector's length only; batches are merged about their own means, so that
    values far from zero lose no digits. One row a key and trigger.
    """
    kind = frames.schema[key].dataType.simpleString()

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, held, products = state.get if state.exists else (0, [], [])
        mean, about = np.array(held, float), np.array(products, float)
        for pdf in batches:
            x = np.stack(pdf[vector].to_numpy()).astype(float)
            if not len(mean):
                mean, about = np.zeros(x.shape[1]), np.zeros(x.shape[1] ** 2)
            own = x.mean(axis=0)
            off, total = own - mean, n + len(x)
            about = about + ((x - own).T @ (x - own)).ravel() + np.outer(off, off).ravel() * (n * len(x) / total)
            mean, n = mean + off * (len(x) / total), total
        state.update((n, mean.tolist(), about.tolist()))
        yield pd.DataFrame({key: [name[0]], "n": [n], "mean": [mean.tolist()], "covariance": [(about / n).tolist()]})

    return frames.groupBy(key).applyInPandasWithState(
        step, f"`{key}` {kind}, n long, mean array<double>, covariance array<double>", "n long, mean array<double>, about array<double>", "update", "NoTimeout"
    )


def frames_between(frames: DataFrame, frame: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames start, start + step, ... below stop."""
    out = frames.where((F.col(frame) >= start) & ((F.col(frame) - start) % step == 0))
    return out if stop is None else out.where(F.col(frame) < stop)
