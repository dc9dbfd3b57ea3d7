"""Track summaries over a stream of observations.

Observations carry event time; late ones within the watermark are counted, later ones dropped.  ``windowed`` merges the
observations of a track in event-time windows by inverse variance; ``latest`` keeps the state of each track between batches
(last time, position, velocity from the last two observations) and drops duplicates and observations out of order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.statistics import sum_normals


def windowed(stream: DataFrame, width: str, lateness: str, key: str = "track", time: str = "ts") -> DataFrame:
    """Mean and sigma of x (with sigma s) for each track and window."""
    mean, sigma = sum_normals(F.col("x"), F.col("s"), 1.0 / (F.col("s") * F.col("s")))
    held = stream.withWatermark(time, lateness)
    return held.groupBy(F.window(time, width), key).agg(mean.alias("mean"), sigma.alias("sigma"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "mean", "sigma", "n")


STATE = "t double, x double"
OUT = "track long, t double, x double, v double"


def latest(stream: DataFrame) -> DataFrame:
    """Velocity of each track at every new observation (track, t in seconds, x), with state across batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t").drop_duplicates("t")
        out = []
        for t, x in zip(rows["t"], rows["x"]):
            if last is not None and t <= last[0]:
                continue
            out.append((key[0], t, x, None if last is None else (x - last[1]) / (t - last[0])))
            last = (t, x)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["track", "t", "x", "v"])

    return stream.groupBy("track").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")
