"""Actor clusters over a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def active_windows(trades: DataFrame, days: int, least: int, on: str = "ts", late: str = "2 days") -> DataFrame:
    """ticker, start, end, n_actors, window_value of every sliding window of ``days`` days with ``least`` distinct members.

    Works on a batch or a stream (ticker, member, value, ``on`` timestamp).  On a stream, rows later
    than ``late`` behind the newest are dropped, and a window is emitted once it is complete, so its
    state is bounded by the window and the lateness.
    """
    own = trades.withWatermark(on, late).groupBy(F.window(on, f"{days} days", "1 day").alias("w"), "ticker")
    counted = own.agg(F.size(F.collect_set("member")).alias("n_actors"), F.sum("value").alias("window_value"))
    return counted.where(F.col("n_actors") >= least).select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_actors", "window_value")
