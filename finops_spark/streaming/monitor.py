"""The feed monitor and batch scoring on streams.

Row-count windows do not exist on streams, so the monitor keeps the last
``window - 1`` values of each asset as state. Rows wait until the watermark has
passed them, so those that come out of order find their place; a timer wakes an
asset whose waiting rows are due, and ends the state of one that has been silent.
Scoring is stateless: the saved pipeline transforms a stream as it transforms a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from finops_spark.functions.scalar import require
from finops_spark.operators.models import ScoringBundle, score_batch

_OUTPUT = "asset string, us bigint, rolling_stdev double"
_STATE = "recent array<double>, last_us bigint, waiting_us array<bigint>, waiting array<double>"
#: Rows of one asset that may wait for the watermark at a time; more stop the query.
MOST_WAITING = 1_000_000
_DAY_MS = 86_400_000


def _monitor(window: int, threshold: float, expire_ms: int, most_waiting: int):
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, last, us, prices = state.get if state.exists else ([], None, [], [])
        # One asset's rows of one trigger; their number is set by the trigger size.
        new = [] if state.hasTimedOut else list(frames)
        us = np.concatenate([np.asarray(us, np.int64), *(f["us"].to_numpy(np.int64) for f in new)])
        prices = np.concatenate([np.asarray(prices, float), *(f["price"].to_numpy(float) for f in new)])
        order = np.argsort(us, kind="stable")
        us, prices = us[order], prices[order]
        passed_ms = state.getCurrentWatermarkMs()
        due = int(np.searchsorted(us, passed_ms * 1_000, side="left"))
        if len(us) - due > most_waiting:
            raise ValueError(f"asset {key[0]}: {len(us) - due} rows wait for the watermark; allow less lateness")
        values = np.concatenate([np.asarray(recent, float), prices[:due]])
        if due and len(values) >= window:
            deviation = np.lib.stride_tricks.sliding_window_view(values, window).std(axis=1)
            at = us[:due][due - min(due, len(deviation)) :]
            flat = deviation[-len(at) :] < threshold
            yield pd.DataFrame({"asset": key[0], "us": at[flat], "rolling_stdev": deviation[-len(at) :][flat]})
        last = int(us[due - 1]) if due else last
        ends_ms = (last or 0) // 1_000 + expire_ms
        if due == len(us) and passed_ms >= ends_ms:
            state.remove()
            return
        state.update(([float(v) for v in values[-(window - 1) :]] if window > 1 else [], last, us[due:].tolist(), prices[due:].tolist()))
        # wakes for the first waiting row, or for the end of a silent asset
        wake_ms = int(us[due]) // 1_000 + 1 if due < len(us) else ends_ms
        state.setTimeoutTimestamp(max(wake_ms, passed_ms + 1))

    return update


def flag_flat_stream(
    prices: DataFrame,
    window: int = 5,
    threshold: float = 0.01,
    lateness: str = "1 hour",
    expire_days: float = 30.0,
    most_waiting: int = MOST_WAITING,
) -> DataFrame:
    """Flags of a stream of (asset string, ts timestamp, price double).

    Rows may come out of order by up to ``lateness``: they are used in time order once
    the watermark has passed them, so flags come that much later; a row that is later still
    is left out by the watermark. An asset without a row for ``expire_days`` of event time
    loses its state and starts anew with its next row. Rows with one time keep the order in
    which they came.
    """
    require(prices, ["asset", "ts", "price"], "price stream")
    ts = F.col("ts").cast("timestamp")
    rows = prices.select(F.col("asset").cast("string").alias("asset"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("price").cast("double").alias("price"))
    flags = rows.withWatermark("ts", lateness).groupBy("asset").applyInPandasWithState(
        _monitor(window, threshold, int(expire_days * _DAY_MS), most_waiting), _OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return flags.select("asset", F.timestamp_micros("us").alias("ts"), "rolling_stdev")


def score_stream(transactions: DataFrame, bundle: ScoringBundle) -> DataFrame:
    return score_batch(transactions, bundle)
