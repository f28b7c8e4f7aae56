"""Polling windows over a stream of snapshots: state per run, and a timer that closes a run whose next snapshot does not come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loadlens.operators.windows import MOST_GAP, MOST_OBSERVATIONS, MOST_SAMPLES

#: Seconds by which event time is ahead of the snapshots' clock: a clock that starts at zero would else be late at once.
AHEAD = 86_400
_STATE = "first_seq long, last_seq long, first_at double, last_at double, snapshots long, samples long, bad boolean, closed boolean"
_OUT = "before_seq long, after_seq long, observations long, recognized_samples long, elapsed double, code string, closed boolean"


def stream_polling_windows(snapshots: DataFrame, key: str, at: str, ended: str, most_observations: int = MOST_OBSERVATIONS, most_samples: int = MOST_SAMPLES, most_gap: float = MOST_GAP, late: str = "0 seconds") -> DataFrame:
    """The window of each run as it stands after each batch (update mode): the columns of ``windows.polling_windows`` and whether the run is over.

    ``snapshots``: a stream with ``key``, seq, recognized_samples, ``at`` (seconds) and ``ended`` (whether the run's last). A run's state is eight numbers,
    whatever its length. Snapshots of a run come in order of seq from batch to batch; in a batch they may be in any order. When event time passes a run's last
    snapshot by more than ``most_gap`` (and ``late``) and it has not ended, a timer closes it with the code of a gap. What comes for a run that is over is left out.
    """
    kind = dict(snapshots.dtypes)[key]

    def window(state: tuple) -> dict:
        first_seq, last_seq, first_at, last_at, n, samples, bad, closed = state
        code = (
            "experimental_metrics_window_invalid" if n < 2 else "experimental_metrics_sample_gap_exceeded" if bad else "experimental_metrics_observation_limit" if n - 2 > most_observations
            else "experimental_metrics_window_too_large" if samples > most_samples else None
        )
        return {"before_seq": first_seq, "after_seq": last_seq, "observations": max(n - 2, 0), "recognized_samples": samples, "elapsed": last_at - first_at, "code": code, "closed": closed}

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            first_seq, last_seq, first_at, last_at, n, samples, _, _ = state.get
            state.remove()
            found = window((first_seq, last_seq, first_at, last_at, n, samples, True, True))
            yield pd.DataFrame([{key: group[0], **found, "code": "experimental_metrics_sample_gap_exceeded"}])
            return
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        now = state.get if state.exists else None
        if now is not None and now[7]:
            return
        for seq, when, samples, over in zip(rows["seq"], rows["_at"], rows["_samples"], rows["_ended"], strict=True):
            if now is None:
                now = (int(seq), int(seq), float(when), float(when), 1, int(samples), False, bool(over))
            else:
                gap = float(when) - now[3]
                now = (now[0], int(seq), now[2], float(when), now[4] + 1, now[5] + int(samples), now[6] or not 0.0 <= gap <= most_gap, bool(over))
            if now[7]:
                break
        state.update(now)
        if not now[7]:
            state.setTimeoutTimestamp(max(int((now[3] + most_gap + AHEAD) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([{key: group[0], **window(now)}])

    given = snapshots.select(F.col(key), F.col("seq").cast("long").alias("seq"), F.coalesce(F.col(at), F.lit(0.0)).cast("double").alias("_at"), F.coalesce(F.col("recognized_samples"), F.lit(0)).cast("long").alias("_samples"), F.coalesce(F.col(ended), F.lit(False)).alias("_ended"))
    timed = given.withColumn("_time", F.timestamp_micros(((F.col("_at") + AHEAD) * 1e6).cast("long"))).withWatermark("_time", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, {_OUT}", _STATE, "update", GroupStateTimeout.EventTimeTimeout)
