"""Streams (an extension of the model: its recordings are whole buffers).

Hopping envelopes and sessions of events with watermarks, and note intervals
tracked with keyed state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def envelope(events: DataFrame, block: str = "10 minutes", hop: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Greatest and mean value of hopping windows by channel; rows later than the watermark are left out."""
    w = F.window("ts", block, hop)
    return events.withWatermark("ts", late).groupBy(w, F.col("user_id").alias("channel")).agg(F.max("value").alias("peak"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "channel", "peak", "mean", "n")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by channel that end after a gap."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w, F.col("user_id").alias("channel")).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "channel", "n")


STATE = "start long, last long, n long"
ISLAND = "channel int, note int, start_frame long, frames long"


def note_islands(frames: DataFrame, gap: int = 1, silence: str = "1 second") -> DataFrame:
    """[W10] Runs of consecutive frames by (channel, note) of a stream (channel, note, frame).

    A run is given out when a later frame closes it, or when its key has had no
    frame for `silence` of processing time, which gives out the last one too.
    Frames of a key must come in order within a batch and across batches.
    """
    import re

    number, unit = re.fullmatch(r"(\d+) (second|minute|hour)s?", silence).groups()
    patience = int(number) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000}[unit]

    def track(key, batches, state):
        channel, note = key
        start, last, n = state.get if state.exists else (None, None, 0)
        closed = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(channel, note, start, n)] if n else [], columns=["channel", "note", "start_frame", "frames"])
            return
        for pdf in batches:
            for frame in sorted(pdf["frame"].tolist()):
                if last is not None and frame <= last:
                    continue
                if last is not None and frame > last + gap:
                    closed.append((channel, note, start, n))
                    start, n = None, 0
                start, last, n = (frame if start is None else start), frame, n + 1
        state.update((start, last, n))
        state.setTimeoutDuration(patience)
        yield pd.DataFrame(closed, columns=["channel", "note", "start_frame", "frames"])

    return frames.groupBy("channel", "note").applyInPandasWithState(track, ISLAND, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
