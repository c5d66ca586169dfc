"""Anchors on a stream: their texts, and keyed state that counts how often one was shown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import SETTINGS
from ..operators.anchors import anchor_texts

OUT = "session_id string, seq bigint, anchor_seq bigint, round bigint"
STATE = "anchor_seq bigint, shown bigint"


def anchor_stream(log: DataFrame, rounds: int = SETTINGS.anchor_rounds) -> DataFrame:
    """Assemblies that show an anchor, from a stream of (session_id, seq, kind).

    Within a micro-batch a session's rows are taken in order of seq. State is one row
    per session with an active anchor; it ends with ``disposed`` or the last round.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor, shown = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, kind in zip(rows["seq"], rows["kind"]):
            if kind == "summary":
                anchor, shown = int(seq), 0
            elif kind == "disposed":
                anchor = None
            elif kind == "assembly" and anchor is not None and shown < rounds:
                shown += 1
                out.append((key[0], int(seq), anchor, shown))
        if anchor is None or shown >= rounds:
            if state.exists:
                state.remove()
        else:
            state.update((anchor, shown))
        yield pd.DataFrame(out, columns=["session_id", "seq", "anchor_seq", "round"])

    return log.groupBy("session_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


TEXTS = "session_id string, at bigint, text string, batch bigint"


def start_anchor_texts(summaries: DataFrame, events: Callable[[], DataFrame], folder: str, checkpoint: str):
    """Write the anchor of each summary of a stream (session_id, at, low, high, summary) to Parquet below ``folder``.

    A summary says which events it stands for, and these are in the log already when it
    comes. So a batch of summaries meets the log as it is then (``events`` gives it), and no
    state is kept: neither idle nor disposed sessions leave any. A batch that comes again
    overwrites its own partition.
    """

    def write(batch: DataFrame, number: int) -> None:
        made = anchor_texts(batch, events()).withColumn("batch", F.lit(number).cast("bigint"))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return summaries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
