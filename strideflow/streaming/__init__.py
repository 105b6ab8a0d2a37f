"""Recordings as they arrive, and live counters.

A file is the unit of arrival: decoding needs nothing from other files, so a directory is
read as a stream without state. Live feeds of single records keep a counter's last value
by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.recording import decoded, segments


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The field table of the files that arrive under ``path``."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return decoded(segments(files.select("path", "content")))


def on_messages(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that calls back with each batch of messages, before any filter."""
    return stream.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_totals(records: DataFrame, bits: int) -> DataFrame:
    """key, seq, total: running totals of wrapping counters in a live feed (key string, seq long, value long).

    Rows of a key within one batch are taken in order of seq; the last value and total are
    state. A key's state is two numbers.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, total = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        totals = []
        for v in rows["value"]:
            total += v if last is None else (v - last) % (1 << bits)
            last = v
            totals.append(total)
        state.update((int(last), int(total)))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "total": totals})

    return records.groupBy("key").applyInPandasWithState(step, "key string, seq long, total long", "last long, total long", "append", GroupStateTimeout.NoTimeout)
