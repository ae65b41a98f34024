"""The same operators on streams: tumbling bins with watermarks, and turn tracking that keeps the last speaker as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_bins(events: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Mean, count and extremes of each key's tumbling bins; events later than the watermark are dropped with their state."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return w.agg(F.avg(value).alias("value"), F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "value", "n", "min", "max")


def live_turns(turns: DataFrame, conversation: str, speaker: str, order: str) -> DataFrame:
    """conversation, turns, changes after each batch; state is the last speaker and two counts a conversation."""
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema}

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, changes = state.get if state.exists else (None, 0, 0)
        for pdf in batches:
            for s in pdf.sort_values(order)[speaker]:
                changes += int(last is not None and s != last)
                last, n = s, n + 1
        state.update((last, n, changes))
        yield pd.DataFrame({conversation: [key[0]], "turns": [n], "changes": [changes]})

    return turns.groupBy(conversation).applyInPandasWithState(update, f"{conversation} {kinds[conversation]}, turns long, changes long", "last string, n long, changes long", "update", GroupStateTimeout.NoTimeout)
