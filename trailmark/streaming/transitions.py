"""Transitions over a stream of events (F1 on Structured Streaming).

Each entity keeps one piece of state: its last event (state, order key,
position, previous state). When newer events arrive, the last event's row is
emitted with its next state, exactly the row the batch operator would emit.
The state is one small row per entity, so it scales with entities, not
events; Spark checkpoints it in the query's checkpoint folder, so a lost
executor or a restart resumes without loss or repeats.

Events must arrive in order per entity (an event older than the entity's
last one is counted in ``late`` and not linked). For data with late arrivals,
run the batch operator over the stored events instead.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import types as T

OUT_SCHEMA = T.StructType([
    T.StructField("person_id", T.LongType()),
    T.StructField("pos", T.LongType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("cur", T.StringType()),
    T.StructField("nxt", T.StringType()),
    T.StructField("prev", T.StringType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("yr", T.IntegerType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("matched_label", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("prev", T.StringType()),
    T.StructField("late", T.LongType()),
])
ORDER = ["yr", "start_date", "matched_label"]


def _step(key, batches, state):
    import pandas as pd

    pdf = pd.concat(list(batches), ignore_index=True).sort_values(ORDER, kind="stable")
    last = state.get if state.exists else None
    late = last[6] if last else 0
    out = []
    for row in pdf.itertuples(index=False):
        k = (row.yr, row.start_date, row.matched_label)
        if last is not None and k <= (last[1], last[2], last[3]):
            late += 1
            continue
        if last is not None:
            out.append((key[0], last[4], last[1], last[0], row.state, last[5]))
            last = (row.state, row.yr, row.start_date, row.matched_label, last[4] + 1, last[0], late)
        else:
            last = (row.state, row.yr, row.start_date, row.matched_label, 0, None, late)
    state.update(last[:6] + (late,))
    yield pd.DataFrame(out, columns=[f.name for f in OUT_SCHEMA.fields])


def stream_transitions(events: DataFrame) -> DataFrame:
    """Streaming events (person_id, state, yr, start_date, matched_label) ->
    transition rows (person_id, pos, yr, cur, nxt, prev), append mode."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    ev = events.select("person_id", "state", "yr", "start_date", "matched_label")
    return ev.groupBy("person_id").applyInPandasWithState(
        _step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def checkpoint_location(spark, name: str) -> str:
    """Per-query folder under the cluster's shared checkpoint folder."""
    from trailmark.session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark).rstrip("/"), "streams", name)
