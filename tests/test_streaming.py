"""Streaming transitions equal the batch transitions over the same events."""

import os

from trailmark.operators import transitions
from trailmark.streaming import transitions as st

SCHEMA = "person_id long, state string, yr int, start_date string, matched_label string"


def test_stream_matches_batch(spark, scratch):
    src = os.path.join(scratch, "in")
    out = os.path.join(scratch, "out")
    b1 = [(1, "a", 2001, "2001", "x"), (1, "b", 2002, "2002", "y"), (2, "a", 2000, "2000", "z")]
    b2 = [(1, "c", 2003, "2003", "w"), (2, "b", 2004, "2004", "v"), (2, "a", 2005, "2005", "u"),
          (3, "q", 2001, "2001", "t")]
    spark.createDataFrame(b1, SCHEMA).write.parquet(os.path.join(src, "b1"))
    ck = os.path.join(scratch, "ck")

    def run():
        ev = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        q = (st.stream_transitions(ev).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
    run()
    spark.createDataFrame(b2, SCHEMA).write.parquet(os.path.join(src, "b2"))
    run()                                                     # restart from the checkpoint
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("person_id", "pos", "cur", "nxt", "prev").collect())
    batch = transitions.build_transitions(spark.createDataFrame(b1 + b2, SCHEMA))
    want = sorted(tuple(r) for r in batch.select("person_id", "pos", "cur", "nxt", "prev").collect())
    assert got == want


def test_late_event_is_not_linked(spark, scratch):
    src = os.path.join(scratch, "in")
    out = os.path.join(scratch, "out")
    ck = os.path.join(scratch, "ck")
    spark.createDataFrame([(1, "a", 2001, "2001", "x"), (1, "b", 2005, "2005", "y")], SCHEMA) \
        .write.parquet(os.path.join(src, "b1"))

    def run():
        ev = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(src)
        q = (st.stream_transitions(ev).writeStream.format("parquet").option("path", out)
               .option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination(120)
    run()
    # 2003 arrives after 2005 was seen: counted as late, no transition emitted for it
    spark.createDataFrame([(1, "c", 2003, "2003", "z"), (1, "d", 2007, "2007", "w")], SCHEMA) \
        .write.parquet(os.path.join(src, "b2"))
    run()
    got = sorted((r.pos, r.cur, r.nxt) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", "b"), (1, "b", "d")]
