"""Cleaning and labels (B1-B8, A10) on hand-made rows."""

from pyspark.sql import functions as F

from trailmark.functions import exprs
from trailmark.operators import clean, labels

COLS = "person_id long, matched_label string, matched_description string, matched_code string, " \
       "start_date string, university_studies boolean, src int"


def test_label_filter_keeps_padded_unknown(spark):
    rows = [(1, None, None, "1.1", "2001", None, 1), (1, "  ", None, "1.1", "2001", None, 2),
            (1, "UNKNOWN", None, "1.1", "2001", None, 3), (1, " unknown ", None, "1.1", "2001", None, 4),
            (1, "Nurse", None, "1.1", "2001", None, 5)]
    out = clean.clean_labels(spark.createDataFrame(rows, COLS))
    assert sorted(r.matched_label for r in out.collect()) == [" unknown ", "Nurse"]


def test_year_is_first_four_digit_run(spark):
    df = spark.createDataFrame([("2019-03-01",), ("n/a",), ("12 May 1987",), ("123",)], "d string")
    got = [r.y for r in df.select(exprs.year_from_text("d").alias("y")).collect()]
    assert got == [2019, None, 1987, None]


def test_year_range_drops_null_and_outside(spark):
    df = spark.createDataFrame([(1949,), (1950,), (2024,), (2025,), (None,)], "yr int")
    assert sorted(r.yr for r in clean.year_range(df).collect()) == [1950, 2024]


def test_dedup_keeps_first_in_order_and_nulls_equal(spark):
    rows = [(1, "A", "x", "1.1", None, None, 2), (1, "A", "y", "1.1", None, None, 1),
            (1, "A", "z", "1.1", "2001", None, 3)]
    out = clean.dedup_events(spark.createDataFrame(rows, COLS), order=["src"])
    got = sorted((r.start_date or "", r.matched_description) for r in out.collect())
    assert got == [("", "y"), ("2001", "z")]


def test_code_group_and_needs_nlp(spark):
    rows = [(1, "A", None, "3343.1", "2001", None, 1), (1, "B", "nan", "", "2001", None, 2),
            (1, "C", "desc", "Unknown", "2001", None, 3), (1, "D", None, None, "2001", None, 4),
            (1, "E", "  ", "7", "2001", None, 5)]
    out = labels.assign_labels(spark.createDataFrame(rows, COLS)).orderBy("src").collect()
    assert [r.occupation_group for r in out] == ["334", None, None, None, "7"]
    assert [r.needs_nlp for r in out] == [False, True, True, True, False]
    assert out[0].combined_text == "A [SEP]"
    assert out[1].combined_text == "B [SEP]"
    assert out[2].combined_text == "C [SEP] desc"


def test_major_group_fallback(spark):
    df = spark.createDataFrame([("2",), ("x",), (None,)], "c string")
    got = [r.m for r in df.select(exprs.major_group(F.col("c")).alias("m")).collect()]
    assert got[1] == "Other" and got[2] == "Other" and got[0] != "Other"


def test_clean_report_counts_each_step(spark):
    rows = [(1, "A", None, "1.1", "2001", None, 1), (1, "A", None, "1.1", "2001", None, 2),
            (1, None, None, "1.1", "2001", None, 3), (2, "B", None, "1.1", "n/a", None, 4),
            (2, "C", None, "1.1", "1900", None, 5)]
    df = spark.createDataFrame(rows, COLS)
    r = clean.clean_report(df).first()
    assert (r.rows_in, r.dropped_label, r.dropped_duplicate, r.dropped_year, r.rows_kept) == (5, 1, 1, 2, 1)
    assert clean.clean_events(df, order=["src"]).count() == r.rows_kept
