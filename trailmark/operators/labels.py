"""Code-based labels (B6-B13) and report label strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.exprs import code_prefix, combine_text, has_valid_code, major_group


def assign_labels(df: DataFrame, code: str = "matched_code", label: str = "matched_label",
                  desc: str = "matched_description", level: int = 3) -> DataFrame:
    """``combined_text``, ``occupation_group`` (first ``level``
    characters of the code before its first dot, null without a valid code)
    and ``needs_nlp``. A blank code counts as missing."""
    ok = has_valid_code(code)
    return (df.withColumn("combined_text", combine_text(label, desc))
              .withColumn("occupation_group", F.when(ok, code_prefix(code, level)))
              .withColumn("needs_nlp", ~ok))


def hierarchy(df: DataFrame, code: str, prefix: str = "") -> DataFrame:
    """Level-1 and level-2 prefixes of a code."""
    return (df.withColumn(f"{prefix}l1", F.substring(F.col(code), 1, 1))
              .withColumn(f"{prefix}l2", F.substring(F.col(code), 1, 2)))


def with_major_group(df: DataFrame, code: str, out: str = "major_group") -> DataFrame:
    """B10."""
    return df.withColumn(out, major_group(code))


def with_names(df: DataFrame, names: DataFrame, code: str, out: str = "name",
               default: str = "Unknown") -> DataFrame:
    """Code -> display name through a (code, name) dimension, with a
    fallback. The dimension has one row per code; AQE broadcasts it when its
    measured size allows and falls back to a shuffle join otherwise."""
    n = names.select(F.col(names.columns[0]).alias("_code"), F.col(names.columns[1]).alias("_name"))
    return (df.join(n, F.col(code) == F.col("_code"), "left")
              .withColumn(out, F.coalesce(F.col("_name"), F.lit(default)))
              .drop("_code", "_name"))


def label_check(df: DataFrame, state: str = "state", code: str = "matched_code", width: int = 3) -> DataFrame:
    """Rows with a valid code whose final state differs from the group
    derived again from the code itself, whatever steps the state came through."""
    coded = df.filter(has_valid_code(code))
    return coded.agg(F.count(F.lit(1)).alias("coded_rows"),
                     F.count_if(~F.col(state).eqNullSafe(code_prefix(code, width))).alias("mismatches"))


def pair_label(a, b, width: int = 25, sep: str = " -> "):
    """Truncated 'from -> to' label."""
    return F.concat(F.substring(F.col(a), 1, width), F.lit(sep), F.substring(F.col(b), 1, width))


def merge_fallback(events: DataFrame, scored: DataFrame, key: Sequence[str], threshold: float,
                   predicted: str = "predicted", confidence: str = "confidence") -> DataFrame:
    """I6 + D1: coded events keep their code group as ``state``; events without a
    code get the predicted group where its confidence reaches ``threshold``;
    the others drop. ``scored`` has (key..., predicted, confidence) of uncoded
    events. ``label_source`` says which."""
    coded = events.filter(~F.col("needs_nlp")).withColumn("state", F.col("occupation_group")) \
                  .withColumn("label_source", F.lit("code"))
    gate = scored.filter(F.col(confidence) >= F.lit(threshold)).select(*key, F.col(predicted).alias("state"))
    model = events.filter("needs_nlp").join(gate, list(key)).withColumn("label_source", F.lit("model"))
    return coded.unionByName(model)


def label_drops(events: DataFrame, scored: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """A10, label step: coded rows, uncoded rows, those accepted and those
    dropped below the threshold."""
    n = events.agg(F.count_if(~F.col("needs_nlp")).alias("coded_rows"), F.count_if("needs_nlp").alias("uncoded_rows"))
    ok = scored.agg(F.count_if(F.col(confidence) >= F.lit(threshold)).alias("accepted")).scalar()
    return n.select("coded_rows", "uncoded_rows", ok.alias("accepted_rows"),
                    (F.col("uncoded_rows") - ok).alias("dropped_low_confidence"))
