"""Rule labelling (B14-B18): ordered regex rules, first match wins.

Rules are data: a list of (label, pattern) or (label, [pattern, ...]) where a
list means all patterns must match (a compound rule). A rule set of any length
becomes one ``CASE WHEN rlike ...`` chain (literal patterns, stops at the first
match, no UDF).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LABEL = "Other & Unclassified"


def _cond(text: Column, pattern) -> Column:
    if isinstance(pattern, (list, tuple)):
        c = F.lit(True)
        for p in pattern:
            c = c & text.rlike(p)
        return c
    return text.rlike(pattern)


def first_match(text: Column, rules: Sequence[tuple], default: str | None = DEFAULT_LABEL) -> Column:
    """Label of the first rule whose pattern(s) match ``text``."""
    out = None
    for lbl, p in rules:
        out = (F.when(_cond(text, p), F.lit(lbl)) if out is None else out.when(_cond(text, p), F.lit(lbl)))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def cascade(df: DataFrame, title: Column, desc: Column, rules: Sequence[tuple],
            broad: Sequence[tuple], out: str = "label", pass_col: str = "pass") -> DataFrame:
    """Rules on the title, then on the description for rows still
    unmatched, then the broad rules on title and description; rows no pass
    labels drop. ``pass`` tells which pass matched (the rescue counts)."""
    passes = [first_match(title, rules, None), first_match(desc, rules, None),
              first_match(title, broad, None), first_match(desc, broad, None)]
    # each pass is a column of its own, so the label and the pass number share it
    names = [f"_pass{k}" for k in range(1, 5)]
    x = df.withColumns(dict(zip(names, passes)))
    which = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in enumerate(names, 1)])
    return x.withColumn(out, F.coalesce(*names)).withColumn(pass_col, which) \
            .filter(F.col(out).isNotNull()).drop(*names)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows where two labellings agree (null-safe)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.avg(F.col(a).eqNullSafe(F.col(b)).cast("double")).alias("agreement"))


def top_disagreements(df: DataFrame, a: str, b: str, n: int = 10) -> DataFrame:
    d = df.filter(~F.col(a).eqNullSafe(F.col(b))).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.col("n").desc(), F.col(a), F.col(b)).limit(n)


# Demonstration rule tables for the document fixture (our own;
# boundaries are written as (^|[^a-z]) ... ([^a-z]|$) so Java regex and RE2
# agree on non-ASCII letters).
W = r"(^|[^a-z])({})([^a-z]|$)"
LANG_RULES = [
    ("de", W.format("der|die|und|nicht|ein")),
    ("es", W.format("los|las|esos|del")),
    ("fr", W.format("les|des|une|est|qui")),
    ("en", W.format("the|and|with|is")),
]
CONTENT_RULES = [
    ("licensed", r"licen[cs]e"),
    ("credential", r"token *= *\"|api[_-]?key|password|secret"),
    ("contact", r"[a-z0-9._%+-]+@[a-z0-9-]+\.[a-z]{2,}"),
] + LANG_RULES
BROAD_RULES = [
    ("legal", r"licen|copyright"),
    ("secrets", r"token|passw|key *="),
    ("personal", r"@|phone"),
    ("markup", r"[<>{}]"),
    ("mixed", [W.format("der|die|und"), W.format("the|and")]),
    ("germanic", W.format("der|die|und|the|and")),
    ("romance", W.format("los|las|les|des|qui")),
    ("romance-marked", [W.format("los|les|des"), r"[#$%&]{3}"]),
    ("numeric", r"[0-9]{4}"),
]
