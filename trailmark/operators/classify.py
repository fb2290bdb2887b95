"""Text classification as Spark jobs (I1-I8) and classifier metrics.

Splits, class weights, the confidence gate and every metric are plain
DataFrame aggregates. The learned parts use MLlib: features from a
tokenizer and feature hashing (or a text embedding, I1), a multinomial
logistic regression (I4) trained on the coded rows with balanced weights,
and scoring (I5) that keeps the best class and its probability.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.operators.sequence import ordered_sequence

CLASS_CUTS = (0.70, 0.85)
CONFIDENCE = 0.35
EMBED_DIM = 384
#: Characters of training text per task of the learned parts.
CHARS_PER_TASK = 32_000_000
#: Characters and texts encoded at once, and tokens remembered, in a task (memory only).
ENCODED_CHARS, ENCODED_TEXTS, REMEMBERED = 1_000_000, 2_000, 300_000
#: A word as ``tokens`` cuts them.
_WORD = re.compile("[^ \t\n\x0b\f\r]+")


def class_split(df: DataFrame, label: str, key: Sequence[str], seed: int = 42,
                cuts: tuple[float, float] = CLASS_CUTS) -> DataFrame:
    """Stratified row split 70/15/15 by class. Rows of a class are ranked
    by md5(key|seed) (deterministic, no driver-side permutation; ``key`` identifies
    a row); cuts at
    floor(0.70 n) and floor(0.85 n) of that class."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    # narrow rows are ranked (a class holding most rows is split over tasks), then joined back
    narrow = df.select(F.col(label).alias("_y"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], h.alias("_h"))
    keys = [f"_k{i}" for i in range(len(key))]
    ranked = ordered_sequence(narrow, ["_y"], ["_h", *keys], position="_rk")
    sizes = narrow.groupBy(F.col("_y").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    a, b = cuts
    cut = ranked.join(sizes, F.col("_y").eqNullSafe(F.col("_c"))).select(*keys, F.when(
        F.col("_rk") < F.floor(F.col("_n") * a), F.lit("train")).when(
        F.col("_rk") < F.floor(F.col("_n") * b), F.lit("val")).otherwise(F.lit("test")).alias("split"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return df.join(cut, on).drop(*keys)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(label, "n_c", (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                    .alias("weight"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n)."""
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per label precision, recall, F1 and support over the labels
    seen on either side, then the support-weighted average and accuracy
    (accuracy in the f1 column, as a classification report prints it)."""
    # labels x labels rows, computed once: every part below reads the small table
    cm = confusion_matrix(df, actual, predicted).checkpoint()
    tp = cm.filter(F.col(actual) == F.col(predicted)).select(F.col(actual).alias("label"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col(actual).alias("label")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("n_pred"))
    per = (sup.join(pred, "label", "full").join(tp, "label", "left")
              .select("label", F.coalesce("tp", F.lit(0)).alias("tp"),
                      F.coalesce("support", F.lit(0)).alias("support"),
                      F.coalesce("n_pred", F.lit(0)).alias("n_pred")))
    p = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("label", p.alias("precision"), r.alias("recall"), "support", "tp")
    per = per.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                      2 * F.col("precision") * F.col("recall")
                                      / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0)))
    tot = per.agg(F.sum("support").alias("n"), F.sum("tp").alias("hits"),
                  *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)
                    for c in ("precision", "recall", "f1")])
    weighted = tot.select(F.lit("weighted avg").alias("label"), "precision", "recall", "f1",
                          F.col("n").alias("support"))
    acc = tot.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("hits") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    return (per.select("label", "precision", "recall", "f1", F.col("support").cast("bigint").alias("support"))
               .unionByName(weighted.withColumn("support", F.col("support").cast("bigint")))
               .unionByName(acc.withColumn("support", F.col("support").cast("bigint"))))


def confidence_gate(scored: DataFrame, prob: str = "confidence", threshold: float = CONFIDENCE) -> DataFrame:
    """Keep predictions with max probability >= threshold."""
    return scored.filter(F.col(prob) >= F.lit(threshold))


def confidence_hist(scored: DataFrame, prob: str = "confidence", threshold: float = CONFIDENCE,
                    bins: int = 20) -> DataFrame:
    """Equal bins on [0, 1] (1.0 in the last bin) with counts, and the
    kept share at the threshold on every row."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    # one pass over the scores; the shares are those of at most ``bins`` + 1 rows
    h = scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(prob) >= F.lit(threshold)).alias("_k"))
    w = Window.partitionBy()
    return h.select("bin", (F.col("bin") / F.lit(float(bins))).alias("lo"), "n", (F.sum("_k").over(w) / F.sum("n").over(w)).alias("kept_share"))


# ---------------------------------------------------------------- learned parts

@dataclass
class TextClassifier:
    """A fitted text pipeline and its labels in index order."""
    labels: list
    pipeline: object


def tokens(text: str):
    """Words and character trigrams of the lower-cased text, as one array."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.concat(words, F.regexp_extract_all(low, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def _signed_bucket(token: str, dim: int) -> int:
    """2 * bucket, plus 1 where the token counts as +1."""
    h = hashlib.md5(token.encode()).hexdigest()
    return 2 * (int(h[:7], 16) % dim) + (h[7] < "8")


class _Buckets:
    """Signed buckets of words and trigrams; each distinct token is hashed once."""

    def __init__(self, dim: int):
        self.dim = dim
        self.words: dict[str, int] = {}
        self.trigrams: dict[int, int] = {}

    def of_words(self, words: list[str]) -> np.ndarray:
        if len(self.words) > REMEMBERED:
            self.words = {}
        for w in set(words).difference(self.words):
            self.words[w] = _signed_bucket(w, self.dim)
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def of_trigrams(self, codes: np.ndarray) -> np.ndarray:
        """For every place of ``codes`` but the last two."""
        c = codes.astype(np.int64)
        each, at = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_inverse=True)
        if len(self.trigrams) > REMEMBERED:
            self.trigrams = {}
        keys = each.tolist()
        for k in set(keys).difference(self.trigrams):
            self.trigrams[k] = _signed_bucket(chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF), self.dim)
        return np.fromiter(map(self.trigrams.__getitem__, keys), np.int64, len(keys))[at]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """(texts, dim) sums over the words and trigrams of lower-cased texts."""
        total = np.zeros(len(texts) * self.dim, np.int64)

        def add(owner, signed):
            cell = owner * self.dim + (signed >> 1)
            total[:] += np.bincount(cell[signed & 1 == 1], minlength=len(total)) - np.bincount(cell[signed & 1 == 0], minlength=len(total))
        words = [_WORD.findall(t) for t in texts]
        add(np.repeat(np.arange(len(texts)), [len(w) for w in words]), self.of_words([w for ws in words for w in ws]))
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for lo in range(0, len(codes) - 2, ENCODED_CHARS):
            part, own = codes[lo:lo + ENCODED_CHARS + 2], owner[lo:lo + ENCODED_CHARS + 2]
            inside = own[:-2] == own[2:]  # no trigram reaches into the next text
            add(own[:-2][inside], self.of_trigrams(part)[inside])
        return total.reshape(len(texts), self.dim)


def _encoded(dim: int):
    """Rows (key, bucket, w) of rows (key, lower-cased text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(dim)
        for b in batches:
            at, n = 0, b.num_rows
            while at < n:
                texts, held = [], 0
                while at + len(texts) < n and len(texts) < ENCODED_TEXTS and held < ENCODED_CHARS:
                    texts.append(b.column(1)[at + len(texts)].as_py())
                    held += len(texts[-1])
                sums = buckets(texts)
                row, bucket = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + row)), pa.array(bucket, pa.int32()), pa.array(sums[row, bucket])],
                                                 names=[b.schema.names[0], "bucket", "w"])
                at += len(texts)
    return run


def bucket_sums(df: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """I1 encoder, long form: signed feature hashing of ``tokens`` (words and
    trigrams) into ``dim`` buckets. (key, bucket, w) with integer sums. Tokens are
    summed into buckets where they are read, each distinct one hashed once by a
    task: at most ``dim`` rows of a text are shuffled, whatever its length."""
    rows = df.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    schema = T.StructType([rows.schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("w", T.LongType())])
    return rows.mapInArrow(_encoded(dim), schema).groupBy(key, "bucket").agg(F.sum("w").alias("w")).filter("w <> 0")


def _dense(dim: int):
    """Rows (key, unit vector) of rows (key, buckets, sums)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODED_TEXTS):
                b = whole.slice(at, ENCODED_TEXTS)
                sizes = b.column("_n").to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), sizes)
                w = b.column("_w").flatten().to_numpy(zero_copy_only=False)
                norm = np.sqrt(np.bincount(row, w.astype(float) ** 2, minlength=b.num_rows))
                out = np.zeros((b.num_rows, dim))
                out[row, b.column("_b").flatten().to_numpy(zero_copy_only=False)] = w / norm[row]
                ends = pa.array(np.arange(b.num_rows + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=[b.schema.names[0], "_out"])
    return run


def hashed_embedding(df: DataFrame, text: str, key: str, out: str = "embedding", dim: int = EMBED_DIM) -> DataFrame:
    """I1 stand-in encoder: ``bucket_sums`` as an L2-normalised array per
    ``key`` (zeros for a text without tokens). (key, out)."""
    g = bucket_sums(df, key, text, dim).groupBy(key).agg(F.collect_list(F.struct("bucket", "w")).alias("_e"))
    x = df.select(key).join(g, key, "left").select(
        key, F.when(F.col("_e").isNull(), F.lit(0)).otherwise(F.size("_e")).alias("_n"), F.col("_e.bucket").alias("_b"), F.col("_e.w").alias("_w"))
    schema = T.StructType([x.schema[key], T.StructField("_out", T.ArrayType(T.DoubleType()))])
    return x.mapInArrow(_dense(dim), schema).withColumnRenamed("_out", out)


def train_classifier(train: DataFrame, text: str, label: str, weight: str | None = None,
                     num_features: int = 1 << 16, reg: float = 0.01, max_iter: int = 50, kind: str = "logistic",
                     trees: int = 30, depth: int = 10, seed: int = 42) -> TextClassifier:
    """I4: tokenizer -> hashing TF -> IDF -> multinomial logistic regression
    or, with ``kind="forest"``, a random forest (MLlib), labels indexed by
    frequency; rows without a label are left out, so there are exactly as many
    classes as labels. A forest splits on at most 2**12 hashed features: its
    statistics grow with features x nodes, not with rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    known = train.filter(F.col(label).isNotNull())
    # short compressed texts become wide vectors: tasks by characters, not by shuffled bytes
    chars = known.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(train.sparkSession.sparkContext.defaultParallelism, -(-chars // CHARS_PER_TASK))
    known = known.select(text, label, *([weight] if weight else [])).repartition(tasks)
    indexer = StringIndexer(inputCol=label, outputCol="_y").fit(known)
    weighted = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        fitted = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=reg, maxIter=max_iter, family="multinomial", **weighted)
    elif kind == "forest":
        num_features = min(num_features, 1 << 12)
        fitted = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed, **weighted)
    else:
        raise ValueError("kind must be 'logistic' or 'forest'")
    stages = [RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
              IDF(inputCol="_tf", outputCol="_x"), fitted]
    return TextClassifier(list(indexer.labels), Pipeline(stages=stages).fit(indexer.transform(known)))


def score(model: TextClassifier, df: DataFrame, label_out: str = "predicted", prob_out: str = "confidence") -> DataFrame:
    """Best class and its probability per row."""
    from pyspark.ml.functions import vector_to_array
    out = model.pipeline.transform(df).withColumn("_pa", vector_to_array(F.col("probability")))
    lab = F.array(*[F.lit(x) for x in model.labels])
    best = F.array_position(out["_pa"], F.array_max(out["_pa"]))
    return (out.withColumn(prob_out, F.array_max("_pa"))
               .withColumn(label_out, F.element_at(lab, best.cast("int")))
               .drop("_pa", "_tok", "_tf", "_x", "rawPrediction", "probability", "prediction"))
