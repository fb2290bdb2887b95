"""Stage tables (A2), freshness metadata (A6), dataset fingerprints (A5),
CSV/JSON sinks (A3, A4) and the incremental embedding table (A7).

A stage is written as parquet under the shared checkpoint folder and read
back: this cuts lineage (later plans start at a parquet scan), survives lost
executors and lets a later run resume. Data go to a folder of their own first;
one rename of a small manifest commits them. A stage is reused only when its
manifest holds the current fingerprint and the versions that the stages before
it have now.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.exprs import hex15_to_number

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def code_signature() -> str:
    """Hash of the package's source files: a stage written by other code is
    not fresh, even on the same input."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha256()
    for dirpath, _, files in sorted(os.walk(root)):
        if os.path.basename(dirpath) == "llm":  # no stage is built from it
            continue
        for f in sorted(files):
            if f.endswith(".py"):
                with open(os.path.join(dirpath, f), "rb") as fh:
                    h.update(f.encode() + b"\0" + fh.read())
    return h.hexdigest()[:16]


def input_signature(spark: SparkSession, paths: Iterable[str]) -> str:
    """Cheap fingerprint of input files from their listing (path, length,
    modification time), listed by Spark and summed as hashes: no data pass and
    no driver loop over files, so it can guard every stage."""
    parts = []
    for path in paths:
        if not path_exists(spark, path):
            parts.append(f"{path}:missing")
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        h = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        n, total = files.agg(F.count(F.lit(1)), F.sum(h)).first()
        parts.append(f"{path}:{n}:{total}")
    return hashlib.sha256("\n".join(sorted(parts)).encode()).hexdigest()[:16]


def dataset_fingerprint(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """A5, distributed: sha256 over the row count and the sum of a 60-bit
    number taken from each row's md5. Order-free (a sum), keeps multiplicity
    (duplicates add up instead of cancelling), no global sort. One row with
    ``fingerprint`` (16 hex chars), ``n_rows`` and ``hash_sum``."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    h = df.select(hex15_to_number(key).cast("decimal(38,0)").alias("_h"))
    agg = h.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_h").cast("decimal(38,0)").alias("hash_sum"))
    digest = F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("hash_sum").cast("string")), 256)
    return agg.select(F.substring(digest, 1, 16).alias("fingerprint"), "n_rows", "hash_sum")


def _read_text(spark: SparkSession, path: str) -> str | None:
    """A small file through the file system; none if it is not there."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over ``path``: readers see the old or the new file."""
    jvm = spark.sparkContext._jvm
    p, fs = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    rename = spark.sparkContext._gateway.new_array(kind, 1)
    rename[0] = kind.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(
        fs.makeQualified(tmp), fs.makeQualified(p), rename)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What was committed last at ``path``: stage, fingerprint, version (the
    folder with the data), versions of the stages it came after, time."""
    text = _read_text(spark, os.path.join(path, "manifest.json"))
    return json.loads(text) if text else None


def commit(spark: SparkSession, path: str, entry: dict) -> None:
    """Make ``entry`` the manifest of ``path``: one rename, after the data."""
    _replace_text(spark, os.path.join(path, "manifest.json"), json.dumps(entry | {"written_at": time.time()}, sort_keys=True))


def data_path(spark: SparkSession, path: str) -> str:
    """Folder of the committed data of a stage."""
    return os.path.join(path, manifest(spark, path)["version"])


def _versions(spark: SparkSession, paths: Iterable[str]) -> dict[str, str | None]:
    return {p: (manifest(spark, p) or {}).get("version") for p in paths}


def stage_is_fresh(spark: SparkSession, path: str, fingerprint: str, after: Iterable[str] = ()) -> bool:
    """Committed with ``fingerprint``, after the versions that the stages in
    ``after`` have now. Data without a manifest (a killed write) is not fresh."""
    m = manifest(spark, path)
    return m is not None and m["fingerprint"] == fingerprint and m["after"] == _versions(spark, after)


def discard(spark: SparkSession, path: str) -> None:
    """Take the commit of a stage back: its data are no longer fresh."""
    p, fs = _fs(spark, os.path.join(path, "manifest.json"))
    fs.delete(p, False)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], fingerprint: str,
          name: str = "", params: dict | None = None, partition_by: list[str] | None = None,
          after: Iterable[str] = ()) -> DataFrame:
    """A2: reuse the stage at ``path`` if fresh, else build, write to a folder
    of its own, commit and read it. The version before stays for those who
    still read it; older ones go."""
    after = list(after)
    if not stage_is_fresh(spark, path, fingerprint, after):
        before = (manifest(spark, path) or {}).get("version")
        version = f"v-{uuid.uuid4().hex[:12]}"
        built = build()  # may commit stages it comes after
        w = built.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(os.path.join(path, version))
        commit(spark, path, {"stage": name or os.path.basename(path), "fingerprint": fingerprint, "version": version,
                             "after": _versions(spark, after), "params": params or {}})
        p, fs = _fs(spark, path)
        for f in fs.listStatus(p):
            if f.isDirectory() and f.getPath().getName() not in (version, before):
                fs.delete(f.getPath(), True)
    return spark.read.parquet(data_path(spark, path))


def write_csv(df: DataFrame, path: str) -> None:
    """A3: header CSV table sink."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A4: JSON metric sink (one JSON object per row)."""
    df.write.mode("overwrite").json(path)


def incremental_embeddings(texts: DataFrame, store_path: str, encode: Callable[[DataFrame], DataFrame],
                           text_col: str = "text") -> DataFrame:
    """Embed each distinct text once. Keys are md5(text) (a null text has
    none); texts in the store are removed with a left anti join, only new ones
    are encoded. A batch is written to a folder of its own and then listed in the
    store's manifest: a run that ended early, or one repeated, adds nothing
    twice. Returns the whole store (key, embedding, batch from 1)."""
    spark = texts.sparkSession
    keys = texts.filter(F.col(text_col).isNotNull()).select(F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("text")) \
                .groupBy("key").agg(F.first("text").alias("text"))
    batches = (manifest(spark, store_path) or {}).get("batches", [])
    known = _batches(spark, store_path, batches)
    new = keys.join(known.select("key"), "key", "left_anti") if known is not None else keys
    name = f"batch-{uuid.uuid4().hex[:12]}"
    encode(new).select("key", "embedding").write.parquet(os.path.join(store_path, name))
    if known is None or not spark.read.parquet(os.path.join(store_path, name)).isEmpty():
        batches = [*batches, name]
        commit(spark, store_path, {"batches": batches})
    return _batches(spark, store_path, batches)


def _batches(spark: SparkSession, store_path: str, names: list[str]) -> DataFrame | None:
    """The listed batches of a store, numbered from 1, as one scan."""
    if not names:
        return None
    rows = spark.read.option("basePath", store_path).parquet(*[os.path.join(store_path, n) for n in names])
    number = F.element_at(F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))]),
                          F.element_at(F.split(F.input_file_name(), "/"), -2))
    return rows.select("key", "embedding", number.alias("batch"))
