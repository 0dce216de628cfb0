"""Intermediate tables in the cluster's shared folder, and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.session import materialize

#: Largest number of keys that ``semi`` / ``anti`` ship to every executor (8 to
#: 40 bytes each, so 2 to 10 MB); beyond it the join shuffles both sides.
MAX_BROADCAST_KEYS = 250_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, so a
    lost executor costs a re-read and later steps do not recompute it."""
    return materialize(df, f"llm-{name}")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Jobs started inside hand Python workers at most so many rows at once:
    rows that hold whole texts or sets would else fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Return the memory that this process has freed to the system: a worker
    goes on with later stages, beside the executor that needs the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, in a worker that keeps no freed memory of
    earlier tasks, nor of this one afterwards."""
    def task(batches: Iterator) -> Iterator:
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lean_group(run: Callable) -> Callable:
    """``run`` over one large group, in a worker that keeps no memory freed by it."""
    def group(pdf):
        try:
            return run(pdf)
        finally:
            give_back()

    return group


def lean_driver(spark: SparkSession) -> None:
    """Between jobs: the driver gives freed memory back. A full collection of
    its JVM shrinks the heap and lets Spark's cleaner drop the shuffles and
    broadcasts that no table refers to any more."""
    give_back()
    spark._jvm.System.gc()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no
    column of ``df``: helper columns never replace the caller's."""
    held = {c.lower() for c in df.columns}
    free = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        free.append(name)
    return free


def _by_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    small = keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    return df.join(F.broadcast(keys) if small else keys, on, how)


def semi(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns occur in ``keys``."""
    return _by_keys(df, keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns do not occur in ``keys``."""
    return _by_keys(df, keys, on, "left_anti")


def attach(df: DataFrame, small: DataFrame, condition, how: str = "inner") -> DataFrame:
    """``df`` joined with a table of a row per source or the like: shipped to
    every executor if it has at most MAX_BROADCAST_KEYS / 10 rows, else shuffled."""
    fits = small.limit(MAX_BROADCAST_KEYS // 10 + 1).count() <= MAX_BROADCAST_KEYS // 10
    return df.join(F.broadcast(small) if fits else small, condition, how)


def is_held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id
    is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held, rows: int | dict[int, int]) -> DataFrame:
    """doc_id, text, label, n_class: a bounded sample of the labelled rows that
    are not held out, one for each distinct text, whole texts.

    About ``rows`` of them by a hash of the text (a dict: that many for each
    label, as far as there are); ``n_class`` is how many distinct labelled texts
    with that label there are in all. Only ids and hashes are shuffled; the
    chosen ids are few enough to be shipped. Labels are 0, 1 or null; any other
    value is an error."""
    value = F.col(column).try_cast("double")
    if not labels.filter(F.col(column).isNotNull() & ~F.coalesce(value.isin(0.0, 1.0), F.lit(False))).isEmpty():
        raise ValueError(f"labels.{column} has values other than 0 and 1")
    known = labels.filter(value.isNotNull()).select("doc_id", value.cast("int").alias("label"))
    hashed = docs.filter(~held).select("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"))
    texts = hashed.join(known, "doc_id").groupBy("h").agg(F.min(F.struct("doc_id", "label")).alias("r"))
    texts = stored(texts.select("h", "r.doc_id", "r.label"), "labelled")
    counts = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    want = {k: min(1.0, rows.get(k, 0) / n if isinstance(rows, dict) else rows / total) for k, n in counts.items()}
    share, n_class = F.lit(0.0), F.lit(0)
    for k in counts:
        share = F.when(F.col("label") == k, F.lit(want[k])).otherwise(share)
        n_class = F.when(F.col("label") == k, F.lit(counts[k])).otherwise(n_class)
    # 2**40 steps: a share is met to within a row
    chosen = texts.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < share * F.lit(float(1 << 40)))
    chosen = stored(chosen.select(F.col("doc_id").alias("__id"), "h", "label", n_class.cast("long").alias("n_class")), "chosen")
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows_ = attach(whole, chosen, F.col("doc_id") == F.col("__id"))
    return stored(rows_.dropDuplicates(["h"]).select("doc_id", "h", "text", "label", "n_class"), "sample")
