"""Fitted steps on streams.

``CleanerModel``, ``FeatureModel``, ``OneHotModel`` and ``ScalerModel``
transform by projection + filter with fitted literals, so the same objects
apply unchanged to a Structured Streaming DataFrame: fit on a batch
snapshot, then clean and featurise new rows as they arrive. Nothing here
keeps state across micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewise.session import checkpoint_dir


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def apply_models(stream: DataFrame, *models, keep: list[str] | None = None) -> DataFrame:
    """Chain fitted models' ``transform`` on a (streaming) DataFrame."""
    out = stream
    for m in models:
        try:
            out = m.transform(out, keep) if keep is not None else m.transform(out)
        except TypeError:
            out = m.transform(out)
    return out


def write_stream(df: DataFrame, sink: str, name: str, fmt: str = "parquet",
                 available_now: bool = True) -> StreamingQuery:
    """Append the transformed rows to ``sink`` (any file format, or
    ``memory`` for tests) with a checkpoint under the shared folder."""
    spark = df.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    w = df.writeStream.outputMode("append").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w
    if fmt == "memory":
        return w.format("memory").queryName(name).start()
    return w.format(fmt).option("path", sink).start()
