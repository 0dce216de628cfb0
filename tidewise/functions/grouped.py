"""Exact order statistics of any number of groups, as a table.

The k-th smallest value of every group is found without a list of groups on the
driver and without a group in one task:

1. (group, value) counts, combined before the shuffle, so that a repeated value
   is one row however often it occurs;
2. these rows are dealt out by ranges of (group, value) and written with the
   number of their range: a large group spans as many ranges as it needs;
3. one row per (group, range) says how many values lie before; a wanted rank
   thus meets exactly one range, and only these ranges are searched by running
   sums.

Three shuffles, however many groups there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.session import materialize

#: Copies of each row of a large table of groups that rows are joined with, so
#: that the rows of one group are spread over so many tasks.
SALTS = 16


def join_groups(rows: DataFrame, group: Column, table: DataFrame, name: str, few: bool, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which has a row per value ``name`` of
    ``group``. A table of few groups is broadcast: the plan cannot know its
    size, and a shuffle by group would leave all of a group's rows to one task.
    Any other is joined on a salt as well."""
    if few:
        return rows.join(F.broadcast(table), group == F.col(name), how)
    hashed = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int")
    copies = table.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, (group == F.col(name)) & (F.col("_salt") == F.col("_s")), how).drop("_salt", "_s")


def group_order_statistics(rows: DataFrame, keys: list[str], value: str, ranks) -> DataFrame:
    """keys, tag, value: for each group and each (tag, k) of ``ranks``, the k-th
    smallest (from 0) non-null value; NaN is the largest. ``ranks`` maps the
    column of a group's number of values to {tag: k column}; a k outside the
    group gives no row. Groups are matched NULL to NULL."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    ranged = materialize(held.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ranged.groupBy(*keys, "_p").agg(F.sum("_n").alias("_in"))
    parts = parts.withColumn("_before", F.sum("_in").over(upto) - F.col("_in"))
    sizes = ranged.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    wanted = sizes.select(*keys, F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), k.cast("long").alias("k")) for t, k in ranks(F.col("_size")).items()])).alias("_w"))
    wanted = wanted.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "_w.tag", "_w.k")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    spots = parts.join(wanted, [*same, F.col("_before") <= F.col("k"), F.col("k") < F.col("_before") + F.col("_in")])
    spots = spots.select(*[f"_k{i}" for i in range(len(keys))], F.col("_p").alias("_kp"), (F.col("k") - F.col("_before")).alias("_at"), "tag")
    searched = [*same, F.col("_p") == F.col("_kp")]
    some = ranged.join(spots.select(*[f"_k{i}" for i in range(len(keys))], "_kp").distinct(), searched, "left_semi")
    within = Window.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    some = some.withColumn("_upto", F.sum("_n").over(within))
    found = some.join(spots, [*searched, F.col("_upto") - F.col("_n") <= F.col("_at"), F.col("_at") < F.col("_upto")])
    return found.select(*keys, "tag", F.col("_v").alias("value"))


def group_quantiles(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys and one column per entry of ``qs`` (name -> q): the groups' quantiles
    with linear interpolation."""
    def ranks(n):
        out = {}
        for name, q in qs.items():
            at = (n - 1) * F.lit(q)
            out |= {f"{name}/lo": F.floor(at), f"{name}/hi": F.ceil(at)}
        return out

    found = materialize(group_order_statistics(rows, keys, value, ranks), "group-quantiles")
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_size"))
    picks = [F.max(F.when(F.col("tag") == f"{name}/{end}", F.col("value"))).alias(f"_{end}{i}") for i, name in enumerate(qs) for end in ("lo", "hi")]
    wide = found.groupBy(*keys).agg(*picks).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[f"_{end}{i}" for i in range(len(qs)) for end in ("lo", "hi")])
    out = sizes.join(wide, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])
    cols = []
    for i, (name, q) in enumerate(qs.items()):
        at = (F.col("_size") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return out.select(*keys, *cols)
