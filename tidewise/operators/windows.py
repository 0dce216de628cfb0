"""Trailing time-window features per entity by prefix sums.

A sliding RANGE frame is summed again for every row, which is quadratic for a
busy entity, and a window per entity puts all its rows into one task. Here a
row adds itself at its time t and takes itself away just after t + width; the
frame's total at any time is the running total of these changes, which is
linear after the sort. Running totals restart in every time slice, and what the
slices before have left enters as a row of its own ahead of a slice, so an
entity is spread over as many tasks as it has slices. Only a row's own
entry carries its other columns, so these are shuffled once.

Sums are DECIMAL, so adding and taking away leaves no rounding error. Their
scale follows from the column's largest finite value and number of values (one
aggregate, an action): 37 digits from that total downwards, so that values from
1e-300 to 1e300 keep their digits. NaN and infinities are counted apart and give
what a plain window gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.functions.expressions import micros

_DAY_US = 86_400_000_000
SLICE_US = _DAY_US
_DIGITS = 37


@dataclass
class _Scale:
    """How a column's values become decimals and back: divided by 10^shift,
    with so many digits after the point."""
    shift: int
    digits: int
    #: Whether the column holds NaN or infinite values.
    odd: bool = False

    def steps(self) -> list[float]:
        """Powers of ten that a double can hold."""
        half = self.shift // 2
        return [float(f"1e{k}") for k in (half, self.shift - half) if k]

    def stored(self, v: Column) -> Column:
        for step in self.steps():
            v = v.cast("double") / F.lit(step)
        return v.cast(f"decimal(38,{self.digits})")

    def value(self, total: Column) -> Column:
        total = total.cast("double")
        for step in self.steps():
            total = total * F.lit(step)
        return total


def _odd(v: Column) -> Column:
    """Whether a value is NaN or infinite."""
    v = v.cast("double")
    return F.isnan(v) | (F.abs(v) == float("inf"))


def _scales(df: DataFrame, columns: list[str]) -> dict[str, _Scale]:
    if not columns:
        return {}
    finite = {c: F.when(~_odd(F.col(c)), F.abs(F.col(c).cast("double"))) for c in columns}
    row = df.agg(*[F.max(v).alias(f"m{i}") for i, v in enumerate(finite.values())], *[F.count(c).alias(f"n{i}") for i, c in enumerate(finite)],
                 *[F.count(v).alias(f"f{i}") for i, v in enumerate(finite.values())]).first()
    out = {}
    for i, c in enumerate(columns):
        most, n = row[f"m{i}"] or 0.0, max(1, row[f"n{i}"])
        whole = math.ceil(math.log10(most) + math.log10(n) + 1e-9) + 1 if most > 0 else 1  # digits of any total
        odd = row[f"f{i}"] < row[f"n{i}"]
        out[c] = _Scale(0, _DIGITS - max(whole, 1), odd) if -5 <= whole <= 30 else _Scale(whole - 9, _DIGITS - 9, odd)
    return out


def trailing(df: DataFrame, key: str, ts: str, frames: dict[str, tuple[int, str | None]],
             slice_us: int = SLICE_US) -> DataFrame:
    """Add one column per entry of ``frames``: name -> (days, None) is the
    number of other rows of the same ``key`` whose ``ts`` lies in [ts - days,
    ts]; (days, column) is that column's mean over the frame, the row itself
    included. Rows of equal ``ts`` are in each other's frames, as in a SQL
    RANGE frame; so are the rows of a key that have no ``ts``."""
    names = list(frames)
    t = micros(F.col(ts))
    # key of the change in the order of time: even at t, odd just after t + width
    changes = [F.struct((2 * t).alias("at"), F.lit(-1).alias("frame"))]
    changes += [F.struct((2 * (t + days * _DAY_US) + 1).alias("at"), F.lit(i).alias("frame"))
                for i, (days, _) in enumerate(frames.values())]
    columns = list(dict.fromkeys(c for _, c in frames.values() if c))
    scales = _scales(df, columns)
    own = {c: f"_o{i}" for i, c in enumerate(df.columns)}  # one by one, so that unused ones are pruned
    rows = df.select(F.col(key), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(columns)], *[F.col(f"`{c}`").alias(o) for c, o in own.items()],
                     F.explode(F.when(F.col(ts).isNull(), F.array(changes[0])).otherwise(F.array(*changes))).alias("_c"))
    rows = rows.select("*", F.col("_c.at").alias("_at"), F.col("_c.frame").alias("_f")).drop("_c")
    rows = rows.withColumns({o: F.when(F.col("_f") == -1, F.col(o)) for o in own.values()}).withColumn("_slice", F.floor(F.col("_at") / (2 * slice_us)))
    deltas = {}
    for i, (_, column) in enumerate(frames.values()):
        add, take = F.col("_f") == -1, F.col("_f") == i
        v = F.col(f"_v{columns.index(column)}") if column else F.lit(1)
        counted = {"n": v.isNotNull()}
        if column:
            odd = _odd(v)
            amount = scales[column].stored(F.when(odd, None).otherwise(v))
            deltas[f"_s{i}"] = F.when(add, amount).when(take, -amount)
            wide = v.cast("double")
            if scales[column].odd:
                counted |= {"nan": F.isnan(wide), "pos": wide == float("inf"), "neg": wide == float("-inf")}
        for what, holds in counted.items():
            deltas[f"_{what}{i}"] = F.when(holds & add, 1).when(holds & take, -1)
    rows = rows.withColumns(deltas).drop(*[f"_v{i}" for i in range(len(columns))])
    within = Window.partitionBy(key, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    left = rows.filter("_slice IS NOT NULL").groupBy(key, "_slice").agg(*[F.sum(d).alias(d) for d in deltas], F.max(F.col("_f") == -1).alias("_own"))
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(key, "_slice", "_own", *[F.sum(d).over(before).alias(d) for d in deltas]).filter("_own").drop("_own")
    left = left.withColumns({"_at": F.col("_slice") * (2 * slice_us) - 1, "_f": F.lit(-2)})  # ahead of all rows of the slice
    out = rows.unionByName(left, allowMissingColumns=True)
    out = out.select(*own.values(), "_f", *[F.sum(d).over(within).alias(f"_r{d}") for d in deltas]).filter("_f = -1")

    def total(d: str):
        none = F.lit(0)
        if d.startswith("_s"):
            none = none.cast(f"decimal(38,{scales[frames[names[int(d[2:])]][1]].digits})")
        return F.coalesce(F.col(f"_r{d}"), none)

    results = []
    for i, name in enumerate(names):
        if frames[name][1] is None:
            results.append((total(f"_n{i}") - 1).cast("long").alias(name))
        else:
            scale = scales[frames[name][1]]
            mean = F.try_divide(scale.value(total(f"_s{i}")), total(f"_n{i}").cast("double"))
            if scale.odd:
                nan, up, down = (total(f"_{what}{i}") > 0 for what in ("nan", "pos", "neg"))
                mean = F.when(nan | (up & down), float("nan")).when(up, float("inf")).when(down, float("-inf")).otherwise(mean)
            results.append(mean.alias(name))
    return out.select(*[F.col(o).alias(c) for c, o in own.items()], *results)


def velocity(df: DataFrame, key: str = "user_id", ts: str = "ts", days: int = 1,
             name: str = "prior_transactions_24h") -> DataFrame:
    """Earlier events of the same entity within ``days`` (the row itself not counted)."""
    return trailing(df, key, ts, {name: (days, None)})


def trailing_avg(df: DataFrame, value: str = "value", key: str = "user_id",
                 ts: str = "ts", days: int = 7, name: str = "avg_amount_7d") -> DataFrame:
    """Mean of ``value`` over the trailing ``days`` of the same entity."""
    return trailing(df, key, ts, {name: (days, value)})
