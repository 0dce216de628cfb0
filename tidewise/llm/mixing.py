"""Mixing sources to target weights by Pareto order sampling (operator 5).

Targets: sources in code-point order (null last) take the given weights in
turn and share ``share`` times all words; a source's target stops at
``most`` times its words and the excess is shared again by weight. This
water filling has one solution, found by sorting sources by (cap / weight).

Documents: a source with ratio target / words takes ``floor(ratio)`` whole
copies of each document; the remaining fraction p is sampled. A document's
rank is the odds of its random number divided by the odds of its inclusion
probability, which a weight column may vary per document; documents are taken
in that order until the words taken are as near the source's quota as whole
documents allow. The random number is a digest of the seed and the id, so
reruns agree.

A hot source is never ordered in one task: its words are summed by rank
interval (1024, with map-side aggregation), and only the interval that holds
the cut is summed again by 1024 finer ones; only the last interval's rows,
about one in a million of the source, are ordered exactly.

Defined results: a null text has no words; documents without words are taken
or not like others but add nothing; a source without words has target 0.
Rows that repeat an id share its random number and are taken or left together.
An empty table gives an empty table. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import attach, stored

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"
INTERVALS = 1024


def sizes(docs: DataFrame, weight: str | None = None, seed: str = SEED, keep=()) -> DataFrame:
    """doc_id, source, words, weight and the document's random number."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        ((F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))).alias("u"), *keep)


def targets(table: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row per source (the mix's own table,
    as small as the list of sources)."""
    per = table.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    rest = F.lit(float(share)) * total - below
    per = per.withColumn("rest", rest).withColumn("open_weight", open_weight)
    full = F.col("cap") * F.col("open_weight") <= F.col("rest") * F.col("weight")
    per = per.withColumn("full", full)
    first = Window.partitionBy()
    # the first source that is not full fixes the level for all that follow
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "rest", "open_weight"))).over(first)
    per = per.withColumn("level", level)
    target = F.when(F.col("full") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("level.rest") * F.col("weight") / F.col("level.open_weight"))
    return per.select("source", "source_size", target.cast("double").alias("target"))


def _ranked(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` with their source's figures and the rank q / (1 + q), q being
    the random odds over the inclusion odds: the same order, within (0, 1)."""
    per_source = per_source.withColumnRenamed("source", "__s")
    rows = attach(rows, per_source, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    chance = F.least(F.greatest(F.coalesce(F.try_divide(F.col("p") * F.col("w"), F.col("mean_w")), F.col("p")), F.lit(1e-12)), F.lit(1 - 1e-12))
    over = F.col("u") * (1 - chance)
    rows = rows.withColumn("rank", over / (over + (1 - F.col("u")) * chance))
    return rows.withColumn("b1", F.floor(F.col("rank") * INTERVALS)).withColumn("b2", F.floor(F.col("rank") * (INTERVALS * INTERVALS)))


def plan(table: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """What each source takes, one row per source: its target, the whole
    copies, and the rank up to which its documents are taken once more."""
    goals = targets(table, weights, share, most)
    scale = table.groupBy(F.col("source").alias("s")).agg(F.coalesce(F.try_divide(F.sum(F.col("size") * F.col("w")), F.sum("size")), F.lit(1.0)).alias("mean_w"))
    goals = goals.join(scale, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = goals.withColumn("whole", F.floor(ratio)).withColumn("p", ratio - F.floor(ratio))
    goals = stored(goals.withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")), "goals")

    def cut(rows: DataFrame, b: str, before) -> DataFrame:
        """Of each source, the interval in which the words pass the quota, and
        the words before it."""
        sums = rows.groupBy("source", "quota", b, before.alias("base")).agg(F.sum("size").alias("n"))
        upto = F.col("base") + F.sum("n").over(Window.partitionBy("source").orderBy(b))
        sums = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("quota"))
        return sums.groupBy("source").agg(F.min(F.struct(b, (F.col("upto") - F.col("n")).alias("base"))).alias(f"c{b}"))

    def within(rows: DataFrame, cuts: DataFrame, b: str) -> DataFrame:
        cuts = cuts.withColumnRenamed("source", "__s")
        return attach(rows, cuts, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").filter(F.col(b) == F.col(f"c{b}.{b}"))

    rows = _ranked(table, goals)
    first = stored(cut(rows, "b1", F.lit(0)), "cut1")
    second = stored(cut(within(rows, first, "b1"), "b2", F.col("cb1.base")), "cut2")
    last = within(rows, second, "b2")
    order = Window.partitionBy("source").orderBy(F.struct("rank", "doc_id"))
    tied = Window.partitionBy("source", "rank", "doc_id")
    last = last.withColumn("upto", F.col("cb2.base") + F.sum("size").over(order)).withColumn("own", F.sum("size").over(tied))
    # up to the quota, or past it by the document that crosses it if that is nearer
    nearer = (F.col("upto") - F.col("own") < F.col("quota")) & (F.col("upto") - F.col("quota") < F.col("quota") - (F.col("upto") - F.col("own")))
    last = last.filter((F.col("upto") <= F.col("quota")) | nearer)
    edge = last.groupBy(F.col("source").alias("s")).agg(F.max(F.struct("rank", "doc_id")).alias("edge"))
    second = second.select(F.col("source").alias("s2"), F.col("cb2.b2").alias("cut_b2"))
    return (goals.join(second, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2")
            .join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    rows = _ranked(rows, plan)
    at_cut = (F.col("b2") == F.col("cut_b2")) & (F.struct("rank", "doc_id") <= F.col("edge"))
    more = F.when(F.col("cut_b2").isNull(), F.col("quota") > 0).otherwise((F.col("b2") < F.col("cut_b2")) | F.coalesce(at_cut, F.lit(False)))
    return rows.withColumn("copies", F.col("whole") + more.cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, weight: str | None = None, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    table = stored(sizes(docs, weight, seed), "sizes")
    rows = _with_copies(table, stored(plan(table, weights, share, most), "mix"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its
    columns. Documents are copied or dropped where they are read; only the plan,
    a row per source, comes to them."""
    per_source = stored(plan(stored(sizes(docs, None, seed), "sizes"), weights, share, most), "mix")
    own = F.struct(*docs.columns)
    rows = _with_copies(sizes(docs.select("doc_id", "source", "text", own.alias("__own")), None, seed, keep=["__own"]), per_source)
    rows = rows.filter("copies > 0").select("__own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("__own.*")
