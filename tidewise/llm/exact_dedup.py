"""Exact deduplication by a tree merge of sorted digest runs (operator 6).

Every document gets a digest of its normalised text and belongs to one of
``runs`` runs (by its id). In each round, ``radix`` runs exchange: a digit of
the run number is replaced by the same digit of the digest's slot, so equal
digests of those runs meet in one run, and the merge of the sorted runs keeps,
for each digest, the smallest identifier and the number of rows. After
log(runs) / log(radix) rounds equal digests of all runs are together. Spark
does a round as a partial aggregate by (run, digest), a shuffle and a
sort-based merge. Rows of equal digest are verified at every level by two more
measures, length and a second hash: texts that differ in them stay apart.

Hot groups: copies collapse inside their run before anything is shuffled, so a
group that is a third of the table is one row per run, then one per merge. The
classes go back down the tree to (run, digest), and documents join there: a
group is spread over all runs, never in one task.

Only digests move; the text is read once and never shuffled.

Defined results: a null text counts as empty; equal texts are those identical
after each run of blanks becomes one space. Of rows that repeat the smallest
``doc_id`` with an equal text, exactly one stays; null ids come last. An empty
table gives an empty table. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import anti, free_names, stored

#: Number of runs and of runs merged at once; runs is a power of radix.
RUNS, RADIX = 256, 16

KEY = ["digest", "chars", "check"]


def normalised(text):
    """Each run of blanks as one space. Single spaces are left as they are, so
    the pattern only stops where something changes."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")),
                            r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digest_table(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, a row number, the run, the digest and its verifying measures."""
    text = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("t"))
    return text.select(
        "doc_id", F.monotonically_increasing_id().alias("row"),
        F.pmod(F.xxhash64("doc_id", F.lit("run")), F.lit(runs)).alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.length("t").alias("chars"), F.xxhash64("t").alias("check"))


def merge_runs(level: DataFrame) -> DataFrame:
    """One merge: rows of equal (run, digest) become one with the smallest
    identifier. The identifier is a struct, which Spark merges by sorting."""
    return level.groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def classes(table: DataFrame, runs: int = RUNS, radix: int = RADIX) -> tuple[DataFrame, DataFrame]:
    """(the merged runs before the first exchange, the classes at the root)."""
    start = merge_runs(table.select("run", *KEY, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("first"), F.lit(1).alias("n")))
    level, slot = start, F.pmod(F.xxhash64("digest"), F.lit(runs))
    digit = 1
    while digit < runs:
        own, theirs = F.floor(F.col("run") / digit) % radix, F.floor(slot / digit) % radix
        level = merge_runs(level.withColumn("run", F.col("run") + (theirs - own) * digit))
        digit *= radix
    return start, level


def find_copies(docs: DataFrame, runs: int = RUNS, radix: int = RADIX) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    table = stored(digest_table(docs, runs), "digests")
    start, root = classes(table, runs, radix)
    down = start.select("run", *KEY).join(root.select(*KEY, "first", "n"), KEY)
    return table.join(down, ["run", *KEY]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    found = stored(find_copies(docs), "copies")
    keys = free_names(docs, "__id", "__sha256")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    marked = docs.withColumns(dict(zip(keys, [name, F.sha2(normalised(F.col("text")), 256)])))
    found = found.select(name.alias(keys[0]), F.col("text_sha256").alias(keys[1]), "kept")
    rows = found.groupBy(*keys).agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    out = anti(marked, rows.filter("kept = 0").select(*keys), keys)
    if not rows.filter("kept = 1 and n > 1").isEmpty():  # rows that repeat id and text
        again = rows.filter("kept = 1 and n > 1").select(*keys)
        out = anti(out, again, keys).unionByName(out.join(again, keys, "left_semi").select(*out.columns).dropDuplicates(keys))
    return out.drop(*keys)
