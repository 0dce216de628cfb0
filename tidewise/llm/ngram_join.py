"""Jaccard self-join on word shingles by parity sketches (operator 7).

Two sets with 100 * intersection >= PERCENT * union differ in at most
D = (100 - PERCENT) / (100 + PERCENT) * (|A| + |B|) shingles. A set's parity
sketch has one bit per position, flipped by every shingle hashed there, so the
Hamming distance of two sketches is at most the number of differing shingles.
Here the sketch is 2**64 positions wide and falls into m > D parts; a part is
kept as the XOR of its odd positions. At most D parts can differ, so linked
sets share a part (pigeonhole), and they are found by joining on parts. m and
D belong to a size band; a set also enters the next bands that a larger
partner may be in. Empty parts are left out wherever the parts that remain
still exceed D. Candidates are verified: first by the Hamming distance of a
folded sketch, then, for sets that fill it, of a wide one whose size follows the
set's, then exactly on the shingle sets.

Steps, each a distributed job:

1. sets: n_shingles, a 128-bit digest and the folded sketch of every set; equal
   sets form a class and only classes are joined on.
2. parts of every set, packed in blocks by hash range, shuffled; per range, parts
   that two or more classes share give candidates.
3. candidates within a part: every class against the part's smallest one (a
   star), verified, components. Only documents of pairs that their sizes and
   sketches allow are read again for their shingles.
4. what a star may have missed: classes that share a part but are in different
   components after step 3, pair by pair, verified, components.

A part that more than GROUP classes share (a very common passage) is skipped in
step 4 for every class that has enough other parts for the pigeonhole: both
partners must be short of parts to need it. Steps 2 to 4 are repeated for the
short classes alone with FINE parts, of about one shingle: there a class is
short only if common shingles are most of its set (nearly 8 in 10 at 80 %), not
half of it. Of its common parts it enters only as many as it is short of, the
first ones by their keys: the first part that two linked sets share is then
among those of both. These few are compared in blocks of
BLOCK by sketches, spread over tasks, and parts with the same members once. A
block first gives a forest, at most one pair for each of its classes, which is
verified; only pairs whose classes are in different components even then are
verified one by one. So no part, however common, is in one task or expanded
into pairs of all its documents, and sketches are compared where rows meet,
before a pair is shuffled.

Defined results: null and blank texts have no shingle and are linked with
nothing; fewer than five words are one shingle; repeated rows are copies; a
null id is never a component's id unless all are null. An empty table gives an
empty table. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import anti, lean, lean_driver, lean_group, semi, small_batches, stored
from .words import mix, shingle_sets

WORDS, PERCENT = 5, 80
#: Size bands grow by this factor; parts exceed D + 1 by this share.
BAND, SPARE = 1.4, 0.15
#: The same share for classes short of other than common parts: about 7 parts a
#: shingle, most of them empty.
FINE = 31.0
GROUP, FLUSH_GROUP, BLOCK = 64, 16, 2048
#: Parts that a task holds before it sorts and packs them; parts a range; the
#: fewest ranges of fine parts.
FLUSH, RANGE, FINE_RANGES = 1 << 18, 1 << 18, 64
SKETCH_BITS = 1024
#: Sets of more shingles than SKETCH_BITS also have a sketch of at least one bit
#: a shingle, up to this many bits (past it the filter is weaker, not the result).
WIDE_BITS = 1 << 16
#: A forest takes pairs below this share of the allowed distance first, from so
#: many parts of each class; salts that spread the members of one part.
SURE, FOREST_PARTS, SALTS = 0.8, 4, 16
NO_ID = -(2**63)

_U = np.uint64


def difference(sizes: int, percent: int) -> int:
    """The most shingles in which linked sets of so many in all can differ."""
    return (100 - percent) * sizes // (100 + percent)


@cache
def bands(percent: int, spare: float = SPARE) -> tuple[list[int], list[tuple[int, int]]]:
    """(smallest size of each band, (D, m) of each band)."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1] + 1, int(lows[-1] * BAND)))
    limits = []
    for high in lows[1:]:
        d = difference(2 * (high - 1), percent)
        limits.append((d, d + 1 + max(1, int(spare * (d + 1)))))
    return lows, limits


def bands_of(n: int, percent: int) -> list[int]:
    """Bands that a set of n shingles enters: its own, and those of larger
    partners. Bands in which only equal sets can be linked are left out."""
    lows, limits = bands(percent)
    own = int(np.searchsorted(lows, n, "right")) - 1
    found = []
    k = own
    while k < len(limits) and (k == own or lows[k] * percent <= 100 * n):
        if limits[k][0] > 0:
            found.append(k)
        k += 1
    return found


def parts(shingles: np.ndarray, band: int, percent: int, spare: float = SPARE) -> np.ndarray:
    """Keys of the parts of a sorted set of shingle hashes; the band is in the
    low byte."""
    d, m = bands(percent, spare)[1][band]
    where = ((shingles >> _U(32)) * _U(m)) >> _U(32)  # rises with the hash
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    part, value = where[first], np.bitwise_xor.reduceat(mix(shingles), first)
    if len(part) <= d:  # too few: the empty parts count as well
        full = np.zeros(m, np.uint64)
        full[part.astype(np.int64)] = value
        part, value = np.arange(m, dtype=np.uint64), full
    keys = mix(value ^ mix(part | _U(band << 40)))
    return (keys & ~_U(0xFF)) | _U(band)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that a set's order does not change."""
    if not len(shingles):
        return 0, 0
    a = np.add.reduce(mix(shingles ^ _U(0x5851F42D4C957F2D)))
    b = np.bitwise_xor.reduce(mix(shingles ^ _U(0x14057B7EF767814F)))
    return int(np.int64(a.astype(np.int64))), int(np.int64(b.astype(np.int64)))


def sketch(shingles: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity sketch folded to so many bits, a power of two."""
    ones = np.bincount((shingles & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(ones.astype(np.uint8)).tobytes()


def wide_bits(n: int) -> int:
    """Bits of the wide sketch of n shingles; 0: it has none."""
    return 0 if n <= SKETCH_BITS else min(WIDE_BITS, 1 << (n - 1).bit_length())


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text"))


def set_table(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, n, hi, lo, sketch, wide: size, digest, sketch (SKETCH_BITS / 64 words,
    null without shingles) and wide sketch (null if it has none) of every
    document's set."""
    words64 = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            sketches, wide = [None] * batch.num_rows, [None] * batch.num_rows
            for i, s in shingle_sets(batch.column(1), words):
                n[i] = len(s)
                if len(s):
                    sketches[i] = np.frombuffer(sketch(s), np.int64)
                if wide_bits(len(s)):
                    wide[i] = np.frombuffer(sketch(s, wide_bits(len(s))), np.int64)
                hi[i], lo[i] = digest(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(hi), pa.array(lo), pa.array(sketches, words64), pa.array(wide, words64)], names=["id", "n", "hi", "lo", "sketch", "wide"])

    return _source(docs).mapInArrow(lean(run), "id long, n long, hi long, lo long, sketch array<long>, wide array<long>")


def _pack(keys: np.ndarray, entities: np.ndarray) -> bytes:
    return keys.tobytes() + entities.tobytes()


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray]:
    keys, entities = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for blob in blobs:
        half = len(blob) // 2
        keys.append(np.frombuffer(blob, np.uint64, count=half // 8))
        entities.append(np.frombuffer(blob, np.int64, offset=half))
    return np.concatenate(keys), np.concatenate(entities)


def _grouped(keys: np.ndarray, entities: np.ndarray):
    """Distinct (key, entity) in order, each group's first place and size."""
    order = np.lexsort((entities, keys))
    keys, entities = keys[order], entities[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (entities[1:] != entities[:-1])
    keys, entities = keys[new], entities[new]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(first)
    return keys, entities, first, np.diff(np.append(first, len(keys)))


# kinds of packed blocks: parts; a common part's smallest class in a flush;
# pairs with that class; memberships in common parts; per class and band, the
# parts beyond D + 1
PART, COMMON, PAIR, MEMBER, EXTRA = range(5)
_ZERO = 1 << 31


def packed_parts(docs: DataFrame, ranges: int, words: int, percent: int, spare: float, flush_group: int) -> DataFrame:
    """kind, range, block of every document's parts; those that more than
    ``flush_group`` documents of a flush share are common."""

    def ranged(kind: int, keys: np.ndarray, entities: np.ndarray, by: np.ndarray):
        where = ((by >> _U(32)) * _U(ranges)) >> _U(32)
        order = np.argsort(where, kind="stable")
        where, keys, entities = where[order], keys[order], entities[order]
        cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
        for a, b in zip(cut, np.append(cut[1:], len(where))):
            yield kind, int(where[a]), _pack(keys[a:b], entities[a:b])

    def flush(held):
        keys, entities = np.concatenate([k for k, _ in held]), np.concatenate([e for _, e in held])
        unique, times = np.unique(keys, return_counts=True)
        common = np.isin(keys, unique[times > flush_group])
        # in the order of documents, so that equal neighbours compress
        yield from ranged(PART, keys[~common], entities[~common], keys[~common])
        if common.any():
            keys, entities, first, size = _grouped(keys[common], entities[common])
            pivots = entities[first]
            yield from ranged(COMMON, keys[first], pivots, keys[first])
            by = mix(entities.view(np.uint64))
            yield from ranged(PAIR, np.repeat(pivots, size).view(np.uint64), entities, by)
            yield from ranged(MEMBER, keys, entities, by)

    def batch_of(rows):
        kinds, where, blocks = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(where, pa.int32()), pa.array(blocks, pa.binary())], names=["kind", "range", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, extra, size = [], [], 0

        def packed():
            spare = np.array(extra, np.int64).reshape(-1, 2)
            yield from flush(held)
            yield from ranged(EXTRA, spare[:, 0].view(np.uint64), spare[:, 1], mix(spare[:, 1].view(np.uint64)))

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), words):
                if len(s):
                    entity = digest(s)[0]
                    for band in bands_of(len(s), percent):
                        keys = parts(s, band, percent, spare)
                        held.append((keys, np.full(len(keys), entity, np.int64)))
                        extra.append((band << 32 | len(keys) - bands(percent)[1][band][0] - 1 + _ZERO, entity))
                        size += len(keys)
                if size >= FLUSH:
                    yield batch_of(list(packed()))
                    held, extra, size = [], [], 0
        if held:
            yield batch_of(list(packed()))

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "kind int, range int, block binary")


def shared_parts(packed: DataFrame) -> DataFrame:
    """kind, a, b: stars as (PAIR, class, smallest class), small groups as
    (PART, group, class), memberships in common parts as (MEMBER, part, class),
    (EXTRA, band and number, class)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {k: list(g) for k, g in pdf.groupby("kind")["block"]}
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        pivot, member = _unpack(by.get(PAIR, []))
        found.append((PAIR, member, pivot.view(np.int64)))
        part, member = _unpack(by.get(MEMBER, []))
        found.append((MEMBER, part.view(np.int64), member))
        spare, member = _unpack(by.get(EXTRA, []))
        found.append((EXTRA, spare.view(np.int64), member))
        common, pivots = _unpack(by.get(COMMON, []))
        keys, entities = _unpack(by.get(PART, []))
        keys, entities, first, size = _grouped(np.concatenate([keys, common]), np.concatenate([entities, pivots]))
        if len(keys):
            hot = (size > GROUP) | np.isin(keys[first], common)
            smallest = np.repeat(entities[first], size)
            star = entities != smallest
            found.append((PAIR, entities[star], smallest[star]))
            of_hot = np.repeat(hot, size)
            found.append((MEMBER, keys[of_hot].view(np.int64), entities[of_hot]))
            group = np.add.reduceat(mix(entities.view(np.uint64)), first)
            cold = np.flatnonzero((size > 2) & ~hot)
            once = np.zeros(len(first), bool)
            once[cold[np.unique(group[cold], return_index=True)[1]]] = True
            small = np.repeat(once, size)
            found.append((PART, np.repeat(group, size)[small].view(np.int64), entities[small]))
        out = [pd.DataFrame({"kind": np.int32(k), "a": a, "b": b}).drop_duplicates() for k, a, b in found if len(a)]
        return pd.concat(out) if out else pd.DataFrame({"kind": pd.Series(dtype="int32"), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})

    return packed.groupBy("range").applyInPandas(lean_group(run), "kind int, a long, b long")


def candidate_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """entity, lo, n, shingles of the documents with these ids."""

    def made(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])], names=["entity", "lo", "n", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, s in shingle_sets(batch.column(1), words):
                if len(s):
                    rows.append((*digest(s), len(s), s.tobytes()))
                if len(rows) >= 512:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    return semi(_source(docs), ids, ["id"]).mapInArrow(lean(run), "entity long, lo long, n long, shingles binary")


def _allowed(percent: int):
    """Whether the sizes na, nb and sketches ka, kb of a pair allow a link."""
    words = (F.bit_count(F.col("ka")[i].bitwiseXOR(F.col("kb")[i])) for i in range(SKETCH_BITS // 64))
    near = reduce(add, words) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & near


def _sharper(named: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that wide sketches allow as well; a pair of sets of
    which one has none stays. Allowed sizes differ by less than two, so one
    fold makes two wide sketches equally long."""
    side = lambda x: named.filter("wide IS NOT NULL").select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    size = F.least(F.size("wa"), F.size("wb"))

    def folded(w: str):
        halves = F.zip_with(F.slice(w, F.lit(1), size), F.slice(w, size + 1, size), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(w) > size, halves).otherwise(F.col(w))

    far = F.aggregate(F.zip_with(folded("wa"), folded("wb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    near = far * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    alone = F.col("wa").isNull() | F.col("wb").isNull()
    return both.filter(F.when(alone, F.lit(True)).otherwise(near)).select("a", "b")


def _verified(docs: DataFrame, named: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b: nodes) that are linked, by their wide sketches and then
    their shingle sets."""
    pairs = stored(_sharper(named, pairs, percent), "sharper")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = candidate_sets(docs, nodes, words).join(named.select("entity", "lo", "n", "node"), ["entity", "lo", "n"])
    sets = stored(sets.select("node", "shingles"), "candidate-sets")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for sa, sb in zip(pdf["sa"], pdf["sb"]):
                both = len(np.intersect1d(np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(sa) + len(sb)) // 8 - both))
            yield pdf.loc[keep, ["a", "b"]]

    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInPandas(lean(run), "a long, b long").distinct()


def _common_pairs(groups: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs within common parts (columns part, node, n, component, sketch)
    that different components and sketches allow, block against block. Linked
    sets meet in the larger one's own band, so parts of a band above that of
    all their members are left out. With
    ``forest`` a block gives only pairs that join its components into the
    fewest possible, the nearest ones first."""
    salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS))
    low = F.element_at(F.array(*[F.lit(x) for x in bands(percent)[0]]), F.col("part").bitwiseAND(F.lit(255)).cast("int") + 1)
    counts = groups.groupBy("part").agg(
        F.max("n").alias("largest"), F.count("*").alias("size"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.bit_xor(F.xxhash64("node")).alias("members"))
    counts = counts.filter("c1 <> c2").filter(F.col("largest") >= low).groupBy("size", "members").agg(F.min("part").alias("part"))
    counts = counts.select("part", F.ceil(F.col("size") / BLOCK).alias("blocks"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    rows = groups.withColumn("salt", salt).join(counts, ["part", "salt"]).drop("salt")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        node, n, label, block = (pdf[c].to_numpy().copy() for c in ("node", "n", "component", "block"))
        same = pdf["lo"].iloc[0] == pdf["hi"].iloc[0]
        left = np.arange(len(pdf)) if same else np.flatnonzero(block == pdf["lo"].iloc[0])
        right = left if same else np.flatnonzero(block == pdf["hi"].iloc[0])
        out = [np.zeros((0, 2), np.int64)]
        for share in (SURE, 1.0) if forest else (1.0,):
            for k, i in enumerate(left):
                others = right[k + 1:] if same else right
                others = others[label[others] != label[i]]
                others = others[np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent]
                if not len(others):
                    continue
                far = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1) * (100 + percent) / ((n[others] + n[i]) * (100 - percent))
                fits = far <= share
                hits = others[fits]
                if forest and len(hits):
                    hits = hits[np.argsort(far[fits], kind="stable")]
                    joined, nearest = np.unique(label[hits], return_index=True)
                    hits = hits[nearest]
                    label[np.isin(label, joined)] = label[i]
                out.append(np.stack([np.minimum(node[hits], node[i]), np.maximum(node[hits], node[i])], axis=1))
        out = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    # by block, not by part alone: the join's exchange would serve the grouping
    rows = rows.repartition("part", "lo", "hi")
    return rows.groupBy("part", "lo", "hi").applyInPandas(run, "a long, b long").distinct()


def _shared_of(docs: DataFrame, ranges: int, words: int, percent: int, spare: float, flush_group: int) -> DataFrame:
    """``shared_parts`` of these documents, stored."""
    return stored(shared_parts(packed_parts(docs, ranges, words, percent, spare, flush_group)), "shared-parts")


def _stars(found: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """a, b: nodes of the stars in ``found`` that sizes and sketches allow."""
    stars = found.filter(F.col("kind") == PAIR).select(F.col("a").alias("ea"), F.col("b").alias("eb")).distinct()
    end = lambda x: named.select(F.col("entity").alias(f"e{x}"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    stars = stars.join(end("a"), "ea").join(end("b"), "eb").filter(_allowed(percent)).filter("a <> b")
    return stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _short(found: DataFrame) -> DataFrame:
    """entity, band, parts: classes with more common parts than parts beyond
    D + 1, and as many of their common parts as they have more, the first by
    their keys. Linked sets share more parts than either has beyond D + 1, so
    two that share only common parts are both short, and the first part that
    they share is among these of both."""
    member = F.col("kind") == MEMBER
    rows = found.filter(member | (F.col("kind") == EXTRA)).select(
        F.col("b").alias("entity"), F.when(member, F.col("a").bitwiseAND(F.lit(255))).otherwise(F.shiftright("a", 32)).alias("band"), F.when(member, F.col("a")).alias("part"),
        F.when(~member, F.col("a").bitwiseAND(F.lit((1 << 32) - 1)) - _ZERO).alias("extra"))
    held = rows.groupBy("entity", "band").agg(F.collect_set("part").alias("parts"), F.min("extra").alias("extra"))
    held = held.withColumn("short", F.greatest(F.size("parts") - F.col("extra"), F.lit(0)).cast("int")).filter("short > 0")
    return held.select("entity", "band", F.slice(F.array_sort("parts"), F.lit(1), F.col("short")).alias("parts"))


def link_table(docs: DataFrame, table: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between classes, named by their smallest ids, that give
    the components of all linked documents. ``table``: ``set_table(docs)``."""
    empty = docs.sparkSession.createDataFrame([], "a long, b long")
    first = F.min(F.when(F.col("id") > NO_ID, F.col("id")))
    classes = table.filter("n > 0").groupBy("hi", "lo", "n").agg(F.coalesce(first, F.lit(NO_ID)).alias("node"), F.min("sketch").alias("sketch"), F.min("wide").alias("wide"))
    classes = stored(classes.withColumnRenamed("hi", "entity"), "classes")
    total = classes.agg(F.sum("n")).first()[0]
    if not total:
        return empty
    found = _shared_of(docs, max(8, -(-total * 6 // (10 * RANGE))), words, percent, SPARE, FLUSH_GROUP)
    ends = found.filter(F.col("kind") != EXTRA).select(F.explode(F.when(F.col("kind") == PAIR, F.array("a", "b")).otherwise(F.array("b"))).alias("entity")).distinct()
    named = stored(classes.join(ends, "entity", "left_semi"), "candidates")

    stars = stored(_stars(found, named, percent), "stars")
    links, tried = stored(_verified(docs, named, stars, words, percent), "star-links"), stars

    def placed() -> DataFrame:
        lean_driver(docs.sparkSession)
        own = components(links)
        return stored(named.drop("wide").join(own, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")

    now = placed()
    short = named.join(_short(found).select("entity").distinct(), "entity", "left_semi").select(F.col("node").alias("id"), "n")
    short = stored(short, "short")
    n_short = short.agg(F.sum("n")).first()[0]
    any_short = bool(n_short)
    cold = found.filter(F.col("kind") == PART)
    if any_short:
        few = semi(_source(docs), short.select("id"), ["id"])
        fine = _shared_of(few, max(FINE_RANGES, -(-n_short * 22 // (10 * RANGE))), words, percent, FINE, GROUP)
        cold = cold.union(fine.filter(F.col("kind") == PART))
        members = stored(_short(fine).select("entity", F.posexplode("parts").alias("place", "part")), "short-members")
    in_common = lambda rows: rows.join(now, "entity").select("part", "node", "n", "component", "sketch")
    if any_short:
        pairs = _common_pairs(in_common(members.filter(F.col("place") < FOREST_PARTS)), percent, forest=True).union(_stars(fine, named, percent)).distinct()
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "forest")
        if not pairs.isEmpty():
            tried = tried.union(pairs)
            links = stored(links.union(_verified(docs, named, pairs, words, percent)), "forest-links")
            now = placed()

    small = cold.select(F.col("a").alias("part"), F.col("b").alias("entity")).distinct().join(now, "entity").select("part", "node", "n", "component", "sketch")
    spread = small.groupBy("part").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("part")
    small = stored(small.join(spread, "part", "left_semi"), "small-groups")
    one = small.select("part", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("sketch").alias("ka"))
    two = small.select(F.col("part").alias("part_b"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("sketch").alias("kb"))
    pairs = one.join(two, F.col("part") == F.col("part_b")).filter("a < b and ca <> cb").filter(_allowed(percent)).select("a", "b").distinct()
    if any_short:
        pairs = pairs.union(_common_pairs(in_common(members), percent, forest=False)).distinct()
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "late-pairs")
    if pairs.isEmpty():
        return links
    return links.union(_verified(docs, named, pairs, words, percent))


def near_copies(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest id
    reachable by links, its own included."""
    lean_driver(docs.sparkSession)
    with small_batches(docs.sparkSession):
        table = stored(set_table(docs, words), "sets")
        links = stored(link_table(docs, table, words, percent), "all-links")
    lean_driver(docs.sparkSession)
    named = components(links)
    table = table.drop("sketch", "wide")
    classes = table.filter("n > 0").groupBy("hi", "lo", "n").agg(F.min(F.when(F.col("id") > NO_ID, F.col("id"))).alias("first"))
    classes = classes.withColumn("node", F.coalesce("first", F.lit(NO_ID))).join(named, "node", "left")
    classes = classes.select("hi", "lo", "n", F.coalesce("component", "node").alias("component"))
    rows = table.join(classes, ["hi", "lo", "n"], "left")
    shown = lambda c: F.when(c > NO_ID, c)
    return rows.select(shown(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                       shown(F.coalesce("component", "id")).alias("component_id"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that stay, one of each component, with all columns.
    Documents without words stay."""
    found = stored(near_copies(docs, words, percent), "near-copies")
    return anti(docs, found.filter("component_id <> doc_id").select("doc_id").distinct(), ["doc_id"])
