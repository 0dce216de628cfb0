"""Alignment of two tokenizers' tokens (operator 11).

Both tokenizers encode a space and the text; their tokens are byte ranges of the
same string. Per batch of documents, ``pandas.merge_asof`` keyed by document
finds for each token of one side the other side's token that covers its first
byte. The union of both directions holds every overlapping pair once; the pairs
that end together are the links, and their ends cut both sequences into the
smallest groups that cover the same bytes.

An id pair's count is the number of links in the corpus that hold it. Documents
keep their distinct id pairs with how often each occurs; pairs are counted from
those and the counts join back. Pairs held by at least one in HEAVY of all
(document, pair) rows number at most HEAVY, so that these are shipped to every
executor whatever the corpus; the others shuffle, and none of them is a large
part of the rows.

Files are read on the driver and shipped (0.5 to 2 MB, constants of the
vocabularies). Encoding and aligning are a map over slices of SLICE_BYTES of
text, a longer text is handled alone; the result is stored, so a lost executor
costs unfinished tasks.

Defined results: a text that is null, empty, or not given back byte for byte by
both sides (U+2581 reads as a space on side B) has no tokens: zeros, '' as
digest, empty lists. Special tokens' strings in a text are plain text. Repeated
rows, and rows with equal or null ids, are documents of their own and count
each; ties between pairs all count as best; an empty table gives an empty table;
columns other than ``doc_id`` and ``text`` play no part.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import stored

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20
#: Most pairs whose counts are shipped to every executor.
HEAVY = 1 << 16
#: Blank runs that the faster byte-level encoder's pattern engine cannot take.
_LONG_BLANKS = re.compile(r"\s{4000}")

DIGESTS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, "
           "pairs array<long>, times array<int>")
ALIGNED = ("doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int>>, "
           "groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>")


class Side:
    """A tokenizer: ``encode`` gives each text's ids, ``tokens`` each id's bytes."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        # decimal ids as they stand in a group: not at its end, and at its end
        self.inner, self.last = [f"{i}," for i in range(len(tokens))], [str(i) for i in range(len(tokens))]
        self.lossless = False


def byte_level(file: bytes) -> Side:
    """Side A: byte-level BPE of a tokenizers file, of a space and the text."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = json.loads(file)["model"]
    own = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    rest = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"] for t in json.loads(file)["added_tokens"]}
    tokens = [b""] * (max(model["vocab"].values()) + 1)
    for name, i in model["vocab"].items():
        tokens[i] = b"" if name in special else bytes(map(byte.__getitem__, name))
    library = Tokenizer.from_buffer(file)
    library.encode_special_tokens = True
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    fast = None
    if all(model["vocab"][a + b] == 256 + i for i, (a, b) in enumerate(merges)):  # ids are ranks
        # the pattern of the file's byte-level splitter: a fixed value
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})

    def one(text: str) -> list[int]:
        if fast is None or _LONG_BLANKS.search(text):
            return library.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    side = Side(lambda texts: [one(" " + t) for t in texts], tokens)
    side.lossless = {bytes([b]) for b in range(256)} <= set(tokens)  # then every text is given back
    return side


def pieces(file: bytes) -> Side:
    """Side B: a sentencepiece model, which itself puts a space before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=file)
    tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()
              for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return Side(lambda texts: model.encode(texts, num_threads=1), tokens)


def _side(name: str, file: bytes) -> Side:
    return byte_level(file) if name.endswith(".json") else pieces(file)


class Aligned:
    """A slice of texts: ids, documents and byte ranges of both sides' tokens,
    overlapping pairs (token numbers, in order), and which of them are links."""

    def __init__(self, texts: list[str], a: Side, b: Side):
        ids = []
        for side in (a, b):
            ids.append(side.encode(texts))
        for i, text in enumerate(texts):
            want = b" " + text.encode()
            if not text or any(b"".join(map(side.tokens.__getitem__, x[i])) != want for side, x in zip((a, b), ids) if not side.lossless):
                ids[0][i] = ids[1][i] = []
        self.sides = []
        for side, each in zip((a, b), ids):
            counts = np.array([len(x) for x in each], np.int64)
            flat = np.fromiter(chain.from_iterable(each), np.int64, int(counts.sum()))
            end = np.cumsum(side.sizes[flat])
            self.sides.append(pd.DataFrame({"doc": np.repeat(np.arange(len(texts)), counts), "start": end - side.sizes[flat], "id": flat, "end": end}))
            self.sides[-1]["no"] = np.arange(len(flat))
        self.counts = [np.bincount(s["doc"], minlength=len(texts)) for s in self.sides]
        left, right = (s[["doc", "start", "no"]] for s in self.sides)
        # start runs on over documents, as both sides cover the same bytes
        over_b = pd.merge_asof(left, right, on="start", by="doc", suffixes=("_a", "_b"))
        over_a = pd.merge_asof(right, left, on="start", by="doc", suffixes=("_b", "_a"))
        inner = over_a["start"].to_numpy() > self.sides[0]["start"].to_numpy()[over_a["no_a"].to_numpy()]  # not found from A
        both = pd.concat([over_b[["doc", "start", "no_a", "no_b"]], over_a.loc[inner, ["doc", "start", "no_a", "no_b"]]])
        self.overlaps = both.sort_values("start", kind="stable", ignore_index=True)
        of_a, of_b = self.overlaps["no_a"].to_numpy(), self.overlaps["no_b"].to_numpy()
        together = self.sides[0]["end"].to_numpy()[of_a] == self.sides[1]["end"].to_numpy()[of_b]
        self.links = self.overlaps[together]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of the group that each token of either side is in."""
        ends = self.sides[0]["end"].to_numpy()[self.links["no_a"].to_numpy()]
        return tuple(np.searchsorted(ends, s["end"].to_numpy()) for s in self.sides)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - 1) // SLICE_BYTES
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            piece = batch.slice(int(rows[0]), len(rows))
            yield piece, [t or "" for t in piece.column("text").to_pylist()]


def _names(a: Side, b: Side) -> list[str]:
    """What stands for a token in a group's text: A's ids, then A's at the end of
    their part, then B's likewise."""
    return a.inner + [n + "|" for n in a.last] + b.inner + [n + ";" for n in b.last]


def _group_digests(x: Aligned, a: Side, b: Side, names: list[str]) -> list[str]:
    """Per text, the digest of ``a1,a2|b1;a3|b2,b3``."""
    in_a, in_b = x.groups()
    # each token's place when the groups' A tokens stand before their B tokens
    at_a = np.arange(len(in_a)) + np.searchsorted(in_b, in_a)
    at_b = np.arange(len(in_b)) + np.searchsorted(in_a, in_b, "right")
    codes = np.zeros(len(in_a) + len(in_b), np.int64)
    first_b = 2 * len(a.tokens)
    for side, at, group, table, base in ((0, at_a, in_a, a, 0), (1, at_b, in_b, b, first_b)):
        last = np.append(group[1:] != group[:-1], True)[:len(group)]
        codes[at] = x.sides[side]["id"].to_numpy() + base + len(table.tokens) * last
    whole = list(map(names.__getitem__, codes.tolist()))
    out, at = [], 0
    for n in (x.counts[0] + x.counts[1]).tolist():
        out.append(hashlib.sha256("".join(whole[at: at + n])[:-1].encode()).hexdigest() if n else "")
        at += n
    return out


def _digest_batch(piece: pa.RecordBatch, texts: list[str], a: Side, b: Side, names: list[str]) -> pa.RecordBatch:
    x = Aligned(texts, a, b)
    n = len(texts)
    doc = x.links["doc"].to_numpy()
    pair = x.sides[0]["id"].to_numpy()[x.links["no_a"].to_numpy()] << 32 | x.sides[1]["id"].to_numpy()[x.links["no_b"].to_numpy()]
    distinct, which = np.unique(pair, return_inverse=True)
    held, times = np.unique(doc * max(len(distinct), 1) + which, return_counts=True)
    offsets = np.searchsorted(held // max(len(distinct), 1), np.arange(n + 1)).astype(np.int32)
    links = pa.array(np.bincount(doc, minlength=n).astype(np.int64))
    pairs = pa.array(distinct[held % max(len(distinct), 1)] if len(held) else np.zeros(0, np.int64), pa.int64())
    return pa.RecordBatch.from_arrays([
        piece.column("row"), piece.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in x.counts), links, links,
        pa.array(np.bincount(x.overlaps["doc"], minlength=n).astype(np.int64)), pa.array(_group_digests(x, a, b, names), pa.string()),
        pa.ListArray.from_arrays(pa.array(offsets), pairs), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int32)))],
        names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs", "times"])


def _aligned_batch(piece: pa.RecordBatch, texts: list[str], a: Side, b: Side, names: list[str]) -> pa.RecordBatch:
    x = Aligned(texts, a, b)
    rows: list[list] = [[], [], [], []]
    first = [np.concatenate([[0], np.cumsum(c)]) for c in x.counts]
    in_group = x.groups()
    by = [{k: g.index.to_numpy() for k, g in t.groupby("doc")} for t in (x.overlaps, x.links)]
    for i in range(len(texts)):
        a0, a1, b0, b1 = first[0][i], first[0][i + 1], first[1][i], first[1][i + 1]
        rows[0].append(x.sides[0]["id"].to_numpy()[a0:a1].tolist())
        rows[1].append(x.sides[1]["id"].to_numpy()[b0:b1].tolist())
        over = x.overlaps.loc[by[0].get(i, [])]
        rows[2].append([{"a": int(p - a0), "b": int(q - b0)} for p, q in zip(over["no_a"], over["no_b"])])
        cut = [np.flatnonzero(np.diff(g[s:e], prepend=-1)).tolist() + [e - s] for g, s, e in ((in_group[0], a0, a1), (in_group[1], b0, b1))]
        rows[3].append([{"a_from": s, "a_to": e, "b_from": p, "b_to": q} for s, e, p, q in zip(cut[0], cut[0][1:], cut[1], cut[1][1:])])
    schema = pa.struct([("a", pa.int32()), ("b", pa.int32())]), pa.struct([(k, pa.int32()) for k in ("a_from", "a_to", "b_from", "b_to")])
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), *map(pa.list_, schema)]
    return pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds))], names=["doc_id", "a_ids", "b_ids", "overlaps", "groups"])


def _mapped(docs: DataFrame, a_path: str, b_path: str, make, schema: str) -> DataFrame:
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:
            files.append((os.path.basename(path), f.read()))
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (_side(*f) for f in shared.value)
        names = _names(a, b)
        for piece, texts in _slices(batches):
            yield make(piece, texts, a, b, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, a_ids, b_ids, overlaps (pairs of token
    numbers), groups (ranges of token numbers on both sides)."""
    return _mapped(docs, a_path, b_path, _aligned_batch, ALIGNED)


def _held(table: DataFrame) -> DataFrame:
    """row, pair, times of every document's distinct id pairs."""
    return table.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", "p.pairs", "p.times").withColumnRenamed("pairs", "pair")


def pair_counts(table: DataFrame) -> DataFrame:
    """pair (A id * 2^32 + B id), count, rows (documents), best (whether no pair
    with its B id has a higher count)."""
    counts = stored(_held(table).groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows")), "pair-counts")
    of = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(of.alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", of).join(highest, "b").select("pair", "count", "rows", (F.col("count") == F.col("highest")).alias("best"))


def dictionary(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """a_id, b_id, count, rows, best of every id pair that ends together."""
    counts = pair_counts(stored(_mapped(docs, a_path, b_path, _digest_batch, DIGESTS), "aligned"))
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b_id"), "count", "rows", "best")


def digests(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256, n_overlaps."""
    table = stored(_mapped(docs, a_path, b_path, _digest_batch, DIGESTS), "aligned")
    counts = stored(pair_counts(table), "pairs")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first().n
    heavy = F.col("rows") * HEAVY >= total  # of these, at most HEAVY exist
    some = counts.filter(heavy).select("pair", "count", "best")
    rest = counts.filter(~heavy).select("pair", F.col("count").alias("rare_count"), F.col("best").alias("rare_best"))
    rows = _held(table).join(F.broadcast(some), "pair", "left")
    known = rows.filter(F.col("count").isNotNull()).select("row", "times", "count", "best")
    rare = rows.filter(F.col("count").isNull()).select("row", "pair", "times").join(rest, "pair").select("row", "times", F.col("rare_count").alias("count"), F.col("rare_best").alias("best"))
    sums = known.unionByName(rare).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = table.drop("pairs", "times").join(sums, "row", "left")
    whole = {c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")}
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole["n_best"], whole["count_sum"], "groups_sha256", "n_overlaps")
