"""BPE encoding and decoding with a tokenizer file in the JSON layout of the
public ``tokenizers`` library (operator 4).

A word's symbols form a doubly linked list; a priority queue of
(merge rank, position) yields the best merge, leftmost first, and entries whose
symbols have changed since they were queued are skipped. Decoding concatenates
the vocabulary strings with the separator that the file's (absent) decoder
implies, one space.

The file is read on the driver and broadcast compressed (1 MB, a constant of the
vocabulary); a worker holds only the codec made from it, not the parsed file. Encoding is a map over Arrow batches: no shuffle,
whole texts, and memory bounded by one batch plus a cache of CACHED words
in a worker, so a lost executor costs its unfinished batches.

Defined results: null and empty texts have no tokens (digests of nothing);
repeated rows give repeated results; an empty table gives an empty table;
columns other than ``doc_id`` and ``text`` are ignored. Characters that Unicode
has added since 15.1 may be lowered or parted otherwise than by the library.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean

#: Words, and blank-separated stretches, whose ids a worker keeps (about 120 MB
#: together); the older half is dropped when full.
CACHED = 300_000

#: Signs after which a stretch of letters needs no pattern to be parted.
ENDS = frozenset(",.;:!?")

#: A queue entry is one integer, rank first, then the position in the word.
POSITION_BITS = 40
POSITION_MASK = (1 << POSITION_BITS) - 1
SEPARATORS = regex.compile("[\x1c-\x1f]")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level files:
    printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    names, spare = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class _Recent(dict):
    """Values of ``make`` for recent keys; when full, the last generation is
    kept for one more round."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most // 2:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encoder and decoder built from a parsed tokenizer file."""

    def __init__(self, spec: dict, cached: int | None = None):
        self.cached = CACHED if cached is None else cached
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        self.pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.pairs)}
        names = _byte_names()
        self.inner = [vocab.get(c) for c in names]
        self.final = [vocab.get(c + self.suffix) for c in names]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.find = regex.compile(splits[0].replace(r"\s", r"\p{White_Space}")).findall
        self.forget()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to one word's symbols."""
        n = len(symbols)
        ranks, pairs = self.ranks, self.pairs
        queue = [rank << POSITION_BITS | i for i, rank in enumerate(map(ranks.get, zip(symbols, symbols[1:]))) if rank is not None]
        if not queue:
            return symbols
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [*symbols, -1]  # the end never matches
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & POSITION_MASK
            left, right, new = pairs[entry >> POSITION_BITS]
            j = after[i]
            if alive[i] != left or alive[j] != right:
                continue  # stale
            alive[i], alive[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get((new, alive[k]))
                if rank is not None:
                    push(queue, rank << POSITION_BITS | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get((alive[h], new))
                if rank is not None:
                    push(queue, rank << POSITION_BITS | h)
        return [x for x in alive if x >= 0]

    def word(self, word: str) -> bytes:
        """The ids of one word, as bytes."""
        raw = word.encode()
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        return array("I", self.merge(symbols if None not in symbols else [s for s in symbols if s is not None])).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """The ids of a normalised stretch of text, as bytes."""
        if chunk.isalpha():
            words = [chunk]
        elif chunk[-1] in ENDS and chunk[:-1].isalpha():
            words = [chunk[:-1], chunk[-1]]
        else:
            words = self.find(chunk)
        return b"".join(map(self.words.__getitem__, words))

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        found: list[bytes] = []
        for part in self.cut.split(text) if self.cut and any(map(text.__contains__, self.special)) else [text]:
            if part in self.special:
                found.append(array("I", [self.special[part]]).tobytes())
                continue
            # Sigma: the library lowers each character alone, without the word-final form
            low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            # str.split also parts at separators that the pattern takes as signs
            found.extend(map(self.chunks.__getitem__, [low] if SEPARATORS.search(low) else low.split()))
        return b"".join(found)

    def forget(self) -> None:
        """Drop the kept encodings."""
        self.words, self.chunks = _Recent(self.word, self.cached), _Recent(self.chunk, self.cached)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.ids(text or ""), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def packed(path: str) -> bytes:
    """The file, as it is shipped to the workers."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


_codecs: dict[int, Codec] = {}


def _codec(shared, cached: int | None = None) -> Codec:
    """One codec per worker process and broadcast file."""
    if id(shared.value) not in _codecs:
        _codecs.clear()
        _codecs[id(shared.value)] = Codec(json.loads(zlib.decompress(shared.value)), cached)
    return _codecs[id(shared.value)]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the token ids (array<int>) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(path))

    @F.pandas_udf("array<int>")
    def ids(texts):
        return texts.map(_codec(shared).encode)

    return docs.select("doc_id", ids("text").alias("ids"))


def digests(docs: DataFrame, path: str, cached: int | None = None) -> DataFrame:
    """Per document: the number of tokens, the digest of the ids as
    little-endian 32-bit integers, and that of the decoded text. ``cached``
    words are kept by a worker until its task ends; without it, CACHED words are
    kept for the worker's later tasks too."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, cached)
        try:
            yield from made(codec, batches)
        finally:
            if cached is not None:
                _codecs.clear()  # the worker goes on with other work

    def made(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids = codec.ids(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(codec.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)
