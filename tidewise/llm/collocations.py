"""Phrase collocations by HAT-trie counting (operator 12).

Texts are lower-cased (A-Z) and cut into pieces at punctuation and line ends,
pieces into words. Of the phrases of 2 to 5 words within a piece that occur
``min_count`` times in a language, the ones whose weakest cut

    score = min over k of floor(1000 * a * n / (f(first k words) * f(rest)))

is highest are returned; phrases that a longer one contains (almost) every time
are dropped. See ``collocations``.

Counting. A task keeps its phrases in a HAT-trie: hash containers of word-id
strings under a shallow trie of first words; a container that outgrows BURST
entries bursts into one container per next word. Beyond SPILL entries, whole
subtrees leave the task as runs sorted by their words, largest subtrees first,
until half is free; the rest leaves at its end. Runs are merged per partition of
(language, phrase): the prefix that deals them out is the whole phrase, so that a
hot prefix spreads over all tasks, and a hot phrase is one row per run. Word ids belong to a task's trie and are given by the exact words, so no
two words or phrases are ever taken for one.

Three passes over the texts count words, pairs, and phrases of 3 to 5 words.
A phrase cannot be frequent unless all its parts are, so pass 2 only counts
pairs of frequent words and pass 3 phrases of frequent pairs. Which ones are
frequent is told to the tasks by a bitmap of 2^FILTER_BITS bits, 16 MB whatever
the corpus; a wrong yes costs time and is corrected by the count, a wrong no
cannot occur. All counts are therefore exact and cover all documents.

Memory in a task: a slice of SLICE_BYTES of text (or one longer text), the trie
and the bitmap. Scores are exact: 38-digit decimals hold 1000 * a * n up to 10^17
words a language.

Defined results: a null text is empty, a null lang ``und``; empty texts, repeated
rows (each counts), very long texts and an empty table (no rows) work. Ties in
score and count are ordered by phrase in UTF-8 byte order, ties between cuts go
to the smallest k. Columns other than ``text`` and ``lang`` play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored
from .words import LOWER, buffers, mix

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 4 << 20
#: Entries of a container, and of a trie, before it bursts or spills.
BURST, SPILL = 8192, 400_000
#: log2 of the bits of a pruning bitmap.
FILTER_BITS = 27
#: Bits of one row of Spark's bitmap functions.
_ROW_BITS = 32768

LONGEST = 5

_PIECE_END = np.zeros(256, bool)
_PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n_words", pa.int32()), ("f", pa.int64())])
_U = np.uint64


class Words:
    """The words of a slice of texts: ``ids`` into ``strings`` in order, the
    number of the ``piece`` each is in, and the text it is in."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffers(texts)
        if not len(raw):
            self.ids = self.piece = self.text = np.zeros(0, np.int64)
            self.strings = pa.array([], pa.large_string())
            return
        raw = LOWER[raw]
        cut = _PIECE_END[raw]
        inside = ~(cut | _BLANK[raw])
        cut[offsets[:-1][offsets[:-1] < len(raw)]] = True  # a text's first byte begins a piece, or ends an empty one
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:]
        starts = np.flatnonzero(first)
        self.piece = np.cumsum(cut)[starts]
        self.text = np.searchsorted(offsets, starts, "right") - 1
        lengths = np.bincount(np.cumsum(first)[inside] - 1, minlength=len(starts))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        each = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[inside])))
        coded = each.dictionary_encode()
        self.ids, self.strings = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, Words]]:
    """(languages, each text's language, words) of slices of texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - 1) // SLICE_BYTES
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            piece = batch.slice(int(rows[0]), len(rows))
            langs = piece.column("lang").dictionary_encode()
            yield langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False), Words(piece.column("text"))


def _hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    raw, offsets = buffers(strings)
    total = np.zeros(len(raw) + 1, np.uint64)
    place = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    with np.errstate(over="ignore"):
        np.cumsum(mix(raw.astype(np.uint64) + _U(1) + (place.astype(np.uint64) << _U(8))), out=total[1:])
        return mix(total[offsets[1:]] - total[offsets[:-1]])


def _follow(hashes: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The hashes of phrases that another word follows."""
    with np.errstate(over="ignore"):
        return mix(hashes * _U(0x9E3779B97F4A7C15) + more)


class Filter:
    """A fixed-size bitmap of hashes, two bits each."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (hashes >> _U(64 - FILTER_BITS)).astype(np.int64), (hashes & _U((1 << FILTER_BITS) - 1)).astype(np.int64)

    def __contains__(self, hashes):
        raise TypeError("use holds()")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        return ((self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


class HatTrie:
    """Counts of word-id strings (rows of a matrix, 0-padded at the end)."""

    def __init__(self, width: int):
        self.width, self.size, self.root = width, 0, {}

    def add(self, rows: np.ndarray) -> None:
        """Count each row once."""
        if not len(rows):
            return
        keys, counts = np.unique(np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.width}").ravel(), return_counts=True)
        self._insert(self.root, keys.tolist(), counts.tolist(), 0)

    def _insert(self, node: dict, keys: list[bytes], counts: list[int], depth: int) -> None:
        """Sorted keys, of which ``depth`` words lead to the node."""
        at, i, n = 4 * depth, 0, len(keys)
        while i < n:
            word = keys[i][at: at + 4]
            j = i + 1
            while j < n and keys[j][at: at + 4] == word:
                j += 1
            child = node.get(word)
            if child is None:
                child = node[word] = Counter()
            if type(child) is dict:
                self._insert(child, keys[i:j], counts[i:j], depth + 1)
            else:
                before = len(child)
                for key, count in zip(keys[i:j], counts[i:j]):
                    child[key[at + 4:]] += count
                self.size += len(child) - before
                if len(child) > BURST and depth + 2 < self.width:
                    node[word] = self._burst(child)
            i = j

    def _burst(self, container: Counter) -> dict:
        node: dict = {}
        for key, count in container.items():
            node.setdefault(key[:4], Counter())[key[4:]] = count
        return node

    def _entries(self, child, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        prefix = prefix.ljust(-len(prefix) % 4 + len(prefix), b"\0")  # numpy drops zero bytes at a key's end
        for key, value in child.items():
            if type(child) is dict:
                yield from self._entries(value, prefix + key)
            else:
                yield prefix + key, value

    def _weight(self, child) -> int:
        return sum(map(self._weight, child.values())) if type(child) is dict else len(child)

    def take(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, counts) of whole subtrees, the largest first, taken out until
        at most ``keep`` entries stay."""
        keys: list[bytes] = []
        counts: list[int] = []
        for word, weight in sorted(((w, self._weight(c)) for w, c in self.root.items()), key=lambda x: -x[1]):
            if self.size <= keep:
                break
            for key, count in self._entries(self.root.pop(word), word):
                keys.append(key)
                counts.append(count)
            self.size -= weight
        rows = np.array(keys, f"S{4 * self.width}").view(">u4").reshape(-1, self.width).astype(np.int64)
        return rows, np.array(counts, np.int64)


def _prefix_counts(rows: np.ndarray, counts: np.ndarray, shortest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, distinct prefixes of n words, how often they occur) of sorted rows."""
    for n in range(shortest, rows.shape[1] + 1):
        long = rows[:, n - 1] > 0
        head, weight = rows[long, :n], counts[long]
        if len(head):
            new = np.concatenate([[True], (head[1:] != head[:-1]).any(axis=1)])
            yield n, head[new], np.add.reduceat(weight, np.flatnonzero(new))


class Counting:
    """One task's trie and the words that its ids stand for."""

    def __init__(self, shortest: int, longest: int):
        self.shortest, self.trie = shortest, HatTrie(longest)
        self.known: dict[tuple[str, str], int] = {}

    def add(self, langs: list[str], lang: np.ndarray, words: Words, frequent: Filter) -> None:
        """Count the slice's phrases whose parts of shortest - 1 words are frequent."""
        m, width = len(words.ids), self.trie.width
        if m < self.shortest:
            return
        of = lang[words.text]
        lang_hash, word_hash = _hashes(pa.array(langs, pa.large_string())), _hashes(words.strings)
        part = word_hash[words.ids]
        for k in range(1, self.shortest - 1):
            part = _follow(part[:-1], word_hash[words.ids[k:]])
        part = frequent.holds(_follow(part, lang_hash[of[:len(part)]]))  # the part of shortest - 1 words from here
        lead = self.shortest - 1
        ids = np.zeros(m + width, np.int64)
        ids[:m] = words.ids + of * len(words.strings)
        piece = np.concatenate([words.piece, np.full(width, -1)])
        start = np.flatnonzero(part[:-1] & part[1:] & (piece[:len(part) - 1] == piece[lead:len(part) - 1 + lead]))
        if not len(start):
            return
        rows = np.zeros((len(start), width), np.int64)
        go = np.ones(len(start), bool)
        part = np.concatenate([part, np.zeros(width, bool)])
        for k in range(width):
            if k >= self.shortest:
                go &= (piece[start + k] == piece[start]) & part[start + k - lead + 1]
            rows[:, k] = np.where(go, ids[start + k] + 1, 0)
        distinct, place = np.unique(rows, return_inverse=True)
        new = np.zeros(len(distinct), np.int64)
        strings = words.strings.take(pa.array((distinct[distinct > 0] - 1) % len(words.strings))).to_pylist()
        which = ((distinct[distinct > 0] - 1) // len(words.strings)).tolist()
        known = self.known
        new[distinct > 0] = [known.setdefault((langs[w], s), len(known) + 1) for w, s in zip(which, strings)]
        self.trie.add(new[place].reshape(rows.shape))

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Sorted runs of what leaves the trie."""
        rows, counts = self.trie.take(keep)
        words = list(self.known)
        if not self.trie.size:
            self.known = {}
        if not len(rows):
            return
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.zeros(len(words) + 1, np.int64)
        rank[np.array(order) + 1] = np.arange(1, len(words) + 1)
        rows = rank[rows]
        by = np.lexsort(rows.T[::-1])
        rows, counts = rows[by], counts[by]
        strings = pa.array(["", *(words[i][1] for i in order)], pa.string())
        langs = pa.array(["", *(words[i][0] for i in order)], pa.string())
        for n, heads, f in _prefix_counts(rows, counts, self.shortest):
            for a in range(0, len(heads), 65_536):
                head = heads[a: a + 65_536]
                phrase = pc.binary_join_element_wise(*[strings.take(pa.array(head[:, k])) for k in range(n)], " ")
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(head[:, 0])), phrase, pa.array(np.full(len(head), n, np.int32)), pa.array(f[a: a + 65_536])], schema=_RUN)


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, lang, words in _slices(batches):
        key, f = np.unique(words.ids + lang[words.text].astype(np.int64) * len(words.strings), return_counts=True) if len(words.ids) else (words.ids, words.ids)
        if len(key):
            yield pa.RecordBatch.from_arrays([
                pa.array(langs, pa.string()).take(pa.array(key // len(words.strings))), words.strings.take(pa.array(key % len(words.strings))).cast(pa.string()),
                pa.array(np.ones(len(key), np.int32)), pa.array(f.astype(np.int64))], schema=_RUN)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def count_words(docs: DataFrame) -> DataFrame:
    """lang, phrase, n_words (1), f of every word."""
    runs = _texts(docs).mapInArrow(_word_runs, "lang string, phrase string, n_words int, f long")
    return stored(runs.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")), "words")


def _merged(runs: DataFrame, min_count: int) -> DataFrame:
    """Runs merged; phrases that occur often enough."""
    return stored(runs.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count), "phrases")


def frequent_filter(phrases: DataFrame) -> Filter:
    """The bitmap of phrases (lang, phrase)."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pc.list_parent_indices(parts := pc.split_pattern(batch.column("phrase"), " ")).to_numpy(), _hashes(pc.list_flatten(parts))
            first = np.searchsorted(words[0], np.arange(len(batch)))
            size = np.bincount(words[0], minlength=len(batch))
            h = words[1][first]
            for k in range(1, int(size.max(initial=1))):
                more = size > k
                h[more] = _follow(h[more], words[1][first[more] + k])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(Filter.places(_follow(h, _hashes(batch.column("lang"))))))], names=["place"])

    spots = phrases.select("lang", "phrase").mapInArrow(places, "place long")
    rows = spots.groupBy(F.floor(F.col("place") / _ROW_BITS).alias("row")).agg(F.bitmap_construct_agg(F.pmod("place", F.lit(_ROW_BITS))).alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in rows.toLocalIterator():  # at most 2^FILTER_BITS bits together
        bits[r.row * (_ROW_BITS // 8): (r.row + 1) * (_ROW_BITS // 8)] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits)


def count_phrases(docs: DataFrame, shortest: int, longest: int, parts: DataFrame, min_count: int) -> DataFrame:
    """lang, phrase, n_words, f of the frequent phrases of some lengths, given
    the frequent ones of shortest - 1 words."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_filter(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(shortest, longest)
        for langs, lang, words in _slices(batches):
            counting.add(langs, lang, words, shared.value)
            if counting.trie.size > SPILL:
                yield from counting.runs(SPILL // 2)
        yield from counting.runs(0)

    return _merged(_texts(docs).mapInArrow(run, "lang string, phrase string, n_words int, f long"), min_count)


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, n_words, a, l, r, n, score of the candidates."""
    words = F.split("phrase", " ")

    def some(first: Column, n: Column) -> Column:
        return F.array_join(F.slice("w", first, n), " ")

    cuts = frequent.filter("n_words >= 2").withColumn("w", words).select("lang", "phrase", "n_words", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", some(F.lit(1), F.col("k")).alias("first"), some(F.col("k") + 1, F.col("n_words")).alias("rest"))
    part = frequent.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), "f")
    cuts = cuts.join(part.withColumnRenamed("f", "l"), (F.col("lang") == F.col("of")) & (F.col("first") == F.col("part"))).drop("of", "part")
    cuts = cuts.join(part.withColumnRenamed("f", "r"), (F.col("lang") == F.col("of")) & (F.col("rest") == F.col("part"))).drop("of", "part")
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("over", F.lit(1000).cast("decimal(38,0)") * (wide["a"] * wide["n"])).withColumn("under", wide["l"] * wide["r"])
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase", "n_words").agg(F.min(F.struct("score", "k", "l", "r", "n", "a")).alias("c"))
    return best.select("lang", "phrase", "n_words", "c.a", "c.l", "c.r", "c.n", "c.score")


def _kept(scored: DataFrame, percent: int) -> DataFrame:
    """Candidates without those that a longer one holds at least ``percent`` of
    the time. A longer one that does has a part one word longer that does too."""
    words = F.split("phrase", " ")
    n = F.col("n_words")
    inner = scored.filter(n >= 3).select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), n - 1), " "), F.array_join(F.slice(words, F.lit(2), n - 1), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = scored.join(inner, ["lang", "phrase"], "left")
    return rows.filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, min_count: int = 100, percent: int = 100, top: int = 2000) -> DataFrame:
    """Each language's first ``top`` phrases by score, count and phrase: lang,
    rank, phrase, a, l, r, n, score, n_words.

    a = f(phrase); l and r are those of the two sides of the weakest cut; n is
    the language's number of words. A phrase goes if a longer candidate that
    contains it occurs at least ``percent`` % as often."""
    words = count_words(docs)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    single = stored(words.filter(F.col("f") >= min_count), "frequent-words")
    pairs = count_phrases(docs, 2, 2, single, min_count)
    longer = count_phrases(docs, 3, LONGEST, pairs, min_count)
    scored = stored(_scored(single.unionByName(pairs).unionByName(longer), totals), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # each language's best of 64 parts, then of those: no task orders a language
    kept = _kept(scored, percent).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("n_words").cast("long").alias("n_words"))
