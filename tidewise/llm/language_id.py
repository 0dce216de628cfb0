"""Language identification by cross-parsing entropy (operator 2).

Per language, a bounded sample of labelled text becomes a suffix automaton. A
text is parsed against it from left to right into longest matches (phrases); a
letter that the sample lacks is a phrase of its own. The language with the
fewest bits per letter wins; ties go to the smaller label. Of a sample of n
letters and A letters in all samples, a match costs log2(n + A) bits and a
letter that the sample lacks log2(A) more, so a short sample is not cheap. A
letter that no sample has costs the same in every language.

The model is bounded by parameters and broadcast: LANG_CHARS letters a language,
SAMPLE_CHARS in all, from as many whole rows as it takes. Every letter is distinct: the
most frequent ones are columns of a table of states, as far as ALPHABET goes;
the transitions of all others are a sorted list.
Scoring is a map over Arrow batches without a shuffle: texts are cut into
stretches of STRETCH letters that are parsed side by side with numpy (a phrase
ends where a stretch ends), so memory is bounded whatever a text's length.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text when no labelled row is given. Copies of a text count once in
the sample. Only ``text`` is an input of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import attach, free_names, is_held_out, stored

LANG_CHARS, SAMPLE_CHARS = 24576, 1 << 18
#: The first share of a language's letters that is drawn, in budgets; what its
#: factor is if that held too few.
DRAWN, MORE = 4, 8
ALPHABET = 128
STRETCH = 512
#: Letters handled at once.
SLICE_CHARS = 1 << 20
#: Letters after which a text's evidence no longer raises the score.
SURE_CHARS = 40

#: Symbols below ALPHABET are columns of a table: SPACE, PAD, RARE (any letter
#: without a column) and letters from LETTER on. ALPHABET + its code point is
#: the symbol of a rare letter.
SPACE, PAD, RARE, LETTER = 0, 1, 2, 3
OWN = ALPHABET - LETTER
#: More than any symbol: (state, symbol) as one number.
SYMBOLS = 1 << 21

_letters: list[np.ndarray] = []


def _lowered() -> np.ndarray:
    """For each code point its lower-case letter, 0 if it is no letter."""
    if not _letters:
        table = np.zeros(0x110000, np.int32)
        for i in chain(range(0xD800), range(0xE000, 0x110000)):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _letters.append(table)
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _plain(points: np.ndarray) -> np.ndarray:
    """Lower-case letters with one 0 for each run of other signs."""
    low = _lowered()[points]
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    return low[keep]


def symbol_table(letters: str) -> np.ndarray:
    """The symbol of each code point: the given letters, most frequent first,
    have a column as far as ALPHABET goes."""
    low = _lowered()
    table = np.where(low > 0, ALPHABET + low, SPACE).astype(np.int64)
    for i, c in enumerate(letters[:OWN]):
        table[ord(c)] = LETTER + i
    return table


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the automaton of all substrings of ``symbols``."""
    go, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return go, last


def parse_table(symbols: list[int], classes: int) -> np.ndarray:
    """The number of states; one number for each (state, column): the state
    after it, times ``classes``, shifted by two bits (whether it ends a match,
    and whether the sample lacks the sign); and (state, symbol, state after it) of rare letters."""
    go, _ = suffix_automaton(symbols)
    next_state = np.full((len(go), classes), -1, np.int64)
    rare = []
    for state, edges in enumerate(go):
        for symbol, after in edges.items():
            if symbol < classes:
                next_state[state, symbol] = after
            else:
                rare += [state, symbol, after]
    root = next_state[0].copy()
    ended = np.zeros_like(next_state)
    missing = next_state < 0
    ended += missing & (np.arange(len(go)) > 0)[:, None]  # the phrase so far
    ended += 2 * (missing & (root < 0)[None, :])  # the sign alone
    next_state = np.where(missing, np.maximum(root, 0)[None, :], next_state)
    ended[0, PAD], next_state[:, PAD] = 0, 0
    ended[1:, PAD] = 1  # the end of a stretch ends its phrase
    return np.concatenate([[len(go)], (next_state * classes << 2 | ended).ravel(), rare]).astype(np.int32)


class Parser:
    """Phrase counts of texts against every language's automaton."""

    def __init__(self, letters: str, classes: int, models: list[tuple[str, int, bytes]]):
        models = sorted(models)
        self.langs = np.array([m[0] for m in models], object)
        self.symbols = symbol_table(letters)
        tables, rare, self.roots, at = [], [], [], 0
        for _, _, raw in models:
            numbers = np.frombuffer(raw, np.int32)
            cells = int(numbers[0]) * classes
            tables.append(numbers[1:1 + cells] + (at << 2))
            edges = numbers[1 + cells:].reshape(-1, 3).astype(np.int64)
            rare.append(np.stack([(edges[:, 0] * classes + at) * SYMBOLS + edges[:, 1], edges[:, 2] * classes + at], axis=1))
            self.roots.append(at)
            at += cells
        self.table = np.concatenate(tables).astype(np.int32) if tables else np.zeros(0, np.int32)
        edges = np.concatenate([*rare, np.full((1, 2), np.iinfo(np.int64).max)])  # the last is never met
        order = np.argsort(edges[:, 0])
        self.edges, self.after = edges[order, 0], edges[order, 1]
        roots = self.table[np.add.outer(np.array(self.roots, np.int64), np.arange(classes))]
        own = (roots & 2 == 0).any(axis=0)
        own[[PAD, RARE]] = False
        alphabet = int(own.sum()) + len(np.unique(self.edges[:-1] % SYMBOLS))
        self.bits = np.log2([m[1] + alphabet for m in models])
        self.lack_bits = np.log2(max(alphabet, 2))

    def _rare(self, state: np.ndarray, symbols: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state after a rare letter, what it ends, as in ``parse_table``)."""
        def follow(before):
            keys = before * SYMBOLS + symbols
            at = np.searchsorted(self.edges, keys)
            return self.edges[at] == keys, self.after[at]

        known, after = follow(state)
        first, fresh = follow(roots)
        ended = np.where(known, 0, (state != roots) + 2 * ~first)
        return np.where(known, after, np.where(first, fresh, roots)), ended

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, signs by text)."""
        matched, lacking, _, lengths = self._counts(texts)
        return matched + lacking, lengths

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(matches by text and language, signs that the language's sample
        lacks, signs that all samples lack by text, signs by text)."""
        plain = [_plain(_points(t)) for t in texts]
        plain = [p[1 if len(p) and p[0] == 0 else 0:] for p in plain]
        lengths = np.array([len(p) for p in plain], np.int64)
        pieces = -(-lengths // STRETCH)
        rows = int(pieces.sum())
        matched, lacking = np.zeros((2, len(texts), len(self.langs)), np.int64)
        if not rows or not len(self.langs):
            return matched, lacking, np.zeros(len(texts), np.int64), lengths
        grid = np.full(rows * STRETCH, PAD, np.int64)
        starts = np.concatenate([[0], np.cumsum(pieces)[:-1]]) * STRETCH
        flat = self.symbols[np.concatenate(plain)]
        where = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        grid[where] = flat
        steps = np.ascontiguousarray(grid.reshape(rows, STRETCH).T)
        steps = steps[: int(min(STRETCH, lengths.max()))]
        state = np.repeat(np.array(self.roots, np.int64)[:, None], rows, axis=1)
        roots = state.copy()
        count, lacks, nowhere = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.int64), np.zeros(rows, np.int64)
        columns = np.where(steps < ALPHABET, steps, RARE)
        some = (columns == RARE).any(axis=1)
        for step, column, rare in zip(steps, columns, some.tolist()):
            found = self.table.take(state + column)
            ended = found & 3
            if rare:
                at = np.flatnonzero(column == RARE)
                after, ended[:, at] = self._rare(state[:, at], step[at], roots[:, at])
            np.right_shift(found, 2, out=state, casting="unsafe")
            if rare:
                state[:, at] = after
                nowhere[at] += (ended[:, at] > 1).all(axis=0)
            count += ended & 1
            lacks += ended >> 1
        count += state != roots
        owner = np.repeat(np.arange(len(texts)), pieces)
        for k in range(len(self.langs)):
            matched[:, k] = np.bincount(owner, count[k], len(texts)).astype(np.int64)
            lacking[:, k] = np.bincount(owner, lacks[k], len(texts)).astype(np.int64)
        return matched, lacking, np.bincount(owner, nowhere, len(texts)).astype(np.int64), lengths

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores, start, held = [], [], 0, 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (i > start and held + len(texts[i]) > SLICE_CHARS):
                matched, lacking, nowhere, lengths = self._counts(texts[start:i])
                some = lacking - nowhere[:, None]
                cost = (matched * self.bits + some * (self.bits + self.lack_bits)) / np.maximum(lengths, 1)[:, None]
                for row, n in zip(cost, lengths.tolist()):
                    if n and len(row):
                        best = int(np.argmin(row))
                        langs.append(self.langs[best])
                        scores.append(float(1 / np.sum(2.0 ** (-(row - row[best]) * min(n, SURE_CHARS)))))
                    else:
                        langs.append("und")
                        scores.append(0.0)
                start, held = i, 0
            if i < len(texts):
                held += len(texts[i])
        return langs, scores


def sample(docs: DataFrame) -> DataFrame:
    """lang, h, text, each: distinct labelled texts in the order of a hash of
    the text, until a language has ``each`` letters or no more rows.

    Only rows whose hash lies in a share of all hashes are ordered; a language
    that the share gives too few letters gets a larger one."""
    rows = docs.filter(F.col("lang").isNotNull()).select("lang", F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    totals = stored(rows.groupBy("lang").agg(F.sum(F.length("text")).alias("total")), "language-totals")
    each = max(256, min(LANG_CHARS, SAMPLE_CHARS // max(totals.count(), 1)))
    shares = totals.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(float(DRAWN * each)) / F.col("total")).alias("share"))
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 40))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("place", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = None
    while chosen is None or not shares.isEmpty():
        drawn = attach(rows, shares, (F.col("lang") == F.col("l")) & (place < F.col("share") * F.lit(float(1 << 40))))
        drawn = drawn.select("lang", "h", place.alias("place"), letters.alias("n"), "share").dropDuplicates(["lang", "h"])
        drawn = stored(drawn.withColumn("upto", upto).filter(F.col("upto") - F.col("n") < each), "language-rows")
        full = drawn.groupBy("lang").agg(F.max("upto").alias("upto"), F.max("share").alias("share")).filter((F.col("upto") >= each) | (F.col("share") >= 1))
        taken = drawn.join(full.select("lang"), "lang", "left_semi").select("lang", "h", "place")
        chosen = taken if chosen is None else chosen.union(taken)
        shares = shares.join(full.select(F.col("lang").alias("l")), "l", "left_anti")
        shares = stored(shares.select("l", F.least(F.lit(1.0), F.col("share") * MORE).alias("share")), "language-shares")
    chosen = chosen.select(F.col("lang").alias("l"), F.col("h").alias("g"), "place")
    found = attach(rows, chosen, (F.col("lang") == F.col("l")) & (F.col("h") == F.col("g")))
    # a text that is longer than the budget is needed only as far as that
    found = found.withColumn("text", F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, 2 * each + 1))
    return found.dropDuplicates(["lang", "h"]).select("lang", "h", "place", "text", F.lit(each).alias("each"))


def fit(docs: DataFrame) -> tuple[str, int, list[tuple[str, int, bytes]]]:
    """(letters, symbol classes, [(lang, sample length, table)]), its size
    bounded by the module's parameters. ``docs``: the labelled rows to use."""
    rows = stored(sample(docs), "language-sample")
    letters = rows.select(F.explode(F.split(F.lower("text"), "")).alias("c")).filter(F.col("c").rlike(r"^\p{L}$"))
    ranked = letters.groupBy("c").count().orderBy(F.desc("count"), "c").limit(OWN).collect()
    alphabet = "".join(r["c"] for r in ranked)
    classes = LETTER + len(alphabet)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        table, each = symbol_table(alphabet), int(pdf["each"].iloc[0])
        parts = [table[_plain(_points(t))] for t in pdf.sort_values(["place", "h"])["text"]]
        symbols = np.concatenate(parts)[:each].tolist()
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(symbols)], "model": [parse_table(symbols, classes).tobytes()]})

    built = rows.groupBy("lang").applyInPandas(build, "lang string, n long, model binary").collect()
    return alphabet, classes, [(r["lang"], r["n"], bytes(r["model"])) for r in built]


def predictor(spark, model):
    """A column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = Parser(*shared.value)  # one a task: nothing stays in the worker
        for texts in batches:
            langs, scores = parser.predict(texts.fillna("").tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict


def identify(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the
    rows that are not held out (by default a fifth, by crc32 of the id)."""
    held = is_held_out(F.col("doc_id"), 5, 0) if held_out is None else held_out
    model = fit(docs.filter(~held))
    predict = predictor(docs.sparkSession, model)
    rows = docs.select("doc_id", held.alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def identified(docs: DataFrame) -> DataFrame:
    """The documents whose text has a letter, all columns, also where no
    labelled row tells languages apart."""
    model = fit(docs.filter(~is_held_out(F.col("doc_id"), 5, 0)))
    if not model[2]:
        return docs.filter(F.col("text").cast("string").rlike(r"\p{L}"))
    predict = predictor(docs.sparkSession, model)
    name, = free_names(docs, "__lang")
    return docs.withColumn(name, predict(F.col("text").cast("string"))).filter(F.col(name)["score"] > 0).drop(name)
