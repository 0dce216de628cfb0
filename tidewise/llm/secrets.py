"""Secrets in texts: patterns, and character Markov models (operator 13).

Base finds are assignments to names such as ``password``, access keys and long
hexadecimal runs. The method adds tokens that look random: two first-order
Markov chains over characters, one of random strings and one of ordinary
identifiers, give a token t the log-likelihood ratio

    LLR(t) = sum over its transitions (a, b) of log2(P_random(b|a) / P_ordinary(b|a)),

and a token of MIN_TOKEN or more characters is a find if its LLR reaches
MIN_BITS in all and MIN_MEAN a character. Tokens that overlap a base find are
left to it.

The chains are trained from labelled samples (``samples``, or the caller's own):
random are the values that the base patterns found and digests in base 64,
ordinary are the words of the texts outside base finds, as written and in
capitals, neighbouring words joined as identifiers are, and repeated signs. SAMPLE_DOCS texts and SAMPLE_VALUES values bound the fit, both chosen
by hash; everything else covers all documents. A chain is at most 128 x 128
counts whatever the corpus.

Everything is DataFrame operations. The text is read once; only lengths and
matches are kept. Offsets are running sums over a document's matches and
overlaps a sweep in both directions, so a document costs in proportion to its
matches. Nothing is grouped by a value, so a secret in every line is no hot key.

Defined results: a null text counts as empty (no finds); an empty text, an empty
table and a table without base finds work (the random chain is then that of the
digests); very long texts and tokens are handled whole; repeated rows, and rows
with equal or null ids, are documents of their own; ties are impossible, as
spans are ordered by start and kind. Other columns, whatever their names, play
no part and ``redact`` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: The base kinds in order, then the added one.
KINDS = ("assign", "access", "hex")
ADDED = "markov"

#: Fixed by the contract; possessive where what follows cannot match what was
#: taken, and hexadecimal runs start where no run is under way.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([a-z0-9+/_.=-]++)"""
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]++", "hex": "(?<![0-9a-f])[0-9a-f]{16,}+"}
MIN_VALUE, MIN_ACCESS = 12, 18

#: Tokens that the models judge.
MIN_TOKEN, MIN_BITS, MIN_MEAN = 16, 12.0, 0.75
SIGNS = "A-Za-z0-9+/_=-"
TOKEN = rf"(?<![{SIGNS}])[{SIGNS}]{{{MIN_TOKEN},}}+"
#: Characters that a chain can step to, for the smoothing.
ALPHABET = 67

#: Bounds on the labelled sample.
SAMPLE_DOCS, SAMPLE_VALUES = 2000, 20_000
#: One document's part of the sample: at most so many words, spread over it.
SAMPLE_WORDS = 500

_STEPS = 1 << 40


def _pieces(text: Column, pattern: str) -> Column:
    """(length of the text before it, match) of each match in order; the last
    entry has no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0),
                      lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))


def read(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document: row, doc_id and the pieces of each kind and of
    tokens, null where there are none."""
    text = docs.select("doc_id", (row if row is not None else F.monotonically_increasing_id()).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    held = {"assign": t.rlike(ASSIGN), "access": t.contains("AKIA"), "hex": t.rlike(PATTERNS["hex"]), ADDED: t.rlike(TOKEN)}
    return stored(text.select("row", "doc_id", *[F.when(held[k], _pieces(t, p)).alias(k) for k, p in (PATTERNS | {ADDED: TOKEN}).items()]), "secrets")


def _placed(table: DataFrame, kinds: tuple[str, ...], first: int = 0) -> DataFrame:
    """row, kind (number), match, start, end of the matches of some kinds."""
    lists = F.array(*[F.struct(F.lit(first + i).alias("kind"), F.col(k).alias("pieces")) for i, k in enumerate(kinds)])
    rows = table.select("row", F.explode(lists).alias("k")).filter("k.pieces is not null")
    rows = rows.select("row", "k.kind", F.posexplode("k.pieces").alias("i", "p")).select("row", "kind", "i", "p.gap", "p.match")
    order = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order)).filter("match is not null")
    return rows.select("row", "kind", "match", (F.col("end") - F.length("match")).alias("start"), "end")


def _value() -> Column:
    """What a base find discloses: the assigned value, or all of it."""
    return F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 1)).otherwise(F.col("match"))


def base_spans(table: DataFrame) -> DataFrame:
    """row, kind, match, start, end, value of every valid base find."""
    rows = _placed(table, KINDS).withColumn("value", _value())
    n = F.length("value")
    return rows.filter(F.when(F.col("kind") == 0, n >= MIN_VALUE).when(F.col("kind") == 1, n >= MIN_ACCESS).otherwise(True))


def _codes(value: Column) -> Column:
    """The characters' codes after a 0 for the start; other than ASCII count as 127."""
    return F.concat(F.array(F.lit(0)), F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.least(F.ascii(c), F.lit(127))))


def _share(bound: int, total: int) -> float:
    return min(1.0, bound / max(total, 1)) * _STEPS


def _joined(sign: str):
    return lambda p: F.concat(p["a"], F.lit(sign), p["b"])


def _run(sign: str):
    return lambda w: F.regexp_replace(w, ".", sign)


def _identifiers() -> Column:
    """Ordinary strings made of the column words: each word, in capitals too,
    two neighbours joined in the usual ways, and runs of one sign."""
    pairs = F.zip_with("words", F.slice("words", 2, F.size("words")), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b")))
    made = [F.transform(pairs, _joined(sign)) for sign in "_-/"] + [F.transform("words", _run(sign)) for sign in "-_=/+"]
    made += [F.transform(pairs, lambda p: F.concat(p["a"], F.initcap(p["b"]))), F.transform(pairs, lambda p: F.concat(F.initcap(p["a"]), F.initcap(p["b"])))]
    made += [F.transform("words", F.upper), F.transform("words", lambda w: F.repeat(F.substring(w, 1, 1), F.length(w)))]
    return F.concat("words", *made)


def samples(docs: DataFrame, base: DataFrame) -> DataFrame:
    """value, secret: the labelled strings of a bounded sample."""
    hashed = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    few = hashed.filter(F.pmod("h", F.lit(_STEPS)) < F.lit(_share(SAMPLE_DOCS, docs.count()))).groupBy("h").agg(F.min("text").alias("text"))
    text = F.col("text")
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, " ")
    words = F.regexp_extract_all(text, F.lit(rf"[{SIGNS}]{{3,}}"), 0)
    step = F.greatest(F.lit(1), F.ceil(F.size("words") / SAMPLE_WORDS)).cast("int")
    few = few.select(words.alias("words")).withColumn("words", F.filter("words", lambda w, i: i % step == 0))
    few = stored(few, "secret-words")
    ordinary = few.select(F.explode(_identifiers()).alias("value"))
    words = few.select(F.explode("words").alias("value"))
    values = stored(base.groupBy(F.xxhash64("value").alias("h")).agg(F.min("value").alias("value")), "secret-values")
    found = values.filter(F.pmod("h", F.lit(_STEPS)) < F.lit(_share(SAMPLE_VALUES, values.count()))).select("value")
    digests = words.distinct().select(F.base64(F.unhex(F.sha2("value", 256))).alias("value"))
    digests = digests.filter(F.pmod(F.xxhash64("value"), F.lit(_STEPS)) < F.lit(_share(SAMPLE_VALUES, digests.count())))
    return found.unionByName(digests).withColumn("secret", F.lit(True)).unionByName(ordinary.withColumn("secret", F.lit(False)))


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio, in bits, of each transition (128 x 128, row by
    row) from labelled strings (value, secret)."""
    codes = samples.filter("value is not null").select("secret", _codes(F.col("value")).alias("c"))
    steps = codes.select("secret", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c")), lambda a, b: a * 128 + b)).alias("step"))
    seen: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in steps.groupBy("secret", "step").agg(F.count("*").alias("n")).collect():  # at most 2 x 128 x 128 rows
        seen[r.secret][r.step] = r.n

    def chain(counts: dict[int, int]) -> list[float]:
        sums = [0] * 128
        for step, n in counts.items():
            sums[step // 128] += n
        return [math.log2((counts.get(step, 0) + 1) / (sums[step // 128] + ALPHABET)) for step in range(128 * 128)]

    return [a - b for a, b in zip(chain(seen[True]), chain(seen[False]))]


def score(value: Column, model: list[float]) -> Column:
    """LLR of a string in bits."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")  # folded into one literal
    codes = _codes(value)
    bits = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.when(b.isNull(), 0.0).otherwise(F.get(table, a * 128 + b)))
    return F.aggregate(bits, F.lit(0.0), lambda total, x: total + x)


def random_tokens(table: DataFrame, model: list[float]) -> DataFrame:
    """row, kind, match, start, end, value, score of the tokens that look random."""
    rows = _placed(table, (ADDED,), len(KINDS)).withColumn("value", F.col("match")).withColumn("score", score(F.col("match"), model))
    return rows.filter((F.col("score") >= MIN_BITS) & (F.col("score") >= MIN_MEAN * F.length("match")))


def _spans(docs: DataFrame, table: DataFrame, model: list[float] | None) -> DataFrame:
    """row, kind, start, end, value, score (null for base finds) of all finds."""
    base = stored(base_spans(table), "secrets-base")
    if model is None:
        model = train(samples(docs, base))
    spans = base.withColumn("score", F.lit(None).cast("double")).unionByName(random_tokens(table, model))
    is_base = F.col("kind") < len(KINDS)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.max(F.when(is_base, F.col("end"))).over(before)).withColumn("next", F.min(F.when(is_base, F.col("start"))).over(after))
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return spans.filter(is_base | clear).select("row", "kind", "start", "end", "value", "score")


def spans(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per find: doc_id, kind, start, end (code points), value, score."""
    table = read(docs)
    names = F.array(*map(F.lit, [*KINDS, ADDED]))
    found = _spans(docs, table, model).join(table.select("row", "doc_id"), "row")
    return found.select("doc_id", F.element_at(names, F.col("kind") + 1).alias("kind"), "start", "end", "value", "score")


def find(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans (kind:start:end by start, then kind, comma-joined), n_markov."""
    table = read(docs)
    found = _spans(docs, table, model).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = table.select("row", "doc_id").join(found, "row", "left")
    rows = rows.withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")))
    names = F.array(*map(F.lit, [*KINDS, ADDED]))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def count(i: int) -> Column:
        return F.size(F.filter("all", lambda s: s["kind"] == i)).cast("long")

    return rows.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(joined(F.filter("all", lambda s: s["kind"] < len(KINDS))), 256).alias("base_sha256"),
                       joined(F.col("all")).alias("spans"), count(len(KINDS)).alias(f"n_{ADDED}"))


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """The documents, all columns, with every find replaced by ``[SECRET]``;
    finds that overlap are replaced together."""
    named = stored(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__own"), "doc_id", "text"), "secrets-docs")
    rows = _spans(named, read(named, F.col("__row")), model)
    order = Window.partitionBy("row").orderBy("start", "kind")
    rows = rows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int")).over(order))
    rows = rows.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = rows.withColumn("before", F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0)))
    rows = rows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "before", "end"))).alias("cuts"))
    out = named.join(rows, F.col("__row") == F.col("row"), "left")
    text = F.col("text").cast("string")
    parts = F.transform("cuts", lambda c: F.concat(F.substring(text, c["before"].cast("int") + 1, (c["start"] - c["before"]).cast("int")), F.lit("[SECRET]")))
    rest = F.substring(text, F.element_at("cuts", -1)["end"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return out.select(clean.alias("__clean"), "__own.*").withColumn("text", F.col("__clean")).drop("__clean")
