"""Personal data and the terms that disclose it (operator 10).

Base finds are e-mail addresses, IP addresses, card and phone numbers, by
pattern and check (parts, Luhn, digits). The method then protects what they
identify: corpus co-occurrence within lines estimates how strongly a term t
reveals an entity e (the found value) by their pointwise mutual information

    PMI(t; e) = log2(c(t, e) * N / (c(t) * c(e))),   IC(e) = log2(N / c(e)),

with c counting lines of the whole corpus and N all its lines. PMI = IC(e)
means that t only occurs with e. Terms with PMI >= REMOVE * IC are removed,
those with PMI >= GENERALISE * IC generalised, wherever they stand in a line
with e. A pair needs MIN_CONTEXTS different lines, so that the words of one
line, or of its copies, are no evidence.

Everything is DataFrame operations. The text is read once for the base finds
(only lengths, finds and the lines that hold them are kept) and once to count
candidate terms; running sums over a document's pieces give code-point offsets,
so a document with very many finds costs in proportion. Counts are grouped with
map-side aggregation; a frequent term or entity is one row per task.

Defined results: a null text counts as empty (no finds); repeated rows are
documents of their own; an empty table gives an empty table. Other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import attach, stored

KINDS = ("email", "ip", "card", "phone")
#: Patterns equal to the plain ones but without backtracking: possessive where
#: what follows cannot match what was taken, and no start within a run that
#: has failed from its beginning.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

MIN_CONTEXTS, GENERALISE, REMOVE = 3, 0.75, 0.95
TERM = r"\p{L}{3,}"
TERM_NO = len(KINDS)


def _pieces(text: Column, pattern: str) -> Column:
    """(length of the text before it, match) of each match in order; the last
    entry has no match."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0),
                      lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the Luhn check."""
    def worth(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid() -> Column:
    """Whether the columns kind (its number) and match pass the kind's check."""
    match, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (F.when(kind == 0, F.lit(True))
            .when(kind == 1, match.rlike(rf"^(?:{PART}\.){{3}}{PART}$"))
            .when(kind == 2, F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .otherwise(n.between(8, 15)))


def _entity() -> Column:
    """The value that a find identifies, however it is written."""
    value = F.when(F.col("kind") == 0, F.lower("match")).when(F.col("kind") == 1, F.col("match")).otherwise(F.regexp_replace("match", "[^0-9]", ""))
    return F.concat_ws(":", F.col("kind").cast("string"), value)


def read(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document with what later steps need of its text: row,
    doc_id, n_lines, the pieces of each kind, and the lines with their lengths,
    texts only of those that may hold a find."""
    text = docs.select("doc_id", (row if row is not None else F.monotonically_increasing_id()).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    held = [F.col("t").contains("@") if k == "email" else F.col("t").rlike(GUARDS[k]) for k in KINDS]
    text = text.select("*", *[h.alias(f"has_{k}") for k, h in zip(KINDS, held)])
    some = F.col("has_email") | F.col("has_ip") | F.col("has_card") | F.col("has_phone")
    any_find = "|".join(f"(?:{GUARDS[k]})" for k in KINDS)
    lines = F.transform(F.split("t", "\n", -1), lambda x: F.struct(F.length(x).alias("n"), F.when(x.rlike(any_find), x).alias("line")))
    return stored(text.select(
        "row", "doc_id", (F.length("t") - F.length(F.translate("t", "\n", "")) + 1).alias("n_lines"),
        *[F.when(F.col(f"has_{k}"), _pieces(F.col("t"), PATTERNS[k])).alias(k) for k in KINDS],
        F.when(some, lines).alias("lines")), "pii")


def _placed(pieces: DataFrame, by: list[str]) -> DataFrame:
    """pieces (by, i, gap, match) with each match's start and end."""
    order = Window.partitionBy(*by).orderBy("i")
    before = F.coalesce(F.sum(F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + before
    return pieces.withColumn("start", start).filter(F.col("match").isNotNull()).withColumn("end", F.col("start") + F.length("match"))


def base_spans(table: DataFrame) -> DataFrame:
    """row, kind (number), start, end, entity of every valid find."""
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("pieces")) for i, k in enumerate(KINDS)])
    rows = table.select("row", F.explode(kinds).alias("k")).filter("k.pieces is not null")
    rows = rows.select("row", "k.kind", F.posexplode("k.pieces").alias("i", "p")).select("row", "kind", "i", "p.gap", "p.match")
    rows = _placed(rows, ["row", "kind"]).filter(_valid())
    return rows.select("row", "kind", "start", "end", _entity().alias("entity"))


def contexts(table: DataFrame, base: DataFrame) -> DataFrame:
    """row, line_no, at (the line's offset), line, entity: each line with each
    entity in it."""
    lines = table.filter("lines is not null").select("row", F.posexplode("lines").alias("line_no", "l"))
    order = Window.partitionBy("row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("row", "line_no", F.col("l.line").alias("line"), F.col("l.n").alias("n"),
                         F.coalesce(F.sum(F.col("l.n") + 1).over(order), F.lit(0)).alias("at"))
    finds = base.select("row", "start", "entity")
    found = lines.filter("line is not null").join(finds, "row").filter("start >= at and start < at + n")
    return found.select("row", "line_no", "at", "line", "entity").distinct()


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(line, PATTERNS["email"], " ")), F.lit(TERM), 0))


def disclosures(docs: DataFrame, table: DataFrame, found: DataFrame) -> DataFrame:
    """term, entity, share: PMI(term; entity) / IC(entity) of the pairs that
    reach GENERALISE."""
    pairs = found.select("entity", F.xxhash64("line").alias("context"), F.explode(_terms(F.col("line"))).alias("term"))
    pairs = pairs.groupBy("term", "entity", "context").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("term", "entity").agg(F.sum("n").alias("c_te"), F.count("*").alias("contexts")).filter(F.col("contexts") >= MIN_CONTEXTS)
    pairs = stored(pairs, "pii-pairs")
    entities = found.groupBy("entity").agg(F.count("*").alias("c_e"))
    wanted = pairs.select(F.col("term").alias("wanted")).distinct()
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line"))
    words = lines.select(F.explode(_terms(F.col("line"))).alias("term"))
    counts = attach(words, wanted, F.col("term") == F.col("wanted")).groupBy("term").agg(F.count("*").alias("c_t"))
    if pairs.isEmpty():
        counts = counts.limit(0)  # no candidate: nothing to count
    total = table.agg(F.sum("n_lines").alias("n"))
    rows = pairs.join(entities, "entity").join(counts, "term").join(F.broadcast(total))  # a single row
    information = F.log2(F.col("n") / F.col("c_e"))
    mutual = F.log2(F.col("c_te") * F.col("n") / (F.col("c_t") * F.col("c_e")))
    return rows.withColumn("share", F.try_divide(mutual, information)).filter(F.col("share") >= GENERALISE).select("term", "entity", "share")


def term_spans(found: DataFrame, flagged: DataFrame, base: DataFrame) -> DataFrame:
    """row, start, end, removed of every disclosing term in a line with its
    entity, outside the base finds."""
    rows = found.withColumn("term", F.explode(_terms(F.col("line")))).join(flagged, ["term", "entity"])
    rows = rows.groupBy("row", "line_no", "term").agg(F.max("share").alias("share"))
    lines = found.select("row", "line_no", "at", "line").distinct().join(rows.select("row", "line_no").distinct(), ["row", "line_no"], "left_semi")
    pieces = lines.select("row", "line_no", "at", F.posexplode(_pieces(F.col("line"), TERM)).alias("i", "p")).select("row", "line_no", "at", "i", "p.gap", "p.match")
    words = _placed(pieces, ["row", "line_no"]).withColumn("term", F.lower("match"))
    words = words.join(rows, ["row", "line_no", "term"]).select("row", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), (F.col("share") >= REMOVE).alias("removed"))
    taken = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    return words.join(taken, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")


def _spans(docs: DataFrame, table: DataFrame) -> DataFrame:
    """row, kind, start, end, removed of all base finds and disclosing terms."""
    base = stored(base_spans(table), "pii-base")
    found = stored(contexts(table, base), "pii-contexts")
    flagged = stored(disclosures(docs, table, found), "pii-terms")
    terms = term_spans(found, flagged, base)
    spans = base.select("row", "kind", "start", "end", F.lit(True).alias("removed"))
    return spans.unionByName(terms.select("row", F.lit(TERM_NO).alias("kind"), "start", "end", "removed"))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans (kind:start:end, comma-joined; kind ``term`` last)."""
    table = read(docs)
    spans = _spans(docs, table).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("all"))
    rows = table.select("row", "doc_id").join(spans, "row", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint>>)")))
    names = F.array(*map(F.lit, [*KINDS, "term"]))

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    def of_kind(i: int) -> Column:
        return F.filter("all", lambda s: s["kind"] == i)

    base = F.filter("all", lambda s: s["kind"] < TERM_NO)
    return rows.select(
        "doc_id", *[F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with base finds replaced by their kind in brackets,
    disclosing terms removed or generalised to ``[TERM]``; all columns."""
    named = stored(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*docs.columns).alias("__own"), "doc_id", "text"), "pii-docs")
    table = read(named, F.col("__row"))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in [*KINDS, "term"]])
    rows = _spans(named, table).withColumn("tag", F.when((F.col("kind") == TERM_NO) & F.col("removed"), "").otherwise(F.element_at(tags, F.col("kind") + 1)))
    # where finds of several kinds overlap, they are replaced together under the first's tag
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    rows = rows.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("part", F.sum((F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("int")).over(order))
    rows = rows.groupBy("row", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("tag", F.struct("start", "kind")).alias("tag"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("row").orderBy("start")), F.lit(0))
    rows = rows.withColumn("before", before).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "before", "end", "tag"))).alias("cuts"))
    out = named.join(rows, F.col("__row") == F.col("row"), "left")
    text = F.col("text").cast("string")
    parts = F.transform("cuts", lambda c: F.concat(F.substring(text, c["before"].cast("int") + 1, (c["start"] - c["before"]).cast("int")), c["tag"]))
    rest = F.substring(text, F.element_at("cuts", -1)["end"].cast("int") + 1, F.length(text))
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), rest))
    return out.select(clean.alias("__clean"), "__own.*").withColumn("text", F.col("__clean")).drop("__clean")
