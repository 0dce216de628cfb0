import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewise.llm import language_id


def phrases(text, sample):
    """Longest matches, restarted every STRETCH signs; brute force."""
    count = 0
    for at in range(0, len(text), language_id.STRETCH):
        part = text[at:at + language_id.STRETCH]
        while part:
            n = 0
            while n < len(part) and part[:n + 1] in sample:
                n += 1
            part, count = part[max(n, 1):], count + 1
    return count


@settings(max_examples=150, deadline=None)
@given(st.text("abcd ", min_size=3, max_size=60), st.lists(st.text("abcde ", max_size=50), min_size=1, max_size=4))
def test_parser_counts_longest_matches(sample, texts):
    letters = "abcde"
    table = language_id.symbol_table(letters)
    classes = language_id.LETTER + 32 + len(letters)
    clean = lambda t: "".join(" " if c == 0 else chr(c) for c in language_id._plain(language_id._points(t)))
    plain = clean(sample)
    model = language_id.parse_table([int(table[ord(c)]) if c != " " else 0 for c in plain], classes)
    old = language_id.STRETCH
    language_id.STRETCH = 16
    try:
        got, _ = language_id.Parser(letters, classes, [("x", len(plain), model.tobytes())]).counts(texts)
        assert got[:, 0].tolist() == [phrases(clean(t).removeprefix(" "), plain) for t in texts]
    finally:
        language_id.STRETCH = old


def test_held_out_accuracy(docs):
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right = rows.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98
    assert rows.filter("score < 0 or score > 1").count() == 0


def test_edge_cases(edge_docs, no_docs):
    rows = language_id.identify(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5)) and 0 <= r.score <= 1 and not math.isnan(r.score)
    assert language_id.identify(no_docs).count() == 0
    out = language_id.identified(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count() - 3
    own = language_id.identified(edge_docs.withColumn("__lang", F.lit("mine")))
    assert own.columns[-1] == "__lang" and {r["__lang"] for r in own.collect()} == {"mine"}
    unlabelled = language_id.identify(edge_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


@settings(max_examples=150, deadline=None)
@given(st.text("ab一二丐 ", min_size=3, max_size=60), st.lists(st.text("abc一二丐丠Я ", max_size=50), min_size=1, max_size=4))
def test_letters_without_a_column_are_distinct(sample, texts):
    table = language_id.symbol_table("ab")
    classes = language_id.LETTER + 2
    clean = lambda t: "".join(" " if c == 0 else chr(c) for c in language_id._plain(language_id._points(t)))
    plain = [clean(sample), clean(sample[::-1])]
    models = [(str(i), len(p), language_id.parse_table([int(table[ord(c)]) if c != " " else 0 for c in p], classes).tobytes()) for i, p in enumerate(plain)]
    got, _ = language_id.Parser("ab", classes, models).counts(texts)
    assert got.tolist() == [[phrases(clean(t).removeprefix(" "), p) for p in plain] for t in texts]


def test_large_scripts(spark):
    """Two languages of ideographs, none in common."""
    rng = random.Random(5)
    signs = rng.sample(range(0x4E00, 0x9FA0), 3000)
    rows = [(i, "".join(chr(signs[2 * rng.randrange(1500) + i % 2]) for _ in range(200)), "ab"[i % 2]) for i in range(300)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sum(r.lang_pred == "ab"[r.doc_id % 2] for r in got) == 300


def test_short_samples_do_not_win(spark, docs):
    """A language of one short row, one whose letters follow 3000 digits, and
    one of another script, beside four with full samples."""
    few = [(-1, "en", "aa"), (-2, "7" * 3000 + " es la", "bb"), (-3, "это язык", "ru"), (-4, "язык", None), (-5, "7" * 3000 + " язык это", None)]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(few, "doc_id long, text string, lang string"))
    held = F.col("doc_id") % 5 == 0
    rows = language_id.identify(table, held & (F.col("doc_id") >= 0)).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id < -2} == {-3: "ru", -4: "ru", -5: "ru"}
    rows = [r for r in rows if r.doc_id >= 0]
    assert sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)


def test_samples_fill_the_budget(spark, monkeypatch):
    """Short rows, copies and long rows give samples of one length."""
    monkeypatch.setattr(language_id, "LANG_CHARS", 1024)
    rows = [(f"k{'abcdefgh'[i % 8]}{'ijklmnop'[i // 8 % 8]}{'qrstuvwx'[i // 64 % 8]}", "short") for i in range(512)]
    rows += [("copies of a text", "copied")] * 400 + [(" ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)), "copied")]
    rows += [("9" * 5000 + " lang" * 2000, "long"), ("x", "tiny"), (None, "none"), ("123", "none")]
    _, _, models = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert {m[0]: m[1] for m in models} == {"short": 1024, "copied": 1024, "long": 1024, "tiny": 1}
