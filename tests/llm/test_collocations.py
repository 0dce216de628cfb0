import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewise.llm import collocations as C


def brute(rows, min_count, percent=100, top=2000):
    found, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        counts = found.setdefault(lang, Counter())
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                counts.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in found.items():
        candidates = {q: a for q, a in f.items() if a >= min_count and len(q) >= 2}
        dropped = {q[i:i + k] for q, a in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                   if 100 * a >= percent * candidates[q[i:i + k]]}
        rows = []
        for q, a in candidates.items():
            if q not in dropped:
                s, _, left, right = min((1000 * a * n[lang] // (f[q[:k]] * f[q[k:]]), k, f[q[:k]], f[q[k:]]) for k in range(1, len(q)))
                rows.append((-s, -a, " ".join(q).encode(), left, right, len(q)))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s, k) for i, (s, a, p, left, right, k) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def check(table, min_count, percent=100, top=2000):
    got = C.collocations(table, min_count, percent, top)
    want = brute([(r.text, r.lang) for r in table.collect()], min_count, percent, top)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def test_documents(docs):
    assert check(docs, 12)
    assert check(docs, 12, percent=60, top=40)


def test_small_tries_spill_and_burst(docs, monkeypatch):
    monkeypatch.setattr(C, "SLICE_BYTES", 3000)
    few = docs.filter("doc_id < 40")
    rows = [(r.text, r.lang) for r in few.collect()]
    shared = []
    for burst, spill in ((3, 60), (8192, 400_000)):
        monkeypatch.setattr(C, "BURST", burst)
        table = few.select("lang", "text").toArrow().to_batches()
        out = Counter()
        counting = C.Counting(3, 5)
        everything = type("All", (), {"holds": staticmethod(lambda h: np.ones(len(h), bool))})
        for langs, lang, words in C._slices(iter(table)):
            counting.add(langs, lang, words, everything)
            if counting.trie.size > spill:
                for batch in counting.runs(spill // 2):
                    out.update({(r["lang"], r["phrase"]): r["f"] + out.pop((r["lang"], r["phrase"]), 0) for r in batch.to_pylist()})
        for batch in counting.runs(0):
            out.update({(r["lang"], r["phrase"]): r["f"] + out.pop((r["lang"], r["phrase"]), 0) for r in batch.to_pylist()})
        shared.append(out)
    assert shared[0] == shared[1]
    want = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]+", lambda m: m[0].lower(), text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang, " ".join(words[i:i + k])) for k in range(3, 6) for i in range(len(words) - k + 1))
    assert shared[0] == want


def test_runs_are_sorted_and_subtrees_leave_whole():
    trie = C.HatTrie(3)
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 300, (5000, 3))
    rows[::7, 2] = 0
    trie.add(rows)
    assert trie.size == len(np.unique(rows, axis=0))
    out, counts = trie.take(1000)
    assert trie.size <= 1000 and counts.sum() + sum(sum(c.values()) if isinstance(c, Counter) else 0 for c in trie.root.values()) <= 5000
    rest, _ = trie.take(0)
    assert not set(out[:, 0]) & set(rest[:, 0])
    assert len(out) + len(rest) == len(np.unique(rows, axis=0))


def test_edge_cases(edge_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    want = check(edge_docs.filter("doc_id is null or doc_id < 6"), 1)
    check(edge_docs, 2)
    assert "und" in {r[0] for r in want}  # null lang


def test_ids_with_zero_bytes(spark):
    """More words than one byte counts, so that some ids end in zero bytes."""
    words = [f"w{i}" for i in range(700)]
    text = " ".join(words)
    check(spark.createDataFrame([(text, "a")] * 3 + [(" ".join(words[250:260]), "a")], "text string, lang string"), 3)


def test_pieces_case_and_ties(spark):
    rows = [("A b. a B, a b\x0bc a\tb É é", "x")] * 3 + [("ÄB Äb äb äb äb", "y"), ("q r q r q r q r", None), ("q r q r", "und"), (None, "z"), (" .,;", "z")]
    check(spark.createDataFrame(rows, "text string, lang string"), 2)
    check(spark.createDataFrame(rows, "text string, lang string"), 1, top=3)


@settings(max_examples=4, deadline=None)
@given(texts=st.lists(st.tuples(st.lists(st.sampled_from(["a", "B", "b", "ab", "é", ".", "\n", " ", "\t", "a b a", "İ"]), max_size=30).map(" ".join),
                                st.sampled_from(["p", "q", None])), min_size=20, max_size=60))
def test_equals_brute_force(spark, texts):
    check(spark.createDataFrame(texts, "text string, lang string"), 3)


def test_scores_pass_64_bits(spark):
    n = 10 ** 13
    frequent = spark.createDataFrame([("x", "a", 1, n), ("x", "b", 1, n // 3), ("x", "a b", 2, n // 7)], "lang string, phrase string, n_words int, f long")
    totals = spark.createDataFrame([("x", 10 ** 16 + 7)], "lang string, n long")
    row = C._scored(frequent, totals).collect()[0]
    assert row.score == 1000 * (n // 7) * (10 ** 16 + 7) // (n * (n // 3))


def test_filter_has_no_false_no(spark):
    phrases = [("l%d" % (i % 3), f"wort{i} é{i * 7}") for i in range(5000)]
    table = spark.createDataFrame(phrases, "lang string, phrase string")
    bits = C.frequent_filter(table)
    import pyarrow as pa
    first, second, lang = (C._hashes(pa.array(x)) for x in zip(*[(*p.split(" "), lg) for lg, p in phrases]))
    assert bits.holds(C._follow(C._follow(first, second), lang)).all()
    other = C._hashes(pa.array([f"other{i}" for i in range(5000)]))
    assert bits.holds(C._follow(C._follow(other, second), lang)).mean() < 0.01
