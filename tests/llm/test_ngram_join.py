import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewise.llm import ngram_join, scratch
from tidewise.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=80):
    """{doc_id: (n_shingles, component_id)} by comparing all that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                common[j] += j > i
        for j, n in common.items():
            if n and 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def agrees(spark, rows):
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.random()}"
    return " ".join(words)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32), st.integers(0, 60))
def test_linked_sets_share_a_part(n, seed, changes):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    keep = a[: max(0, len(a) - changes)]
    b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, changes + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
    both = len(np.intersect1d(a, b))
    if not len(b) or 100 * both < 80 * (len(a) + len(b) - both) or (len(a) == len(b) == both):
        return
    parts = [set(np.concatenate([ngram_join.parts(s, k, 80) for k in ngram_join.bands_of(len(s), 80)]).tolist()) for s in (a, b)]
    assert parts[0] & parts[1]
    far = np.bitwise_count(np.frombuffer(ngram_join.sketch(a), np.uint64) ^ np.frombuffer(ngram_join.sketch(b), np.uint64)).sum()
    assert far <= len(a) + len(b) - 2 * both <= ngram_join.difference(len(a) + len(b), 80)


def test_equals_brute_force_on_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_copies(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


@pytest.mark.parametrize("group, flush", [(64, 1 << 20), (3, 1 << 20), (3, 300)])
def test_common_passages_and_large_groups(spark, monkeypatch, group, flush):
    """Groups over GROUP, parts common within a flush, and documents that are
    mostly common passage, all at once."""
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "FLUSH", flush)
    monkeypatch.setattr(ngram_join, "FLUSH_GROUP", 2 if flush < 1000 else 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    base = [f"b{i}" for i in range(150)]
    texts = [edited(base, rng.randrange(6), rng) for _ in range(60)]  # near copies, links short of complete
    texts += [" ".join(passage + [f"u{d}w{i}" for i in range(rng.randrange(8, 120))]) for d in range(60)]
    texts += [" ".join(passage + [f"v{d}w{i}" for i in range(rng.randrange(1, 14))]) for d in range(40)]  # mostly passage
    texts += [edited([f"s{k}w{i}" for i in range(n)], 1, rng) for k, n in enumerate([4, 5, 6, 8, 9, 13, 20, 40, 90]) for _ in range(4)]
    rng.shuffle(texts)
    agrees(spark, list(enumerate(texts)))


def test_long_documents(spark):
    """Sets beyond the plain sketch, with wide sketches of equal and of
    different sizes (1900 and 2100 words), linked and unlinked."""
    rng = random.Random(5)
    texts = []
    for k, (n, m) in enumerate([(1900, 2100), (2040, 2060), (1000, 1100), (5000, 5100)]):
        words = [f"l{k}w{i}" for i in range(m)]
        texts += [" ".join(words), " ".join(words[:n]), edited(words, m // 60, rng), edited(words, m // 15, rng), edited(words, m // 44, rng)]
    agrees(spark, list(enumerate(texts)))


@pytest.mark.parametrize("n, m", [(1030, 1200), (2000, 2100), (4000, 4090), (70000, 80000)])
def test_wide_sketches_allow_links(spark, n, m):
    """The distance of wide sketches never exceeds the differing shingles; sets
    with nothing in common are refused."""
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))
    sets = {1: a, 2: np.sort(rng.permutation(a)[:n]), 3: np.unique(rng.integers(0, 2**63, m, dtype=np.uint64))}
    rows = [(k, len(s), np.frombuffer(ngram_join.sketch(s, ngram_join.wide_bits(len(s))), np.int64).tolist()) for k, s in sets.items()]
    rows.append((4, 1000, None))
    named = spark.createDataFrame(rows, "node long, n long, wide array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "a long, b long")
    assert sorted(map(tuple, ngram_join._sharper(named, pairs, 80).collect())) == [(1, 2), (1, 4)]


def test_parts_beside_a_common_one(spark):
    """Parts 1, common in one flush, and 2 have the same holders: the ordinary
    part is kept."""
    keys, holders = np.array([1, 1, 1, 2, 2, 2], np.uint64), np.array([5, 6, 7] * 2, np.int64)
    blocks = [(ngram_join.PART, 0, bytearray(ngram_join._pack(keys, holders))), (ngram_join.COMMON, 0, bytearray(ngram_join._pack(keys[:1], holders[:1])))]
    got = ngram_join.shared_parts(spark.createDataFrame(blocks, "kind int, range int, block binary")).collect()
    assert sorted(r.b for r in got if r.kind == ngram_join.PART) == [5, 6, 7]


def test_edge_cases(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_copies(edge_docs).collect()}
    assert {(1, 5, 1), (2, 5, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (8, 3, 8), (None, 1, None)} <= got
    assert {c for i, _, c in got if i in (6, 7)} == {6}
    assert ngram_join.near_copies(edge_docs).count() == edge_docs.count()
    assert ngram_join.near_copies(no_docs).count() == 0
    out = ngram_join.deduplicate(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted({str(r.doc_id) for r in out.collect()}) == ["1", "3", "4", "5", "6", "8", "9", "None"]
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.near_copies(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50 + i) for i in range(9)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 50 for i in [100, *range(50, 59)]} | {200: 200, 201: 200}
    assert got == want


def test_group_steps_give_memory_back(monkeypatch):
    """After each large group, also one that fails."""
    called = []
    monkeypatch.setattr(scratch, "give_back", lambda: called.append(1))
    assert scratch.lean_group(lambda pdf: pdf + 1)(2) == 3
    with pytest.raises(ZeroDivisionError):
        scratch.lean_group(lambda pdf: pdf / 0)(2)
    assert len(called) == 2


def test_half_common_passage_is_not_compared_in_blocks(spark, monkeypatch):
    """A passage that is 6 in 10 of each of 150 documents: fine parts leave
    enough others, so no membership in it is compared block by block; links
    that rest on the other words are found."""
    compared, plain = [], ngram_join._common_pairs
    monkeypatch.setattr(ngram_join, "_common_pairs", lambda groups, *a, **k: compared.append(groups.count()) or plain(groups, *a, **k))
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(64)]
    texts = [" ".join(passage + [f"u{d}w{i}" for i in range(40)]) for d in range(150)]
    texts += [edited(texts[d].split(), 1, rng) for d in range(0, 150, 15)]
    agrees(spark, list(enumerate(texts)))
    assert sum(compared) == 0


def test_short_classes_enter_as_few_parts_as_they_are_short_of(spark):
    part = lambda k: k << 8 | 3  # noqa: E731  band 3
    rows = [(ngram_join.MEMBER, part(k), e) for k, e in [(9, 1), (5, 1), (7, 1), (5, 1), (5, 2), (7, 2)]]
    rows += [(ngram_join.EXTRA, 3 << 32 | x + ngram_join._ZERO, e) for e, x in [(1, 1), (2, 2), (4, 0)]]
    got = ngram_join._short(spark.createDataFrame(rows, "kind int, a long, b long")).collect()
    assert [(r.entity, r.band, r.parts) for r in got] == [(1, 3, [part(5), part(7)])]


def test_driver_gives_memory_back(spark, monkeypatch):
    called = []
    monkeypatch.setattr(scratch, "give_back", lambda: called.append(1))
    scratch.lean_driver(spark)
    assert called == [1]
