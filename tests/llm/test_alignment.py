import hashlib
import json
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewise.llm import alignment
from tidewise.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    vocab = {i: s for s, i in json.load(open(A))["model"]["vocab"].items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printable}
    names |= {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(printable)))}
    b = SentencePieceProcessor(model_file=B)

    def tokens(text):
        left = [(i, bytes(names[c] for c in vocab[i])) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes.fromhex(piece[3:5]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        want = b" " + text.encode()
        if not text or b"".join(t for _, t in left) != want or b"".join(t for _, t in right) != want:
            return [], []
        return left, right

    return tokens


def ends(tokens):
    at, out = 0, []
    for _, t in tokens:
        at += len(t)
        out.append(at)
    return out


def brute(tokens, texts):
    """doc -> (n_a, n_b, n_groups, n_links, n_best, count_sum, digest, n_overlaps)"""
    links, rows = [], []
    for text in texts:
        left, right = tokens(text or "")
        ea, eb = ends(left), ends(right)
        at = dict(zip(eb, right))
        own = [(i, at[e][0]) for (i, _), e in zip(left, ea) if e in at]
        cuts = [e for e in ea if e in at]
        inside = [{}, {}]
        for found, side, es in zip(inside, (left, right), (ea, eb)):
            group, limits = 0, iter(cuts)
            limit = next(limits, 0)
            for (i, _), e in zip(side, es):
                if e > limit:
                    group, limit = group + 1, next(limits)
                found.setdefault(group, []).append(str(i))
        groups = ";".join(f"{','.join(inside[0][g])}|{','.join(inside[1][g])}" for g in range(len(cuts)))
        # a new overlap begins wherever a token of either side begins
        overlaps = len({0, *ea[:-1], *eb[:-1]}) if left else 0
        links.append(own)
        rows.append((len(left), len(right), len(cuts), len(own), hashlib.sha256(groups.encode()).hexdigest() if left else "", overlaps))
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(r[0], r[1], r[2], r[3], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[4], r[5]) for r, own in zip(rows, links)]


def check(tokens, table):
    rows = table.select("doc_id", "text").collect()
    want = sorted(((str(r.doc_id), *w) for r, w in zip(rows, brute(tokens, [r.text for r in rows]))))
    got = alignment.digests(table, A, B)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    return got


def test_edge_cases(spark, both, edge_docs, no_docs):
    assert alignment.digests(no_docs, A, B).count() == 0 and alignment.align(no_docs, A, B).count() == 0
    got = check(both, edge_docs)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_rare_pairs_join_like_heavy_ones(both, docs, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", 50)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 5000)
    check(both, docs.filter("doc_id < 60"))


@settings(max_examples=4, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["the ", "token", "<|endoftext|>", "<s>", "<0x0A>", "▁", "é", "漢字", "🎉👍🏽", "\n\n", "  ", "\t", "\x00", "x1 ", "'ll ", "ﬁ", " ", "Ġ", "123456"]), max_size=12).map("".join),
                      min_size=20, max_size=60))
def test_equals_brute_force(spark, both, texts):
    check(both, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_long_blank_runs_and_special_strings(spark, both):
    check(both, spark.createDataFrame([(1, "a" + " " * 5000 + "b"), (2, "\n" * 4500), (3, "a<|endoftext|>b"), (4, "x▁y"), (5, "z" * 30_000), (5, "z z z")], "doc_id long, text string"))


def test_align_gives_overlaps_and_groups(spark, both, docs):
    some = docs.limit(8)
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in alignment.align(some, A, B).collect():
        left, right = both(texts[r.doc_id])
        assert r.a_ids == [i for i, _ in left] and r.b_ids == [i for i, _ in right]
        ea, eb = ends(left), ends(right)
        spans = [list(zip([0, *e], e)) for e in (ea, eb)]
        want, j = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(eb) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(eb) and spans[1][k][0] < e:
                want.append((i, k))
                k += 1
        assert [tuple(x) for x in r.overlaps] == want
        for a0, a1, b0, b1 in r.groups:
            assert b"".join(t for _, t in left[a0:a1]) == b"".join(t for _, t in right[b0:b1])
            assert a1 == a0 + 1 or b1 == b0 + 1 or not set(ea[a0:a1 - 1]) & set(eb[b0:b1 - 1])
        assert len(r.groups) == len(set(ea) & set(eb))


def test_dictionary_counts(spark, docs):
    rows = alignment.dictionary(docs.limit(20), A, B).collect()
    sums = sum(r["count"] for r in rows)
    assert sums == sum(r.n_links for r in alignment.digests(docs.limit(20), A, B).collect())
    for r in rows:
        assert r.best == (r["count"] == max(x["count"] for x in rows if x.b_id == r.b_id))
