import hashlib
import struct
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewise.llm import bpe
from tidewise.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(bpe.load(tokenizer_path())), Tokenizer.from_file(tokenizer_path())


def same(both, text):
    codec, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_equals_the_library_on_any_text(both, text):
    same(both, "".join(c for c in text if unicodedata.category(c) != "Cn"))  # assigned as far as Python knows


@pytest.mark.parametrize("text", ["", "  ", "a<|endoftext|>b<|startoftext|>", "ΑΣ İstanbul ẞ", "x" * 3000, "\x1c a\x85b", "don't I'LL 123 !!!,", "🎉👍🏽 漢字"])
def test_equals_the_library_on_odd_texts(both, text):
    same(both, text)


def test_cache_generations(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 4)
    codec = bpe.Codec(bpe.load(tokenizer_path()))
    text = "alpha beta gamma delta epsilon alpha beta zeta"
    for _ in range(3):
        assert codec.encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_digests(spark, both, edge_docs, no_docs):
    assert bpe.digests(no_docs, tokenizer_path()).count() == 0
    rows = bpe.digests(edge_docs, tokenizer_path()).collect()
    want = []
    for r in edge_docs.collect():
        ids = both[1].encode(r.text or "", add_special_tokens=False).ids
        text = both[1].decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, bpe.digests(edge_docs, tokenizer_path(), cached=4).collect()), key=key) == sorted(want, key=key)
    got = {r.doc_id: r.ids for r in bpe.encode(edge_docs.filter("doc_id = 9"), tokenizer_path()).collect()}
    assert got[9] == both[1].encode("émile zola écrivit naïvement à Σίσυφος", add_special_tokens=False).ids


def test_workers_are_shipped_the_packed_file(both):
    """A few hundred KB in one object, not the parsed file's several hundred thousand."""
    assert len(bpe.packed(tokenizer_path())) < 2_000_000

    class Shared:
        value = bpe.packed(tokenizer_path())

    codec = bpe._codec(Shared, 10)
    assert codec.encode("alpha beta") == both[1].encode("alpha beta", add_special_tokens=False).ids
    bpe._codecs.clear()


def test_freed_memory_is_given_back():
    """Blocks freed below one still in use stay with the process unless given back."""
    import ctypes

    from tidewise.llm.scratch import give_back, lean

    def held() -> int:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 >> 20

    libc = ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    blocks = [libc.malloc(100_000) for _ in range(3000)]
    for b in blocks:
        ctypes.memset(b, 1, 100_000)
    for b in blocks[:-1]:
        libc.free(b)
    before = held()
    give_back()
    assert held() < before - 200
    libc.free(blocks[-1])
    assert list(lean(iter)([1, 2])) == [1, 2]
