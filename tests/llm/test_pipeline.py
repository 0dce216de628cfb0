import hashlib
import re
import struct

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewise.llm import queries
from tidewise.llm.queries import tokenizer_path

from .test_ngram_join import brute

SF001 = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, docs):
    """Every stage on its predecessor's rows, each against a plain version."""
    table, kept = docs, None
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in table.collect()]
        table = stage(spark, table, SF001)
        if name != "bpe":
            assert table.columns == docs.columns
        rows = [r.asDict() for r in table.collect()]
        if name == "language_id":
            want = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in want)
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before, key=lambda r: r["doc_id"]):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
            assert sorted(r["doc_id"] for r in rows) == sorted(first.values())
        elif name == "ngram_jaccard_join":
            placed = brute([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, (_, c) in placed.items() if c == i)
        elif name == "mixing":
            size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows)
            assert abs(size(rows) / size(before) - 1.5) < 0.1
            kept = rows
        else:
            library = Tokenizer.from_file(tokenizer_path())
            want = []
            for r in kept:
                ids = library.encode(r["text"], add_special_tokens=False).ids
                want.append((r["doc_id"], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()))
            assert sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in rows) == sorted(want)


def test_empty_and_edge_tables(spark, edge_docs, no_docs):
    for table in (no_docs, edge_docs):
        for _, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, SF001)
        assert (table.count() == 0) == (table is not None and table.filter("n_tokens > 0").isEmpty())


def test_no_labelled_rows(spark, edge_docs):
    """Without a label to learn from, the first stage keeps texts with letters,
    and a language may be called und."""
    for label in (None, "und"):
        table = edge_docs.withColumn("lang", F.lit(label).cast("string"))
        out = corpus_pipeline.identify_language(spark, table, SF001)
        assert out.columns == table.columns and out.count() == table.count() - 3


def test_registered():
    assert {int(re.match(r"op(\d+)_", k)[1]) for k in queries.QUERIES} == set(range(1, 11))
    assert set(queries.SQL) <= set(queries.QUERIES)
