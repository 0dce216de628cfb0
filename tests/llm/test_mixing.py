import re
from collections import defaultdict

from pyspark.sql import functions as F

from tidewise.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(w[s] for s in open_)
        if not open_:
            return full
        over = [s for s in open_ if left * w[s] / total >= most * sizes[s]]
        if not over:
            return full | {s: left * w[s] / total for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check(rows, table):
    size, of = defaultdict(int), {}
    for r in table:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        size[r.source] += n
        of.setdefault((r.doc_id, n), []).append(r.source)
    want = brute_targets(size)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        source = of[r.doc_id, r["size"]][0]
        assert r.source_size == size[source] and abs(r.target - want[source]) <= 1e-9 * max(1, want[source])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source] += r.taken
        largest[source] = max(largest[source], r["size"])
    for s in taken:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 * want[s]


def test_targets_and_quotas(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    assert sorted(rows) == sorted(mixing.mix(docs.repartition(7)).collect())  # reruns agree


def test_edge_cases(edge_docs, no_docs):
    rows = mixing.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert r.taken <= 2 * r["size"]
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    words = out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r.taken for r in rows)


def test_weights_raise_inclusion(spark):
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"),
                                     F.when(F.col("id") % 2 == 0, 1.6).otherwise(0.4).alias("w"))
    rows = mixing.mix(table, weights=(1,), share=0.4, weight="w").collect()
    even = sum(r.copies for r in rows if r.doc_id % 2 == 0)
    odd = sum(r.copies for r in rows if r.doc_id % 2)
    assert abs(3 * (even + odd) - 0.4 * 12000) <= 2 and 3 < even / odd < 5
