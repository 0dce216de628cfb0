import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewise.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("runs, radix", [(256, 16), (8, 2), (1, 2)])
def test_equals_brute_force(docs, edge_docs, runs, radix):
    for table in (docs, edge_docs):
        got = exact_dedup.find_copies(table, runs, radix).collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(table.collect())
        by = defaultdict(list)
        for r in got:
            by[r.text_sha256].append(r)
        for rows in by.values():  # exactly one row of each text stays, the smallest
            kept = [r for r in rows if r.kept]
            assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_deduplicate(edge_docs, no_docs):
    out = exact_dedup.deduplicate(edge_docs)
    assert out.columns == edge_docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "6", "7", "8", "9", "None"]
    assert exact_dedup.deduplicate(no_docs).count() == 0
    assert exact_dedup.find_copies(no_docs).count() == 0


def test_helper_columns_leave_the_callers_alone(edge_docs):
    own = edge_docs.withColumn("__id", F.lit("mine")).withColumn("__SHA256", F.col("doc_id") * 2)
    out = exact_dedup.deduplicate(own)
    assert out.columns == own.columns and out.count() == 8
    assert all(r["__id"] == "mine" and r["__SHA256"] == (None if r.doc_id is None else 2 * r.doc_id) for r in out.collect())


def test_runs_are_merged_by_sorting(docs):
    table = exact_dedup.digest_table(docs)
    _, root = exact_dedup.classes(table)
    plan = root._jdf.queryExecution().toString()
    assert plan.count("SortAggregate") >= 6  # a partial and a merging one per level
