import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewise.llm import quality, toxicity
from tidewise.llm.scratch import labelled_sample

SF01 = "/root/testdata/sf0.01"


def held_out_auc(rows, labels, column):
    data = rows.filter("held_out").join(labels, "doc_id").select("score", F.col(column).alias("y")).toPandas()
    rank, y = data["score"].rank(), data["y"]
    pos, neg = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")


def test_quality_held_out(tables):
    assert held_out_auc(quality.score(*tables), tables[1], "quality") > 0.95


def test_toxicity_held_out(spark):
    """Words of a lexicon need examples: 449 toxic documents are enough."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert held_out_auc(toxicity.score(docs, labels), labels, "toxic") > 0.93


@pytest.mark.parametrize("op, column", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_cases(op, column, edge_docs, no_docs, labels):
    few = labels.limit(0)
    rows = op.score(edge_docs, few).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert op.score(no_docs, labels).count() == 0
    some = edge_docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).alias("quality"), (F.col("doc_id") % 2).alias("toxic"))
    some = some.unionByName(some.select("doc_id", F.lit(None).cast("long").alias("quality"), F.lit(None).cast("long").alias("toxic")))
    rows = op.score(edge_docs, some).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    same = [r.score for r in rows if r.doc_id in (3, 4, 5)]  # no word: equal scores
    assert len(set(same)) == 1


def test_labels_of_held_out_rows_do_not_matter(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    two = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert one == two


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 200), st.integers(1, 20))
def test_block_max_search_is_exact(seed, n, k):
    rng = np.random.default_rng(seed)
    vocabulary = np.arange(12, dtype=np.int64)
    idf = rng.uniform(1, 3, 12)
    dense = rng.integers(0, 3, (n, 12)) * (rng.random((n, 12)) < 0.4)
    vectors = []
    for row in dense:
        at = np.flatnonzero(row)
        vectors.append(toxicity.unit(at, (1 + np.log(row[at])) * idf[at]))
    index = toxicity.Index(vocabulary, idf, vectors, np.arange(n), rng.integers(0, 2, n), np.ones(n))
    q = rng.integers(0, 3, 12)
    at, w = index.vector(np.flatnonzero(q).astype(np.int64), q[q > 0])
    full = np.zeros((n, 12))
    by = {int(i): j for j, i in enumerate(index.ids)}
    for i, (t, x) in enumerate(vectors):
        full[by[i], t] = x
    query = np.zeros(12)
    query[at] = w
    score = full @ query
    best, similar = index.nearest(at, w, k)
    want = np.sort(score[score > 1e-15])[::-1][:k]
    assert np.allclose(similar, want) and np.allclose(score[best], similar)


def test_ftrl_separates():
    texts = pa.array(["good words here", "bad bad bad"] * 20)
    rows = list(quality.features(texts))
    w = quality.train(rows, [1, 0] * 20)
    assert w[rows[0][0]] @ rows[0][1] > 1 and w[rows[1][0]] @ rows[1][1] < -1


def test_other_labels_are_refused(edge_docs, spark):
    for value in ("2", "0.5", "toxic"):
        odd = spark.createDataFrame([(1, "1"), (6, value), (7, None)], "doc_id long, toxic string")
        with pytest.raises(ValueError, match="other than 0 and 1"):
            labelled_sample(edge_docs, odd, "toxic", F.lit(False), 10)
    fine = spark.createDataFrame([(1, "1"), (6, "0.0"), (7, None)], "doc_id long, toxic string")
    assert {(r.doc_id, r.label) for r in labelled_sample(edge_docs, fine, "toxic", F.lit(False), {0: 9, 1: 9}).collect()} == {(1, 1), (6, 0)}
