import numpy as np

from tidewise.llm import ann

SF01 = "/root/testdata/sf0.01"


def brute(ids, vectors, query, top):
    scores = [(float((v * vectors[query]).sum()), i) for i, v in zip(ids, vectors.values()) if i != query]
    return sorted(scores, key=lambda x: (-x[0], x[1]))[:top]


def recall(rows, vectors, top=20):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(found) + 1)) and len({f[1] for f in found}) == len(found)
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(found, found[1:]))
        want = brute(list(vectors), vectors, q, top)
        assert len(found) == len(want)
        assert all(abs(s - float((vectors[q] * vectors[i]).sum())) < 1e-12 for _, i, s in found)
        hits.append(len({i for _, i, _ in found} & {i for _, i in want}) / len(want))
    return np.mean(hits)


def test_recall_over_several_shards(spark, monkeypatch):
    table = spark.read.parquet(f"{SF01}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    rows = ann.valid_vectors(table)
    queries = rows.filter("vec_id % 20 = 0")
    assert recall(ann.search(ann.build(rows, shard_rows=150), queries).collect(), vectors) >= 0.95
    assert recall(ann.nearest(table).collect(), vectors) >= 0.95


def test_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(1200, 16)) * rng.lognormal(0, 0.7, (1200, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    assert recall(ann.nearest(table).collect(), dict(enumerate(data))) >= 0.9


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (20, [1.0, 1.0]), (20, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (60, None)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, dim int, shard int")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(table).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 2, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0)]
    assert ann.nearest(table.limit(0)).count() == 0


def test_one_vector_repeated(spark):
    table = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    assert recall(ann.nearest(table).collect(), vectors) == 1


def test_queries_side_by_side_find_what_each_finds_alone():
    """A block of queries follows the graph together: the same nodes as a
    best-first search of each query by itself."""
    rng = np.random.default_rng(3)
    nodes, queries = rng.normal(size=(900, 12)), rng.normal(size=(70, 12))
    flat = ann.Graph(nodes).flat()
    searcher = ann.Searcher(flat["start"], flat["widths"], flat["links"], flat["vectors"], 12)
    alone = [[[j for j in row if j >= 0] for row in level.tolist()] for level in searcher.near]
    for width in (1, 30, 1200):
        found = searcher.nearest(queries, width)
        assert found.shape == (70, width)
        for q, got in zip(queries, found):
            at = [searcher.start]
            for near in alone[:0:-1]:
                at = [ann.Graph._search(searcher, q, at, 1, near.__getitem__, nodes)[0][1]]
            want = [i for _, i in ann.Graph._search(searcher, q, at, width, alone[0].__getitem__, nodes)]
            assert got[got >= 0].tolist() == want
