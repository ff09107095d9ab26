import math

import numpy as np

from llm_fixtures import none, odd, odd_rows  # noqa: F401
import corpus_pipeline
from pricelens.llm import permutation_index, queries, shingle_join


def exact(rows, every, k=10):
    ids, table = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q, v in zip(ids, table, strict=True):
        if q % every == 0:
            far = np.sqrt(((table - v) ** 2).sum(axis=1))
            order = [k for k in np.lexsort((ids, far)) if ids[k] != q][:k]
            out[int(q)] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_recall_and_scores_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact([tuple(r) for r in rows], 100)
    got = {}
    for r in sorted(queries.op4_permutation_index(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    assert all(abs(s - np.linalg.norm(vectors[q] - vectors[x])) < 1e-12 for q, v in got.items() for x, s in v)


def test_odd_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = math.nan, math.inf
    good = [(k, [float(k % 3), 1.0]) for k in range(1, 40)] + [(100, [0.0, 1.0]), (200, [1.0, 1.0])]
    bad = [(300, None), (400, [0.0, 0.0]), (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]), (800, []), (900, [1.0]), (None, [1.0, 2.0])]
    rows = [(i, v, "x", 1) for i, v in good + bad]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, shard int").repartition(4)
    got = {}
    for r in permutation_index.nearest(table, shard=16, group=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = exact(good, 100)
    assert {q: [(x, s) for _, x, s in sorted(v)] for q, v in got.items()} == want
    assert permutation_index.nearest(table.limit(0)).count() == 0
    assert permutation_index.nearest(table.where("vec_id = 100")).count() == 0


def test_inverted_files_rank_by_footrule():
    rng = np.random.default_rng(1)
    near = np.argsort(rng.random((50, 12)), axis=1)[:, :5].astype(np.int16)
    query = np.argsort(rng.random(12))[:5].astype(np.int16)
    place = lambda p: {int(x): k for k, x in enumerate(p)}
    far = [sum(abs(place(query).get(x, 5) - place(v).get(x, 5)) for x in range(12)) for v in near]
    assert permutation_index.InvertedFiles(near, 12).ranked(query, 50).tolist() == np.argsort(far, kind="stable").tolist()


def test_pipeline_stages_take_effect(spark, sf_dir, folder):
    docs, counts = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    columns = docs.columns
    strange = spark.createDataFrame([(10**6, "12 34", None, "s", 5), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "Γειά σου κόσμε " * 60, None, "s", 900)], docs.schema)
    docs = docs.union(strange)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        counts.append(docs.count())
        if k == 0:
            assert docs.where("doc_id >= 1000000").count() == 0 and counts[0] == before.count() - 3
        if k == 2:
            linked = shingle_join.linked_documents(before)
            assert counts[2] == linked.select("component_id").distinct().count()
        if k < 4:
            assert docs.columns == columns
        if k == 3:
            assert counts[3] == counts[2] and docs.where("n_chars <> length(text)").count() == 0
            assert docs.selectExpr("sum(length(text))").first()[0] < before.selectExpr("sum(length(text))").first()[0]
    assert counts[0] > counts[1] > counts[2]
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.agg({"doc_id": "max"}).first()[0] < 10**6


def test_pipeline_handles_odd_and_no_rows(spark, odd, none, sf_dir, folder):
    for name, docs in (("odd", odd.select("doc_id", "text", "lang", "source", "n_chars", "score", "key")), ("none", none.select("doc_id", "text", "lang", "source", "n_chars"))):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}{k}")
            docs = spark.read.parquet(f"{folder}/{name}{k}")
            assert k == 4 or docs.columns == columns
        assert (docs.count() > 0) == (name == "odd")


def test_a_repeated_id_is_one_query_and_a_neighbour_each_time(spark):
    rows = [(k, [float(k), 1.0]) for k in range(1, 30)] + [(100, [3.0, 1.0]), (100, [3.0, 1.0]), (200, [3.5, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in permutation_index.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert [x for _, x, _ in sorted(got[100])] == [3, 200, 2, 4, 1, 5, 6, 7, 8, 9]
    assert [(x, s) for _, x, s in sorted(got[200])][:4] == [(3, 0.5), (4, 0.5), (100, 0.5), (100, 0.5)]
    assert [n for n, _, _ in sorted(got[100])] == list(range(1, 11)) == [n for n, _, _ in sorted(got[200])]
