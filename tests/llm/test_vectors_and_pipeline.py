"""The vector search against brute force, the registered queries against SQL, and the pipeline's stages."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkgrid.llm import ann, oracles, queries
from inkgrid.llm.shared import materialise

SMALL = "/root/testdata/sf0.001"


def test_search(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    x[100:140] = x[0]  # ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(2000, None, "n"), (2020, [0.0] * 24, "z"), (2040, [float("nan")] * 24, "b"), (2060, [1.0], "short"), (None, [1.0] * 24, "i")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = ann.search(table, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    d, hits = x.astype(float), 0
    assert sorted(by) == list(range(0, 1500, 20))
    for q, own in by.items():
        own.sort(key=lambda r: r["rank"])
        exact = ann.exact_products(d[q], d)
        order = [i for i in np.lexsort((np.arange(1500), -exact)).tolist() if i != q][:20]
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(r["score"] == exact[r["vec_id"]] for r in own)
        hits += len({r["vec_id"] for r in own} & set(order))
    assert hits >= 0.9 * 20 * len(by)
    assert ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_in_near_copies(spark):
    """Thousands of near copies share one code or a few: the exact nearest are found, whatever their ids."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((4000, 24))
    x[1000:] = x[0] + 1e-3 * rng.standard_normal((3000, 24))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = [0, 7, 1500, 3999]
    found = ann.search(table, F.col("vec_id").isin(asked)).collect()
    for q in asked:
        exact = ann.exact_products(x[q], x)
        order = [i for i in np.lexsort((np.arange(4000), -exact)).tolist() if i != q][:20]
        assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == order


def test_anisotropic_loss_is_lower():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 16))
    q = ann.fit(x, threshold=0.3)
    plain = ann.Quantiser(q.centres, 1.0)

    def parallel(code):
        r = (q.pad(x) - np.stack([q.centres[m][code[:, m]] for m in range(8)], 1)).reshape(2000, -1)
        return ((r * x).sum(1) ** 2 / (x * x).sum(1)).mean()

    assert parallel(q.codes(x)) < parallel(plain.codes(x))


def test_few_rows_are_ranked_exactly():
    """Both levels of codes leave less than a seventh of a real table to exact products, and lose no neighbour."""
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet", columns=["vec_id", "embedding"])
    table = table.filter(pc.is_valid(table["embedding"]))
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)
    q = ann.fit(x)
    code = q.codes(x)
    second, *reach = q.reaches(x, code)
    block = ann.Coded(q, ids, x, *(np.ascontiguousarray(ann.pack_nibbles(c).T) for c in (code, second)), *reach)
    counts = []
    for k in range(0, len(ids), 25):
        found, score, n = block.nearest(ids[k], x[k], 20, ann.RERANK)
        exact = ann.exact_products(x[k], x)
        others = np.flatnonzero(ids != ids[k])
        want = others[np.lexsort((ids[others], -exact[others]))[:20]]
        assert found.tolist() == ids[want].tolist() and (score == exact[want]).all()
        counts.append(n / len(ids))
    print(np.mean(counts))
    assert np.mean(counts) <= 0.15


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    a = queries.queries()[name](spark, SMALL).toPandas()
    b = con.execute(oracles.oracle_sql()[name]).df()[list(a.columns)]
    norm = lambda df: sorted(str(tuple(None if v is None or v != v else round(float(v), 9) if isinstance(v, (float, int, np.number, np.bool_)) else v for v in r)) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))
    assert norm(a) == norm(b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] <= counts[4] < counts[5]
