"""Vector search for many queries at once."""

from __future__ import annotations

import numpy as np
from docframe.operators import search
from docframe.plans import catalog


def test_all_queries_over_blocks_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 400)] + [(400, [0.0] * 8), (401, [1.0, 2.0]), (402, None), (None, [1.0] * 8)]
    rows += [(450 + i, rows[49][1]) for i in range(4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in search.nearest_each(vectors, vectors.filter("vec_id % 50 = 0"), 6, block=3).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    full = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 8}
    cos = lambda a, b: round(float(a @ b / n), 6) if (n := np.linalg.norm(a) * np.linalg.norm(b)) else 0.0
    want = {q: sorted(((i, cos(v, full[q])) for i, v in full.items()), key=lambda x: (-x[1], x[0]))[:6] for q in full if q % 50 == 0}
    assert len(want) == 9 and {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_registered_search_takes_every_fiftieth(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = catalog.nearest_to_each(spark, "/root/testdata/sf0.01").groupBy("query_id").count().collect()
    assert len(found) == vectors.filter("vec_id % 50 = 0").count() and all(r["count"] == 20 for r in found)


def test_python_gets_single_vectors_not_joined_blocks(spark):
    vectors = spark.range(1, 301).selectExpr("id as vec_id", "array(1.0D, cast(id as double)) as embedding")
    found = search.nearest_each(vectors, vectors.filter("vec_id % 50 = 0"), 3, block=40)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "units" not in plan
    assert found.count() == 18
