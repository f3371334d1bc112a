"""Exact nearest rows in many tiles against all products."""

import numpy as np
import pytest

from qbank.operators import search


@pytest.mark.parametrize("block", [7, 4096])
def test_tiles(spark, block):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 5)), 1)
    x[10:20] = x[5]  # ties
    x[30] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    ix = search.index(df)
    got = {}
    for r in search.similar(ix, ix.where("vec_id % 3 = 0"), k=6, threshold=-1.0, block=block).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 9))
    unit = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    for i in range(0, 90, 3):
        scores = np.round((unit * unit[i]).sum(axis=1), 12)
        order = [j for j in np.lexsort((np.arange(90), -scores)) if j != i][:6]
        assert np.allclose([got[i][n + 1][1] for n in range(6)], scores[order], atol=1e-8)
        assert len({v for v, _ in got[i].values()}) == 6 and i not in {v for v, _ in got[i].values()}
    assert search.similar(ix, ix.limit(0)).count() == 0 and search.similar(ix.limit(0), ix).count() == 0
