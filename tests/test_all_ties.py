"""Nearest neighbours where more rows tie than are asked for."""

import numpy as np
import pytest

from mnemex.operators.vectors import nearest


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("itself", [True, False])
def test_nearest_among_many_equal_vectors(spark, metric, itself):
    r = np.random.default_rng(5)
    ids = r.permutation(400)
    base = r.normal(size=(4, 6))
    x = base[ids % 4] * (1 + 1e-9 * r.normal(size=(400, 1)))  # equal but for digits that rounding drops
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>").coalesce(1)
    asked = rows.where("id < 4").withColumnRenamed("id", "query_id")
    got = nearest(asked, rows, k=3, metric=metric, itself=itself).collect()
    first = 0 if itself else 1
    assert sorted((g.query_id, g.rank, g.id) for g in got) == [(q, k + 1, q + 4 * (k + first)) for q in range(4) for k in range(3)]
