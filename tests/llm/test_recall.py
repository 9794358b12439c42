"""Recall of the nearest-neighbour search on the given vectors, against brute force, and the work that it takes."""
import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import ann


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    rows = pq.read_table(glob.glob(path)[0]).to_pylist()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    good = ann.clean(spark.read.parquet(path))
    out = ann.search(good, good.filter(F.col("vec_id") % 50 == 0), 5).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        assert [q[0] for q in sorted(found[ids[k]])] == [1, 2, 3, 4, 5]
        assert all(abs(score - s[ids == v][0]) < 1e-9 for _, v, score in found[ids[k]])
        s[k] = -9
        hits += len({int(ids[j]) for j in np.argsort(-s, kind="stable")[:5]} & {v for _, v, _ in found[ids[k]]})
        total += 5
    print(sf, "recall", hits / total)
    assert hits / total >= 0.9
