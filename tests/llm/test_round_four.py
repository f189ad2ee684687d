"""What grew faster than its input."""

import numpy as np

from loomery.llm import ego_join


def test_vectors_are_not_shuffled_for_pairs_of_intervals(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(400 + i, [1.0 + i / 1000] + [0.0] * 7) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ego_join, "INTERVAL", 32)
    plans, tiles = [], ego_join.interval_tiles

    def seen(seq, eps2, tasks):
        out = tiles(seq, eps2, tasks)
        plans.append((out._jdf.queryExecution().executedPlan().toString(), tasks, seq.count(), out.count()))
        return out

    monkeypatch.setattr(ego_join, "interval_tiles", seen)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ego_join.near_vectors(df).collect()}
    (plan, tasks, n, pairs), = plans
    assert "CartesianProduct" in plan and "Exchange" not in plan and tasks <= ego_join.PARTS
    assert n <= pairs <= n * (n + 1) // 2
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert {i: got[i][0] for i in got} == {i: int(near[i].sum()) - 1 for i in range(len(rows))}
