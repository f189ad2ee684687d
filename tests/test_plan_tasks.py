"""Tasks of a loader's plan."""

from loomery.plans import loader
from loomery.plans.loader import DataLoader


def test_a_whole_plan_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    path = tmp_path / "manifest.tsv"
    path.write_text("@STRING\n" + "".join(f"{k}\n" for k in range(203)))
    made = DataLoader(spark, {"manifest_filename": str(path), "batch_size": 2, "etl": [{"type": "label"}]})
    rows = lambda df: sorted((r.batch_id, r.slot, r.row_idx, r.label[0]) for r in df.collect())
    assert made.plan(iterated=True).rdd.getNumPartitions() == 26
    assert made.plan().rdd.getNumPartitions() == 4  # as many as shuffles have
    monkeypatch.setattr(loader, "TASK_BATCHES", 10)
    assert made.plan().rdd.getNumPartitions() == 11
    monkeypatch.setattr(loader, "MAX_TASKS", 7)
    few = made.plan()
    assert few.rdd.getNumPartitions() == 7 and rows(few) == rows(made.plan(iterated=True)) == [(k // 2, k % 2, k % 203, k % 203) for k in range(204)]
    assert [b[0][1].ravel().tolist() for b in made] == [[2 * k, (2 * k + 1) % 203] for k in range(102)]
