"""Lines of manifests: all of a table's rows have one, and their numbers hold when files are split otherwise."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomery.operators import rows
from loomery.plans.all_queries import ORACLES, QUERIES
from loomery.plans.loader import DataLoader
from loomery.sources import manifest

TEXTS = ["the end", "", "# eleven eels", "@ here", None, " \t", "\n", "\ufeffe", "e#e", "a\tb\r\ne@", "1", "see thee " * 50, "é", "#", "@STRING", "0\te"]


def same(spark, name, table, folder):
    pq.write_table(table[1], f"{folder}/{table[0]}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table[0]} AS SELECT * FROM '{folder}/{table[0]}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    return sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


@pytest.mark.parametrize("ids", ["from zero", "below zero", "one is null"])
def test_every_text_is_a_line(spark, tmp_path, ids):
    """Texts that are null, empty or begin as the format's own lines do, and keys that are null or below zero."""
    texts = TEXTS * 3
    keys = [k - 20 if ids == "below zero" else None if ids == "one is null" and k == 11 else k for k in range(len(texts))]
    assert same(spark, "loader_own_provider", ("documents", pa.table({"doc_id": pa.array(keys, pa.int64()), "text": pa.array(texts, pa.string())})), tmp_path)


def test_every_event_is_a_line(spark, tmp_path):
    kinds = ["click", "", "#", "@STRING", "# view", "view"] * 5
    assert same(spark, "manifest_file", ("events", pa.table({"event_id": pa.array(range(30), pa.int64()), "event_type": kinds})), tmp_path)


def test_numbers_hold_when_files_are_split_otherwise(spark, tmp_path):
    """A plan that was made with some splits is run with others, as when executors come and go."""
    n = 0
    for k, size in enumerate((3, 4000, 1, 700)):
        lines = ["# part"] + ["@STRING"] * (k == 0) + [str(n + i) for i in range(size)]
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines))
        n += size
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    plan = DataLoader(spark, {"manifest_filename": str(tmp_path), "batch_size": 8, "etl": [{"type": "label"}]}).plan()
    try:
        for size in ("2k", "11k", before):
            spark.conf.set(key, size)
            got = sorted((r.batch_id * 8 + r.slot, r.row_idx, r.label[0]) for r in plan.collect())
            assert got == [(k, k, k) for k in range(n)]
    finally:
        spark.conf.set(key, before)


def test_comments_between_records(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("#\n@STRING\n" + "".join(f"{k}\n" + "# note\n\n" * (k % 3 == 0) for k in range(40)))
    _, records = manifest.parse(manifest.read_lines(spark, str(tmp_path / "m.tsv")))
    got = records.orderBy("row_idx").collect()
    assert [(r.row_idx, r.e) for r in got] == [(k, [str(k)]) for k in range(40)]
    assert [r.line_no for r in got] == [2 + k + 2 * ((k + 2) // 3) for k in range(40)]


def test_rows_apart_are_not_numbered_in_place(spark):
    df = spark.createDataFrame([(k % 2, k) for k in range(6)], "part long, x long").coalesce(1)
    with pytest.raises(ValueError, match="must stand together"):
        rows.number_in_place(df, ["part"], "n")
