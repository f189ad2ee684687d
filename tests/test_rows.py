import math

import pytest
from pyspark.sql import functions as F

from loomery.functions.prng import M, unit, with_draws
from loomery.operators import rows


@pytest.fixture(scope="module")
def events(spark):
    return spark.range(1003).withColumnRenamed("id", "row_idx").repartition(5).withColumn("v", F.col("row_idx") * 2)


def test_row_index(spark):
    df = spark.createDataFrame([(float(x % 17), x) for x in range(500)], "k double, id long").repartition(7)
    got = rows.with_row_index(df, "k", ("id",), ranges=9).orderBy("k", "id").collect()
    assert [r.row_idx for r in got] == list(range(500))
    assert rows.with_row_index(df.where("k < 0"), "k").count() == 0


def test_prng_is_stable_and_even(events):
    one = {r.row_idx: r.u for r in with_draws(events, "row_idx", 42, {"u": 0}).collect()}
    two = {r.row_idx: r.u for r in with_draws(events.repartition(2), "row_idx", 42, {"u": 0}).collect()}
    assert one == two and len(set(one.values())) == 1003 and all(0 <= x < M for x in one.values())
    assert abs(with_draws(events, "row_idx", 7, {"u": 1}).agg(F.avg(unit(F.col("u")))).first()[0] - 0.5) < 0.05


@pytest.mark.parametrize("fraction", [0.001, 0.1, 0.5, 0.999, 1.0])
def test_subset(events, fraction):
    got = rows.subset(events, fraction).orderBy("row_idx").collect()
    assert len(got) == int(1003 * fraction) and [r.row_idx for r in got] == list(range(len(got)))
    assert [r.v for r in got] == sorted(r.v for r in got)


def test_subset_range(events):
    with pytest.raises(ValueError):
        rows.subset(events, 0)


def test_shard():
    n, per = 17, {}
    for node in range(2):
        place = {}
        for r in range(n):
            per_node, bs, nodes = n // 2, 3, 2
            b, tail = divmod(per_node, bs)
            dealt = b * bs * nodes
            if r < dealt and r % (bs * nodes) // bs == node:
                place[r // (bs * nodes) * bs + r % bs] = r
            elif dealt + tail * node <= r < dealt + tail * (node + 1):
                place[b * bs + r - dealt - tail * node] = r
        per[node] = [place[i] for i in sorted(place)]
    assert per == {0: [0, 1, 2, 6, 7, 8, 12, 13], 1: [3, 4, 5, 9, 10, 11, 14, 15]}


@pytest.mark.parametrize("n,bs,nodes", [(17, 3, 2), (100, 7, 3), (5, 10, 2)])
def test_shard_is_a_partition(spark, n, bs, nodes):
    df, seen = spark.range(n).withColumnRenamed("id", "row_idx"), []
    for k in range(nodes):
        got = rows.shard(df, n, k, nodes, bs).orderBy("row_idx").collect()
        assert [r.row_idx for r in got] == list(range(n // nodes))
        seen += [r.source_idx for r in got]
    assert sorted(seen) == list(range(n // nodes * nodes))
    if n == 17:
        assert seen == [0, 1, 2, 6, 7, 8, 12, 13, 3, 4, 5, 9, 10, 11, 14, 15]


def test_block_list():
    assert rows.block_list(1003, 335) == [(0, 335), (335, 335), (670, 333)]
    assert rows.block_list(20, 5000) == [(0, 20)] and rows.block_list(0, 5) == []


def test_shuffles(events):
    got = rows.shuffle_rows(events, 3)
    assert sorted(r.row_idx for r in got.collect()) == list(range(1003)) and got.where("row_idx <> source_idx").count() > 900
    blocks = rows.shuffle_blocks(rows.with_blocks(events, 1003, 335), 3).collect()
    assert sorted(r.row_idx for r in blocks) == list(range(1003)) and all(r.source_idx // 335 == r.block_id for r in blocks)
    plain = rows.shuffle_blocks(rows.with_blocks(events, 1003, 335), 3, within=False, block_order=False).collect()
    assert all(r.row_idx == r.source_idx for r in plain)


def test_batches_wrap(events):
    n = rows.batch_count(1003, 32)
    got = rows.batches(events, 1003, 32, n).collect()
    assert n == 32 and len(got) == 1024 and all(r.pos % 1003 == r.row_idx and r.pos == r.batch_id * 32 + r.slot for r in got)
    assert rows.batch_count(10, 1, "COUNT", 4) == 4
    for bad in (("COUNT", 0), ("SOME", 1)):
        with pytest.raises(ValueError):
            rows.batch_count(10, 1, *bad)


def test_positions():
    assert list(rows.positions(10, 2, "ONCE")) == [0, 1, 2, 3, 4]
    forever = rows.positions(10, 2, "INFINITE")
    assert [next(forever) for _ in range(30)] == list(range(30))


def test_row_at(events):
    assert rows.row_at(events, 1002).v == 2004
    with pytest.raises(IndexError):
        rows.row_at(events, 1003)


def test_transpose(spark):
    df = spark.createDataFrame([(0, s, [s * 10.0 + i for i in range(3)]) for s in range(4)], "b long, s long, v array<double>")
    got = {r.position: r["values"] for r in rows.transpose(df, "b", "s", "v").collect()}
    assert got == {i: [s * 10.0 + i for s in range(4)] for i in range(3)}
    assert math.isclose(sum(map(sum, got.values())), 192)


def test_tied_keys_are_split(spark):
    """Rows of one key are in several partitions, in the order of their ties, and else in that of the table."""
    df = spark.createDataFrame([(float(x >= 1000), 2000 - x) for x in range(2000)] + [(1e15, 0)], "k double, id long").coalesce(1)
    got = rows.with_row_index(df, "k", ("id",), ranges=16)
    assert [r.row_idx for r in got.orderBy("k", "id").collect()] == list(range(2001))
    plain = rows.with_row_index(df, "k", ranges=16)
    assert [r.id for r in plain.orderBy("row_idx").collect()] == [*range(2000, 0, -1), 0]
    parts = plain.select(F.input_file_name().alias("f"), "k").distinct().groupBy("k").count().collect()
    assert min(r["count"] for r in parts if r.k < 2) > 3


def test_numbers_in_place(spark):
    df = spark.createDataFrame([(p, x) for p in (2, 0, 1) for x in range(50)], "part long, x long").repartition(5, "part").sortWithinPartitions(F.desc("part"), F.desc("x"))
    got = rows.number_in_place(df, ["part"], "n").orderBy("n").collect()
    assert [(r.n, r.part, r.x) for r in got] == [(50 * p + 49 - x, p, x) for p in range(3) for x in range(49, -1, -1)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_subset_neither_joins_nor_sorts_what_is_left(events):
    assert plan_of(rows.subset(events, 0.3)).count("Exchange") <= 2 and "SortMergeJoin" not in plan_of(rows.subset(events, 0.3))


def test_epochs_have_their_own_order(events):
    blocks = rows.with_blocks(rows.with_epochs(events, 2, 4), 1003, 100)
    got = rows.shuffle_blocks(blocks, 3, within=False).collect()
    order = {e: [r.source_idx for r in sorted((r for r in got if r.epoch == e), key=lambda r: r.row_idx)] for e in (2, 3, 4)}
    assert all(sorted(o) == list(range(1003)) for o in order.values()) and len({tuple(o) for o in order.values()}) == 3
    starts = [x for x in order[2] if x % 101 == 0]
    assert all(order[2][order[2].index(s) : order[2].index(s) + 10] == list(range(s, s + 10)) for s in starts if s + 10 < 1003)


@pytest.mark.parametrize("n,bs,nodes", [(1003, 7, 3), (20, 4, 1)])
def test_deals_partition_every_epoch(events, n, bs, nodes):
    got = {k: rows.deal_epochs(events.where(F.col("row_idx") < n), n, 5, 1, 3, k, nodes, bs).collect() for k in range(nodes)}
    seen = set()
    for epoch in (1, 2, 3):
        mine = {k: sorted((r.row_idx, r.source_idx) for r in rs if r.epoch == epoch) for k, rs in got.items()}
        assert all([p for p, _ in m] == list(range(n // nodes)) for m in mine.values())
        all_ = [s for m in mine.values() for _, s in m]
        assert len(set(all_)) == len(all_) == n // nodes * nodes
        seen.add(tuple(all_))
    assert len(seen) == 3


def test_move_to(events):
    head, rest = rows.move_to(events, 3)
    assert sorted(r.row_idx for r in head.collect()) == [0, 1, 2] and sorted(r.row_idx for r in rest.collect()) == list(range(1000))
    assert rest.where("row_idx = 0").first().v == 6 and rows.move_to(events, 5000)[1].count() == 0


def test_bottom_k(spark):
    """The same rows as by a rank, from any layout."""
    df = spark.range(5000).selectExpr("id % 7 % 3 as a", "cast(id % 5 as int) as b", "(id * 7919) % 100003 as u", "id").repartition(6)
    got = rows.bottom_k(df, ["a", "b"], ["u", "id"], 11, by=["a"])
    want = sorted((r.a, r.b, r.u, r.id) for r in df.collect())
    best = [r for i, r in enumerate(want) if i < 11 or want[i - 11][:2] != r[:2]]
    assert sorted(map(tuple, got.collect())) == best and got.columns == df.columns
    assert "Window" not in plan_of(got) and rows.bottom_k(df.limit(0), ["a"], ["u"], 3).count() == 0
