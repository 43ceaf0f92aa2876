"""Versions, clocks, counters, trees, placement, load, streams on small fixtures; and plans."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions.clocks import Lamport, compare, merge
from quarry.functions.hashing import Ranges, Ring, hash_partition, salt, unsalt
from quarry.operators import crdt, index, load, merkle, resolve, scans
from quarry.operators import transactions as tx
from quarry.plans.explain import physical_plan, plan_tree
from quarry.queries import QUERIES
from quarry.sources.store import Store
from quarry.streaming import ingest

OPS = "key string, value string, ts long, origin string, seq long, is_delete boolean"


def test_last_write_wins_ties_and_tombstones(spark):
    ops = spark.createDataFrame(
        [("k", "v1", 1, "a", 1, False), ("k", "v3", 2, "b", 1, False), ("k", "v2", 2, "a", 9, False), ("d", "x", 1, "a", 2, False), ("d", None, 5, "a", 3, True)], OPS
    )
    assert [(r["key"], r["value"]) for r in resolve.latest(ops, ["key"]).collect()] == [("k", "v3")]
    assert resolve.latest(ops, ["key"], tombstones=True).count() == 2
    parts = [ops.where("seq = 1"), ops.where("seq <> 1")]
    assert resolve.merge_segments(parts, ["key"]).first()["value"] == "v3"


def test_siblings(spark):
    schema = "key string, value string, vc map<string,long>, ts long, origin string, seq long, is_delete boolean"
    base = [("k", "va", {"A": 1}, 1, "a", 1, False), ("k", "vb", {"B": 1}, 2, "b", 1, False)]
    assert resolve.siblings(spark.createDataFrame(base, schema), ["key"]).count() == 2
    more = spark.createDataFrame([*base, ("k", "va", {"A": 1, "B": 1}, 3, "a", 2, False)], schema)
    assert [r["value"] for r in resolve.siblings(more, ["key"]).collect()] == ["va"]
    assert resolve.winner(spark.createDataFrame(base, schema), ["key"]).first()["value"] == "vb"


def test_clocks(spark):
    rows = [({"a": 2, "b": 1}, {"a": 1}, ">"), ({"a": 1}, {"a": 1, "c": 1}, "<"), ({"a": 1}, {"b": 1}, None), ({"a": 1}, {"a": 1}, None)]
    df = spark.createDataFrame(rows, "x map<string,long>, y map<string,long>, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", compare(F.col("x"), F.col("y"))).collect())
    assert df.select(merge(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 2, "b": 1}
    c = Lamport(3)
    assert (c.tick(), c.update(10), c.update(2)) == (4, 11, 12)


def test_visibility(spark):
    df = spark.createDataFrame([(1, "t1", None), (2, "t2", None), (3, None, "t1"), (4, None, "t3")], "k int, created_tx string, deleted_tx string")
    assert [r["k"] for r in resolve.visible(df, ["t1"]).collect()] == [2, 3]
    assert [r["k"] for r in resolve.visible(df, ["t1"], "t1").collect()] == [1, 2]


def test_counters_and_sets(spark):
    inc = spark.createDataFrame([("x", "A", 2), ("x", "B", 3)], "key string, replica string, n int")
    states = crdt.counter_states(inc, ["key"], "replica", "n")
    assert crdt.counter_value(states.union(states), ["key"]).first()["value"] == 5
    merged = spark.range(1).select(crdt.merge_counters(F.create_map(F.lit("A"), F.lit(1)), F.create_map(F.lit("A"), F.lit(2), F.lit("B"), F.lit(1))).alias("m")).first()["m"]
    assert merged == {"A": 2, "B": 1}
    ops = spark.createDataFrame([("s", "a", "t1", False), ("s", "a", "t1", True), ("s", "a", "t2", False), ("s", "b", "t3", False), ("s", "b", "t3", True)], "key string, e string, tag string, rm boolean")
    assert [r["e"] for r in crdt.set_members(ops, ["key"], "e", "tag", "rm").collect()] == ["a"]
    adds, gone = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array(F.lit("3"))), F.create_map(F.lit("a"), F.array(F.lit("1")), F.lit("b"), F.array(F.lit("3")))
    assert spark.range(1).select(crdt.set_value(adds, gone).alias("v")).first()["v"] == ["a"]


def fold(leaves):
    level = [hashlib.sha256(x.encode()).hexdigest() for x in leaves]
    if not level:
        return hashlib.sha256(b"").hexdigest()
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
    return level[0]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 37])
def test_merkle_root(spark, root, n):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(n)], "k int, v string").repartition(3)
    want = fold([f"{i}:v{i}" for i in range(n)])
    for depth in (1, 2, 12):  # many rounds, or one
        assert merkle.root(spark, df, "k", "v", f"{root}/{depth}", depth=depth) == want
    several = df.withColumn("s", F.when(F.col("k") < 5, "a").when(F.col("k") < 6, "b"))
    got = {r["s"]: r["root"] for r in merkle.segment_roots(several, "s", "k", "v", f"{root}/s", depth=2).collect()}
    parts = {s: [f"{i}:v{i}" for i in range(n) if ("a" if i < 5 else "b" if i < 6 else None) == s] for s in ("a", "b", None)}
    assert got == {s: fold(x) for s, x in parts.items() if x}


def most_read(spark, group, run):
    """The most rows that one task of run() got from shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(group, "")
    run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    tasks = [x.apply(i) for s in stages for x in [store.taskList(s, 0, 1000)] for i in range(x.size())]
    return max(x.taskMetrics().get().shuffleReadMetrics().recordsRead() for x in tasks)


def test_merkle_spreads_a_segment_over_tasks(spark, root):
    n = 4000
    df = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("v")).withColumn("s", F.when(F.col("id") % 100 == 7, F.col("id")))
    many = {r: fold([f"{i}:v{i}" for i in range(n) if (i if i % 100 == 7 else None) == r]) for r in (None, *range(7, n, 100))}
    # as for large tables: joins without broadcasts, partitions that aren't merged
    large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in large}
    got = []
    try:
        for k, v in large.items():
            spark.conf.set(k, v)
        most = [
            most_read(spark, "one", lambda: got.append(merkle.root(spark, df, "id", "v", f"{root}/one", depth=4))),
            most_read(spark, "many", lambda: got.append(merkle.segment_roots(df, "s", "id", "v", f"{root}/many", depth=4).collect())),
        ]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(most) < 0.6 * n, most
    assert got[0] == fold([f"{i}:v{i}" for i in range(n)]) and dict(map(tuple, got[1])) == many


def test_merkle_difference(spark):
    a = spark.createDataFrame([("k1", "v"), ("k2", "v")], "k string, v string")
    assert [r["k"] for r in merkle.differing_keys(a, a.where("k = 'k1'"), "k", "v").collect()] == ["k2"]
    assert merkle.differing_keys(a.where("k = 'k1'"), a, "k", "v").isEmpty()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20), st.sampled_from([1, 3, 7, 128, 1000, 2**31 - 1]))
def test_hash_partition_is_the_160_bit_remainder(spark, keys, n):
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hash_partition(F.col("k"), n).alias("p"))
    for r in df.collect():
        assert r["p"] == int(hashlib.sha1(r["k"].encode()).hexdigest(), 16) % n


def test_ring(spark):
    ring = Ring((("n0", 10), ("n1", 10))).add("n2", 10)
    df = spark.createDataFrame([(f"k{i}",) for i in range(300)], "k string")
    got = {r["k"]: (r["o"], r["p"]) for r in df.select("k", ring.owner(F.col("k")).alias("o"), ring.preference(F.col("k"), 3).alias("p")).collect()}
    assert all(ring.owner_of(k) == o and sorted(p) == ["n0", "n1", "n2"] for k, (o, p) in got.items())
    gone = ring.remove("n1")
    moved = {r["k"]: r["o"] for r in df.select("k", gone.owner(F.col("k")).alias("o")).collect()}
    assert all(moved[k] == o for k, (o, _) in got.items() if o != "n1")
    assert ring.ranges(spark).count() == 30


def test_ranges(spark):
    r = Ranges(("a", "h", "p"))
    df = spark.createDataFrame([("a",), ("g",), ("h",), ("z",), ("A",)], "k string")
    assert [x["p"] for x in df.select(r.partition(F.col("k")).alias("p")).collect()] == [0, 0, 1, 1, 1]
    assert r.split(0, "d").bounds == ("a", "d", "h", "p") and r.split(0, "d").merge(0, 1) == r
    with pytest.raises(ValueError):
        r.merge(1, 0)
    with pytest.raises(ValueError):
        r.split(0, "z")


def test_salt(spark):
    df = spark.createDataFrame([("hot#1", i) for i in range(20)], "k string, i int").withColumn("s", salt(F.col("k"), F.col("i"), 3))
    assert df.select("s").distinct().count() > 1
    assert df.select(unsalt(F.col("s")).alias("k")).distinct().collect()[0]["k"] == "hot#1"


def test_load(spark):
    rows = [(0, "a")] * 30 + [(1, "b"), (1, "c")] + [(2, "d")] * 2
    ops = spark.createDataFrame(rows, "pid int, key string")
    counts = load.partition_counts(spark, ops, "pid", 6, "key")
    assert [r["pid"] for r in load.hot_partitions(counts).collect()] == [0]
    assert load.split_proposals(counts).isEmpty()  # one key can't be split
    assert sorted(r["pid"] for r in load.cold_partitions(counts).collect()) == [1, 2, 3, 4, 5]
    assert sorted(tuple(r) for r in load.merge_proposals(counts, "pid").collect()) == [(2, 3), (3, 4), (4, 5)]
    assert [r["key"] for r in load.hot_keys(ops, "key", 2).collect()] == ["a", "d"]
    assert [r["key"] for r in load.keys_to_salt(ops, "key", 3).collect()] == ["a"]
    owners = list(load.rebalanced(128, ["x", "y", "z"]).values())
    assert max(map(owners.count, "xyz")) - min(map(owners.count, "xyz")) <= 1


def test_paging_and_search(spark):
    df = spark.createDataFrame([(f"pk{i}", f"v{i}") for i in range(5)] + [("foo1", "V9")], "k string, v string")
    assert [r["v"] for r in scans.page(df.where("k like 'pk%'"), ["k"], 2, 2).collect()] == ["v2", "v3"]
    assert [r["k"] for r in scans.page(df, ["k"], query="v9", search=["v"]).collect()] == ["foo1"]


def test_event_log(spark):
    df = spark.createDataFrame([("[2024-01-02 03:04:05] node up",), ("noise",)], "value string")
    assert [(str(r["time"]), r["message"]) for r in scans.event_log(df).collect()] == [("2024-01-02 03:04:05", "node up")]


def test_index_is_typed(spark):
    df = spark.createDataFrame([("p1", "red"), ("p2", "red"), ("p3", "5")], "k string, color string")
    i = index.entries(df, "color", F.col("k"))
    assert [r["key"] for r in index.lookup(i, "red").collect()] == ["p1", "p2"]
    assert [r["key"] for r in index.lookup(i, "5").collect()] == ["p3"]


def test_conflict_reports(spark):
    t = spark.createDataFrame([("t1", 1, 9, ["x"], ["y"]), ("t2", 2, 5, [], ["x"]), ("t3", 10, 12, ["x"], [])], "tx string, start int, commit int, reads array<string>, writes array<string>")
    assert [tuple(r) for r in tx.serialization_conflicts(t).collect()] == [("t1", "t2")]
    b = spark.createDataFrame([("a", "1.5"), ("a", "x"), ("b", None)], "k string, amount string")
    assert sorted(tuple(r) for r in tx.balances(b, "k", "amount").collect()) == [("a", 1.5), ("b", 0.0)]


def test_streams(spark, root, tmp_path):
    src = tmp_path / "in"
    ops = [(f"k{i % 3}", f"v{i}", i, "a", i, i == 5) for i in range(6)]
    spark.createDataFrame(ops, OPS).write.json(str(src))
    stream = ingest.read_log(spark, str(src), OPS)
    got = ingest.run_to_memory(ingest.current_values(stream, ["key"]), "t_current")
    assert sorted((r["key"], r["value"], r["is_delete"]) for r in got.collect()) == [("k0", "v3", False), ("k1", "v4", False), ("k2", "v5", True)]
    twice = spark.createDataFrame([("o1", "2024-01-01 00:00:00"), ("o1", "2024-01-01 00:00:30"), ("o2", "2024-01-01 00:00:10")], "op_id string, event_time string")
    twice.coalesce(1).write.json(str(tmp_path / "dup"))
    once = ingest.distinct_operations(ingest.read_log(spark, str(tmp_path / "dup"), "op_id string, event_time string"))
    assert ingest.run_to_memory(once, "t_once", "append").count() == 2


def test_ingest_is_repeatable(spark, root, tmp_path):
    from quarry.catalog import parse_create

    store = Store(spark, root)
    store.catalog.create(parse_create("CREATE TABLE kv (k string PRIMARY KEY, v string)"))
    spark.createDataFrame([("a", "1", False), ("b", "2", False)], "k string, v string, is_delete boolean").write.json(str(tmp_path / "in"))
    for n in range(2):
        stream = ingest.read_log(spark, str(tmp_path / "in"), "k string, v string, is_delete boolean")
        ingest.ingest(stream, store, "kv", f"{tmp_path}/cp{n}").awaitTermination()  # the second time a checkpoint was lost
    assert sorted(tuple(r) for r in store.view("kv").collect()) == [("a", "1"), ("b", "2")]
    spark.createDataFrame([("c", "3", False)], "k string, v string, is_delete boolean").write.json(str(tmp_path / "other"))
    stream = ingest.read_log(spark, str(tmp_path / "other"), "k string, v string, is_delete boolean")
    ingest.ingest(stream, store, "kv", f"{tmp_path}/cp-other").awaitTermination()  # another stream with the same batch numbers
    assert sorted(tuple(r) for r in store.view("kv").collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    ingest.ingest(stream, store, "kv", f"{tmp_path}/cp-other").awaitTermination()
    assert store.log("kv").where("key = 'kv||c'").count() == 1


def test_store_survives_late_operations(spark, root):
    from quarry.catalog import parse_create

    store = Store(spark, root)
    store.catalog.create(parse_create("CREATE TABLE kv (k string PRIMARY KEY, v string)"))
    t = store.catalog.get("kv")
    rows = lambda *r: spark.createDataFrame(r, "k string, v string")
    store.append("kv", store.operations(t, rows(("a", "new"), ("b", "x")), ts=100))
    store.append("kv", store.operations(t, rows(("b", None)), delete=True, ts=200))
    store.compact("kv", horizon=150)
    store.append("kv", store.operations(t, rows(("a", "old"), ("b", "back"), ("c", "y")), ts=50))
    assert sorted(tuple(r) for r in store.view("kv").collect()) == [("a", "new"), ("c", "y")]


def test_random_histories_resolve_like_a_loop(spark):
    rng = random.Random(1)
    ops = [(f"k{rng.randrange(9)}", str(i), rng.randrange(20), rng.choice("ab"), i, rng.random() < 0.2) for i in range(300)]
    best = {}
    for o in ops:
        if o[0] not in best or o[2:5] > best[o[0]][2:5]:
            best[o[0]] = o
    want = sorted((k, o[1]) for k, o in best.items() if not o[5])
    assert sorted((r["key"], r["value"]) for r in resolve.latest(spark.createDataFrame(ops, OPS), ["key"]).collect()) == want


D = "/root/testdata/sf0.001"


def test_plans(spark):
    plan = physical_plan(QUERIES["seq_scan_filter"](spark, D))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThanOrEqual(o_totalprice,100000.0)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan and "Exchange" not in plan
    assert "BroadcastHashJoin" in physical_plan(QUERIES["nlj_equi_join"](spark, D))
    lww = physical_plan(QUERIES["tombstone_resolve"](spark, D))
    assert "partial_max_by" in lww and lww.count("Exchange") == 1
    tree = plan_tree(QUERIES["project_alias"](spark, D))
    assert tree["node"] and tree["bytes"] > 0
