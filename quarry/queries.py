"""Queries over the driver tables, one or more for each relational operator, with SQL of the same meaning."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import parse_create
from quarry.engine import Engine
from quarry.functions.clocks import compare, merge
from quarry.functions.hashing import Ranges, Ring, hash_partition, salt, unsalt
from quarry.operators import crdt, index, load, merkle, resolve, scans
from quarry.operators import transactions as tx
from quarry.plans.sql import connect
from quarry.plans.stats import analyze
from quarry.sources.fs import scratch
from quarry.sources.store import Store
from quarry.sources.tables import load as table
from quarry.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


# scans, projections, predicates


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice >= 100000")
def seq_scan_filter(spark, d):
    return table(spark, d, "orders").where("o_totalprice >= 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey AS id, c_name AS name FROM customer")
def project_alias(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT * FROM nation")
def select_star(spark, d):
    return table(spark, d, "nation").select("*")


def _predicate(name: str, condition: str) -> None:
    cols = "l_orderkey, l_linenumber, l_quantity, l_returnflag"

    @query(f"SELECT {cols} FROM lineitem WHERE {condition}", name)
    def run(spark, d):
        return table(spark, d, "lineitem").where(condition).select(*cols.split(", "))


for _name, _condition in (
    ("pred_eq", "l_quantity = 17"),
    ("pred_neq", "l_returnflag <> 'N'"),
    ("pred_gt", "l_quantity > 45"),
    ("pred_gte", "l_quantity >= 45"),
    ("pred_lt", "l_quantity < 5"),
    ("pred_lte", "l_quantity <= 5"),
    ("pred_and", "l_quantity > 45 AND l_returnflag = 'R'"),
    ("pred_or", "l_quantity = 1 OR l_linenumber = 7"),
):
    _predicate(_name, _condition)


@query("SELECT event_id, nullif(event_type, 'view') AS kind FROM events WHERE nullif(event_type, 'view') IS DISTINCT FROM 'click'")
def pred_neq_keeps_nulls(spark, d):
    e = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    return e.where(~F.col("kind").eqNullSafe("click"))


@query("SELECT event_id, event_type FROM events WHERE contains(lower(event_type), 'ur')")
def pred_substring(spark, d):
    return table(spark, d, "events").where(F.lower("event_type").contains("ur")).select("event_id", "event_type")


# joins

_FLAGSHIP = """SELECT o.o_orderkey, o.o_totalprice, c.c_name, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 200000"""


@query(_FLAGSHIP)
def nlj_equi_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_totalprice", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name < 'K'")
def join_inner_predicate(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).where("n_name < 'K'").select("s_suppkey", "s_name", "n_name")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT n_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def join_three_tables(spark, d):
    s, n, r = (table(spark, d, x) for x in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


# indexes


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7")
def index_scan_eq(spark, d):
    o = table(spark, d, "orders")
    return index.through(o, F.col("o_orderkey"), index.entries(o, "o_custkey", F.col("o_orderkey")), 7).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_totalprice > 150000")
def index_scan_residual(spark, d):
    o = table(spark, d, "orders")
    i = index.entries(o, "o_custkey", F.col("o_orderkey"))
    return index.through(o, F.col("o_orderkey"), i, 7, F.col("o_totalprice") > 150000).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderpriority")
def index_value_keys(spark, d):
    return index.keys_by_value(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderkey"))


@query("SELECT DISTINCT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F'")
def index_lookup_sorted(spark, d):
    return index.lookup(index.entries(table(spark, d, "orders"), "o_orderstatus", F.col("o_orderkey")), "F")


# versions: the events of a user are versions of the user's key


def _ops(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.lit("a").alias("origin"), F.col("event_id").alias("seq"), F.col("value"), "event_type", (F.col("event_type") == "error").alias("is_delete")
    )


@query("SELECT user_id AS key, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def lww_latest_per_key(spark, d):
    return resolve.latest(_ops(spark, d), ["key"], tombstones=True).select("key", "seq", "value")


@query("SELECT user_id AS key, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def tombstone_resolve(spark, d):
    return resolve.latest(_ops(spark, d), ["key"]).select("key", "seq", "value")


@query("SELECT user_id AS key, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def merge_segments(spark, d):
    ops = _ops(spark, d)
    return resolve.merge_segments([ops.where(F.pmod("seq", F.lit(3)) == i) for i in range(3)], ["key"]).select("key", "seq", "value")


@query("SELECT user_id AS key, event_id AS seq, value, event_type FROM events WHERE user_id = 7 ORDER BY event_id")
def point_get_versions(spark, d):
    e = Engine(spark, scratch(spark, "store"))
    e.sql("CREATE TABLE ev (key int PRIMARY KEY, seq int, value double, event_type string)")
    ops = _ops(spark, d).select("key", "seq", "value", "event_type")
    e.store.append("ev", e.store.operations(e.store.catalog.get("ev"), ops, ts=F.col("seq")))
    return e.versions("ev", 7).select("row.key", "row.seq", "row.value", "row.event_type")


@query("""SELECT user_id AS key, event_id AS seq FROM events WHERE event_id % 7 <> 3 AND (event_type <> 'error' OR event_id % 7 = 5)""")
def versioned_get(spark, d):
    tag = F.concat(F.lit("t"), F.pmod("seq", F.lit(7)).cast("string"))
    ops = _ops(spark, d).withColumn("created_tx", tag).withColumn("deleted_tx", F.when(F.col("is_delete"), tag))
    # t5 has not committed its deletions, t3 nothing; the reader's own writes are t5's
    hidden = resolve.visible(ops, ["t3"])
    undone = ops.where(F.col("deleted_tx") == "t5")
    return hidden.unionByName(undone).select("key", "seq")


@query("SELECT event_id, user_id, value FROM events WHERE user_id = 7 AND event_id BETWEEN 100 AND 5000")
def clustering_range_scan(spark, d):
    return scans.scan_range(table(spark, d, "events"), F.col("user_id") == 7, "event_id", 100, 5000).select("event_id", "user_id", "value")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_brand), 'a') ORDER BY p_partkey LIMIT 25 OFFSET 10")
def list_records_page(spark, d):
    return scans.page(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), ["p_partkey"], 10, 25, "A", ["p_name", "p_brand"])


def _three_segments(spark, d) -> Store:
    store = Store(spark, scratch(spark, "store"))
    store.catalog.create(parse_create("CREATE TABLE ord (o_orderkey int PRIMARY KEY, o_custkey int, o_totalprice double)"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    for i in range(3):
        store.put("ord", o.where(F.pmod("o_orderkey", F.lit(3)) == i))
    return store


@query("SELECT 'ops/0000000' || (o_orderkey % 3) || '/' AS segment, count(*) AS items, min('ord||' || o_orderkey) AS first_key, max('ord||' || o_orderkey) AS last_key FROM orders GROUP BY 1")
def segment_summary(spark, d):
    return _three_segments(spark, d).segments("ord").select("segment", "items", "first_key", "last_key")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 1")
def segment_scan(spark, d):
    return _three_segments(spark, d).segment("ord", 1).select("row.*")


@query("SELECT date_trunc('second', ts)::timestamp AS time, 'event ' || event_id || ' ' || event_type AS message FROM events")
def event_log(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("["), F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss"), F.lit("] event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"))
    return scans.event_log(e.select(line.alias("value"))).select(F.col("time").cast("timestamp_ntz").alias("time"), "message")


# vector clocks: each event type is a node that counts its events of a user

_CLOCKS = """WITH e AS (SELECT user_id AS key, event_id, event_type AS node, event_id % 4 AS grp FROM events),
c AS (SELECT key, grp, count(*) FILTER (node = 'click') AS a, count(*) FILTER (node = 'view') AS b, count(*) FILTER (node = 'purchase') AS c FROM e GROUP BY key, grp)"""


def _clocks(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key"), F.pmod("event_id", F.lit(4)).alias("grp"))
    n = e.agg(*(F.count(F.when(F.col("event_type") == t, 1)).alias(c) for c, t in (("a", "click"), ("b", "view"), ("c", "purchase"))))
    return n.select("key", "grp", F.create_map(F.lit("a"), "a", F.lit("b"), "b", F.lit("c"), "c").alias("vc"))


_GT = "(x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND (x.a > y.a OR x.b > y.b OR x.c > y.c))"
_LT = _GT.replace("x.", "z.").replace("y.", "x.").replace("z.", "y.")


@query(f"{_CLOCKS} SELECT x.key, x.grp AS g, y.grp AS h, CASE WHEN {_GT} THEN '>' WHEN {_LT} THEN '<' END AS rel, greatest(x.a, y.a) AS a, greatest(x.b, y.b) AS b, greatest(x.c, y.c) AS c FROM c x JOIN c y ON x.key = y.key AND x.grp < y.grp")
def vclock_compare_merge(spark, d):
    c = _clocks(spark, d)
    x, y = c.select("key", F.col("grp").alias("g"), F.col("vc").alias("x")), c.select("key", F.col("grp").alias("h"), F.col("vc").alias("y"))
    j = x.join(y, "key").where("g < h").withColumn("m", merge(F.col("x"), F.col("y")))
    return j.select("key", "g", "h", compare(F.col("x"), F.col("y")).alias("rel"), *(F.col("m")[k].alias(k) for k in "abc"))


@query(f"{_CLOCKS} SELECT x.key, x.grp FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.key = x.key AND {_LT})")
def vclock_siblings(spark, d):
    return resolve.siblings(_clocks(spark, d), ["key"], "grp").select("key", "grp")


@query(f"{_CLOCKS}, s AS (SELECT x.key, x.grp FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.key = x.key AND {_LT})) SELECT key, max(grp) AS grp FROM s GROUP BY key")
def vclock_winner(spark, d):
    ops = _clocks(spark, d).select("key", "vc", "grp", F.col("grp").alias("ts"), F.lit("a").alias("origin"), F.lit(0).alias("seq"), F.lit(False).alias("is_delete"))
    return resolve.winner(ops, ["key"], value="grp").select("key", "grp")


@query("SELECT event_id, user_id, value FROM events")
def duplicate_suppression(spark, d):
    e = Engine(spark, scratch(spark, "store"))
    e.sql("CREATE TABLE ev (event_id int PRIMARY KEY, user_id int, value double)")
    e.store.put("ev", table(spark, d, "events").select("event_id", "user_id", "value"))
    log = e.log("ev")
    return resolve.without_duplicates(log.unionByName(log.where("partition_key < '5'"))).select("row.*")  # part of it is delivered twice


@query("""WITH r AS (SELECT user_id AS key, event_id % 3 AS replica, arg_max(event_id, ts) AS value, max(ts) AS ts FROM events GROUP BY 1, 2),
w AS (SELECT key, arg_max(value, ts) AS winner FROM r GROUP BY key) SELECT key, replica, value, winner FROM r JOIN w USING (key) WHERE value <> winner""")
def read_repair_candidates(spark, d):
    ops = _ops(spark, d).withColumn("replica", F.pmod("seq", F.lit(3)))
    replicas = resolve.latest(ops, ["key", "replica"], tombstones=True).select("key", "replica", F.col("seq").alias("value"), "ts", "origin", "seq")
    return resolve.stale_replicas(replicas, ["key"]).select("key", "replica", "value", "winner")


# counters and sets


@query("SELECT user_id, CAST(sum(m) AS BIGINT) AS value FROM (SELECT user_id, event_type, max(n) AS m FROM (SELECT user_id, event_type, event_id % 3 AS copy, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL) GROUP BY user_id")
def gcounter_value(spark, d):
    e = table(spark, d, "events").select("user_id", F.pmod("event_id", F.lit(3)).alias("copy"), F.col("event_type").alias("replica"), F.lit(1).alias("n"))
    return crdt.counter_value(crdt.counter_states(e, ["user_id", "copy"], "replica", "n").select("user_id", "state"), ["user_id"])


@query("SELECT DISTINCT user_id, event_type AS element FROM (SELECT user_id, event_type, event_id // 3 AS tag, max(event_id % 3) AS r FROM events GROUP BY ALL) WHERE r < 2")
def orset_members(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("element"), F.floor(F.col("event_id") / 3).alias("tag"), (F.pmod("event_id", F.lit(3)) == 2).alias("removes"))
    return crdt.set_members(e, ["user_id"], "element", "tag", "removes")


# Merkle trees


def _merkle_sql(levels: int) -> str:
    sql = "WITH l0 AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, sha256(n_nationkey::varchar || ':' || n_name) AS h FROM nation)"
    for k in range(levels):
        sql += f", l{k + 1} AS (SELECT i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM l{k} GROUP BY i // 2)"
    return f"{sql} SELECT h AS root FROM l{levels}"


@query(_merkle_sql(math.ceil(math.log2(25))))
def merkle_root(spark, d):
    root = merkle.root(spark, table(spark, d, "nation"), "n_nationkey", "n_name", scratch(spark, "merkle"))
    return spark.createDataFrame([(root,)], "root string")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 6 = 1 OR n_nationkey >= 20")
def merkle_leaf_diff(spark, d):
    n = table(spark, d, "nation")
    other = n.where("n_nationkey < 20").withColumn("n_name", F.when(F.col("n_nationkey") % 6 == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    return merkle.differing_keys(n, other, "n_nationkey", "n_name")


@query("""WITH l0 AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, sha256(n_nationkey::varchar || ':' || n_name) AS h FROM nation),
l1 AS (SELECT region, i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM l0 GROUP BY region, i // 2), s AS (SELECT region, count(*) AS n FROM l0 GROUP BY 1),
k1 AS (SELECT l1.* FROM l1 JOIN s USING (region) WHERE n > 1 UNION ALL SELECT l0.* FROM l0 JOIN s USING (region) WHERE n = 1),
l2 AS (SELECT region, i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM k1 GROUP BY region, i // 2),
k2 AS (SELECT l2.* FROM l2 JOIN s USING (region) WHERE n > 2 UNION ALL SELECT k1.* FROM k1 JOIN s USING (region) WHERE n <= 2),
l3 AS (SELECT region, i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM k2 GROUP BY region, i // 2),
k3 AS (SELECT l3.* FROM l3 JOIN s USING (region) WHERE n > 4 UNION ALL SELECT k2.* FROM k2 JOIN s USING (region) WHERE n <= 4),
l4 AS (SELECT region, i // 2 AS i, sha256(arg_min(h, i) || arg_max(h, i)) AS h FROM k3 GROUP BY region, i // 2),
k4 AS (SELECT l4.* FROM l4 JOIN s USING (region) WHERE n > 8 UNION ALL SELECT k3.* FROM k3 JOIN s USING (region) WHERE n <= 8)
SELECT region AS n_regionkey, h AS root FROM k4""")
def merkle_segments(spark, d):
    return merkle.segment_roots(table(spark, d, "nation"), "n_regionkey", "n_nationkey", "n_name", scratch(spark, "merkle"))


def _merkle_orders_sql(depth: int = 24) -> str:
    """Levels beyond the root repeat it: a single node stays."""
    sql = "WITH l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, sha256(o_orderkey::varchar || ':' || o_orderpriority) AS h FROM orders)"
    for k in range(depth):
        sql += f", n{k} AS (SELECT count(*) AS n FROM l{k}), l{k + 1} AS (SELECT i // 2 AS i, CASE WHEN (SELECT n FROM n{k}) > 1 THEN sha256(arg_min(h, i) || arg_max(h, i)) ELSE min(h) END AS h FROM l{k} GROUP BY i // 2)"
    return f"{sql} SELECT h AS root FROM l{depth}"


@query(_merkle_orders_sql())
def merkle_root_orders(spark, d):
    root = merkle.root(spark, table(spark, d, "orders"), "o_orderkey", "o_orderpriority", scratch(spark, "merkle"))
    return spark.createDataFrame([(root,)], "root string")


# placement

_BYTE = "('0x' || substr(sha1(user_id::varchar), 39, 2))::bigint % 128"


@query("SELECT (('0x' || substr(sha1(o_orderkey::varchar), 39, 2))::bigint % 128)::int AS pid, count(*) AS n FROM orders GROUP BY 1")
def hash_pid_counts(spark, d):
    return table(spark, d, "orders").groupBy(hash_partition(F.col("o_orderkey"), 128).alias("pid")).agg(F.count("*").alias("n"))


def _horner(n: int) -> str:
    acc = "0"
    for i in range(5):
        acc = f"(({acc}) * {pow(16, 8, n)} + ('0x' || substr(sha1(c_custkey::varchar), {8 * i + 1}, 8))::bigint) % {n}"
    return acc


@query(f"SELECT c_custkey, ({_horner(1000)})::int AS pid FROM customer")
def hash_partition_any(spark, d):
    return table(spark, d, "customer").select("c_custkey", hash_partition(F.col("c_custkey"), 1000).alias("pid"))


_RANGES = Ranges(("Customer#000000000", "Customer#000000300", "Customer#000000900", "Customer#000001200"))


@query("""SELECT CASE WHEN c_name >= 'Customer#000000000' AND c_name < 'Customer#000000300' THEN 0 WHEN c_name >= 'Customer#000000300' AND c_name < 'Customer#000000900' THEN 1
ELSE 2 END AS pid, count(*) AS n FROM customer GROUP BY 1""")
def range_pid_counts(spark, d):
    return table(spark, d, "customer").groupBy(_RANGES.partition(F.col("c_name")).alias("pid")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN c_name >= 'Customer#000000000' AND c_name < 'Customer#000000100' THEN 0 WHEN c_name >= 'Customer#000000100' AND c_name < 'Customer#000000300' THEN 1
ELSE 2 END AS pid, count(*) AS n FROM customer GROUP BY 1""")
def range_split_merge(spark, d):
    ranges = _RANGES.split(0, "Customer#000000100").merge(2, 3)
    return table(spark, d, "customer").groupBy(ranges.partition(F.col("c_name")).alias("pid")).agg(F.count("*").alias("n"))


_RING = Ring((("n0", 8), ("n1", 8))).add("n2", 8)
_TOKENS = ", ".join(f"('{t}', '{n}')" for t, n in _RING.tokens)


@query(f"""WITH t(token, node) AS (VALUES {_TOKENS}), n AS (SELECT token, node, row_number() OVER (ORDER BY token) - 1 AS i FROM t),
k AS (SELECT c_custkey, (SELECT count(*) FROM n WHERE token <= sha1(c_custkey::varchar)) % 24 AS i FROM customer) SELECT node, count(*) AS keys FROM k JOIN n USING (i) GROUP BY node""")
def ring_owner_counts(spark, d):
    return table(spark, d, "customer").groupBy(_RING.owner(F.col("c_custkey")).alias("node")).agg(F.count("*").alias("keys"))


@query(f"""WITH t(token, node) AS (VALUES {_TOKENS}), n AS (SELECT token, node, row_number() OVER (ORDER BY token) - 1 AS i FROM t),
k AS (SELECT s_suppkey, (SELECT count(*) FROM n WHERE token <= sha1(s_suppkey::varchar || ':0')) % 24 AS i FROM supplier),
w AS (SELECT s_suppkey, node, min((n.i - k.i + 24) % 24) AS far FROM k, n GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY far) AS pos FROM w)
SELECT s_suppkey, string_agg(node, ',' ORDER BY pos) AS nodes FROM o WHERE pos <= 2 GROUP BY s_suppkey""")
def ring_preference(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(_RING.preference(F.col("s_suppkey"), 2), ",").alias("nodes"))


@query(f"WITH t(token, node) AS (VALUES {_TOKENS}), n AS (SELECT token, node, row_number() OVER (ORDER BY token) - 1 AS i FROM t) SELECT CAST(a.i AS INTEGER) AS \"partition\", b.token AS start, a.token AS \"end\", a.node FROM n a JOIN n b ON b.i = (a.i + 23) % 24")
def ring_ranges(spark, d):
    return _RING.ranges(spark)


_COUNTS = f"WITH c AS (SELECT {_BYTE} AS pid, count(*) AS ops, count(DISTINCT user_id) AS items FROM events GROUP BY 1), p AS (SELECT r.range::int AS pid, coalesce(ops, 0) AS ops, coalesce(items, 0) AS items FROM range(128) r LEFT JOIN c ON c.pid = r.range)"


def _counts(spark, d) -> DataFrame:
    ops = table(spark, d, "events").withColumn("pid", hash_partition(F.col("user_id"), 128))
    return load.partition_counts(spark, ops, "pid", 128, "user_id")


@query(f"{_COUNTS} SELECT * FROM p")
def partition_counts(spark, d):
    return _counts(spark, d)


@query(f"{_COUNTS} SELECT * FROM p WHERE ops > 2.0 * (SELECT avg(ops) FROM p)")
def hot_partitions(spark, d):
    return load.hot_partitions(_counts(spark, d))


@query(f"{_COUNTS} SELECT * FROM p WHERE ops < 0.5 * (SELECT avg(ops) FROM p)")
def cold_partitions(spark, d):
    return load.cold_partitions(_counts(spark, d))


@query(f"{_COUNTS} SELECT * FROM p WHERE ops > 2.0 * (SELECT avg(ops) FROM p) AND items >= 2")
def auto_split_proposals(spark, d):
    return load.split_proposals(_counts(spark, d))


@query(f"{_COUNTS}, k AS (SELECT pid FROM p WHERE ops < 0.5 * (SELECT avg(ops) FROM p) AND items <= 1) SELECT a.pid AS \"left\", b.pid AS \"right\" FROM k a JOIN k b ON a.pid + 1 = b.pid")
def auto_merge_proposals(spark, d):
    return load.merge_proposals(_counts(spark, d), "pid")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def hot_keys_top5(spark, d):
    return load.hot_keys(table(spark, d, "events"), "user_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 60")
def keys_to_salt(spark, d):
    return load.keys_to_salt(table(spark, d, "events"), "user_id", 60)


@query("SELECT user_id::varchar AS key, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def salted_counts(spark, d):
    e = table(spark, d, "events").select(salt(F.col("user_id"), F.col("event_id"), 8).alias("salted"), "value")
    part = e.groupBy("salted").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return part.groupBy(unsalt(F.col("salted")).alias("key")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT user_id AS key, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def salted_latest(spark, d):
    ops = _ops(spark, d)
    return load.salted_latest(ops, "key", load.keys_to_salt(ops, "key", 60), "seq", 8, resolve.ORDER).select("key", "seq", "value")


@query("SELECT event_id, user_id, value FROM events WHERE ('0x' || substr(sha1('ev||' || event_id), 39, 2))::bigint % 128 = 17")
def partition_transfer(spark, d):
    here, there = (Store(spark, scratch(spark, "store"), origin) for origin in ("here", "there"))
    for store in (here, there):
        store.catalog.create(parse_create("CREATE TABLE ev (event_id int PRIMARY KEY, user_id int, value double)"))
    here.put("ev", table(spark, d, "events").select("event_id", "user_id", "value"))
    scans.move_partition(here, there, "ev", 17, 128)
    return there.view("ev").join(here.view("ev").select("event_id"), "event_id", "left_anti")


@query("SELECT count(*) AS ops, greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS seconds, round(sum(value), 2) AS total, round(count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS throughput FROM events")
def cluster_totals(spark, d):
    out = load.totals(table(spark, d, "events"), "ts", "value")
    return out.withColumns({"total": F.round("total", 2), "throughput": F.round("throughput", 9)})


# statistics

_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS num_rows, count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::int), 0) AS num_distinct FROM customer" for c in _CUSTOMER))
def analyze_rows_ndv(spark, d):
    return analyze(table(spark, d, "customer"))


# DDL, DML, transactions: customers in a store, changed by SQL

_DDL = "CREATE TABLE cust (c_custkey int PRIMARY KEY, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string)"


def _store(spark, d):
    sql = connect(spark, scratch(spark, "store"))
    sql.execute(_DDL)
    sql.store.put("cust", table(spark, d, "customer"))
    return sql


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT * FROM (VALUES (10000001, 'new', 1::bigint, 5.0::double, NULL), (10000002, 'other', NULL, NULL, 'X')) t")
def dml_insert_view(spark, d):
    sql = _store(spark, d)
    sql.execute("INSERT INTO cust (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) VALUES (10000001, 'new', 1, 5.0, NULL), (10000002, 'other', NULL, NULL, 'X')")
    return sql.store.view("cust")


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def dml_update_view(spark, d):
    sql = _store(spark, d)
    sql.execute("UPDATE cust SET c_acctbal = c_acctbal * 2 + 1 WHERE c_mktsegment = 'BUILDING'")
    return sql.store.view("cust")


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT (c_acctbal < 0)")
def dml_delete_view(spark, d):
    sql = _store(spark, d)
    sql.execute("DELETE FROM cust WHERE c_acctbal < 0")
    sql.store.compact("cust")
    return sql.store.view("cust")


@query("SELECT c_custkey, c_name, NULL::bigint AS age FROM customer")
def add_column_null(spark, d):
    sql = _store(spark, d)
    sql.execute("ALTER TABLE cust ADD COLUMN age int")
    return sql.execute("SELECT c_custkey, c_name, age FROM cust")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 10000001, 'new', 5.0::double")
def sql_index_after_write(spark, d):
    sql = _store(spark, d)
    sql.execute("CREATE INDEX by_segment ON cust (c_mktsegment)")
    sql.execute("INSERT INTO cust (c_custkey, c_name, c_acctbal, c_mktsegment) VALUES (10000001, 'new', 5.0, 'BUILDING')")
    return sql.execute("SELECT c_custkey, c_name, c_acctbal FROM cust WHERE c_mktsegment = 'BUILDING'")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def transaction_commit(spark, d):
    e = Engine(spark, scratch(spark, "store"))
    e.sql(_DDL)
    e.store.put("cust", table(spark, d, "customer"))
    first, second = e.begin(), e.begin()
    first.put("cust", e.store.view("cust").where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    second.put("cust", e.store.view("cust").withColumn("c_acctbal", F.lit(0.0)))
    first.commit()
    e.abort(second.id)
    return e.store.view("cust").select("c_custkey", "c_acctbal")


@query("SELECT user_id, count(*) AS value FROM events GROUP BY user_id")
def counter_apply(spark, d):
    store = Store(spark, scratch(spark, "store"))
    store.catalog.create(parse_create("CREATE TABLE cnt (user_id int PRIMARY KEY, state map<string,bigint>)"))
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("replica"), F.lit(1).alias("amount"), "event_id")
    for i in range(2):
        crdt.apply_increments(store, "cnt", "state", e.where(F.pmod("event_id", F.lit(2)) == i))
    return crdt.counter_value(store.view("cnt"), ["user_id"])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def sql_index_path(spark, d):
    sql = _store(spark, d)
    sql.execute("CREATE INDEX by_segment ON cust (c_mktsegment)")
    return sql.execute("SELECT c_custkey, c_name, c_acctbal FROM cust WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")


@query("SELECT user_id, round(sum(value), 2) AS balance FROM events GROUP BY user_id")
def balance_after_increments(spark, d):
    return tx.balances(table(spark, d, "events"), "user_id", "value").withColumn("balance", F.round("balance", 2))


_TX = "t AS (SELECT event_id AS tx, event_id AS start, event_id + 40 AS done, user_id AS r, user_id % 20 AS w FROM events)"


@query(f"WITH {_TX} SELECT DISTINCT a.tx, b.tx AS other FROM t a JOIN t b ON a.r = b.w WHERE b.tx <> a.tx AND b.done > a.start AND b.done < a.done")
def ssi_conflicts(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("tx"), F.col("event_id").alias("start"), (F.col("event_id") + 40).alias("commit"), F.array("user_id").alias("reads"), F.array(F.pmod("user_id", F.lit(20))).alias("writes"))
    return tx.serialization_conflicts(e)


@query("WITH e AS (SELECT event_id, user_id, event_type FROM events) SELECT DISTINCT r.event_id AS tx, w.event_id AS other, r.user_id AS key FROM e r JOIN e w ON r.user_id = w.user_id WHERE r.event_type = 'view' AND w.event_type = 'purchase' AND w.event_id > r.event_id AND w.event_id <= r.event_id + 500")
def write_conflicts(spark, d):
    e = table(spark, d, "events")
    r = e.where("event_type = 'view'").select(F.col("event_id").alias("tx"), F.col("user_id").alias("key"), F.col("event_id").alias("at"), (F.col("event_id") + 500).alias("until"))
    w = e.where("event_type = 'purchase'").select(F.col("event_id").alias("tx"), F.col("user_id").alias("key"), F.col("event_id").alias("at"))
    return tx.write_conflicts(r, w)


@query("SELECT min(m) AS acknowledged FROM (SELECT event_type, max(event_id) AS m FROM events GROUP BY 1)")
def min_acknowledged(spark, d):
    return tx.acknowledged(table(spark, d, "events").groupBy("event_type").agg(F.max("event_id").alias("seq")))


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 = 0")
def fetch_updates(spark, d):
    e = Engine(spark, scratch(spark, "store"))
    e.sql("CREATE TABLE ev (event_id int PRIMARY KEY, user_id int)")
    rows = table(spark, d, "events").select("event_id", "user_id")
    e.store.put("ev", rows.where("event_id % 3 <> 0"))
    seen = spark.createDataFrame(e.replication("ev").select("origin", F.col("last_seq").alias("seq")).collect(), "origin string, seq long")  # a peer's view, one row an origin
    e.store.put("ev", rows.where("event_id % 3 = 0"))  # what the peer lacks
    return e.updates("ev", seen).select("row.event_id", "row.user_id")


# streaming


def _events_stream(spark, d) -> DataFrame:
    # the table's file is the source: a stream wants a folder
    return spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("SELECT user_id AS key, event_id AS seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def streaming_lww(spark, d):
    e = _events_stream(spark, d)
    ops = e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.lit("a").alias("origin"), F.col("event_id").alias("seq"), "value")
    return ingest.run_to_table(ops, scratch(spark, "stream"), ["key"]).select("key", "seq", "value")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_window_counts(spark, d):
    counts = ingest.windowed_counts(_events_stream(spark, d), "ts", "1 hour", "1 day", "event_type")
    return ingest.run_to_memory(counts, "streaming_window_counts").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# more of what the SQL front takes


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority HAVING count(*) > 10")
def sql_group_having(spark, d):
    sql = connect(spark, scratch(spark, "store"))
    sql.execute("CREATE TABLE orders (o_orderkey int PRIMARY KEY, o_orderpriority string, o_totalprice double)")
    sql.store.put("orders", table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"))
    return sql.execute(SQL["sql_group_having"])


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))

