"""Tables, SQL, access paths and transactions on small fixtures."""

import json

import pytest

from quarry.catalog import CatalogError, ColumnDef, TableDef, ValidationError, parse_create
from quarry.engine import Engine
from quarry.operators.transactions import Conflict, InsufficientFunds, Transaction
from quarry.plans.sql import SqlError, connect
from quarry.plans.stats import access_path


@pytest.fixture
def sql(spark, root):
    return connect(spark, root)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def people(sql):
    sql.execute("CREATE TABLE users (id int PRIMARY KEY, age int)")
    sql.execute("INSERT INTO users (id, age) VALUES (1, 20), (2, 25)")
    sql.store.compact("users")
    sql.execute("INSERT INTO users VALUES (3, 30), (4, 40)")
    return sql


def test_create_parses_types_keys_and_defaults(spark):
    t = parse_create("CREATE TABLE t (a int, b string NOT NULL, c double DEFAULT 1.5, d decimal(10,2), PRIMARY KEY (a, b))")
    assert t.keys == ["a", "b"] and not t.columns[1].nullable and t.columns[2].default == "1.5" and t.columns[3].type == "decimal(10,2)"
    with pytest.raises(CatalogError):
        parse_create("CREATE TABLE t (a nonsense PRIMARY KEY)")


def test_filter_over_snapshot_and_log(sql):
    people(sql)
    assert rows(sql.execute("SELECT id FROM users WHERE age >= 30")) == [(3,), (4,)]


def test_index_equals_scan_and_keeps_other_conditions(sql):
    people(sql)
    scan = rows(sql.execute("SELECT id, age FROM users WHERE age = 30"))
    sql.execute("CREATE INDEX by_age ON users (age)")
    assert sql.path("SELECT id, age FROM users WHERE age = 30").kind == "IndexScan"
    assert rows(sql.execute("SELECT id, age FROM users WHERE age = 30")) == scan == [(3, 30)]
    assert rows(sql.execute("SELECT id FROM users WHERE age = 30 AND id > 3")) == []
    assert rows(sql.execute("SELECT id FROM users WHERE age = 30 OR id = 1")) == [(1,), (3,)]
    sql.execute("UPDATE users SET age = 31 WHERE id = 3")
    assert rows(sql.execute("SELECT id FROM users WHERE age = 30")) == []
    assert rows(sql.execute("SELECT id FROM users WHERE age = 31")) == [(3,)]


def test_access_path_by_statistics():
    assert access_path(None, "city", True).kind == "IndexScan"
    assert access_path(None, None, False).kind == "SeqScan"
    assert access_path({"num_rows": 1000, "num_distinct": {"val": 1000}}, "val", True).cost == 4
    seq = access_path({"num_rows": 1000, "num_distinct": {"val": 2}}, "val", True)
    assert (seq.kind, seq.cost) == ("SeqScan", 1000)
    assert access_path({"num_rows": 1000, "num_distinct": {}}, "val", True).kind == "SeqScan"


def test_insert_update_delete(sql):
    sql.execute("CREATE TABLE users (id int PRIMARY KEY, name string)")
    assert sql.execute("INSERT INTO users (id, name) VALUES (1, 'a'), (2, 'it''s; WHERE')").first()["affected"] == 2
    assert sql.execute("UPDATE users SET name = 'b' WHERE id = 1").first()["affected"] == 1
    assert rows(sql.execute("SELECT * FROM users")) == [(1, "b"), (2, "it's; WHERE")]
    sql.execute("INSERT INTO users VALUES (1, 'c')")  # an existing key is replaced
    sql.execute("UPDATE users SET name = concat(name, '!') WHERE name = 'c'")
    assert rows(sql.execute("SELECT name FROM users WHERE id = 1")) == [("c!",)]
    sql.execute("UPDATE users SET id = id + 10 WHERE id = 1")
    assert rows(sql.execute("SELECT id FROM users")) == [(2,), (11,)]
    assert sql.execute("DELETE FROM users").first()["affected"] == 2
    assert rows(sql.execute("SELECT * FROM users")) == []
    sql.store.compact("users", horizon=1 << 60)
    assert sql.store.log("users").count() == 0


def test_validation(sql):
    sql.execute("CREATE TABLE users (id int PRIMARY KEY, name string, score double DEFAULT 1.0)")
    put = lambda r, s: sql.store.put("users", sql.spark.createDataFrame(r, s))
    put([(1, "a", 2)], "id int, name string, score int")
    with pytest.raises(ValidationError):
        put([("a",)], "name string")
    with pytest.raises(ValidationError):
        put([("x", "a")], "id string, name string")
    with pytest.raises(ValidationError):
        put([(1, "a", 1)], "id int, name string, extra int")
    with pytest.raises(Exception, match="must not be null"):
        put([(None, "a")], "id int, name string")
    put([(2, "b")], "id int, name string")
    assert rows(sql.execute("SELECT * FROM users")) == [(1, "a", 2.0), (2, "b", 1.0)]


def test_ddl(sql):
    sql.execute("CREATE TABLE users (id int PRIMARY KEY, name string)")
    with pytest.raises(CatalogError):
        sql.execute("CREATE TABLE users (id int PRIMARY KEY)")
    sql.execute("INSERT INTO users VALUES (1, 'a')")
    sql.execute("ALTER TABLE users ADD COLUMN age int")
    sql.execute("INSERT INTO users VALUES (2, 'b', 30)")
    assert [tuple(r) for r in sql.execute("SELECT id, age FROM users ORDER BY id").collect()] == [(1, None), (2, 30)]
    with pytest.raises(CatalogError):
        sql.execute("ALTER TABLE users ADD COLUMN age int")
    with pytest.raises(CatalogError):
        sql.store.catalog.get("nothing")
    with pytest.raises(SqlError):
        sql.execute("GRANT ALL")
    with pytest.raises(CatalogError):
        TableDef("t", [ColumnDef("a", "int"), ColumnDef("A", "int")])


def test_analyze_and_explain(sql):
    sql.execute("CREATE TABLE users (id int PRIMARY KEY, city string)")
    sql.execute("INSERT INTO users VALUES (1, 'NY'), (2, 'SF'), (3, 'NY'), (4, NULL)")
    stats = {r["column"]: (r["num_rows"], r["num_distinct"]) for r in sql.execute("ANALYZE TABLE users").collect()}
    assert stats == {"id": (4, 4), "city": (4, 3)}
    tree = json.loads(sql.execute("EXPLAIN SELECT id FROM users WHERE city = 'NY'").first()["plan"])
    assert tree["path"] == "SeqScan" and tree["plan"]["children"]


def test_joins(sql):
    sql.execute("CREATE TABLE dept (dept_id int PRIMARY KEY, dept_name string)")
    sql.execute("CREATE TABLE student (sid int PRIMARY KEY, dept_id int, sname string)")
    sql.execute("INSERT INTO dept VALUES (1, 'cs'), (2, 'math')")
    sql.execute("INSERT INTO student VALUES (1, 1, 'a'), (2, 2, 'b'), (3, 1, 'c'), (4, NULL, 'd')")
    got = sql.execute("SELECT d.dept_name FROM student s JOIN dept d ON s.dept_id = d.dept_id ORDER BY s.sid").collect()
    assert [r[0] for r in got] == ["cs", "math", "cs"]
    assert sql.execute("SELECT s.sid FROM student s LEFT JOIN dept d ON s.dept_id = d.dept_id WHERE d.dept_id IS NULL").first()[0] == 4


def accounts(spark, root):
    e = Engine(spark, root)
    e.sql("CREATE TABLE acc (id string PRIMARY KEY, balance double)")
    e.sql("INSERT INTO acc VALUES ('from', 10.0), ('to', 0.0)")
    return e


def test_transactions(spark, root):
    e = accounts(spark, root)
    one, two = e.begin(), e.begin()
    one.get("acc", "from").collect()
    two.put("acc", spark.createDataFrame([("from", 7.0)], "id string, balance double"))
    assert two.get("acc", "from").first()["balance"] == 7.0  # its own writes
    assert e.get("acc", "from").first()["balance"] == 10.0  # not others'
    two.commit()
    one.put("acc", spark.createDataFrame([("to", 9.0)], "id string, balance double"))
    with pytest.raises(Conflict):
        one.commit()
    assert rows(e.sql("SELECT * FROM acc")) == [("from", 7.0), ("to", 0.0)]
    lost, late = Transaction(e.store), Transaction(e.store)
    for t in (lost, late):
        t.put("acc", spark.createDataFrame([("x", 1.0)], "id string, balance double"))
    lost.commit()
    with pytest.raises(Conflict):
        late.commit()
    gone = e.begin()
    gone.put("acc", spark.createDataFrame([("y", 1.0)], "id string, balance double"))
    gone.abort()
    assert e.get("acc", "y").isEmpty()


def test_transfer_and_increment(spark, root):
    e = accounts(spark, root)
    e.transfer("acc", "balance", "from", "to", 4)
    assert rows(e.sql("SELECT * FROM acc")) == [("from", 6.0), ("to", 4.0)]
    with pytest.raises(InsufficientFunds):
        e.transfer("acc", "balance", "from", "to", 100)
    e.increment("acc", "balance", "to", 2)
    e.increment("acc", "balance", "new", 3)
    assert rows(e.sql("SELECT * FROM acc")) == [("from", 6.0), ("new", 3.0), ("to", 6.0)]


def test_engine_reports(spark, root):
    e = Engine(spark, root, partitions=8)
    e.sql("CREATE TABLE kv (pk string, ck string, value string, PRIMARY KEY (pk, ck))")
    for pk, ck, v in (("alpha", "c", "vc"), ("alpha", "a", "va"), ("alpha", "b", "vb"), ("bravo", "a", "other"), ("bravo", "z", "gone")):
        e.put("kv", pk=pk, ck=ck, value=v)
    e.delete("kv", "bravo", "z")
    assert [r["ck"] for r in e.scan_range("kv", "alpha", "a", "c").collect()] == ["a", "b", "c"]
    assert [r["clustering_key"] for r in e.records("kv", 1, 2).collect()] == ["b", "c"]
    assert [r["key"] for r in e.records("kv", query="OTHER").collect()] == ["kv||bravo|a"]
    assert e.get("kv", "bravo", "z").isEmpty() and e.versions("kv", "bravo", "z").count() == 2
    assert e.partitions("kv").agg({"ops": "sum"}).first()[0] == 6
    assert e.hotspots("kv")[1].first()["key"] == "kv||bravo|z"
    assert e.segments("kv").count() == 6
    root_ = e.merkle_root("kv")
    e.compact("kv")
    assert e.segments("kv").count() == 1 and e.merkle_root("kv") == root_
    assert e.query_index("kv", "value", "vb").first()["key"] == "kv||alpha|b"
    assert e.replication("kv").first()["ops"] == 5
    assert e.tables().first()["columns"] == 3 and e.describe("kv").count() == 3
    assert e.time_series("kv").agg({"ops": "sum"}).first()[0] == 5


def test_a_writer_that_stops_leaves_the_old_state(sql):
    people(sql)
    files, store = sql.store.files, sql.store
    number, _ = store._latest("users")
    before = rows(store.view("users"))
    # segments and half a state that a stopped writer left
    files._put("users/ops/00000007/part-0.parquet", "cut")
    files._put(f"users/_state/{number + 1:012d}.json.abc.new", '{"segments": [')
    assert rows(store.view("users")) == before
    store.put("users", store.spark.createDataFrame([(9, 90)], "id int, age int"))
    assert rows(store.view("users")) == [*before, (9, 90)]
    # of two writers that start from one state the second fails, and nothing is lost
    assert not files.replace("users/_state", number, "{}")
    assert rows(store.view("users")) == [*before, (9, 90)]
    for n in files.names("users/_state"):
        files.delete(f"users/_state/{n}")
    with pytest.raises(RuntimeError, match="no state"):
        store.view("users")


def test_sequence_numbers_go_on(spark, root):
    e = Engine(spark, root)
    e.sql("CREATE TABLE kv (k string PRIMARY KEY, v int)")
    for i in range(3):
        e.sql(f"INSERT INTO kv VALUES ('a', {i}), ('b', {i}), ('c', {i})")
    seqs = [r["seq"] for r in e.log("kv").orderBy("ts", "seq").collect()]
    assert seqs == sorted(set(seqs)) and len(seqs) == 9
    seen = spark.createDataFrame(e.replication("kv").select("origin", "last_seq").toDF("origin", "seq").collect(), "origin string, seq long")
    assert e.updates("kv", seen).isEmpty()
    e.put("kv", k="d", v=4)
    assert [r["row"]["k"] for r in e.updates("kv", seen).collect()] == ["d"]


def test_commit_over_tables_is_seen_whole_or_not_at_all(spark, root, monkeypatch):
    e = Engine(spark, root)
    for t in ("t1", "t2"):
        e.sql(f"CREATE TABLE {t} (k int PRIMARY KEY, v int)")
        e.sql(f"INSERT INTO {t} VALUES (1, 0)")
    row = spark.createDataFrame([(1, 5)], "k int, v int")
    tx = e.begin()
    tx.put("t1", row)
    tx.put("t2", row)
    append, calls = e.store.append, []

    def stops(*args, **options):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("stopped between two tables")
        append(*args, **options)

    monkeypatch.setattr(e.store, "append", stops)
    with pytest.raises(OSError, match="between"):
        tx.commit()
    monkeypatch.undo()
    assert rows(e.store.view("t1")) == rows(e.store.view("t2")) == [(1, 0)]
    e.compact("t1")
    again = e.begin()
    again.put("t1", row)
    again.put("t2", row)
    again.commit()
    assert rows(e.store.view("t1")) == rows(e.store.view("t2")) == [(1, 5)]


def test_transactions_are_listed_and_aborted_by_id(spark, root):
    e = Engine(spark, root)
    e.sql("CREATE TABLE t (k int PRIMARY KEY, v int)")
    a, b = e.begin(), e.begin()
    a.put("t", spark.createDataFrame([(1, 1)], "k int, v int"))
    assert sorted(r["tx"] for r in e.transactions().collect()) == sorted([a.id, b.id])
    e.abort(a.id)
    with pytest.raises(Conflict):
        a.commit()
    b.commit()
    assert e.transactions().isEmpty() and e.store.view("t").isEmpty()


def test_keys_with_separators_are_different_rows(spark, root):
    e = Engine(spark, root)
    e.sql("CREATE TABLE t (a string, b string, v int, PRIMARY KEY (a, b))")
    e.store.put("t", spark.createDataFrame([("a|b", "c", 1), ("a", "b|c", 2), ("a\\", "|c", 3), ("a\\|", "c", 4)], "a string, b string, v int"))
    assert e.store.view("t").count() == 4
    assert [e.get("t", *k).first()["v"] for k in (("a|b", "c"), ("a", "b|c"), ("a\\", "|c"), ("a\\|", "c"))] == [1, 2, 3, 4]


def test_unique_index(sql):
    sql.execute("CREATE TABLE u (id int PRIMARY KEY, mail string, city string)")
    sql.execute("INSERT INTO u VALUES (1, 'a', 'x'), (2, 'b', 'x'), (3, NULL, 'x'), (4, NULL, 'y')")
    sql.execute("CREATE UNIQUE INDEX by_mail ON u (mail)")
    for bad in ("INSERT INTO u VALUES (5, 'a', 'z')", "INSERT INTO u VALUES (5, 'n', 'z'), (6, 'n', 'z')", "UPDATE u SET mail = 'b' WHERE id = 1"):
        with pytest.raises(ValidationError, match="unique"):
            sql.execute(bad)
    sql.execute("UPDATE u SET mail = 'c' WHERE id = 1")
    sql.execute("INSERT INTO u VALUES (5, 'a', 'z'), (6, NULL, 'z')")
    with pytest.raises(ValidationError):
        sql.execute("CREATE UNIQUE INDEX by_city ON u (city)")
    assert rows(sql.execute("SELECT id FROM u WHERE mail = 'a'")) == [(5,)]


def test_writes_end_with_a_compaction_after_many_segments(spark, root):
    from quarry.sources.store import Store

    store = Store(spark, root, flush_at=4)
    store.catalog.create(parse_create("CREATE TABLE t (k int PRIMARY KEY, v int)"))
    for i in range(6):
        store.put("t", spark.createDataFrame([(i % 2, i)], "k int, v int"))
    assert len(store.state("t")["segments"]) == 2 and rows(store.view("t")) == [(0, 4), (1, 5)]


def test_an_index_reads_a_part_of_the_table(spark, root):
    """Few keys are read by themselves: row groups of a snapshot in the order of keys are skipped."""
    from quarry.plans.explain import physical_plan

    e = Engine(spark, root)
    e.sql("CREATE TABLE t (k int PRIMARY KEY, v int, pad string)")
    spark.conf.set("parquet.block.size", str(1 << 16))
    try:
        e.store.put("t", spark.range(60_000).selectExpr("id AS k", "id AS v", "repeat(sha2(string(id), 256), 4) AS pad").repartition(1))
        e.compact("t")
        e.sql("CREATE INDEX by_v ON t (v)")
    finally:
        spark.conf.unset("parquet.block.size")
    e.put("t", k=60_001, v=7, pad="late")

    def read(df):
        """Rows that the scans of a query handed on."""
        df.collect()
        total, todo = 0, [df._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            name = node.nodeName()
            if name.startswith("AdaptiveSparkPlan"):
                todo.append(node.executedPlan())
            elif hasattr(node, "plan") and "QueryStage" in name:
                todo.append(node.plan())
            elif name.startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return total

    by_index = e.sql("SELECT k, v FROM t WHERE v = 7")
    assert rows(by_index) == [(7, 7), (60_001, 7)]
    assert "PushedFilters: [In(key" in physical_plan(by_index) or "EqualTo(key" in physical_plan(by_index)
    scan = e.store.view("t").where("v = 7").select("k", "v")
    assert rows(scan) == [(7, 7), (60_001, 7)]
    assert read(e.sql("SELECT k, v FROM t WHERE v = 7")) * 10 < read(scan)
