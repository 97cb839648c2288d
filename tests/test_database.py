"""SQL writes, table definitions, transactions, the store and declared schemas."""

import datetime

import pytest
from pyspark.sql import functions as F

from inkfold.operators.closure import CascadeCycle
from inkfold.plans import schema_apply
from inkfold.plans.database import ConstraintError, Database
from inkfold.plans.statements import StatementError, statements
from inkfold.plans.where import typed_list
from inkfold.sources.store import Store, StoreConflict

@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Rows here are few."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


TABLES = """
CREATE TABLE person (name VARCHAR(10) NOT NULL, age INTEGER, ok BOOLEAN, kind ENUM('a','b'), pos INTEGER DEFAULT NEXT, UNIQUE(name));
CREATE TABLE task (what TEXT, owner_id TEXT REFERENCES person ON DELETE CASCADE, nth INTEGER DEFAULT NEXT(owner_id), boss TEXT REFERENCES person)"""
A, B, C = ("2024010100000" + str(k) for k in range(3))


def fresh(spark, **more):
    db = Database(spark, clock=lambda: datetime.datetime(2024, 1, 1), **more)
    db.execute_batch(TABLES)
    db.execute("INSERT INTO person (name, age, ok, kind) VALUES ('ann', 3, true, 'a'), ('bob', 1+1, false, 'b'), (UPPER('cy'), NULL, NULL, '')")
    return db


@pytest.fixture(scope="module")
def filled(spark):
    db = fresh(spark)
    db.execute(f"INSERT INTO task (what, owner_id, boss) VALUES ('t1', '{A}', '{B}'), ('t2', '{A}', NULL), ('t3', '{B}', '{A}')")
    return db


@pytest.fixture
def db(filled):
    before = filled.state
    yield filled
    filled.state, filled.saved = before, None


def rows(db, text):
    return [tuple(r) for r in db.execute(text).rows.collect()]


def test_insert_fills_defaults_and_types(db):
    assert rows(db, "SELECT id, title, name, age, ok, pos, date FROM person ORDER BY id") == [(A, f"person {A}", "ann", 3, True, 1, "2024-01-01"), (B, f"person {B}", "bob", 2, False, 2, "2024-01-01"), (C, f"person {C}", "CY", None, None, 3, "2024-01-01")]
    assert rows(db, "SELECT what, nth FROM task ORDER BY what") == [("t1", 1), ("t2", 2), ("t3", 1)]


@pytest.mark.parametrize("text, message", [
    ("INSERT INTO person (name, age) VALUES ('dd', 1), ('dd', 'x')", "type mismatch for person.age: expected INTEGER, got 'x'"),
    ("INSERT INTO person (name, age) VALUES ('dd', '')", "type mismatch for person.age: expected INTEGER, got ''"),
    ("INSERT INTO person (name, ok) VALUES ('dd', 'yes')", "type mismatch for person.ok: expected BOOLEAN, got 'yes'"),
    ("INSERT INTO person (name) VALUES ('verylongname!')", "value too long for person.name: 13 chars exceeds limit 10"),
    ("INSERT INTO person (age) VALUES (1)", "NOT NULL constraint violated: person.name"),
    ("INSERT INTO person (name) VALUES (NULLIF('a', 'a'))", "NOT NULL constraint violated: person.name"),
    ("INSERT INTO person (name, bogus) VALUES ('e', 1)", "unknown column: person.bogus"),
    ("INSERT INTO person (name, kind) VALUES ('e', 'q')", "column 'kind': value 'q' not in allowed values ['a', 'b']"),
    ("INSERT INTO person (name) VALUES ('ann')", "UNIQUE constraint violated: person(name) = (ann)"),
    ("INSERT INTO person (name) VALUES ('x'), ('x')", "UNIQUE constraint violated: person(name) = (x)"),
    ("INSERT INTO task (owner_id) VALUES ('1')", "column 'owner_id': referenced id '1' not found in person"),
    ("UPDATE person SET name = NULL WHERE name = 'ann'", "NOT NULL constraint violated: person.name"),
    ("UPDATE person SET name = 'bob' WHERE name = 'ann'", "UNIQUE constraint violated: person(name) = (bob)"),
    ("UPDATE person SET age = 'old'", "type mismatch for person.age: expected INTEGER, got 'old'"),
])
def test_violations(db, text, message):
    before = db.state
    with pytest.raises(ConstraintError) as e:
        db.execute(text)
    assert str(e.value) == message and db.state is before


@pytest.mark.parametrize("text", [
    "INSERT INTO person (name) VALUES (SHA2('a', 256))", "INSERT INTO person (name) SELECT what FROM task", "INSERT OR REPLACE INTO person (name) VALUES ('a')", "INSERT INTO person (name) VALUES ('a', 'b')",
    "INSERT INTO person (name) VALUES ('a') ON CONFLICT (name) DO UPDATE SET name = 'b'", "UPDATE person SET age = 1 FROM task", "CREATE INDEX i ON person (name)", "CREATE VIEW v AS SELECT 1", "DROP VIEW v",
    "CREATE TRIGGER t", "ALTER INDEX i RENAME TO j", "RENAME TABLE a TO b", "CREATE TABLE x (a TEXT REFERENCES person ON DELETE SET NULL)", "CREATE TABLE x (a TEXT DEFAULT NEXT)", "SELECT * FROM nowhere_at_all", "COMMIT", "INSERT INTO nothing (a) VALUES (1)",
    "ALTER TABLE person ALTER COLUMN age TYPE VARCHAR(3)", "ALTER TABLE person ALTER COLUMN name TYPE VARCHAR(2)", "ALTER TABLE person ALTER COLUMN name TYPE CHAR(10)", "ALTER TABLE task ALTER COLUMN owner_id TYPE INTEGER", "DELETE FROM task_boss WHERE task_id = '1'",
])
def test_refused(db, text):
    with pytest.raises(Exception) as e:
        db.execute(text)
        db.execute(text).rows.collect()
    assert isinstance(e.value, StatementError) or "nowhere_at_all" in str(e.value)


def test_conflict_keeps_the_stored_row(db):
    out = db.execute("INSERT INTO person (name, age) VALUES ('ann', 9), ('new', 1) ON CONFLICT DO NOTHING")
    assert out.ids[0] == A and out.count == 1 and rows(db, "SELECT age FROM person WHERE name = 'ann'") == [(3,)]
    assert rows(db, "SELECT count(*) FROM person") == [(4,)]


def test_update_reads_old_rows(db):
    assert db.execute("UPDATE person SET age = age + 10, pos = age WHERE name IN (SELECT name FROM person WHERE age > 2)").count == 1
    assert rows(db, "SELECT age, pos FROM person WHERE name = 'ann'") == [(13, 3)]
    assert db.execute("UPDATE task SET what = 'new' WHERE id = 'none'").count == 0
    db.execute("UPDATE task SET what = 'done' WHERE what = 't1'")
    assert rows(db, "SELECT title FROM task WHERE what = 'done'") == [("done",)], "the first body column is the title"


def test_delete_cascades_and_cuts_references(db):
    assert db.execute("DELETE FROM person WHERE name = 'ann'").count == 1
    assert rows(db, "SELECT what, boss FROM task") == [("t3", None)]


def test_transactions(db):
    db.execute("BEGIN")
    db.execute("DELETE FROM person WHERE name = 'ann'")
    assert rows(db, "SELECT count(*) FROM task") == [(1,)]
    with pytest.raises(StatementError):
        db.execute("BEGIN")
    db.execute("ROLLBACK")
    assert rows(db, "SELECT count(*) FROM task") == [(3,)]
    with pytest.raises(ConstraintError):
        db.execute_batch("DELETE FROM task; INSERT INTO person (name) VALUES ('bob')")
    assert rows(db, "SELECT count(*) FROM task") == [(3,)], "a batch is one transaction"


def test_junctions(db):
    assert db.execute(f"INSERT INTO task_boss (task_id, boss_id) VALUES ((SELECT id FROM task WHERE what = 't1'), '{C}')").count == 1
    assert rows(db, "SELECT boss FROM task WHERE what = 't1'") == [(f"{B},{C}",)]
    t1 = rows(db, "SELECT id FROM task WHERE what = 't1'")[0][0]
    assert db.execute(f"DELETE FROM task_boss WHERE task_id = '{t1}' AND boss_id = '{B}'").count == 1
    assert sorted(rows(db, "SELECT task_id, boss_id FROM task_boss WHERE task_id = '" + t1 + "'")) == [(t1, C)]
    with pytest.raises(ConstraintError):
        db.execute(f"INSERT INTO task_boss (task_id, boss_id) VALUES ('{t1}', 'nobody')")


def test_cycles_and_restrict(spark):
    db = Database(spark, clock=lambda: datetime.datetime(2024, 1, 1))
    db.execute("CREATE TABLE node (name TEXT, up TEXT REFERENCES node ON DELETE CASCADE)")
    chain = spark.createDataFrame([(f"n{k:03}", str(k), f"n{k - 1:03}" if k else None) for k in range(81)], "id string, name string, up string")
    db.state.frames["node"] = db.typed_rows(db.table("node"), chain)
    db.execute("UPDATE node SET up = 'n002' WHERE id = 'n000'")
    with pytest.raises(CascadeCycle, match="cycle through node, node"):
        db.execute("DELETE FROM node WHERE id = 'n000'")
    db.execute("UPDATE node SET up = NULL WHERE id = 'n000'")
    db.execute("CREATE TABLE leaf (what TEXT, at TEXT NOT NULL REFERENCES node ON DELETE RESTRICT, maybe TEXT REFERENCES node ON DELETE RESTRICT)")
    db.execute("INSERT INTO leaf (what, at, maybe) VALUES ('x', 'n005', 'n003')")
    with pytest.raises(ConstraintError, match="refers to it"):
        db.execute("DELETE FROM node WHERE id = 'n000'")
    db.execute("UPDATE leaf SET at = ''")
    assert db.execute("DELETE FROM node WHERE id = 'n000'").count == 1
    assert rows(db, "SELECT count(*) FROM node") == [(0,)], "the chain of 81 rows goes as a whole"
    assert rows(db, "SELECT maybe FROM leaf") == [(None,)]


def test_singletons(spark):
    db = Database(spark, clock=lambda: datetime.datetime(2024, 1, 1))
    db.execute("CREATE TABLE setting (theme TEXT DEFAULT 'light') SINGLETON DEFAULT VALUES")
    assert rows(db, "SELECT theme FROM setting") == [("light",)]
    with pytest.raises(ConstraintError, match="already holds row 20240101000000"):
        db.execute("INSERT INTO setting (theme) VALUES ('dark')")
    assert db.upsert_singleton("setting", {"theme": "dark"}) == (A, "updated")
    db.execute("DELETE FROM setting")
    with pytest.raises(ConstraintError, match="<intra-batch>"):
        db.execute("INSERT INTO setting (theme) VALUES ('a'), ('b')")
    assert db.upsert_singleton("setting", {"theme": "x"})[1] == "created"
    db.execute("ALTER TABLE setting DROP SINGLETON")
    db.execute("INSERT INTO setting (theme) VALUES ('y')")
    with pytest.raises(StatementError):
        db.execute("ALTER TABLE setting SET SINGLETON")


def test_alter(db):
    db.execute_batch("ALTER TABLE person ADD COLUMN note TEXT; ALTER TABLE person RENAME COLUMN note TO remark; ALTER TABLE person DROP COLUMN ok; ALTER TABLE person DROP COLUMN IF EXISTS ok")
    assert "remark" in db.frame("person").columns and "ok" not in db.frame("person").columns
    db.execute("ALTER TABLE person ALTER COLUMN name TYPE TEXT")
    db.execute("ALTER TABLE person ALTER COLUMN age SET DATA TYPE REAL")
    db.execute("ALTER TABLE person ALTER COLUMN age TYPE INTEGER")
    db.execute("ALTER TABLE task SET TITLE TEMPLATE '{what} of {owner_id.name}'")
    db.execute(f"INSERT INTO task (what, owner_id) VALUES ('go', '{B}')")
    assert rows(db, "SELECT title FROM task WHERE what = 'go'") == [("go of bob",)]
    with pytest.raises(StatementError):
        db.execute("ALTER TABLE task SET TITLE TEMPLATE '{owner_id.boss.name}'")
    db.execute("ALTER TABLE person SET ZONE body FOR name")
    db.execute("ALTER TABLE person SET SEARCH KEY name")
    assert db.table("person").search_key == "name" and db.table("person").columns["name"].zone == "Body"
    with pytest.raises(ConstraintError):
        db.execute("ALTER TABLE task ADD UNIQUE (owner_id)")
    db.execute("ALTER TABLE person DROP UNIQUE (name)")
    db.execute("ALTER TABLE person RENAME TO human")
    assert db.table("task").columns["owner_id"].references == "human" and rows(db, "SELECT count(*) FROM task_owner_id j JOIN human h ON h.id = j.owner_id_id") == [(4,)]
    db.execute("DROP TABLE human")
    assert rows(db, "SELECT count(*) FROM untyped") == [(3,)]
    db.execute("DROP TABLE IF EXISTS human")
    assert db.execute("CREATE INDEX IF NOT EXISTS i ON task(what)").message.startswith("ignored")


def test_batches(spark, db):
    db.insert_rows("person", spark.createDataFrame([("p1", "dd", 1), ("p2", "ee", 2)], "id string, name string, age int"), ["id"])
    assert rows(db, "SELECT id, pos FROM person WHERE name IN ('dd', 'ee') ORDER BY id") == [("p1", 4), ("p2", 5)]
    with pytest.raises(ConstraintError):
        db.insert_rows("person", spark.createDataFrame([("p3", "dd", 1)], "id string, name string, age int"), ["id"])
    assert db.update_rows("person", spark.createDataFrame([("p1", None), ("p2", 7)], "id string, age int")).count == 2
    assert rows(db, "SELECT age FROM person WHERE id IN ('p1', 'p2') ORDER BY id") == [(None,), (7,)]
    for bad in ([("p1", 1), ("p1", 2)], [("nobody", 1)]):
        with pytest.raises(ConstraintError):
            db.update_rows("person", spark.createDataFrame(bad, "id string, age int"))


def test_typed_filters_over_the_database(db):
    got = typed_list(db.catalog(), "task", {"owner": {"some": {"name": {"eq": "ann"}}}, "what": {"startsWith": "t"}}, [("what", "ASC")])
    assert [r.what for r in got.collect()] == ["t1", "t2"]


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = fresh(spark, store=Store(path))
    db.execute("UPDATE person SET age = 40 WHERE name = 'ann'")
    db.execute("DELETE FROM person WHERE name = 'bob'")
    db.execute("INSERT INTO person (name) VALUES ('bob')")
    want = sorted(rows(db, "SELECT name, age, kind FROM person"))
    again = Database(spark, store=Store(path))
    assert sorted(rows(again, "SELECT name, age, kind FROM person")) == want == [("CY", None, ""), ("ann", 40, "a"), ("bob", None, None)]
    assert again.table("person").unique == (("name",),) and again.store.is_fresh(spark)
    db.execute("BEGIN")
    db.execute("DELETE FROM person")
    assert again.store.is_fresh(spark), "nothing is written before the commit"
    db.execute("ROLLBACK")
    db.execute("INSERT INTO person (name) VALUES ('late')")
    assert not again.store.is_fresh(spark)
    with pytest.raises(StoreConflict):
        again.execute("INSERT INTO person (name) VALUES ('x')")
    assert len(db.store.manifest["parts"]["person"]) > 2
    assert db.store.compact(spark, most_parts=1)
    third = Database(spark, store=Store(path))
    assert len(third.store.manifest["parts"]["person"]) == 1 and rows(third, "SELECT count(*) FROM person") == [(4,)]


SCHEMA = """
tables:
  author: {columns: {name: {type: VARCHAR(20), required: true}, born: INTEGER}, unique: [[name]], search_key: name}
  book: {columns: {name: TEXT, author_id: {type: TEXT, references: author, on_delete: cascade}}, title_template: "{name}"}
"""


def test_declared_schema(spark):
    db = Database(spark, clock=lambda: datetime.datetime(2024, 1, 1))
    report = schema_apply.apply(db, SCHEMA, dry_run=True)
    assert [s.statement.split(" (")[0] for s in report.steps[:2]] == ['CREATE TABLE "author"', 'CREATE TABLE "book"'] and not report.applied and not db.state.tables
    assert schema_apply.apply(db, SCHEMA).applied and schema_apply.plan(db.state.tables, SCHEMA) == []
    assert schema_apply.plan(db.state.tables, schema_apply.exported(db.state.tables)) == []
    db.execute("INSERT INTO author (name, born) VALUES ('Ann', 1900)")
    less = {"tables": {"writer": {"renamed_from": "author", "columns": {"name": {"type": "TEXT", "required": True}}, "unique": [["name"]]}}}
    with pytest.raises(schema_apply.SchemaError, match="allow_destructive"):
        schema_apply.apply(db, less)
    assert set(db.state.tables) == {"author", "book"}
    done = schema_apply.apply(db, less, allow_destructive=True)
    assert [s.destructive for s in done.steps][-2:] == [True, True] and rows(db, "SELECT name FROM writer") == [("Ann",)]
    with pytest.raises(StatementError):
        schema_apply.apply(db, {"tables": {"writer": {"columns": {"name": {"type": "VARCHAR(2)", "required": True}}, "unique": [["name"]]}}})
    assert db.saved is None and db.table("writer").columns["name"].declared == "TEXT"
    for bad in ("tables: {a: {columns: {b: {references: c}}}}", "tables: {a: {colums: {}}}", "other: 1"):
        with pytest.raises(schema_apply.SchemaError):
            schema_apply.plan({}, bad)


def test_statements_are_read():
    found = statements("""CREATE TABLE IF NOT EXISTS "My-T" (a INT DEFAULT -1, b TEXT ZONE body, PRIMARY KEY (a)); -- note
        DELETE FROM x WHERE a = ';' ; START TRANSACTION; select 1""")
    assert [type(s).__name__ for s in found] == ["CreateTable", "Delete", "Transaction", "Query"]
    assert found[0].name == "my-t" and found[0].columns[0].default == "-1" and found[0].unique == [("a",)] and found[1].where == "a = ';'"
