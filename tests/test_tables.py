"""Tables of the engine's own: definitions, changes, constraints, versions, transactions, rights, routines."""

import pickle

import pytest

from sedge.operators import routines
from sedge.plans.lexer import DialectError
from sedge.session import ConstraintError, Denied, Engine
from sedge.sources.store import StoreError


def test_types_and_constraints(engine):
    e = engine
    e.sql("CREATE TABLE n (id INTEGER PRIMARY KEY, amt DECIMAL(6,2), q SMALLINT, s VARCHAR(3), age INT CHECK (age >= 0 AND age < 150), name TEXT NOT NULL DEFAULT 'none', twice INT GENERATED ALWAYS AS (q * 2) STORED)")
    e.sql("INSERT INTO n (amt, q, s, age) VALUES (12.34, 100, 'abc', 30)")
    assert e.last_insert_rowid == 1 and e.changes() == 1
    assert e.rows("SELECT id, q, name, twice FROM n") == [(1, 100, "none", 200)]
    for bad in ("INSERT INTO n (q) VALUES (100000)", "INSERT INTO n (amt) VALUES ('abc')", "INSERT INTO n (amt) VALUES (1.234)", "INSERT INTO n (s) VALUES ('abcd')", "INSERT INTO n (age) VALUES (200)", "INSERT INTO n (name) VALUES (NULL)", "UPDATE n SET age = -5"):
        with pytest.raises(ConstraintError):
            e.sql(bad)
    assert e.rows("SELECT COUNT(*), MAX(age) FROM n") == [(1, 30)]
    e.sql("CREATE TABLE g (id INTEGER PRIMARY KEY, p POINT, u UUID, b BIT(3))")
    e.sql("INSERT INTO g VALUES (1, 'POINT(1 2)', '123e4567-e89b-12d3-a456-426614174000', '101')")
    assert e.rows("SELECT ST_AsText(p), ST_X(p) FROM g") == [("POINT(1 2)", 1.0)]
    for bad in ("(2, 'LINESTRING(0 0, 1 1)', NULL, NULL)", "(2, NULL, 'short', NULL)", "(2, NULL, NULL, '12')"):
        with pytest.raises(ConstraintError):
            e.sql(f"INSERT INTO g VALUES {bad}")


def test_upserts_and_returning(engine):
    e = engine
    e.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT NOT NULL, hits INT); INSERT INTO t VALUES (1, 'a', 1), (2, 'b', 1)")
    assert e.rows("INSERT OR IGNORE INTO t VALUES (1, 'z', 9), (3, 'c', 1) RETURNING id") == [(3,)]
    assert e.rows("INSERT INTO t VALUES (1, 'q', 5) ON CONFLICT (id) DO UPDATE SET hits = hits + 10 RETURNING id, hits") == [(1, 11)]
    e.sql("INSERT INTO t VALUES (2, 'q', 5) ON CONFLICT (id) DO UPDATE SET hits = 99 WHERE hits > 50")
    e.sql("INSERT OR REPLACE INTO t VALUES (3, 'cc', 7)")
    e.sql("INSERT INTO t VALUES (5, 'x', 1), (5, 'y', 2) ON CONFLICT (id) DO UPDATE SET hits = hits + 1")
    assert e.rows("SELECT * FROM t ORDER BY id") == [(1, "a", 11), (2, "b", 1), (3, "cc", 7), (5, "x", 2)]
    assert e.rows("UPDATE t SET hits = hits * 2, name = name || '!' WHERE id < 3 RETURNING name, hits AS h") == [("a!", 22), ("b!", 2)]
    assert e.rows("DELETE FROM t WHERE id = 3 RETURNING *") == [(3, "cc", 7)] and e.changes() == 1
    e.sql("UPDATE t SET hits = (SELECT MAX(id) FROM t) WHERE id IN (SELECT id FROM t WHERE hits > 10)")
    assert e.rows("SELECT hits FROM t WHERE id = 1") == [(5,)]
    e.sql("TRUNCATE TABLE t")
    assert e.rows("SELECT COUNT(*) FROM t") == [(0,)]


def test_only_files_with_affected_rows_are_rewritten(engine):
    e = engine
    e.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, v INT)")
    for i in range(3):
        e.sql(f"INSERT INTO t VALUES ({i}, {i})")
    before = set(e.store.state.tables["t"].files())
    e.sql("UPDATE t SET v = 50 WHERE id = 1")
    after = set(e.store.state.tables["t"].files())
    assert len(before & after) == 2 and e.rows("SELECT id, v FROM t ORDER BY id") == [(0, 0), (1, 50), (2, 2)]
    e.sql("VACUUM")
    assert e.rows("SELECT SUM(v) FROM t") == [(52,)]


def test_versions_and_transactions(engine):
    e = engine
    e.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, v INT) WITH SYSTEM VERSIONING")
    e.sql("INSERT INTO t VALUES (1, 10)")
    v = e.current_version()
    e.sql("UPDATE t SET v = 20; INSERT INTO t VALUES (2, 99)")
    assert e.rows("SELECT COUNT(*), MAX(v) FROM t") == [(2, 99)]
    assert e.rows(f"SELECT * FROM t FOR SYSTEM_TIME AS OF {v}") == [(1, 10)]
    e.sql("BEGIN; DELETE FROM t; SAVEPOINT a; INSERT INTO t VALUES (7, 7); SAVEPOINT b; INSERT INTO t VALUES (8, 8); ROLLBACK TO a")
    assert e.rows("SELECT COUNT(*) FROM t") == [(0,)]
    e.sql("ROLLBACK")
    assert e.rows("SELECT COUNT(*) FROM t") == [(2,)]
    e.sql("BEGIN; DELETE FROM t WHERE id = 1; SAVEPOINT a; RELEASE a; COMMIT")
    assert e.rows("SELECT id FROM t") == [(2,)]
    for bad in ("COMMIT", "ROLLBACK TO nowhere"):
        with pytest.raises(DialectError):
            e.sql(bad)


def test_definitions(engine):
    e = engine
    e.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, a INT, b TEXT); INSERT INTO t VALUES (1, 2, 'x'); CREATE INDEX i ON t (a); COMMENT ON TABLE t IS 'about'")
    e.sql("ALTER TABLE t ADD COLUMN c INT DEFAULT 5; ALTER TABLE t ADD d TEXT; ALTER TABLE t RENAME COLUMN b TO bb; ALTER TABLE t RENAME TO tt")
    assert e.rows("SELECT id, a, bb, c, d FROM tt") == [(1, 2, "x", 5, None)]
    for bad in ("ALTER TABLE tt DROP COLUMN id", "ALTER TABLE tt DROP COLUMN a", "ALTER TABLE tt ADD COLUMN c INT", "CREATE TABLE tt (x INT)", "DROP TABLE nope", "CREATE INDEX j ON tt (zz)"):
        with pytest.raises(DialectError):
            e.sql(bad)
    e.sql("ALTER TABLE tt DROP COLUMN d; DROP INDEX i; CREATE TABLE IF NOT EXISTS tt (x INT); DROP TABLE IF EXISTS nope")
    e.sql("CREATE VIEW v (k, n) AS SELECT a, COUNT(*) FROM tt GROUP BY a; CREATE TABLE c AS SELECT k, n * 2 AS m FROM v; CREATE MATERIALIZED VIEW mv AS SELECT * FROM c")
    assert e.rows("SELECT v.n, mv.m FROM v JOIN mv ON mv.k = v.k") == [(1, 2)]
    e.sql("CREATE TABLE p (id INTEGER PRIMARY KEY) PARTITION BY HASH(id) PARTITIONS 3; INSERT INTO p SELECT 1 UNION SELECT 2 UNION SELECT 3 UNION SELECT 4")
    assert sum(e.rows(f"SELECT COUNT(*) FROM p__p{i}")[0][0] for i in range(3)) == 4
    e.sql("ANALYZE p; REINDEX; DROP VIEW mv")


def test_rights(engine):
    e = engine
    e.sql("CREATE TABLE t (x INT); CREATE TABLE u (x INT); INSERT INTO t VALUES (1); GRANT SELECT ON t TO ann; GRANT INSERT ON u TO PUBLIC; CREATE VIEW tv AS SELECT * FROM t; GRANT SELECT ON tv TO bob")
    e.set_user("ann")
    assert e.rows("SELECT x FROM t") == [(1,)]
    for bad in ("INSERT INTO t VALUES (2)", "SELECT * FROM u", "DELETE FROM t", "GRANT SELECT ON u TO ann"):
        with pytest.raises(Denied):
            e.sql(bad)
    e.sql("INSERT INTO u VALUES (5)")
    e.set_user("bob")
    assert e.rows("SELECT x FROM tv") == [(1,)]
    e.set_user(None)
    e.sql("REVOKE SELECT ON t FROM ann")
    e.set_user("ann")
    with pytest.raises(Denied):
        e.sql("SELECT * FROM t")


def test_reopening_and_conflicts(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    a = Engine(spark, path)
    a.sql("CREATE TABLE t (id INTEGER PRIMARY KEY, s TEXT); INSERT INTO t VALUES (1, 'x'); CREATE FUNCTION dbl(x INT) RETURNS INT LANGUAGE PLSQL AS $$ BEGIN RETURN x * 2; END $$")
    b = Engine(spark, path)
    assert b.rows("SELECT s, dbl(4) FROM t") == [("x", 8.0)]
    a.sql("INSERT INTO t VALUES (2, 'y')")
    with pytest.raises(StoreError):
        b.sql("INSERT INTO t VALUES (3, 'z')")
    assert Engine(spark, path).rows("SELECT COUNT(*) FROM t") == [(2,)]
    a.sql("CREATE TEMP TABLE tmp AS SELECT * FROM t")
    assert a.rows("SELECT COUNT(*) FROM tmp") == [(2,)]
    with pytest.raises(DialectError):
        Engine(spark, path).sql("SELECT * FROM tmp")


def test_routines_sequences_and_functions(engine):
    e = engine
    e.sql("CREATE FUNCTION fact(n INT) RETURNS INT LANGUAGE PLSQL AS DECLARE r INT := 1; i INT := 1; BEGIN WHILE i <= n LOOP r := r * i; i := i + 1; END LOOP; RETURN r; END")
    e.sql("CREATE FUNCTION sgn(x INT) RETURNS INT LANGUAGE PLSQL AS BEGIN IF x > 0 THEN RETURN 1; ELSIF x < 0 THEN RETURN -1; ELSE RETURN 0; END IF; END")
    e.sql("CREATE OR REPLACE FUNCTION lsum(n INT) LANGUAGE LUA AS $$ local s = 0 for i = 1, n do s = s + i end return s $$")
    assert e.rows("SELECT fact(5), sgn(-3), sgn(0), lsum(100)") == [(120.0, -1.0, 0.0, 5050.0)]
    assert e.rows("CALL fact(4)") == [(24.0,)]
    e.create_function("joined", lambda *v: "-".join(map(str, v)), "string")
    assert e.rows("SELECT joined(1, 'a', 2)") == [("1-a-2",)]
    e.sql("CREATE SEQUENCE q START WITH 100 INCREMENT BY 1")
    assert e.rows("SELECT NEXTVAL('q'), NEXTVAL('q'), CURRVAL('q'), SETVAL('q', 7), NEXTVAL('q')") == [(100, 101, 101, 7, 8)]


@pytest.mark.parametrize("source,language,args,want", [
    ("a * a + b * b", "SQL", {"a": 3, "b": 4}, 25), ("x > 2 AND NOT x > 5", "SQL", {"x": 3}, 1), ("sqrt(a) + max(1, b)", "SQL", {"a": 4, "b": 9}, 11),
    ("local s = 0 for i = 1, n do s = s + i end return s", "LUA", {"n": 100}, 5050), ("if x < 0 then return -x else return x end", "LUA", {"x": -5}, 5), ("return 2 ^ 10", "LUA", {}, 1024), ("local i = 0 while i * i < n do i = i + 1 end return i", "LUA", {"n": 10}, 4),
    ("$x * 3 div 2 + 7 mod 4", "XPATH", {"x": 2}, 6), ("$x gt 1 and $x le 5", "XPATH", {"x": 2}, 1), ("let $a := $x + 1 let $b := $a * $a return $b - 1", "XQUERY", {"x": 4}, 24),
    ("DECLARE s NUMBER := 0; BEGIN FOR i IN 1..n LOOP s := s + i; END LOOP; RETURN s; END", "PLSQL", {"n": 100}, 5050),
])
def test_numeric_languages(spark, source, language, args, want):
    assert routines.compiled(source, language, list(args))(*args.values()) == want
    try:
        text = routines.expression(source, language, {k: str(v) for k, v in args.items()})
    except routines.Looping:
        return
    assert spark.sql(f"SELECT {text}").first()[0] == want


def test_keywords():
    from sedge.plans.parser import KEYWORDS, is_keyword

    assert is_keyword("select") and not is_keyword("colour") and list(KEYWORDS) == sorted(KEYWORDS)


def test_many_rows_of_values(engine):
    engine.sql("CREATE TABLE mv (id INTEGER PRIMARY KEY, a INT, s TEXT DEFAULT 'none')")
    engine.sql("INSERT INTO mv VALUES " + ", ".join(f"({i}, {i % 7}, 'it''s {i}')" for i in range(10_000)))
    assert engine.changes() == 10_000
    engine.sql("INSERT INTO mv (a) VALUES (1), (2 + 3), ((SELECT MAX(a) FROM mv)), (NULL), (7)")
    assert engine.rows("SELECT id, a, s FROM mv WHERE id > 9998 ORDER BY id") == [(9999, 3, "it's 9999"), (10000, 1, "none"), (10001, 5, "none"), (10002, 6, "none"), (10003, None, "none"), (10004, 7, "none")]


def test_a_sequence_gives_each_row_a_value(engine):
    engine.sql("CREATE SEQUENCE s START WITH 10 INCREMENT BY 5; CREATE TABLE sv (id INTEGER PRIMARY KEY, a INT); INSERT INTO sv VALUES (1, 1), (2, 2), (3, 3)")
    assert sorted(engine.rows("SELECT a, NEXTVAL('s') AS k FROM sv"))[0][0] == 1 and engine.rows("SELECT CURRVAL('s') AS c") == [(20,)]
    assert {r[0] for r in engine.rows("SELECT NEXTVAL('s') AS k FROM sv WHERE a > 1")} == {25, 30} and engine.rows("SELECT NEXTVAL('s') AS k") == [(35,)]
    with pytest.raises(DialectError):
        engine.sql("SELECT NEXTVAL('s') + 1 FROM sv")
    assert engine.rows("SELECT NEXTVAL('s') AS k FROM sv WHERE a > 9") == []


@pytest.mark.parametrize(("source", "language"), [
    ("DECLARE s INT := 0; BEGIN FOR i IN x..y LOOP IF i % 3 = 1 THEN s := s + i * x; ELSIF i > 7 AND NOT s > 50 THEN s := s - 2; ELSE NULL; END IF; END LOOP; RETURN s; END", "PLSQL"),
    ("DECLARE s INT; BEGIN FOR i IN 1..y LOOP s := s + i; IF i > x OR s > 1 THEN RETURN -i; END IF; END LOOP; END", "PLSQL"),
    ("DECLARE n INT := y; BEGIN WHILE n > 1 LOOP n := n / 2; IF n < x THEN RETURN power(n, 2) + least(n, x); END IF; END LOOP; RETURN n; END", "PLSQL"),
    ("local s = 0 for i = y, x, -2 do for j = 1, i do s = s + j ^ 2 end end if s == 0 then return nosuch(s) end return s", "LUA"),
    ("local s = 'a' for i = 1, 2 do s = s + 'b' end return length(s) + z", "LUA"),
    ("for i = 1, 3, x do s = i end return s / y", "LUA"),
])
def test_loops_as_python_give_what_the_interpreter_gives(source, language):
    def got(call):
        try:
            return call()
        except Exception as e:
            return type(e), str(e)

    steps = routines.program(source, language)
    call = pickle.loads(pickle.dumps(routines.Program(steps, ["x", "y"])))
    for x in (None, 0.0, 1.0, 3.0, -2.0, 7.5):
        for y in (None, 0.0, 1.0, 9.0, 20.0):
            assert got(lambda: call(x, y)) == got(lambda: routines.run(steps, {"x": x, "y": y})), (x, y)  # noqa: B023


def test_loops_do_not_walk_trees_by_row(monkeypatch):
    call = routines.Program(routines.program("DECLARE s INT := 0; BEGIN FOR i IN 1..n LOOP s := s + i; END LOOP; RETURN s; END", "PLSQL"), ["n"])
    monkeypatch.setattr(routines, "_value", None)
    assert call(100.0) == 5050.0
    deep = ("num", 1.0)
    for _ in range(150):
        deep = ("op", "+", deep, ("var", "n"))
    monkeypatch.undo()
    assert routines.Program([("return", deep)], ["n"])(2.0) == 301.0
