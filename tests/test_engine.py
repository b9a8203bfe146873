"""Tables, constraints, mutations, triggers, transactions and the client interface."""

import dataclasses
import decimal

import pytest

from quillon.engine import Engine
from quillon.errors import ConstraintError, QuillonError, TransactionError, ValidationError


def rows(engine, sql, *values):
    return sorted(tuple(r) for r in engine.query(sql, *values).collect())


@pytest.fixture
def people(engine):
    engine.execute_batch(
        """CREATE TABLE crews (id INT PRIMARY KEY, name TEXT NOT NULL, active BOOLEAN NOT NULL);
        CREATE TABLE users (id INT PRIMARY KEY, name VARCHAR(16) COLLATE NOCASE UNIQUE, crew_id INT REFERENCES crews(id), score INT DEFAULT 5, CHECK (score >= 0));
        INSERT INTO crews (id, name, active) VALUES (1, 'Deck', TRUE), (2, 'Galley', FALSE);
        INSERT INTO users (id, name, crew_id) VALUES (1, 'Alice', 1), (2, 'Bob', 2), (3, NULL, NULL);"""
    )
    return engine


@pytest.mark.parametrize(
    "sql",
    [
        "INSERT INTO users (id, name) VALUES (1, 'Zed');",
        "INSERT INTO users (id, name) VALUES (9, 'aLICE');",
        "INSERT INTO users (id, name) VALUES (8, 'x'), (8, 'y');",
        "INSERT INTO users (id, score) VALUES (9, -1);",
        "INSERT INTO users (id, crew_id) VALUES (9, 77);",
        "INSERT INTO crews (id, name, active) VALUES (9, NULL, TRUE);",
        "UPDATE users SET id = 1 WHERE id = 2;",
        "UPDATE users SET score = -1;",
        "UPDATE users SET crew_id = 5 WHERE id = 1;",
        "DELETE FROM crews WHERE id = 1;",
        "UPDATE crews SET id = 7 WHERE id = 1;",
    ],
)
def test_constraints_hold_and_statements_are_atomic(people, sql):
    before = rows(people, "SELECT id, name, crew_id, score FROM users WHERE name IS NOT NULL;"), rows(people, "SELECT * FROM crews;")
    with pytest.raises(ConstraintError):
        people.execute(sql)
    assert (rows(people, "SELECT id, name, crew_id, score FROM users WHERE name IS NOT NULL;"), rows(people, "SELECT * FROM crews;")) == before


@pytest.mark.parametrize("sql", ["INSERT INTO users (id, nothing) VALUES (1, 2);", "INSERT INTO users (name) VALUES ('x');", "INSERT INTO users (id) VALUES ('a');", "UPDATE users SET nothing = 1;", "CREATE TABLE k (a INT);", "DROP TABLE crews;", "ALTER TABLE users DROP COLUMN crew_id;", "ALTER TABLE users ADD COLUMN z INT NOT NULL;"])
def test_invalid_mutations(people, sql):
    with pytest.raises(ValidationError):
        people.execute(sql)


def test_nocase_and_unique_nulls(people):
    assert rows(people, "SELECT id FROM users WHERE name = 'ALICE';") == [(1,)]
    assert people.execute("INSERT INTO users (id) VALUES (4);") == 1


def test_upsert_sees_existing_row_and_runs_in_order(people):
    assert people.execute("INSERT INTO users (id, name) VALUES (1, 'q'), (1, 'q'), (7, 'new') ON DUPLICATE KEY UPDATE score = score + 10;") == 3
    assert rows(people, "SELECT id, score FROM users WHERE id IN (1, 7);") == [(1, 25), (7, 5)]


def test_upsert_of_a_query(people):
    people.execute("INSERT INTO users (id, name, score) SELECT id + 1, CONCAT(name, 'x'), 1 FROM crews ON DUPLICATE KEY UPDATE score = 99;")
    assert rows(people, "SELECT id, score FROM users;") == [(1, 5), (2, 99), (3, 99)]


def test_joined_mutations_take_each_row_once(people):
    people.execute("CREATE TABLE tags (id INT PRIMARY KEY, user_id INT);")
    people.execute("INSERT INTO tags (id, user_id) VALUES (1, 1), (2, 1), (3, 2);")
    assert people.execute("UPDATE users u INNER JOIN tags t ON t.user_id = u.id SET u.score = t.id;") == 2
    assert rows(people, "SELECT id, score FROM users WHERE id < 3;") == [(1, 1), (2, 3)]
    assert people.execute("DELETE u FROM users u INNER JOIN tags t ON t.user_id = u.id WHERE t.id < 3;") == 1


def test_cascades_follow_the_graph(engine):
    engine.execute_batch(
        """CREATE TABLE a (x INT PRIMARY KEY, y INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, x INT, y INT, FOREIGN KEY (x, y) REFERENCES a(x, y) ON DELETE CASCADE ON UPDATE CASCADE);
        CREATE TABLE c (id INT PRIMARY KEY, b_id INT REFERENCES b(id) ON DELETE SET NULL);
        INSERT INTO a (x, y) VALUES (1, 1), (2, 2); INSERT INTO b (id, x, y) VALUES (10, 1, 1), (20, 2, 2), (30, NULL, 2); INSERT INTO c (id, b_id) VALUES (1, 10), (2, 20);
        UPDATE a SET y = 9 WHERE x = 1;"""
    )
    assert (10, 1, 9) in [tuple(r) for r in engine.query("SELECT id, x, y FROM b;").collect()]
    engine.execute("DELETE FROM a WHERE x = 1;")
    assert {r[0] for r in engine.query("SELECT id FROM b;").collect()} == {20, 30}
    assert dict(engine.query("SELECT id, b_id FROM c;").collect()) == {1: None, 2: 20}


def test_triggers(people):
    people.execute("CREATE TABLE audit (id INT PRIMARY KEY AUTO_INCREMENT, entry TEXT);")
    for event, value in (("INSERT", "NEW.name"), ("UPDATE", "CONCAT(OLD.name, '>', NEW.name)"), ("DELETE", "OLD.name")):
        people.execute(f"CREATE TRIGGER on_{event.lower()} AFTER {event} ON users AS INSERT INTO audit (entry) VALUES ({value});")
    people.execute("INSERT INTO users (id, name) VALUES (5, 'Eve'), (6, 'Flo');")
    people.execute("UPDATE users SET name = 'Ivy' WHERE id = 5;")
    people.execute("DELETE FROM users WHERE id = 6;")
    assert rows(people, "SELECT entry FROM audit;") == [("Eve",), ("Eve>Ivy",), ("Flo",), ("Flo",)]
    with pytest.raises(ValidationError):
        people.execute("CREATE TRIGGER bad AFTER INSERT ON users AS INSERT INTO audit (entry) VALUES (OLD.name);")


def test_trigger_failure_and_depth_undo_the_statement(engine):
    engine.execute_batch("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, CHECK (id < 3)); CREATE TRIGGER t AFTER INSERT ON a AS INSERT INTO b (id) VALUES (NEW.id);")
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO a (id) VALUES (1), (5);")
    assert rows(engine, "SELECT id FROM a;") == []
    assert issubclass(ConstraintError, QuillonError)


def test_transactions(people):
    with pytest.raises(RuntimeError), people.transaction():
        people.execute("DELETE FROM users;")
        raise RuntimeError
    assert people.query("SELECT id FROM users;").count() == 3
    people.execute_batch("BEGIN; DELETE FROM users WHERE id = 3; SAVEPOINT s; DELETE FROM users; ROLLBACK TO SAVEPOINT s; RELEASE SAVEPOINT s; COMMIT;")
    assert rows(people, "SELECT id FROM users;") == [(1,), (2,)]
    for sql in ("COMMIT;", "ROLLBACK;", "SAVEPOINT s;"):
        with pytest.raises(TransactionError):
            people.execute(sql)


def test_views_and_definitions(people):
    people.execute("CREATE VIEW decks AS SELECT u.id AS id, u.name AS name FROM users u INNER JOIN crews t ON u.crew_id = t.id WHERE t.active = TRUE;")
    assert rows(people, "SELECT name FROM decks;") == [("Alice",)]
    for sql in ("DROP TABLE users;", "UPDATE decks SET name = 'x';", "CREATE VIEW v AS SELECT id FROM v;"):
        with pytest.raises(ValidationError):
            people.execute(sql)
    assert [r[0] for r in people.query("SHOW VIEWS;").collect()] == ["decks"]
    assert people.query_row("SHOW CREATE VIEW decks;")["sql"].startswith("CREATE VIEW decks AS SELECT")
    assert "REFERENCES crews(id)" in people.query_row("SHOW CREATE TABLE users;")["sql"]
    assert [r["kind"] for r in people.query("EXPLAIN SELECT id FROM users WHERE id = 1;").collect()] == ["logical", "physical"]


def test_alter(people):
    people.execute_batch(
        """ALTER TABLE users ADD COLUMN active BOOL NOT NULL DEFAULT TRUE; ALTER TABLE users ALTER COLUMN score SET DEFAULT 8; ALTER TABLE users RENAME COLUMN score TO points;
        ALTER TABLE users ADD CONSTRAINT small CHECK (points < 100); ALTER TABLE crews RENAME TO groups; INSERT INTO users (id, crew_id) VALUES (9, 1); ALTER TABLE users DROP COLUMN active;"""
    )
    assert rows(people, "SELECT points FROM users WHERE id IN (1, 9);") == [(5,), (8,)]
    for sql in ("UPDATE users SET points = 100;", "DELETE FROM groups WHERE id = 1;"):
        with pytest.raises(ConstraintError):
            people.execute(sql)
    people.execute("ALTER TABLE users DROP CONSTRAINT small;")
    with pytest.raises(ConstraintError):
        people.execute("ALTER TABLE users ALTER COLUMN name SET NOT NULL;")


def test_types_round_trip(engine):
    engine.execute(
        "CREATE TABLE kinds (id INT PRIMARY KEY, small INT8, huge INT128, price DECIMAL(7, 3), label CHAR(6), raw VARBINARY(5), padded BINARY(3), phase ENUM('open', 'shut', 'lost'), born DATE, noon TIME, seen DATETIME, far TIME WITH TIME ZONE, share FLOAT32);"
    )
    engine.execute("INSERT INTO kinds (id, small, huge, price, label, raw, padded, phase, born, noon, seen, far, share) VALUES (7, -77, -12345678901234567890123456789012345678, '45.605', 'QXV', 'plum', 'k', 'shut', '2031-07-09', '04:05:06', '1999-12-05 21:22:23', '23:30:00-02:30', 0.25);")
    row = engine.query_row("SELECT * FROM kinds;")
    assert (row.small, row.price, row.label, bytes(row.raw), bytes(row.padded), row.phase, str(row.born), row.noon, str(row.seen), row.far, row.share) == (-77, decimal.Decimal("45.605"), "QXV   ", b"plum", b"k\0\0", "shut", "2031-07-09", "04:05:06", "1999-12-05 21:22:23", "23:30:00-02:30", 0.25)
    assert row.huge == decimal.Decimal("-12345678901234567890123456789012345678")
    assert engine.query("SELECT id FROM kinds WHERE label = 'QXV' AND noon < '05:00:00' AND far = '23:30:00-02:30' AND padded = X'6B';").count() == 1
    for value in ("small = -129", "price = '12345.000'", "label = 'QXVQXVQ'", "phase = 'none'", "raw = 'sixsix'", "born = '2031-7-9'"):
        with pytest.raises(Exception, match="."):
            engine.execute(f"UPDATE kinds SET {value};")


def test_prepared_and_mapping(people):
    statement = people.prepare("SELECT id, name FROM users WHERE id = ? OR name = ?;")
    assert statement.parameter_count == 2
    with pytest.raises(ValidationError):
        statement.query()
    assert statement.bind(1, 2).bind(2, "alice").query().count() == 2

    @dataclasses.dataclass
    class User:
        id: int
        name: str

    assert people.query_as(User, "SELECT id, name, score FROM users WHERE id = 1;") == [User(1, "Alice")]
    assert people.query_one("SELECT COUNT(*) FROM users;") == 3
    assert people.table_text("SELECT id, name FROM users WHERE id = 3;").splitlines() == ["+----+------+", "| id | name |", "+----+------+", "| 3  | NULL |", "+----+------+", "1 row(s)"]


def test_scripts_stop_at_the_first_error(people):
    seen = 0
    with pytest.raises(ConstraintError):
        for _ in people.script("DELETE FROM users WHERE id = 3; INSERT INTO users (id) VALUES (1); DELETE FROM users;"):
            seen += 1
    assert seen == 1 and people.query("SELECT id FROM users;").count() == 2


def test_persistence_and_vacuum(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "db"))
    one.execute_batch("CREATE TABLE t (id INT PRIMARY KEY AUTO_INCREMENT, v DECIMAL(6, 2)); INSERT INTO t (v) VALUES ('1.50'), ('2.50'); UPDATE t SET v = '3.00' WHERE id = 1; CREATE VIEW w AS SELECT v FROM t;")
    two = Engine(spark, str(tmp_path / "db"))
    assert rows(two, "SELECT id, v FROM t;") == [(1, decimal.Decimal("3.00")), (2, decimal.Decimal("2.50"))]
    assert two.vacuum() > 0 and two.query("SELECT v FROM w;").count() == 2
    two.execute("INSERT INTO t (v) VALUES ('4.00');")
    assert two.query_one("SELECT MAX(id) FROM t;") == 3


def test_cells_cursor_and_mapping(people):
    (cells,) = people.cells("SELECT id, name, score / 2 AS half, TRUE AS yes, crew_id, X'0A' AS raw FROM users WHERE id = 3;")
    assert (cells.get_int("id"), cells.get_int(0), cells.get_float("half"), cells.get_bool(3), cells.get_blob("raw"), cells.is_null("crew_id"), len(cells)) == (3, 3, 2.5, True, b"\n", True, 6)
    for wrong in (lambda: cells.get_string("id"), lambda: cells.get_int("half"), lambda: cells.get_int("crew_id"), lambda: cells.get_int("yes"), lambda: cells.get(9), lambda: cells.get("gone")):
        with pytest.raises(ValidationError):
            wrong()
    cursor = people.cursor("users", "id")
    assert cursor.current() is None and cursor.next() and cursor.current()["name"] == "Alice" and cursor.next() and cursor.current()["id"] == 2
    assert cursor.seek(3) and not cursor.next() and not cursor.is_valid() and not cursor.seek(17) and cursor.first() and cursor.current()["id"] == 1
    Pair = dataclasses.make_dataclass("Pair", ["id", "score"])
    assert people.query_one_as(Pair, "SELECT id, score FROM users WHERE id = 2;") == Pair(2, 5) and people.query_one_as(Pair, "SELECT id, score FROM users WHERE id = 20;") is None


def test_table_cells(people):
    text = people.table_text("SELECT TRUE AS yes, X'00FF' AS raw, name FROM crews WHERE id = 1;")
    assert "| true | 0x00ff | Deck" in text
    from quillon.operators.render import cell

    assert cell("two\nlines\r") == "two\\nlines\\r" and cell(False) == "false" and cell(None) == "NULL"


def test_integrity_check_finds_damage(spark, tmp_path):
    import shutil

    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute_batch("CREATE TABLE a (id INT PRIMARY KEY, v TEXT NOT NULL); CREATE TABLE b (id INT PRIMARY KEY, a_id INT REFERENCES a(id)); INSERT INTO a (id, v) VALUES (1, 'x'); INSERT INTO b (id, a_id) VALUES (1, 1);")
    assert engine.integrity_check() == []
    a, b = engine.catalog.tables["a"], engine.catalog.tables["b"]
    whole = list(a.parts)
    a.parts = [engine.storage.write("a", engine.storage.read(a).selectExpr("2 AS id", "CAST(NULL AS STRING) AS v", "rowid"))]
    engine.storage.publish(engine.catalog)
    assert len(engine.integrity_check()) == 2  # a NULL, and b's parent
    a.parts = [*whole, *whole]
    engine.storage.publish(engine.catalog)
    assert any("duplicate key" in x for x in engine.integrity_check())
    shutil.rmtree(tmp_path / "db" / b.parts[0])
    assert any("missing" in x for x in engine.integrity_check())


def test_two_writers_lose_no_update(spark, tmp_path):
    path = str(tmp_path / "db")
    one, two = Engine(spark, path), Engine(spark, path)
    one.execute("CREATE TABLE t (id INT PRIMARY KEY);")
    two.execute("INSERT INTO t (id) VALUES (1);")  # sees the other's table
    one.execute("BEGIN;")
    one.execute("INSERT INTO t (id) VALUES (2);")
    two.execute("INSERT INTO t (id) VALUES (3);")
    with pytest.raises(TransactionError, match="version"):
        one.execute("COMMIT;")
    assert rows(one, "SELECT id FROM t;") == rows(two, "SELECT id FROM t;") == [(1,), (3,)]
    one.execute("INSERT INTO t (id) VALUES (2);")
    assert rows(two, "SELECT id FROM t;") == [(1,), (2,), (3,)]


def test_a_held_lock_stops_a_writer(spark, tmp_path, monkeypatch):
    from quillon.sources import storage

    engine = Engine(spark, str(tmp_path / "db"))
    engine.execute("CREATE TABLE t (id INT PRIMARY KEY);")
    monkeypatch.setattr(storage, "LOCK_WAIT", 0.2)
    lock = tmp_path / "db" / "writer.lock"
    lock.touch()
    with pytest.raises(TransactionError, match="locked"):
        engine.execute("INSERT INTO t (id) VALUES (1);")
    assert rows(engine, "SELECT id FROM t;") == []
    monkeypatch.setattr(storage, "LOCK_SECONDS", -1.0)  # its owner is gone
    assert engine.execute("INSERT INTO t (id) VALUES (1);") == 1 and not lock.exists()


def test_upsert_of_a_query_with_equal_keys(engine):
    engine.execute_batch("CREATE TABLE s (id INT PRIMARY KEY, k TEXT); INSERT INTO s (id, k) VALUES (1, 'a'), (2, 'b'), (3, 'A'), (4, NULL), (5, NULL), (6, 'a');")
    engine.execute_batch("CREATE TABLE v (k VARCHAR(9) COLLATE NOCASE PRIMARY KEY, n INT NOT NULL DEFAULT 1, CHECK (n < 20)); INSERT INTO v (k) VALUES ('B');")
    assert engine.execute("INSERT INTO v (k) SELECT k FROM s WHERE k IS NOT NULL ON DUPLICATE KEY UPDATE n = n * 2 + 1;") == 4
    assert rows(engine, "SELECT LOWER(k) AS k, n FROM v;") == [("a", 7), ("b", 3)]
    with pytest.raises(ConstraintError):
        engine.execute("INSERT INTO v (k) SELECT k FROM s WHERE k IS NOT NULL ON DUPLICATE KEY UPDATE n = n * 3;")
    assert rows(engine, "SELECT LOWER(k) AS k, n FROM v;") == [("a", 7), ("b", 3)]


def test_recursion_limit(engine):
    engine.execute_batch("CREATE TABLE s (n INT PRIMARY KEY); INSERT INTO s (n) VALUES (1);")
    with pytest.raises(Exception, match="."):
        engine.query("WITH RECURSIVE r AS (SELECT n FROM s UNION ALL SELECT n + 1 AS n FROM r) SELECT n FROM r;").count()


def test_shell(engine, capsys, monkeypatch):
    from quillon import __main__ as shell

    monkeypatch.setattr(shell, "Engine", lambda *_: engine)
    assert shell.main(["", "CREATE TABLE t (id INT PRIMARY KEY); INSERT INTO t (id) VALUES (1); SELECT id FROM t;"]) == 0
    assert "1 row(s) affected" in capsys.readouterr().out
    lines = iter(["SELECT id", "FROM t;", "SELECT gone FROM t;"])

    def line(prompt):
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    monkeypatch.setattr("builtins.input", line)
    assert shell.main([]) == 0
    captured = capsys.readouterr()
    assert "| 1  |" in captured.out and "ValidationError" in captured.err
