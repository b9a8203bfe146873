"""Registered queries of the dialect and its engine, with their DuckDB counterparts.

A query is a script of the dialect: all statements but the last are executed on an in-memory
engine over the directory's tables, the last one's rows are the result. Where the text is plain
SQL, the counterpart is the same text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .engine import Engine
from .plans.lexer import split_script

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def run_script(spark: SparkSession, sf_dir: str, script: str, values: tuple = ()) -> DataFrame:
    engine = Engine(spark, sources=sf_dir)
    *before, last = split_script(script)
    for statement in before:
        engine.execute(statement)
    return engine.query(last, *values)


def add(name: str, script: str, oracle: str | None = None, values: tuple = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: run_script(spark, sf_dir, script, values)
    ORACLE_SQL[name] = oracle or script.strip().rstrip(";")


# scans, filters, expressions

add("scan_all", "SELECT * FROM nation;")
add("scan_project", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10.0 AND 20.0 AND l_returnflag IN ('A', 'R');")
add("scan_key", "SELECT * FROM orders WHERE o_orderkey = 7;")
add("filter_logic", "SELECT p_partkey FROM part WHERE (p_size < 5 OR NOT p_size < 45) AND p_retailprice > 100.0;")
add("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_name NOT LIKE '%7%';")
add("filter_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (1, 2, NULL);")
add("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45;")
add(
    "filter_null",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 1000.0 WHERE o_orderkey IS NULL OR c_acctbal IS NOT NULL AND c_acctbal < 0.0;",
)
add("case_when", "SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'large' WHEN p_size >= 20 THEN 'middle' ELSE 'small' END AS class FROM part;")
add("alias_in_where", "SELECT l_orderkey, l_linenumber, l_extendedprice * 2.0 AS double_price FROM lineitem WHERE double_price > 100000.0;")
add("arithmetic_integers", "SELECT o_orderkey + 1 AS a, o_orderkey * 3 - 2 AS b, o_orderkey % 7 AS c, -o_orderkey AS d FROM orders;")
add("arithmetic_division", "SELECT p_partkey, CAST(p_size / 7 AS FLOAT) > 3.5 AS big FROM part;", "SELECT p_partkey, p_size / 7.0 > 3.5 AS big FROM part")
add("boolean_values", "SELECT c_custkey, c_acctbal > 0.0 AS positive, NOT c_acctbal > 5000.0 AS modest FROM customer;")
add("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT AVG(c_acctbal) FROM customer);")
add("correlated_scalar", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS orders_made FROM customer;")
add("correlated_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000.0);")
add("correlated_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey);")
add("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1);")
add("not_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1);")
add("parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?;", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 500.5", ("F", 500.5))

# joins

add("join_inner", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F';")
add("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey;")
add("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey;")
add("join_full", "SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey;")
add("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey;")
add("join_theta", "SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey;")
add("join_full_theta", "SELECT a.r_regionkey AS one, b.r_regionkey AS two FROM region a FULL JOIN region b ON a.r_regionkey > b.r_regionkey + 2;")
add("join_chain", "SELECT n_name, r_name, COUNT(*) AS orders_made FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name;")
add("join_exists_on", "SELECT n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey AND EXISTS (SELECT r_regionkey FROM region WHERE r_regionkey = n_regionkey AND r_name LIKE 'A%');")

# aggregates

add("group_by", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS quantity, ROUND(AVG(l_discount), 6) AS discount, MIN(l_shipdate) AS first, MAX(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus;")
add("group_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12;")
add("group_having_alias", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12;")
add("group_null_key", "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2);")
add("aggregate_global", "SELECT COUNT(*) AS n, COUNT(o_orderkey) AS k, MAX(o_orderkey) AS top, MIN(o_orderpriority) AS least FROM orders;")
add("aggregate_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, AVG(o_totalprice) AS mean FROM orders WHERE o_orderkey < 0;")
add("aggregate_nulls", "SELECT COUNT(o_orderkey) AS matched, COUNT(*) AS rows_seen FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P';")
add("aggregate_integers", "SELECT p_brand, SUM(p_size) AS total FROM part GROUP BY p_brand;", "SELECT p_brand, CAST(SUM(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
add("distinct", "SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 4;")

# windows

add("window_row_number", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders;")
add("window_rank", "SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS place, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS dense FROM part;")
add("window_aggregate", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS top, MIN(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders;")
add(
    "window_whole_partition",
    "SELECT p_partkey, SUM(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS total FROM part;",
    "SELECT p_partkey, CAST(SUM(p_size) OVER (PARTITION BY p_brand) AS BIGINT) AS total FROM part",
)
add("window_expression_key", "SELECT n_nationkey, COUNT(*) OVER (PARTITION BY n_nationkey % 3) AS n FROM nation;")

# sorting and limits

add("order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10;")
add("order_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10;", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
add(
    "order_nulls",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey > 100 ORDER BY o_orderkey, c_custkey LIMIT 20;",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderkey > 100 ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 20",
)
add("order_grouped", "SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3;")
add("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20;")

# set operations

add("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier;")
add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier;")
add("intersect", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier;")
add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders;")
add(
    "set_right_associative",
    "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2;",
    "SELECT r_regionkey AS k FROM region UNION ALL (SELECT n_regionkey FROM nation EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey > 2)",
)

# derived tables, common table expressions, views

add("derived_table", "SELECT x.k, x.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) x WHERE x.n > 10;")
add("cte", "WITH big AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 1000.0), few AS (SELECT c_custkey FROM customer WHERE c_acctbal < 100.0) SELECT o_orderkey FROM big JOIN few ON o_custkey = c_custkey;")
add(
    "cte_recursive",
    "WITH RECURSIVE steps AS (SELECT r_regionkey AS n FROM region WHERE r_regionkey = 0 UNION ALL SELECT n + 1 AS n FROM steps WHERE n < 200) SELECT n FROM steps;",
    "SELECT CAST(range AS BIGINT) AS n FROM range(0, 201)",
)
add(
    "cte_recursive_distinct",
    "WITH RECURSIVE reach AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 3 + 1) % 25 AS k FROM reach) SELECT k FROM reach;",
    "WITH RECURSIVE reach AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 1 UNION SELECT (k * 3 + 1) % 25 AS k FROM reach) SELECT k FROM reach",
)
add(
    "view",
    "CREATE VIEW rich AS SELECT c_custkey AS k, c_acctbal AS held FROM customer WHERE c_acctbal > 5000.0; CREATE VIEW richer AS SELECT k FROM rich WHERE held > 8000.0; SELECT k FROM richer;",
    "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 8000.0",
)

# functions and casts

add(
    "functions_text",
    """SELECT c_custkey, LOWER(c_name) AS lo, UPPER(c_mktsegment) AS up, LENGTH(c_name) AS len, OCTET_LENGTH(c_name) AS octets, BIT_LENGTH(c_name) AS bits, CONCAT(c_name, '/', c_mktsegment) AS joined, LEFT(c_name, 3) AS l, RIGHT(c_name, 3) AS r,
    SUBSTRING(c_name, 2, 4) AS part, SUBSTRING(c_name, -4) AS tail, REPLACE(c_name, 'C', '') AS gone, REPEAT(LEFT(c_name, 1), 3) AS again, REVERSE(c_name) AS back, LOCATE('0', c_name) AS at, HEX(c_name) AS hexed, TRIM(CONCAT('  ', c_name, ' ')) AS trimmed, CONCAT_WS('-', c_name, NULL, 'z') AS listed FROM customer;""",
    """SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, CAST(length(c_name) AS INTEGER) AS len, CAST(strlen(c_name) AS INTEGER) AS octets, CAST(8 * strlen(c_name) AS INTEGER) AS bits, c_name || '/' || c_mktsegment AS joined, left(c_name, 3) AS l, right(c_name, 3) AS r,
    substring(c_name, 2, 4) AS part, right(c_name, 4) AS tail, replace(c_name, 'C', '') AS gone, repeat(left(c_name, 1), 3) AS again, reverse(c_name) AS back, CAST(instr(c_name, '0') AS INTEGER) AS at, hex(c_name) AS hexed, c_name AS trimmed, c_name || '-z' AS listed FROM customer""",
)
add("functions_null", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), 99) AS c, IFNULL(NULLIF(n_regionkey, 2), 7) AS i, GREATEST(n_nationkey, n_regionkey, 3) AS g, LEAST(n_nationkey, n_regionkey) AS l, GREATEST(NULLIF(n_regionkey, 0), 2) AS gn FROM nation;", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 99) AS c, coalesce(nullif(n_regionkey, 2), 7) AS i, greatest(n_nationkey, n_regionkey, 3) AS g, least(n_nationkey, n_regionkey) AS l, CASE WHEN n_regionkey = 0 THEN NULL ELSE greatest(n_regionkey, 2) END AS gn FROM nation")
add("functions_math", "SELECT c_custkey, ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, POWER(2, c_nationkey) AS p FROM customer;", "SELECT c_custkey, abs(c_acctbal) AS a, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, power(2, c_nationkey) AS p FROM customer")
add(
    "functions_temporal",
    "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, HOUR(o_orderdate) AS h, DATE(o_orderdate) AS day_, UNIX_TIMESTAMP(o_orderdate) AS epoch, TIME(o_orderdate) AS clock, TIME_TO_SEC(TIME(o_orderdate)) AS s FROM orders;",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(o_orderdate AS DATE) AS day_, CAST(epoch(o_orderdate) AS BIGINT) AS epoch, strftime(o_orderdate, '%H:%M:%S') AS clock, CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS BIGINT) AS s FROM orders",
)
add(
    "temporal_arithmetic",
    "SELECT o_orderkey, DATE(o_orderdate) + 30 AS later, DATE(o_orderdate) + INTERVAL '0-1' YEAR TO MONTH AS month_on, DATE(o_orderdate) - CAST('1994-01-01' AS DATE) AS days, o_orderdate + 3600 AS hour_on, o_orderdate - CAST('1994-01-01 00:00:00' AS DATETIME) AS seconds FROM orders;",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS month_on, CAST(date_diff('day', DATE '1994-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days, o_orderdate + INTERVAL 3600 SECOND AS hour_on, CAST(epoch(o_orderdate) - epoch(TIMESTAMP '1994-01-01 00:00:00') AS BIGINT) AS seconds FROM orders",
)
add(
    "casts",
    "SELECT n_nationkey, CAST(n_nationkey AS TEXT) AS t, CAST(CAST(n_nationkey AS TEXT) AS INT) AS i, CAST(n_nationkey AS FLOAT) AS f, CAST(n_regionkey AS BOOLEAN) AS b, CAST(n_nationkey > 3 AS TEXT) AS word, CAST('2024-02-29' AS DATE) AS d FROM nation;",
    "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS t, n_nationkey AS i, CAST(n_nationkey AS DOUBLE) AS f, n_regionkey <> 0 AS b, CASE WHEN n_nationkey > 3 THEN 'TRUE' ELSE 'FALSE' END AS word, DATE '2024-02-29' AS d FROM nation",
)

# tables, constraints, mutations, transactions

_NATIONS = "CREATE TABLE home (id INT PRIMARY KEY, name TEXT NOT NULL, region INT, visits INT NOT NULL DEFAULT 1, CHECK (visits >= 0)); INSERT INTO home (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation;"
add("insert_select", _NATIONS + "SELECT * FROM home;", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, 1 AS visits FROM nation")
add("insert_values", "CREATE TABLE notes (id INT PRIMARY KEY AUTO_INCREMENT, body TEXT); INSERT INTO notes (body) VALUES ('a'), ('b'); INSERT INTO notes SET body = 'c'; SELECT id, body FROM notes;", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS x(id, body)")
add(
    "insert_on_duplicate",
    _NATIONS + "INSERT INTO home (id, name, region) VALUES (3, 'again', 0), (3, 'again', 0), (100, 'new', 1) ON DUPLICATE KEY UPDATE visits = visits + 1; SELECT id, name, visits FROM home;",
    "SELECT n_nationkey AS id, n_name AS name, CAST(CASE WHEN n_nationkey = 3 THEN 3 ELSE 1 END AS INTEGER) AS visits FROM nation UNION ALL SELECT 100, 'new', 1",
)
add("update_rows", _NATIONS + "UPDATE home SET visits = visits + region, name = LOWER(name) WHERE region > 1; SELECT * FROM home;", "SELECT n_nationkey AS id, CASE WHEN n_regionkey > 1 THEN lower(n_name) ELSE n_name END AS name, n_regionkey AS region, CAST(CASE WHEN n_regionkey > 1 THEN 1 + n_regionkey ELSE 1 END AS INTEGER) AS visits FROM nation")
add(
    "update_joined",
    _NATIONS + "UPDATE home h INNER JOIN region r ON h.region = r.r_regionkey SET h.name = CONCAT(h.name, '@', r.r_name) WHERE r.r_name LIKE 'A%'; SELECT id, name FROM home;",
    "SELECT n_nationkey AS id, CASE WHEN r_name LIKE 'A%' THEN n_name || '@' || r_name ELSE n_name END AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
add("delete_rows", _NATIONS + "DELETE FROM home WHERE id % 2 = 0; SELECT id FROM home;", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 <> 0")
add("delete_joined", _NATIONS + "DELETE h FROM home h INNER JOIN region r ON h.region = r.r_regionkey WHERE r.r_name LIKE 'A%'; SELECT id FROM home;", "SELECT n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE NOT r_name LIKE 'A%'")
_FAMILY = "CREATE TABLE area (id INT PRIMARY KEY, name TEXT); CREATE TABLE land (id INT PRIMARY KEY, area_id INT REFERENCES area(id) {}); INSERT INTO area (id, name) SELECT r_regionkey, r_name FROM region; INSERT INTO land (id, area_id) SELECT n_nationkey, n_regionkey FROM nation;"
add("foreign_key_cascade", _FAMILY.format("ON DELETE CASCADE") + "DELETE FROM area WHERE id = 2; SELECT id, area_id FROM land;", "SELECT n_nationkey AS id, n_regionkey AS area_id FROM nation WHERE n_regionkey <> 2")
add("foreign_key_set_null", _FAMILY.format("ON DELETE SET NULL") + "DELETE FROM area WHERE id = 2; SELECT id, area_id FROM land;", "SELECT n_nationkey AS id, nullif(n_regionkey, 2) AS area_id FROM nation")
add("foreign_key_update", _FAMILY.format("ON UPDATE CASCADE") + "UPDATE area SET id = 20 WHERE id = 2; SELECT id, area_id FROM land;", "SELECT n_nationkey AS id, CASE WHEN n_regionkey = 2 THEN 20 ELSE n_regionkey END AS area_id FROM nation")
add(
    "trigger_audit",
    _NATIONS + "CREATE TABLE audit (id INT PRIMARY KEY, entry TEXT); CREATE TRIGGER watch AFTER UPDATE ON home AS INSERT INTO audit (id, entry) VALUES (NEW.id, CONCAT(OLD.name, '>', NEW.name)); UPDATE home SET name = 'x' WHERE id < 2; SELECT id, entry FROM audit;",
    "SELECT n_nationkey AS id, n_name || '>x' AS entry FROM nation WHERE n_nationkey < 2",
)
add("select_into", "SELECT r_name INTO kept FROM region WHERE r_regionkey > 2; SELECT r_name FROM kept;", "SELECT r_name FROM region WHERE r_regionkey > 2")
add(
    "alter_table",
    _NATIONS + "ALTER TABLE home ADD COLUMN active BOOLEAN NOT NULL DEFAULT TRUE; ALTER TABLE home RENAME COLUMN name TO title; ALTER TABLE home DROP COLUMN region; ALTER TABLE home RENAME TO lands; SELECT id, title, active FROM lands;",
    "SELECT n_nationkey AS id, n_name AS title, TRUE AS active FROM nation",
)
add("transaction", _NATIONS + "BEGIN; DELETE FROM home WHERE id > 3; SAVEPOINT here; DELETE FROM home; ROLLBACK TO SAVEPOINT here; COMMIT; BEGIN; DELETE FROM home; ROLLBACK; SELECT id FROM home;", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey <= 3")
add("collation_nocase", "CREATE TABLE people (id INT PRIMARY KEY, name VARCHAR(30) COLLATE NOCASE, code CHAR(12)); INSERT INTO people (id, name, code) SELECT n_nationkey, n_name, LEFT(n_name, 8) FROM nation; SELECT id FROM people WHERE name = 'nation_3' OR code = 'NATION_4';", "SELECT n_nationkey AS id FROM nation WHERE lower(n_name) = 'nation_3' OR left(n_name, 8) = 'NATION_4'")
add("create_index", _NATIONS + "CREATE INDEX by_region ON home (region); CREATE UNIQUE INDEX by_name ON home (name); SHOW INDEXES FROM home;", "SELECT 'home' AS table_name, 'by_name' AS index_name, TRUE AS is_unique, 'name' AS columns UNION ALL SELECT 'home', 'by_region', FALSE, 'region'")
add("describe", _NATIONS + "DESCRIBE home;", "SELECT * FROM (VALUES ('id', 'INT', FALSE, TRUE, FALSE, NULL), ('name', 'TEXT', FALSE, FALSE, FALSE, NULL), ('region', 'INT', TRUE, FALSE, FALSE, NULL), ('visits', 'INT', FALSE, FALSE, FALSE, '1')) AS x(\"column\", type, nullable, primary_key, auto_increment, \"default\")")
add("show_tables", _NATIONS + "SHOW TABLES;", "SELECT 'home' AS table_name")

# statements and forms that the queries above leave out

add("drop_table", _NATIONS + "CREATE TABLE spare (id INT PRIMARY KEY); DROP TABLE spare; DROP TABLE IF EXISTS spare; SHOW TABLES;", "SELECT 'home' AS table_name")
add("drop_index", _NATIONS + "CREATE INDEX by_region ON home (region); CREATE UNIQUE INDEX by_name ON home (name); DROP INDEX by_region ON home; SHOW INDEXES FROM home;", "SELECT 'home' AS table_name, 'by_name' AS index_name, TRUE AS is_unique, 'name' AS columns")
add("show_views", "CREATE VIEW v1 AS SELECT r_name FROM region; CREATE VIEW v2 AS SELECT n_name FROM nation; DROP VIEW v1; SHOW VIEWS;", "SELECT 'v2' AS view_name")
_WATCHED = _NATIONS + "CREATE TABLE log (id INT PRIMARY KEY AUTO_INCREMENT, entry TEXT); CREATE TRIGGER coming AFTER INSERT ON home AS INSERT INTO log (entry) VALUES (CONCAT('+', NEW.name)); CREATE TRIGGER going AFTER DELETE ON home AS INSERT INTO log (entry) VALUES (CONCAT('-', OLD.name));"
add("show_triggers", _WATCHED + "DROP TRIGGER coming; SHOW TRIGGERS FROM home;", "SELECT 'going' AS trigger_name, 'DELETE' AS event, 'home' AS table_name, 'INSERT INTO log (entry) VALUES (CONCAT(''-'', OLD.name))' AS body")
add("trigger_insert_delete", _WATCHED + "INSERT INTO home (id, name) VALUES (90, 'here'); DELETE FROM home WHERE id = 90 OR id = 3; SELECT entry FROM log;", "SELECT '+here' AS entry UNION ALL SELECT '-here' UNION ALL SELECT '-' || n_name FROM nation WHERE n_nationkey = 3")
add("drop_trigger", _WATCHED + "DROP TRIGGER going; DELETE FROM home WHERE id > 2; SELECT COUNT(*) AS n FROM log;", "SELECT CAST(0 AS BIGINT) AS n")
add("show_create_view", "CREATE VIEW near_ AS SELECT n_name FROM nation WHERE n_regionkey = 1; SHOW CREATE VIEW near_;", "SELECT 'near_' AS name, 'CREATE VIEW near_ AS SELECT n_name FROM nation WHERE n_regionkey = 1;' AS sql")
add("show_create_table", "CREATE TABLE pair (id INT PRIMARY KEY AUTO_INCREMENT, label VARCHAR(8) NOT NULL DEFAULT 'x'); SHOW CREATE TABLE pair;", "SELECT 'pair' AS name, 'CREATE TABLE pair (id INT PRIMARY KEY AUTO_INCREMENT, label VARCHAR(8) NOT NULL DEFAULT ''x'');' AS sql")
add(
    "alter_constraints",
    _NATIONS + "ALTER TABLE home ADD CONSTRAINT few CHECK (visits < 9); ALTER TABLE home DROP CONSTRAINT few; ALTER TABLE home ALTER COLUMN region SET NOT NULL; ALTER TABLE home ALTER COLUMN region DROP NOT NULL; ALTER TABLE home ALTER COLUMN visits SET DEFAULT 50; INSERT INTO home (id, name) VALUES (70, 'late'); ALTER TABLE home ALTER COLUMN visits DROP DEFAULT; DESCRIBE home;",
    "SELECT * FROM (VALUES ('id', 'INT', FALSE, TRUE, FALSE, NULL), ('name', 'TEXT', FALSE, FALSE, FALSE, NULL), ('region', 'INT', TRUE, FALSE, FALSE, NULL), ('visits', 'INT', FALSE, FALSE, FALSE, CAST(NULL AS VARCHAR))) AS x(\"column\", type, nullable, primary_key, auto_increment, \"default\")",
)
add("foreign_key_restrict", _FAMILY.format("ON DELETE RESTRICT ON UPDATE RESTRICT") + "INSERT INTO area (id, name) VALUES (40, 'empty'), (41, 'empty too'); DELETE FROM area WHERE id = 40; UPDATE area SET id = 42 WHERE id = 41; SELECT id FROM area;", "SELECT r_regionkey AS id FROM region UNION ALL SELECT 42")
add("foreign_key_update_null", _FAMILY.format("ON UPDATE SET NULL") + "UPDATE area SET id = 20 WHERE id = 2; SELECT id, area_id FROM land;", "SELECT n_nationkey AS id, nullif(n_regionkey, 2) AS area_id FROM nation")
add("release_savepoint", _NATIONS + "BEGIN; SAVEPOINT a; DELETE FROM home WHERE id > 9; SAVEPOINT b; RELEASE SAVEPOINT a; COMMIT; SELECT id FROM home;", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey <= 9")
add("upsert_select", _NATIONS + "INSERT INTO home (id, name, region) SELECT n_regionkey, n_name, n_nationkey FROM nation ON DUPLICATE KEY UPDATE visits = visits + 1; SELECT id, name, visits FROM home;", "SELECT n_nationkey AS id, n_name AS name, CAST(1 + (SELECT COUNT(*) FROM nation AS o WHERE o.n_regionkey = nation.n_nationkey) AS INTEGER) AS visits FROM nation")
add("division_exact", "SELECT o_orderkey, CAST(o_orderkey / 8 AS FLOAT) AS eighth, CAST(CAST('1.23456789' AS DECIMAL(20, 10)) / 4 AS TEXT) AS digits FROM orders;", "SELECT o_orderkey, o_orderkey / 8.0::DOUBLE AS eighth, '0.308641972500000000' AS digits FROM orders")
add("round_ties", "SELECT n_nationkey, ROUND(n_nationkey + 0.005, 2) AS two, ROUND(n_nationkey / 2.0) AS half, ROUND(n_nationkey * 25.0, -2) AS hundreds FROM nation;", "SELECT n_nationkey, floor((n_nationkey + 0.005::DOUBLE) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS two, floor(n_nationkey / 2.0::DOUBLE + 0.5) AS half, floor(n_nationkey * 25.0::DOUBLE / 100 + 0.5) * 100 AS hundreds FROM nation")
add("unhex_text", "SELECT n_nationkey, CAST(UNHEX(HEX(n_name)) AS TEXT) AS name FROM nation;", "SELECT n_nationkey, n_name AS name FROM nation")
add("clock_functions", "SELECT event_id, HOUR(ts) AS h, MINUTE(ts) AS m, SECOND(ts) AS s, SEC_TO_TIME(HOUR(ts) * 3600 + MINUTE(ts) * 60 + SECOND(ts)) AS clock FROM events;", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(second(ts) AS INTEGER) AS s, strftime(ts, '%H:%M:%S') AS clock FROM events")
add(
    "interval_arithmetic",
    "SELECT o_orderkey, DATE(o_orderdate) - INTERVAL '2 00:00:00' DAY TO SECOND AS days_back, o_orderdate + INTERVAL '1 02:03:04' DAY TO SECOND AS later, o_orderdate - INTERVAL '1-2' YEAR TO MONTH AS earlier, TIME(o_orderdate + 3661) - TIME(o_orderdate) AS seconds, TIME(o_orderdate) + INTERVAL '0 00:00:05' DAY TO SECOND AS clock FROM orders;",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) - 2 AS DATE) AS days_back, o_orderdate + INTERVAL '93784 seconds' AS later, o_orderdate - INTERVAL '14 months' AS earlier, CAST((epoch(o_orderdate) + 3661) % 86400 - epoch(o_orderdate) % 86400 AS INTEGER) AS seconds, strftime(o_orderdate + INTERVAL '5 seconds', '%H:%M:%S') AS clock FROM orders",
)
add("interval_sums", "SELECT n_nationkey FROM nation WHERE INTERVAL '1 23:00:00' DAY TO SECOND + INTERVAL '0 01:00:00' DAY TO SECOND = INTERVAL '2 00:00:00' DAY TO SECOND AND INTERVAL '1-0' YEAR TO MONTH - INTERVAL '0-2' YEAR TO MONTH = INTERVAL '0-10' YEAR TO MONTH;", "SELECT n_nationkey FROM nation")
add("window_average", "SELECT p_partkey, AVG(p_size) OVER (PARTITION BY p_brand) AS mean FROM part;")
add("window_null_order", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY x, n_nationkey) AS place FROM (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS x FROM nation) y;", "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY nullif(n_regionkey, 2) NULLS FIRST, n_nationkey) AS place FROM nation")
add("having_alone", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 0;")
add("limit_per_arm", "SELECT r_regionkey AS k FROM region ORDER BY r_regionkey LIMIT 2 UNION ALL SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 3;", "SELECT CAST(x AS INTEGER) AS k FROM (VALUES (0), (1), (0), (1), (2)) AS t(x)")
add("order_nulls_descending", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r DESC, n_nationkey LIMIT 20;", "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS LAST, n_nationkey LIMIT 20")
add("name_resolution", "SELECT a.n_name AS n_name, b.n_regionkey AS k FROM nation a JOIN nation AS b ON a.n_nationkey = b.n_regionkey WHERE a.n_nationkey < 3;")
add("recursive_shape", "WITH RECURSIVE walk AS (SELECT n_nationkey AS k, 0 AS depth FROM nation WHERE n_nationkey < 2 UNION ALL SELECT k + 2 AS k, depth + 1 AS depth FROM walk WHERE depth < 5) SELECT k, depth FROM walk;", "SELECT CAST(a + 2 * d AS BIGINT) AS k, CAST(d AS BIGINT) AS depth FROM (VALUES (0), (1)) AS s(a), (SELECT unnest(range(0, 6)) AS d)")

add("rowid_lookup", _NATIONS + "SELECT id FROM home WHERE rowid = 4 OR rowid > 23;", "SELECT n_nationkey AS id FROM nation WHERE n_nationkey = 3 OR n_nationkey > 22")

add("interval_stored", "SELECT n_nationkey AS k, INTERVAL '0-7' YEAR TO MONTH AS months, INTERVAL '1 00:00:30' DAY TO SECOND AS span INTO spans FROM nation; SELECT k, CAST('2020-01-31' AS DATE) + months AS later, CAST('2020-01-31 00:00:00' AS DATETIME) + span AS moment FROM spans;", "SELECT n_nationkey AS k, DATE '2020-08-31' AS later, TIMESTAMP '2020-02-01 00:00:30' AS moment FROM nation")

# whole analyses

add("revenue_by_nation", "SELECT n_name, COUNT(*) AS items, ROUND(SUM(l_extendedprice * (1.0 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity < 25.0 GROUP BY n_name;")
add("top_orders_per_customer", "SELECT x.o_custkey, x.o_orderkey, x.place FROM (SELECT o_custkey, o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) x WHERE x.place <= 3;")
add("events_by_day", "SELECT DATE(ts) AS d, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY DATE(ts), event_type;", "SELECT CAST(ts AS DATE) AS d, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY CAST(ts AS DATE), event_type")

add("lineitem_having", "SELECT l_suppkey, COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 40;")
add("orders_by_nation", "SELECT n_name, COUNT(*) AS n FROM orders INNER JOIN customer ON o_custkey = c_custkey INNER JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name;")
add("join_full_orders", "SELECT c_custkey, o_orderkey FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey;")
add("order_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 100;")

#: The headline queries that bench.py times.
HEADLINE = ("lineitem_having", "orders_by_nation", "join_full_orders", "order_page", "scan_project", "group_by", "group_having", "join_chain", "join_full", "window_rank", "window_aggregate", "correlated_exists", "union_distinct", "order_limit", "revenue_by_nation", "top_orders_per_customer")
