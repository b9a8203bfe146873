"""Lexing, parsing and rendering without tables of their own."""

import decimal

import pytest

from quillon.errors import ParseError, ValidationError
from quillon.plans.lexer import script_is_complete, split_script
from quillon.plans.parser import parse


def test_keywords_must_be_capitalized():
    with pytest.raises(ParseError, match="capitalized: SELECT"):
        parse("select a FROM t;")


@pytest.mark.parametrize("sql", ["SELECT 1;", "SELECT a FROM t", "SELECT a, * FROM t;", "INSERT INTO t VALUES (1);", "SELECT a FROM (SELECT b FROM u);", "CREATE TABLE t (id int);", "SELECT a FROM t LIMIT -1;", "SELECT a FROM t WHERE X'abc' = b;"])
def test_rejected(sql):
    with pytest.raises(ParseError):
        parse(sql)


def test_text_escapes():
    query, _ = parse(r"SELECT 'it''s \'x\' \\' FROM t;")
    assert query.items[0].value.value == "it's 'x' \\"


def test_parameters_are_counted():
    assert parse("SELECT a FROM t WHERE a = ? AND b IN (?, ?);")[1] == 3


def test_scripts_split_at_tokens():
    assert split_script("SELECT ';' FROM t; SELECT b FROM u;") == ["SELECT ';' FROM t;", "SELECT b FROM u;"]
    assert script_is_complete("SELECT 1;") and script_is_complete("") and not script_is_complete("SELECT 'a;") and not script_is_complete("DROP VIEW a; UPDATE stock SET n = (n")


SHAPES = [
    "SELECT id, COUNT(*) OVER (PARTITION BY id) AS n, SUM(id) FROM t;",
    "SELECT DISTINCT id, ROW_NUMBER() OVER (PARTITION BY id) AS n FROM t;",
    "SELECT RANK() OVER (PARTITION BY id) FROM t;",
    "SELECT id FROM t WHERE COUNT(*) > 1;",
    "SELECT id FROM t WHERE id IN (SELECT id, name FROM t);",
    "SELECT missing FROM t;",
    "SELECT id FROM missing;",
    "SELECT id FROM t a JOIN t b ON a.id = b.id;",
    "SELECT id AS x FROM t UNION SELECT id, name FROM t;",
    "SELECT SQRT(id) FROM t;",
    "SELECT LENGTH(id) FROM t;",
    "SELECT SUM(name) FROM t;",
    "SELECT x FROM (SELECT id AS x FROM t) d WHERE x;",
    "WITH RECURSIVE r AS (SELECT id FROM t) SELECT id FROM r WHERE id IN (SELECT nothing FROM r);",
    "WITH RECURSIVE r AS (SELECT id FROM r UNION ALL SELECT id FROM r) SELECT id FROM r;",
]


@pytest.mark.parametrize("sql", SHAPES)
def test_invalid_statements(engine, sql):
    engine.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT);")
    with pytest.raises(ValidationError):
        engine.query(sql)


ONE = "SELECT {} AS v FROM one_row;"


@pytest.fixture(scope="module")
def one(spark):
    from quillon.engine import Engine

    e = Engine(spark)
    e.execute("CREATE TABLE one_row (id INT PRIMARY KEY);")
    e.execute("INSERT INTO one_row (id) VALUES (1);")
    return e


VALUES = {
    "SUBSTRING('hello', -10, 3)": "hel", "SUBSTRING('hello', 0, 2)": "he", "SUBSTRING('hello', 2)": "ello", "SUBSTRING('hello', 2, -1)": "", "LOCATE('', 'abc', 10)": 4, "LOCATE('b', 'abc', 0)": 2, "LOCATE('z', 'abc')": 0,
    "REPLACE('ab', '', '-')": "-a-b-", "GREATEST(1, NULL, 3)": None, "LEAST(2, 1)": 1, "TRIM('\t x ')": "x", "HEX('ab')": "6162", "UNHEX('6162')": b"ab", "LENGTH(X'616263')": 3, "BIT_LENGTH('é')": 16, "CONCAT('a', TRUE, 1)": "aTRUE1", "CONCAT('a', NULL)": None,
    "CONCAT_WS('-', 'a', NULL, 'b')": "a-b", "REPEAT('a', -1)": "", "LEFT('abc', -1)": "", "ROUND(-2.5)": -3.0, "CEIL(1.2)": 2.0, "POWER(2, 10)": 1024.0, "SEC_TO_TIME(90061)": "01:01:01", "CAST('10:11:12+03:00' AS TIME WITH TIME ZONE)": "10:11:12+03:00",
    "TIME_TO_SEC('01:00:01')": 3601, "CAST('2024-01-31' AS DATE) + INTERVAL '0-1' YEAR TO MONTH = CAST('2024-02-29' AS DATE)": True, "CAST('23:59:59' AS TIME) + 2": "00:00:01", "CAST(258 AS BLOB)": b"\x02\x01\x00\x00", "CAST(TRUE AS TEXT)": "TRUE", "CAST(2.9 AS INT)": 2,
    "CAST('yes' AS TEXT) LIKE 'y\\\\%'": False, "'a\\\\b' LIKE 'a\\\\b'": True, "NULL IN (1)": None, "3 NOT IN (1, NULL)": None, "UNIX_TIMESTAMP('1970-01-02 00:00:00')": 86400, "CASE WHEN NULL THEN 1 ELSE 2 END": 2, "7 % 4": 3, "-7 % 4": -3, "NULLIF(1, 1)": None, "IFNULL(NULL, 5)": 5,
    "INTERVAL '1 00:00:00' DAY TO SECOND + INTERVAL '0 01:00:00' DAY TO SECOND = INTERVAL '1 01:00:00' DAY TO SECOND": True,
}


@pytest.mark.parametrize("expression", VALUES)
def test_values(one, expression):
    got = one.query_one(ONE.format(expression))
    assert (bytes(got) if isinstance(got, bytearray) else got) == VALUES[expression]


@pytest.mark.parametrize(
    ("quotient", "digits"),
    [
        ("2 / 3", "0.666666666666666667"),
        ("5 / 2", "2.5"),
        ("CAST('1.23456789' AS DECIMAL(20, 10)) / 1", "1.23456789"),
        ("CAST('0.0000001' AS DECIMAL(20, 10)) / 2", "0.00000005"),
        ("CAST('12345678901234567890' AS INT128) / 8", "1543209862654320986.25"),
        ("CAST('-7' AS DECIMAL(38, 18)) / CAST('0.000000000000000002' AS DECIMAL(38, 18))", "-3500000000000000000"),
        ("CAST('1000000.5' AS DECIMAL(38, 18)) / CAST('0.125' AS DECIMAL(38, 18))", "8000004"),
    ],
)
def test_exact_division(one, quotient, digits):
    assert one.query_one(ONE.format(quotient)) == decimal.Decimal(digits)


def test_products_keep_their_digits(one):
    product = "CAST('1234567.0123456789' AS DECIMAL(17, 10)) * CAST('0.0123456789' AS DECIMAL(20, 10))"
    assert one.query_one(ONE.format(product)) == decimal.Decimal("1234567.0123456789") * decimal.Decimal("0.0123456789")


def test_quotients_beyond_38_digits_are_errors(one):
    with pytest.raises(Exception, match="."):
        one.query_one(ONE.format("CAST('123456789012345678901234' AS INT128) / 1"))


def test_wide_integers_keep_their_digits_when_negated(one):
    digits = "98765432109876543210987654321098765432"
    assert one.query_one(ONE.format(f"-CAST('{digits}' AS INT128)")) == -int(digits)
    assert one.query_one(ONE.format(f"ABS(CAST('-{digits}' AS INT128))")) == int(digits)
    assert one.query_one(ONE.format(f"-(-CAST('{digits}' AS INT128))")) == int(digits)


@pytest.mark.parametrize(("rounded", "value"), [("ROUND(1.005, 2)", 1.0), ("ROUND(2.5)", 3.0), ("ROUND(-2.5)", -3.0), ("ROUND(1250.0, -2)", 1300.0), ("ROUND(0.49999999999999994)", 0.0), ("ROUND(POWER(10.0, 300))", 1e300)])
def test_rounding_scales_the_double(one, rounded, value):
    assert one.query_one(ONE.format(rounded)) == pytest.approx(value, rel=1e-15, abs=0)


ERRORS = ["CAST('2024-1-1' AS DATE)", "CAST(' 7' AS INT)", "CAST('t' AS BOOLEAN)", "CAST(300 AS UINT8)", "CAST(-1 AS UINT)", "CAST(1.234 AS DECIMAL(4, 2))", "CAST('abcde' AS CHAR(4))", "UNHEX('abc')", "1 / 0", "POWER(10.0, 400)", "CAST('24:00:00' AS TIME)", "CAST('x' AS ENUM('a', 'b'))"]


@pytest.mark.parametrize("expression", ERRORS)
def test_run_time_errors(one, expression):
    with pytest.raises(Exception, match="."):
        one.query_one(ONE.format(expression))
