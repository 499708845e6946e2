"""Reading statements: what the dialect has, what it refuses, and how it binds."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegate.dialect.lexer import DialectError, tokens
from tidegate.dialect.statements import StatementReader
from tidegate.dialect.translate import like_pattern, to_spark


def read(sql):
    return StatementReader(sql).statement()


@pytest.mark.parametrize("sql", ["MERGE INTO a USING b ON a.x = b.x", "GRANT SELECT ON a TO b", "REVOKE SELECT ON a FROM b", "", "SELECT", "SELECT 1 FROM", "SELECT (1", "SELECT 1 2 3", "SELECT 'a", "WITH a AS (SELECT 1) DELETE FROM b", "SELECT ROW_NUMBER() FROM t", "SELECT NO_SUCH(1)"])
def test_refused(sql):
    with pytest.raises(ValueError):
        read(sql)


@pytest.mark.parametrize("sql, part", [
    ("SELECT 1 + 2 * 3", "(1 + (2 * 3))"),
    ("SELECT a | b & c", "(cast(`a` AS bigint) | cast((cast(`b` AS bigint) & cast(`c` AS bigint)) AS bigint))"),
    ("SELECT NOT a = b OR c = d", "((NOT (`a` = `b`)) OR (`c` = `d`))"),
    ("SELECT a FROM t ORDER BY a", "ORDER BY `a` ASC NULLS LAST"),
    ("SELECT a FROM t ORDER BY a DESC", "ORDER BY `a` DESC NULLS FIRST"),
    ("SELECT a FROM t ORDER BY a DESC NULLS LAST", "ORDER BY `a` DESC NULLS LAST"),
    ("SELECT a, b, SUM(c) FROM t GROUP BY a", "min_by(`b`, coalesce(_place, 9223372036854775807L)) AS `b`"),
    ("SELECT SUM(a) FILTER (WHERE b > 1) OVER (ORDER BY c) FROM t", "CASE WHEN (`b` > 1) THEN `a` END"),
    ("SELECT 1 UNION SELECT 2 INTERSECT SELECT 3", "(SELECT 1 UNION SELECT 2) INTERSECT (SELECT 3)"),
    ("SELECT STDDEV(a) FROM t", "stddev_pop"),
    ("SELECT * FROM a JOIN b USE INDEX (i) ON a.x = b.x", "INNER JOIN `b` AS `b` ON (`a`.`x` = `b`.`x`)"),
    ("SELECT * FROM t FOR UPDATE", "SELECT * FROM `t` AS `t`"),
    ("SELECT COUNT(*) OVER (ORDER BY a RANGE 2 PRECEDING) FROM t", "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"),
])
def test_spark_sql(sql, part):
    assert part in to_spark(sql)


def test_strings_and_names():
    assert [t.text for t in tokens("'it''s' \"a b\" `c` 'x\\ny' -- gone\n/* gone */ @@version")][:-1] == ["it's", "a b", "c", "x\ny", "@@version"]


def test_like_pattern():
    assert like_pattern("a!_b", "!") == "a\\_b"
    assert like_pattern("a\\b", "") == "a\\\\b"
    assert like_pattern("!#", "!") == "#"


def test_limits():
    with pytest.raises(DialectError):
        tokens("x" * ((1 << 20) + 1))
    with pytest.raises(DialectError):
        to_spark("SELECT " + "(" * 300 + "1" + ")" * 300)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="SELECT FROMWHERE*(),.'\"`=<>+-ab1?;\n", max_size=60))
def test_reader_fails_only_as_it_should(text):
    try:
        read(text)
    except ValueError:
        pass


@pytest.mark.parametrize("sql, kind", [
    ("INSERT OR IGNORE INTO t (a) VALUES (1), (DEFAULT)", "insert"), ("REPLACE INTO t VALUES (1)", "insert"), ("UPDATE t SET (a, b) = (1, 2) WHERE c = 3 RETURNING *", "update"),
    ("DELETE FROM t USING u WHERE t.a = u.a", "delete"), ("CREATE TABLE t (a INTEGER PRIMARY KEY, b VARCHAR(5) NOT NULL DEFAULT 'x', CHECK (a > 0), FOREIGN KEY (b) REFERENCES u (c) ON DELETE SET NULL)", "create_table"),
    ("CREATE TABLE t (y INTEGER) PARTITION BY RANGE (y) (PARTITION p0 VALUES LESS THAN (2020), PARTITION p1 VALUES LESS THAN MAXVALUE)", "create_table"),
    ("CREATE FULLTEXT INDEX f ON t (a, b)", "create_fulltext"), ("DROP TABLE IF EXISTS t", "drop_table"), ("ALTER TABLE t ADD CONSTRAINT c UNIQUE (a)", "alter"),
    ("SAVEPOINT s", "savepoint"), ("START TRANSACTION", "begin"), ("SHOW CREATE TABLE t", "show_create"), ("DESC t", "describe"), ("EXPLAIN SELECT 1", "explain"), ("SET x = 1", "set"), ("USE db", "nothing"),
    ("CREATE TRIGGER g AFTER INSERT ON t BEGIN UPDATE u SET a = 1; END", "create_trigger"), ("CREATE COLLECTION IF NOT EXISTS c", "create_collection"),
])
def test_statements(sql, kind):
    assert read(sql).kind == kind
