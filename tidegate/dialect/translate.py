"""Queries and expressions of the dialect to Spark SQL, in one descent over the tokens.

Each rule returns Spark SQL text. What differs from Spark is settled here: NULL ordering, truth of values, function
names and meanings, set operations from left to right, windows with FILTER, values of ungrouped columns, time travel.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from tidegate import functions
from tidegate.dialect.lexer import DialectError, Token, tokens
from tidegate.functions import conditional
from tidegate.functions.aggregates import AGGREGATES, WINDOW_ONLY

MOST_DEPTH, MOST_LIST = 200, 4096
sys.setrecursionlimit(max(sys.getrecursionlimit(), 30 * MOST_DEPTH))  # a level of nesting takes up to some 15 calls
#: Words that end an expression or a table, so none of them is an alias without AS.
CLAUSES = set(
    "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL AS AND OR NOT "
    "WHEN THEN ELSE END ASC DESC NULLS SET VALUES RETURNING FOR USE FORCE IGNORE INDEXED WINDOW OUTER BETWEEN IN IS LIKE REGEXP RLIKE GLOB ESCAPE "
    "SEPARATOR AGAINST OVER FILTER SELECT WITH CASE EXISTS DISTINCT ALL INTO PARTITION ROWS RANGE".split()
)
SYSTEM_VARIABLES = {"version": "'8.0.0'", "autocommit": "1", "sql_mode": "''", "max_allowed_packet": "67108864", "tx_isolation": "'REPEATABLE-READ'", "transaction_isolation": "'REPEATABLE-READ'", "version_comment": "'tidegate'"}
_COMPARE = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "<=>": "<=>"}


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\0", "\\0") + "'"


def like_pattern(text: str, escape: str) -> str:
    """A pattern for Spark, which escapes by backslashes and only what needs it."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if escape and c == escape and i + 1 < len(text):
            i += 1
            out += "\\" + text[i] if text[i] in "%_\\" else text[i]
        else:
            out += "\\\\" if c == "\\" else c
        i += 1
    return out


def name(text: str) -> str:
    return f"`{text.replace('`', '``')}`"


@dataclass
class Sql:
    """Text of an expression and what its surroundings must know of it."""

    text: str
    boolean: bool = False
    aggregate: bool = False
    window: bool = False
    column: str = ""  # the name, if it is a column alone
    constant: bool = False

    def joined(self, text: str, *others: Sql, boolean: bool = False) -> Sql:
        every = (self, *others)
        return Sql(text, boolean, any(x.aggregate for x in every), any(x.window for x in every), "", all(x.constant for x in every))

    @property
    def number(self) -> str:
        return f"cast({self.text} AS int)" if self.boolean else self.text

    @property
    def condition(self) -> str:
        return self.text if self.boolean else conditional.truth(self.text)


@dataclass
class Item:
    """Of a select list."""

    sql: Sql
    alias: str = ""


@dataclass
class Scope:
    """Tables that a statement names, and how they are to be read."""

    table: Callable[[str, str | None], str] = lambda t, as_of: name(t)
    args: list = field(default_factory=list)
    recursive: Callable[..., str] | None = None


class Translator:
    def __init__(self, sql: str, scope: Scope | None = None):
        self.tokens, self.at, self.depth, self.params = tokens(sql), 0, 0, 0
        self.scope = scope or Scope()
        self.ctes: list[set[str]] = [set()]

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def op(self, *texts: str) -> str:
        if self.now.kind == "op" and self.now.text in texts:
            return self.take().text
        return ""

    def word(self, *words: str) -> str:
        """Take the next words if they are these."""
        for i, w in enumerate(words):
            if self.ahead(i).upper != w:
                return ""
        self.at += len(words)
        return words[-1]

    def any_word(self, *words: str) -> str:
        return self.take().upper if self.now.upper in words else ""

    def need(self, *texts: str) -> str:
        found = self.op(*texts) or self.any_word(*texts)
        if not found:
            raise DialectError(f"expected {' or '.join(texts)}, found {self.now.text or 'the end'!r}")
        return found

    def identifier(self) -> str:
        if self.now.kind not in ("word", "name"):
            raise DialectError(f"expected a name, found {self.now.text!r}")
        return self.take().text

    def names(self) -> list[str]:
        self.need("(")
        out = [self.identifier()]
        while self.op(","):
            out.append(self.identifier())
        self.need(")")
        return out

    def finish(self) -> None:
        self.op(";")
        if self.now.kind != "end":
            raise DialectError(f"unexpected {self.now.text!r}")

    # queries

    def query(self) -> str:
        """[WITH ...] SELECT ... with set operations."""
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise DialectError("nested too deeply")
        head = self.with_clause() if self.now.upper == "WITH" else ""
        out = head + self.set_operations()
        if head:
            self.ctes.pop()
        self.depth -= 1
        return out

    def with_clause(self) -> str:
        self.word("WITH")
        recursive = bool(self.word("RECURSIVE"))
        self.ctes.append(set(self.ctes[-1]))
        parts, has_recursion = [], False
        while True:
            cte = self.identifier()
            columns = self.names() if self.now.text == "(" else []
            self.need("AS")
            self.need("(")
            start = self.at
            self.ctes[-1].add(cte.lower())
            body = self.set_operations() if self.now.upper != "WITH" else self.query()
            arms, before = getattr(self, "last_arms", []), getattr(self, "before_last", "")
            self.need(")")
            refers = any(t.text.lower() == cte.lower() and t.kind in ("word", "name") for t in self.tokens[start : self.at])
            if recursive and refers and len(arms) > 1 and arms[-1][0] == "UNION" and self.scope.recursive:
                body = f"SELECT * FROM {name(self.scope.recursive(cte, columns, before, arms[-1][1], parts))}"
                refers = False
            has_recursion |= recursive and refers
            parts.append(f"{name(cte)}{'(' + ', '.join(map(name, columns)) + ')' if columns else ''} AS ({body})")
            if not self.op(","):
                break
        if self.now.upper not in ("SELECT",):
            raise DialectError("only SELECT may follow WITH")
        return f"WITH {'RECURSIVE ' if has_recursion else ''}{', '.join(parts)} "

    def set_operations(self) -> str:
        """From left to right, all of equal rank; ORDER BY and LIMIT of the last arm are those of the whole."""
        out, tail, _ = self.select()
        arms, before = [("", out)], out
        while self.now.upper in ("UNION", "INTERSECT", "EXCEPT"):
            how = self.take().upper + (" ALL" if self.word("ALL") else "")
            if self.now.upper != "SELECT":
                raise DialectError(f"expected SELECT after {how}")
            right, new_tail, _ = self.select()
            left = f"{out}{tail}" if not tail else f"SELECT * FROM ({out}{tail})"
            before, out = left, f"({left}) {how} ({right})" if len(arms) > 1 else f"{left} {how} {right}"
            arms.append((how, right))
            tail = new_tail
        self.last_arms, self.before_last = arms, before
        return out + tail

    def select(self) -> tuple[str, str, list[Item]]:
        """One SELECT: its text, its ORDER BY and LIMIT, its items."""
        self.need("SELECT")
        distinct = bool(self.any_word("DISTINCT"))
        self.any_word("ALL")
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
            if len(items) > MOST_LIST:
                raise DialectError("select list too long")
        source = where = having = head = ""
        placed = False
        groups: list[Sql] = []
        if self.word("FROM"):
            source = self.tables()
            head = self.head
            as_of = self.as_of()
            if as_of is not None:
                raise DialectError("AS OF belongs behind a table")
        if self.word("WHERE"):
            where = self.expression().condition
        having_sql = None
        if self.word("GROUP", "BY"):
            groups.append(self.expression())
            while self.op(","):
                groups.append(self.expression())
        if self.word("HAVING"):
            having_sql = self.expression()
        orders = self.order_items() if self.word("ORDER", "BY") else []
        limit = offset = None
        while self.now.upper in ("LIMIT", "OFFSET"):
            if self.word("LIMIT"):
                limit = None if self.word("ALL") else self.expression().text
            else:
                self.word("OFFSET")
                offset = self.expression().text
        if self.word("FOR"):  # locks mean nothing here
            self.any_word("UPDATE", "SHARE")
            while self.any_word("NOWAIT", "SKIP", "LOCKED", "OF"):
                pass
        aliases = {i.alias.lower(): i for i in items if i.alias}
        grouped = bool(groups) or any(i.sql.aggregate for i in items) or bool(having_sql and having_sql.aggregate)
        keys = set()
        texts = []
        for g in groups:
            if g.text.isdigit() and 1 <= int(g.text) <= len(items):
                g = items[int(g.text) - 1].sql
            elif g.column and g.column.lower() in aliases and not aliases[g.column.lower()].sql.aggregate and "." not in g.text:
                target = aliases[g.column.lower()].sql
                g = g if target.column.lower() == g.column.lower() else target
            texts.append(g.text)
            keys |= {g.text.lower(), g.column.lower()} - {""}

        def plain(s: Sql) -> str:
            """What an ungrouped expression gives in a group: its value in the first row, as the first table's files have them."""
            nonlocal placed
            bare = not (s.aggregate or s.window or s.constant or s.text.lower() in keys or (s.column and s.column.lower() in keys))
            if not grouped or not bare or s.text == "*" or s.text.endswith(".*"):
                return s.text
            placed = True
            return f"min_by({s.text}, coalesce(_place, {2**63 - 1}L))" if source else f"first({s.text})"

        hidden = [o for o, _ in orders if not (o.text.isdigit() or o.column.lower() in aliases or any(o.text.lower() == i.sql.text.lower() for i in items))]
        if distinct and hidden and not grouped and not any(i.sql.window or i.sql.text.endswith("*") for i in items):
            # rows are sorted by what is not shown, and the first of equal ones stays
            distinct, grouped, texts = False, True, [i.sql.text for i in items]
            keys = {x.lower() for x in texts} | {i.sql.column.lower() for i in items if i.sql.column}
            orders = [(o if o not in hidden else o.joined(f"{'max' if 'DESC' in d else 'min'}({o.text})"), d) for o, d in orders]
            for o, _ in orders:
                o.aggregate = o.aggregate or o.text.startswith(("max(", "min("))
        # Spark sorts by no window or subquery that is not selected: such orders become columns, which an outer SELECT leaves out
        wrap = not distinct and any(o.window or "(SELECT " in o.text for o in hidden)
        shown = [plain(i.sql) + (f" AS {name(i.alias)}" if i.alias else f" AS {name(i.sql.column)}" if plain(i.sql) != i.sql.text and i.sql.column else "") for i in items]
        if orders:
            parts = []
            for sql, direction in orders:
                by_place = sql.text.isdigit() or (sql.column and sql.column.lower() in aliases)
                if wrap and sql in hidden:
                    shown.append(f"{plain(sql)} AS `_order{len(shown)}`")
                    parts.append(f"`_order{len(shown) - 1}`{direction}")
                    continue
                parts.append((sql.text if by_place else plain(sql)) + direction)
        if placed and source:
            table, alias = re.fullmatch(r"(.+?)((?: AS `(?:[^`]|``)+`)?)", head, re.DOTALL).groups()
            source = f"(SELECT *, monotonically_increasing_id() AS _place FROM {table}){alias}" + source[len(head) :]
        out = f"SELECT {'DISTINCT ' if distinct else ''}{', '.join(shown)}"
        out += f" FROM {source}" if source else ""
        out += f" WHERE {where}" if where else ""
        out += f" GROUP BY {', '.join(texts)}" if texts else ""
        if having_sql:
            having = having_sql.condition
            out += f" HAVING {having}" if grouped else (f" AND {having}" if where else f" WHERE {having}")
        if wrap:
            out = f"SELECT * EXCEPT ({', '.join(f'`_order{n}`' for n in range(len(items), len(shown)))}) FROM ({out})"
        tail = ""
        if orders:
            tail += f" ORDER BY {', '.join(parts)}"
        tail += f" LIMIT {limit}" if limit is not None else ""
        tail += f" OFFSET {offset}" if offset is not None else ""
        return out, tail, items

    def order_items(self) -> list[tuple[Sql, str]]:
        out = []
        while True:
            sql = self.expression()
            down = self.any_word("ASC", "DESC") == "DESC"
            nulls = self.any_word("FIRST", "LAST") if self.word("NULLS") else ("FIRST" if down else "LAST")
            out.append((sql, f" {'DESC' if down else 'ASC'} NULLS {nulls}"))
            if not self.op(","):
                return out

    def item(self) -> Item:
        if self.op("*"):
            return Item(Sql("*"))
        if self.now.kind in ("word", "name") and self.ahead().text == "." and self.ahead(2).text == "*":
            table = self.identifier()
            self.at += 2
            return Item(Sql(f"{name(table)}.*"))
        sql = self.expression()
        if self.word("AS"):
            return Item(sql, self.take().text if self.now.kind == "string" else self.identifier())
        if self.now.kind == "name" or (self.now.kind == "word" and self.now.upper not in CLAUSES):
            return Item(sql, self.identifier())
        return Item(sql)

    # tables

    def tables(self) -> str:
        out = head = self.table()
        while True:
            if self.op(","):
                out += f" CROSS JOIN {self.table()}"
                continue
            start = self.at
            natural = bool(self.word("NATURAL"))
            kind = self.any_word("INNER", "LEFT", "RIGHT", "FULL", "CROSS")
            if kind in ("LEFT", "RIGHT", "FULL"):
                self.word("OUTER")
            if not self.word("JOIN"):
                self.at, self.head = start, head
                return out
            right = self.table()
            kind = "INNER" if kind in ("", "CROSS") and self.now.upper in ("ON", "USING") else kind or ("INNER" if natural else "CROSS")
            out += f" {'NATURAL ' if natural else ''}{kind} JOIN {right}"
            if self.word("ON"):
                out += f" ON {self.expression().condition}"
            elif self.word("USING"):
                out += f" USING ({', '.join(map(name, self.names()))})"

    def table(self) -> str:
        if self.op("("):
            body = self.query()
            self.need(")")
            alias = self.alias()
            return f"({body}){' AS ' + name(alias) if alias else ''}"
        table = self.identifier()
        if self.op("."):
            table = self.identifier()
        as_of = self.as_of()
        alias = self.alias() or table
        if as_of is None:
            as_of = self.as_of()
        while self.any_word("USE", "FORCE", "IGNORE"):  # hints mean nothing here
            self.any_word("INDEX", "KEY")
            self.names()
        if self.word("INDEXED", "BY"):
            self.identifier()
        self.word("NOT", "INDEXED")
        if table.lower() in self.ctes[-1]:
            return f"{name(table)} AS {name(alias)}"
        return f"{self.scope.table(table, as_of)} AS {name(alias)}"

    def as_of(self) -> str | None:
        if self.now.upper == "AS" and self.ahead().upper == "OF":
            self.at += 2
            self.word("SYSTEM", "TIME")
            if self.now.kind == "param":
                self.take()
                self.params += 1
                return str(self.scope.args[self.params - 1])
            if self.any_word("CURRENT_TIMESTAMP", "NOW"):
                if self.op("("):
                    self.need(")")
                return "now"
            if self.now.kind not in ("string", "number"):
                raise DialectError("AS OF needs a time")
            return self.take().text
        return None

    def alias(self) -> str:
        if self.now.upper == "AS" and self.ahead().upper != "OF":
            self.take()
            return self.identifier()
        if self.now.kind == "name" or (self.now.kind == "word" and self.now.upper not in CLAUSES):
            return self.identifier()
        return ""

    # expressions, loosest first

    def expression(self) -> Sql:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise DialectError("nested too deeply")
        left = self.conjunction()
        while self.word("OR"):
            right = self.conjunction()
            left = left.joined(f"({left.condition} OR {right.condition})", right, boolean=True)
        self.depth -= 1
        return left

    def conjunction(self) -> Sql:
        left = self.negation()
        while self.word("AND"):
            right = self.negation()
            left = left.joined(f"({left.condition} AND {right.condition})", right, boolean=True)
        return left

    def negation(self) -> Sql:
        if self.now.upper == "NOT" and self.ahead().upper != "EXISTS":
            self.take()
            inner = self.negation()
            return inner.joined(f"(NOT {inner.condition})", boolean=True)
        return self.comparison()

    def comparison(self) -> Sql:
        left = self.arithmetic(0)
        while True:
            how = self.op(*_COMPARE)
            if how:
                right = self.arithmetic(0)
                # a truth value beside another one stays; beside a number it counts as 1 or 0
                a, b = (left.text, right.text) if left.boolean == right.boolean else (left.number, right.number)
                left = left.joined(f"({a} {_COMPARE[how]} {b})", right, boolean=True)
                continue
            negated = self.now.upper == "NOT" and self.ahead().upper in ("IN", "LIKE", "REGEXP", "RLIKE", "GLOB", "BETWEEN")
            kind = self.ahead().upper if negated else self.now.upper
            if kind == "IS":
                left = self.is_test(left)
                continue
            if kind == "IN" and not negated and self.ahead().upper in ("BOOLEAN", "NATURAL"):
                return left
            if kind not in ("IN", "LIKE", "REGEXP", "RLIKE", "GLOB", "BETWEEN"):
                return left
            self.at += 2 if negated else 1
            found = getattr(self, f"_{'regexp' if kind == 'RLIKE' else kind.lower()}")(left)
            left = found.joined(f"(NOT {found.text})", boolean=True) if negated else found

    def is_test(self, left: Sql) -> Sql:
        self.take()
        negated = bool(self.word("NOT"))
        if self.word("DISTINCT"):
            self.need("FROM")
            right = self.arithmetic(0)
            same = f"({left.text} <=> {right.text})"
            return left.joined(same if negated else f"(NOT {same})", right, boolean=True)
        value = self.need("NULL", "TRUE", "FALSE", "UNKNOWN")
        if value in ("NULL", "UNKNOWN"):
            return left.joined(f"({left.text} IS {'NOT ' if negated else ''}NULL)", boolean=True)
        return left.joined(f"({left.condition} IS {'NOT ' if negated else ''}{value})", boolean=True)

    def _in(self, left: Sql) -> Sql:
        self.need("(")
        if self.now.upper in ("SELECT", "WITH"):
            body = self.query()
            self.need(")")
            return left.joined(f"({left.text} IN ({body}))", Sql(""), boolean=True)
        values = self.list()
        return left.joined(f"({left.text} IN ({', '.join(v.text for v in values)}))", *values, boolean=True)

    def _like(self, left: Sql) -> Sql:
        start = self.at
        pattern = self.arithmetic(0)
        alone = self.at == start + 1 and self.tokens[start].kind == "string"
        escape = ""
        if self.word("ESCAPE"):
            if self.now.kind != "string" or len(self.now.text) != 1:
                raise DialectError("ESCAPE needs one character")
            escape = self.take().text
        if alone:
            text = literal(like_pattern(self.tokens[start].text, escape))
        else:  # without ESCAPE nothing escapes: backslashes are doubled for Spark, whose default they are
            text = f"{pattern.text} ESCAPE {literal(escape)}" if escape else f"replace({pattern.text}, '\\\\', '\\\\\\\\')"
        return left.joined(f"(cast({left.text} AS string) LIKE {text})", pattern, boolean=True)

    def _regexp(self, left: Sql) -> Sql:
        pattern = self.arithmetic(0)
        return left.joined(functions.render("REGEXP_LIKE", [left.text, pattern.text]), pattern, boolean=True)

    def _glob(self, left: Sql) -> Sql:
        pattern = self.arithmetic(0)
        return left.joined(functions.render("GLOB", [pattern.text, left.text]), pattern, boolean=True)

    def _between(self, left: Sql) -> Sql:
        low = self.arithmetic(0)
        self.need("AND")
        high = self.arithmetic(0)
        return left.joined(f"({left.text} BETWEEN {low.text} AND {high.text})", low, high, boolean=True)

    #: Binary operators, loosest first, each level from left to right.
    LEVELS = (("|",), ("&",), ("<<", ">>"), ("+", "-", "||"), ("*", "/", "%", "MOD"), ("^",))

    def arithmetic(self, level: int) -> Sql:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.arithmetic(level + 1)
        while True:
            how = self.op(*self.LEVELS[level])
            if not how and "MOD" in self.LEVELS[level] and self.now.upper == "MOD" and self.ahead().text != "(":
                how = self.take().upper
            if not how:
                return left
            right = self.arithmetic(level + 1)
            a, b = (left.text, right.text) if how == "||" else (left.number, right.number)
            if how == "||":
                text = f"concat(cast({a} AS string), cast({b} AS string))"
            elif how == "/":
                text = f"try_divide(cast({a} AS double), cast({b} AS double))"
            elif how in ("%", "MOD"):
                text = f"try_mod({a}, {b})"
            elif how in ("<<", ">>"):
                text = f"CASE WHEN cast({b} AS bigint) >= 0 THEN {'shiftleft' if how == '<<' else 'shiftright'}(cast({a} AS bigint), cast({b} AS int)) END"
                text = f"({text})"
            elif how in "&|^":
                text = f"(cast({a} AS bigint) {how} cast({b} AS bigint))"
            else:
                text = f"({a} {how} {b})"
            left = left.joined(text, right)

    def unary(self) -> Sql:
        how = self.op("-", "+", "~")
        if how:
            inner = self.unary()
            if how == "-" and inner.text.replace(".", "", 1).isdigit():
                return inner.joined(f"-{inner.text}")
            return inner.joined(f"(-({inner.text}))" if how == "-" else f"(~cast({inner.text} AS bigint))" if how == "~" else inner.text)
        out = self.primary()
        while self.word("COLLATE"):  # text compares by its bytes
            self.identifier()
        while self.now.text in ("->", "->>") and self.now.kind == "op":
            self.take()
            path = self.primary()
            out = out.joined(functions.render("JSON_EXTRACT", [out.text, path.text]), path)
        return out

    def list(self) -> list[Sql]:
        """Expressions up to the closing parenthesis."""
        out: list[Sql] = []
        if self.op(")"):
            return out
        while True:
            out.append(self.expression())
            if len(out) > MOST_LIST:
                raise DialectError("list too long")
            if not self.op(","):
                self.need(")")
                return out

    def primary(self) -> Sql:
        t = self.take()
        if t.kind == "number":
            text = str(int(t.text, 16)) if t.text[:2].lower() == "0x" else t.text
            return Sql(text + ("D" if "." in text or "e" in text.lower() else "L" if int(text) > 2**31 - 1 else ""), constant=True)
        if t.kind == "string":
            return Sql(literal(t.text), constant=True)
        if t.kind == "blob":
            return Sql(f"X'{t.text}'", constant=True)
        if t.kind == "param":
            self.params += 1
            if self.params > len(self.scope.args):
                raise DialectError("fewer arguments than placeholders")
            return Sql(value(self.scope.args[self.params - 1]), constant=True)
        if t.kind == "sysvar":
            key = t.text[2:].lower().removeprefix("session.").removeprefix("global.")
            return Sql(SYSTEM_VARIABLES.get(key, "NULL"), constant=True)
        if t.kind == "op" and t.text == "(":
            if self.now.upper in ("SELECT", "WITH"):
                body = self.query()
                self.need(")")
                return Sql(f"({body})")
            inner = self.expression()
            if self.op(","):
                rest = self.list()
                return inner.joined(f"({', '.join(x.text for x in (inner, *rest))})", *rest)
            self.need(")")
            return inner.joined(f"({inner.text})", boolean=inner.boolean)
        if t.kind == "op" and t.text == "[":
            values = []
            while not self.op("]"):
                values.append(self.expression().text)
                self.op(",")
            return Sql(f"cast(array({', '.join(values)}) AS array<double>)", constant=True)
        if t.kind == "op" and t.text == "*":
            return Sql("*")
        if t.kind == "word":
            found = self.special(t)
            if found:
                return found
        if t.kind not in ("word", "name"):
            raise DialectError(f"unexpected {t.text or 'end'!r}")
        if self.now.text == "(" and self.now.kind == "op" and t.kind == "word":
            return self.function(t.text.upper())
        path = [t.text]
        while self.now.text == "." and self.now.kind == "op":
            self.take()
            path.append(self.identifier())
        return Sql(".".join(map(name, path[-2:])), column=path[-1])

    def special(self, t: Token) -> Sql | None:
        """Words with a syntax of their own."""
        word, call = t.upper, self.now.text == "("
        if word in ("NULL", "TRUE", "FALSE") and not call:
            return Sql(word, boolean=word != "NULL", constant=True)
        if word == "CASE":
            return self.case()
        if word in ("NOT", "EXISTS"):
            if word == "NOT":
                self.need("EXISTS")
            self.need("(")
            body = self.query()
            self.need(")")
            return Sql(f"({'NOT ' if word == 'NOT' else ''}EXISTS ({body}))", boolean=True)
        if word in ("CURRENT_TIMESTAMP", "CURRENT_DATE", "CURRENT_TIME") and not call:
            return Sql(functions.render(word, []), constant=True)
        if not call:
            return None
        if word == "CAST":
            self.need("(")
            x = self.expression()
            self.need("AS")
            kind = self.identifier()
            if self.op("("):
                while not self.op(")"):
                    self.take()
            self.need(")")
            return x.joined(conditional.cast(x.text, kind), boolean=conditional.spark_type(kind) == "boolean")
        if word == "EXTRACT":
            self.need("(")
            part = self.identifier().upper()
            self.need("FROM")
            x = self.expression()
            self.need(")")
            return x.joined(functions.render(part, [x.text]))
        if word == "POSITION":
            self.need("(")
            a = self.arithmetic(0)
            self.need("IN", ",")
            b = self.expression()
            rest = [self.expression()] if self.op(",") else []
            self.need(")")
            return a.joined(functions.render("LOCATE", [x.text for x in (a, b, *rest)]), b, *rest)
        if word == "MATCH":
            return self.match_against()
        return None

    def case(self) -> Sql:
        subject = None if self.now.upper == "WHEN" else self.expression()
        out, parts = "CASE" + (f" {subject.text}" if subject else ""), [subject] if subject else []
        while self.word("WHEN"):
            test = self.expression()
            self.need("THEN")
            then = self.expression()
            out += f" WHEN {test.text if subject else test.condition} THEN {then.text}"
            parts += [test, then]
        if self.word("ELSE"):
            other = self.expression()
            out += f" ELSE {other.text}"
            parts.append(other)
        self.need("END")
        return parts[0].joined(f"({out} END)", *parts[1:])

    def match_against(self) -> Sql:
        """Every word (runs of ASCII letters and digits, lower-cased) is part of some column."""
        columns = [name(c) for c in self.names()]
        self.need("AGAINST")
        self.need("(")
        words = self.primary()
        while self.any_word("IN", "NATURAL", "BOOLEAN", "LANGUAGE", "MODE", "WITH", "QUERY", "EXPANSION"):
            pass
        self.need(")")
        held = f"exists(array({', '.join(f'lower({c})' for c in columns)}), c -> contains(c, w))"
        found = f"regexp_extract_all(lower({words.text}), '[a-z0-9]+', 0)"
        return Sql(f"(size({found}) > 0 AND forall({found}, w -> coalesce({held}, false)))", boolean=True)

    def function(self, called: str) -> Sql:
        self.need("(")
        if called in AGGREGATES or called in WINDOW_ONLY:
            return self.aggregate(called)
        args = self.list()
        text = functions.render(called, [a.text for a in args])
        boolean = called in ("REGEXP_LIKE", "REGEXP_MATCH", "GLOB", "JSON_VALID", "IS_TRUE", "IS_FALSE", "IS_UNKNOWN")
        if called in ("IF", "IIF"):
            text = functions.render(called, [args[0].condition, *(a.text for a in args[1:])])
        first, *rest = args or [Sql("", constant=called != "RANDOM")]
        return first.joined(text, *rest, boolean=boolean)

    def aggregate(self, called: str) -> Sql:
        distinct = bool(self.any_word("DISTINCT"))
        args = []
        how: dict = {}
        while not self.op(")"):
            if self.word("ORDER", "BY"):
                how["order"] = ", ".join(s.text + d for s, d in self.order_items())
            elif self.word("SEPARATOR"):
                how["separator"] = self.primary().text
            else:
                args.append(self.expression())
                self.op(",")
        if called in ("MIN", "MAX") and len(args) > 1:  # scalar: NULLs are skipped
            return args[0].joined(f"{'least' if called == 'MIN' else 'greatest'}({', '.join(a.text for a in args)})", *args[1:])
        test = None
        if self.now.upper == "FILTER":
            self.take()
            self.need("(")
            self.need("WHERE")
            test = self.expression().condition
            self.need(")")
        if self.word("OVER"):
            return self.windowed(called, args, distinct, test)
        if called in WINDOW_ONLY:
            raise DialectError(f"{called} needs OVER")
        if called == "GROUP_CONCAT" and len(args) > 1:
            how.setdefault("separator", args.pop().text)
        clause = f" FILTER (WHERE {test})" if test else ""
        nested = called in ("JSON_ARRAYAGG", "JSON_OBJECTAGG")  # the aggregate is inside
        text = AGGREGATES[called]([a.text for a in args] or ["*"], distinct, **how, **({"where": clause} if nested else {}))
        return Sql(text + ("" if nested else clause), aggregate=True)

    def windowed(self, called: str, args: list[Sql], distinct: bool, test: str | None) -> Sql:
        """Windows. FILTER becomes CASE, since Spark has no filtered window aggregates; DISTINCT has no effect."""
        self.need("(")
        parts = []
        if self.word("PARTITION", "BY"):
            keys = [self.expression().text]
            while self.op(","):
                keys.append(self.expression().text)
            parts.append(f"PARTITION BY {', '.join(keys)}")
        ordered = bool(self.word("ORDER", "BY"))
        if ordered:
            parts.append("ORDER BY " + ", ".join(s.text + d for s, d in self.order_items()))
        frame = self.frame()
        self.need(")")
        x = [a.text for a in args]
        whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        if called in WINDOW_ONLY:
            if called == "FIRST_VALUE" and ordered:
                frame = whole
            elif called in ("LAST_VALUE", "NTH_VALUE"):
                frame = whole if frame or not ordered else ""
            else:
                frame = ""
            text = f"{called.lower()}({', '.join(x)})"
            if called in ("ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "PERCENT_RANK", "CUME_DIST", "LAG", "LEAD") and not ordered:
                parts.append("ORDER BY 1")
        else:
            if test:
                x = [f"CASE WHEN {test} THEN {a if a != '*' else 1} END" for a in x or ["*"]]
            text = AGGREGATES[called](x or ["*"], False)
        over = " ".join([*parts, frame]).strip()
        return Sql(f"{text} OVER ({over})", window=True)

    def frame(self) -> str:
        """RANGE with offsets counts rows, as ROWS does; RANGE of peers stays."""
        kind = self.any_word("ROWS", "RANGE")
        if not kind:
            return ""
        bounds = []
        between = bool(self.word("BETWEEN"))
        while True:
            if self.word("UNBOUNDED"):
                bounds.append("UNBOUNDED " + self.need("PRECEDING", "FOLLOWING"))
            elif self.word("CURRENT"):
                self.need("ROW")
                bounds.append("CURRENT ROW")
            else:
                kind = "ROWS"
                bounds.append(f"{self.arithmetic(0).text} {self.need('PRECEDING', 'FOLLOWING')}")
            if not (between and len(bounds) == 1):
                break
            self.need("AND")
        return f"{kind} BETWEEN {bounds[0]} AND {bounds[1] if between else 'CURRENT ROW'}"


def value(x) -> str:
    """A Python value as a literal."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "TRUE" if x else "FALSE"
    if isinstance(x, (bytes, bytearray)):
        return f"X'{bytes(x).hex()}'"
    if isinstance(x, int):
        return f"{x}L" if abs(x) > 2**31 - 1 else str(x)
    if isinstance(x, float):
        return f"double('{x}')"
    if isinstance(x, (list, tuple)):
        return f"cast(array({', '.join(value(v) for v in x)}) AS array<double>)"
    return literal(str(x))


def to_spark(sql: str, scope: Scope | None = None) -> str:
    """Spark SQL of one query of the dialect."""
    t = Translator(sql, scope)
    if t.now.upper not in ("SELECT", "WITH"):
        raise DialectError(f"not a query: {t.now.text!r}")
    out = t.query()
    t.finish()
    return out
