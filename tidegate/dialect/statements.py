"""Statements of the dialect as plain records; their queries and expressions are already Spark SQL."""

from __future__ import annotations

from types import SimpleNamespace as Record

from tidegate.dialect.lexer import DialectError
from tidegate.dialect.translate import Scope, Sql, Translator, name

_ACTIONS = ("CASCADE", "RESTRICT")


class StatementReader(Translator):
    """Reads one statement."""

    def __init__(self, sql: str, scope: Scope | None = None):
        super().__init__(sql, scope)
        self.sql = sql

    def statement(self) -> Record:
        word = self.now.upper
        if word in ("SELECT", "WITH"):
            out = Record(kind="query", sql=self.query())
        else:
            reader = getattr(self, f"read_{word.lower()}", None) if word else None
            if not reader:
                raise DialectError(f"unexpected {self.now.text!r}" if self.now.kind != "end" else "empty statement")
            self.take()
            out = reader()
        self.finish()
        return out

    # changes of rows

    def read_insert(self) -> Record:
        conflict = self.any_word("REPLACE", "IGNORE", "ABORT", "ROLLBACK", "FAIL") if self.word("OR") else self.any_word("IGNORE")
        return self.inserted(conflict or "ABORT")

    def read_replace(self) -> Record:
        return self.inserted("REPLACE")

    def inserted(self, conflict: str) -> Record:
        self.need("INTO")
        table = self.identifier()
        alias = self.alias() if self.now.upper == "AS" else ""
        columns = self.names() if self.now.text == "(" else []
        out = Record(kind="insert", table=table, alias=alias, columns=columns, conflict=conflict, rows=None, sql=None, on=None, sets=[], where="", returning=None)
        if self.word("DEFAULT", "VALUES"):
            out.rows = [[]]
        elif self.word("VALUES"):
            out.rows = []
            while True:
                self.need("(")
                row = []
                while True:
                    row.append(None if self.word("DEFAULT") else self.expression().text)
                    if not self.op(","):
                        break
                self.need(")")
                out.rows.append(row)
                if not self.op(","):
                    break
        else:
            out.sql = self.query()
        if self.word("ON", "CONFLICT"):
            out.on = self.names() if self.now.text == "(" else []
            self.need("DO")
            if self.need("NOTHING", "UPDATE") == "NOTHING":
                out.conflict = "IGNORE"
            else:
                self.need("SET")
                out.conflict, out.sets = "UPDATE", self.assignments()
                out.where = self.expression().condition if self.word("WHERE") else ""
        elif self.word("ON", "DUPLICATE", "KEY", "UPDATE"):
            out.conflict, out.on, out.sets = "UPDATE", [], self.assignments()
        out.returning = self.returning()
        return out

    def function(self, called: str) -> Sql:
        if called == "VALUES":  # the row that could not be inserted
            self.need("(")
            column = self.identifier()
            self.need(")")
            return Sql(f"`excluded`.{name(column)}")
        return super().function(called)

    def assignments(self) -> list[tuple[str, str]]:
        out = []
        while True:
            if self.op("("):
                self.at -= 1
                columns = self.names()
                self.need("=")
                self.need("(")
                values = self.list()
                if len(values) != len(columns):
                    raise DialectError("as many values as columns are needed")
                out += [(c, v.text) for c, v in zip(columns, values)]
            else:
                column = self.identifier()
                if self.op("."):
                    column = self.identifier()
                self.need("=")
                out.append((column, self.expression().text))
            if not self.op(","):
                return out

    def returning(self) -> str | None:
        if not self.word("RETURNING"):
            return None
        items = [self.item()]
        while self.op(","):
            items.append(self.item())
        return ", ".join(i.sql.text + (f" AS {name(i.alias)}" if i.alias else "") for i in items)

    def read_update(self) -> Record:
        table = self.identifier()
        alias = self.alias() if self.now.upper not in ("SET", "JOIN", "INNER", "LEFT") else ""
        joins = ""
        while self.now.upper in ("JOIN", "INNER", "LEFT"):
            joins += self.join_clause()
        self.need("SET")
        sets = self.assignments()
        if self.word("FROM"):
            joins += f" CROSS JOIN {self.tables()}"
        where = self.expression().condition if self.word("WHERE") else ""
        return Record(kind="update", table=table, alias=alias, sets=sets, joins=joins, where=where, returning=self.returning())

    def join_clause(self) -> str:
        kind = self.any_word("INNER", "LEFT") or "INNER"
        self.word("OUTER")
        self.need("JOIN")
        right = self.table()
        self.need("ON")
        return f" {kind} JOIN {right} ON {self.expression().condition}"

    def read_delete(self) -> Record:
        target = self.identifier() if self.now.upper != "FROM" else ""
        self.need("FROM")
        table, joins = self.identifier(), ""
        alias = self.alias() if self.now.upper not in ("USING", "WHERE", "RETURNING") else ""
        while self.now.upper in ("JOIN", "INNER", "LEFT"):
            joins += self.join_clause()
        if self.word("USING"):
            joins += f" CROSS JOIN {self.tables()}"
        where = self.expression().condition if self.word("WHERE") else ""
        if target and target.lower() not in (table.lower(), alias.lower()):
            raise DialectError(f"{target} is not the table that rows are deleted from")
        return Record(kind="delete", table=table, alias=alias, joins=joins, where=where, returning=self.returning())

    def read_truncate(self) -> Record:
        self.word("TABLE")
        return Record(kind="truncate", table=self.identifier())

    # definitions

    def exists_clause(self, negated: bool) -> bool:
        return bool(self.word("IF", "NOT", "EXISTS") if negated else self.word("IF", "EXISTS"))

    def read_create(self) -> Record:
        replace = bool(self.word("OR", "REPLACE"))
        temporary = bool(self.any_word("TEMP", "TEMPORARY"))
        unique = bool(self.word("UNIQUE"))
        what = self.need("TABLE", "VIEW", "MATERIALIZED", "INDEX", "FULLTEXT", "VECTOR", "FOREIGN", "COLLECTION", "TRIGGER", "PROCEDURE", "POLICY")
        if what == "MATERIALIZED":
            self.need("VIEW")
        if what in ("FULLTEXT", "VECTOR"):
            self.need("INDEX")
        if what == "FOREIGN":
            self.need("TABLE")
        quiet = self.exists_clause(True)
        out = Record(kind=f"create_{what.lower()}", name=self.identifier(), quiet=quiet, replace=replace, temporary=temporary, unique=unique)
        getattr(self, f"created_{what.lower()}")(out)
        return out

    def created_table(self, out: Record) -> None:
        out.columns, out.constraints, out.partition, out.sql = [], [], None, None
        if self.now.text == "(":
            self.take()
            while True:
                if self.now.upper in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                    out.constraints.append(self.table_constraint())
                else:
                    out.columns.append(self.column(out))
                if not self.op(","):
                    break
            self.need(")")
        while self.now.upper in ("ENGINE", "CHARSET", "COLLATE", "DEFAULT", "AUTO_INCREMENT", "COMMENT"):
            while self.now.upper in ("DEFAULT", "CHARACTER", "SET") or self.now.upper in ("ENGINE", "CHARSET", "COLLATE", "AUTO_INCREMENT", "COMMENT"):
                self.take()
            self.op("=")
            self.take()
        if self.word("PARTITION", "BY"):
            out.partition = self.partition()
        if self.word("AS"):
            out.sql = self.query()

    def column(self, out: Record) -> Record:
        column = Record(name=self.identifier(), type="TEXT", not_null=False, default=None, auto=False, dims=0)
        if self.now.kind == "word" and self.now.upper not in ("PRIMARY", "NOT", "NULL", "UNIQUE", "DEFAULT", "CHECK", "REFERENCES", "AUTO_INCREMENT", "AUTOINCREMENT", "COLLATE"):
            column.type = self.take().upper
            if self.op("("):
                if column.type == "VECTOR":
                    column.dims = int(self.now.text)
                while not self.op(")"):
                    self.take()
        while True:
            if self.word("NOT", "NULL"):
                column.not_null = True
            elif self.word("NULL"):
                pass
            elif self.word("PRIMARY", "KEY"):
                out.constraints.append(Record(kind="primary", name="", columns=[column.name]))
            elif self.any_word("AUTO_INCREMENT", "AUTOINCREMENT"):
                column.auto = True
            elif self.word("UNIQUE"):
                self.word("KEY")
                out.constraints.append(Record(kind="unique", name="", columns=[column.name]))
            elif self.word("DEFAULT"):
                column.default = self.arithmetic(0).text
            elif self.word("CHECK"):
                self.need("(")
                out.constraints.append(Record(kind="check", name="", sql=self.expression().condition))
                self.need(")")
            elif self.word("COLLATE"):
                self.take()
            elif self.now.upper == "REFERENCES":
                out.constraints.append(self.references([column.name], ""))
            else:
                return column

    def table_constraint(self) -> Record:
        label = self.identifier() if self.word("CONSTRAINT") else ""
        if self.word("PRIMARY", "KEY"):
            return Record(kind="primary", name=label, columns=self.names())
        if self.word("UNIQUE"):
            self.any_word("KEY", "INDEX")
            return Record(kind="unique", name=label, columns=self.names())
        if self.word("CHECK"):
            self.need("(")
            sql = self.expression().condition
            self.need(")")
            return Record(kind="check", name=label, sql=sql)
        self.need("FOREIGN")
        self.need("KEY")
        return self.references(self.names(), label)

    def references(self, columns: list[str], label: str) -> Record:
        self.need("REFERENCES")
        out = Record(kind="foreign", name=label, columns=columns, table=self.identifier(), target=self.names() if self.now.text == "(" else [], delete="NO ACTION", update="NO ACTION")
        while self.word("ON"):
            event = self.need("DELETE", "UPDATE").lower()
            if self.word("SET"):
                action = "SET " + self.need("NULL", "DEFAULT")
            elif self.word("NO", "ACTION"):
                action = "NO ACTION"
            else:
                action = self.need(*_ACTIONS)
            setattr(out, event, action)
        return out

    def partition(self) -> Record:
        how = self.need("RANGE", "HASH", "LIST", "KEY")
        self.need("(")
        column = self.identifier()
        self.need(")")
        out = Record(how=how, column=column, n=0, bounds=[])
        if self.word("PARTITIONS"):
            out.n = int(self.take().text)
        if self.op("("):
            while True:
                self.need("PARTITION")
                part = self.identifier()
                bound = None
                if self.word("VALUES"):
                    self.need("LESS")
                    self.need("THAN")
                    paren = self.op("(")
                    bound = None if self.any_word("MAXVALUE") else int(self.arithmetic(0).text)
                    if paren:
                        self.need(")")
                out.bounds.append((part, bound))
                if not self.op(","):
                    break
            self.need(")")
            out.n = out.n or len(out.bounds)
        return out

    def created_view(self, out: Record) -> None:
        out.columns = self.names() if self.now.text == "(" else []
        self.need("AS")
        start = self.at
        out.sql = self.query()
        out.tokens = self.tokens[start : self.at]

    created_materialized = created_view

    def created_index(self, out: Record) -> None:
        self.need("ON")
        out.table = self.identifier()
        out.method = self.identifier() if self.word("USING") else ""
        out.columns = self.names()
        out.where = self.expression().condition if self.word("WHERE") else ""

    created_fulltext = created_index
    created_vector = created_index

    def created_foreign(self, out: Record) -> None:
        holder = Record(constraints=[])
        self.need("(")
        out.columns = [self.column(holder)]
        while self.op(","):
            out.columns.append(self.column(holder))
        self.need(")")
        self.need("WRAPPER")
        out.wrapper = self.take().text
        out.options = {}
        if self.word("OPTIONS"):
            self.need("(")
            while True:
                key = self.take().text
                self.op("=")
                out.options[key] = self.take().text
                if not self.op(","):
                    break
            self.need(")")

    def created_collection(self, out: Record) -> None:
        pass

    def created_trigger(self, out: Record) -> None:
        out.when = self.need("BEFORE", "AFTER", "INSTEAD")
        if out.when == "INSTEAD":
            self.need("OF")
        out.event = self.need("INSERT", "UPDATE", "DELETE")
        self.need("ON")
        out.table = self.identifier()
        if self.word("FOR"):
            self.need("EACH")
            self.need("ROW")
        out.test = None
        if self.word("WHEN"):
            paren = self.now.text == "("
            start = self.at
            self.expression()
            out.test = self.tokens[start : self.at]
            if not paren and not out.test:
                raise DialectError("WHEN needs a condition")
        out.body = self.block()

    def created_procedure(self, out: Record) -> None:
        out.params, out.body = [], []
        self.need("(")
        while not self.op(")"):
            mode = self.any_word("IN", "OUT", "INOUT") or "IN"
            out.params.append((mode, self.identifier()))
            if self.now.kind == "word" and self.now.text not in (",", ")"):
                self.take()
                if self.op("("):
                    while not self.op(")"):
                        self.take()
            self.op(",")
        out.body = self.block()

    def block(self) -> list[list]:
        """BEGIN statement; ... END: the statements' tokens."""
        self.need("BEGIN")
        out, statement, depth = [], [], 0
        while True:
            if self.now.kind == "end":
                raise DialectError("END is missing")
            if self.now.upper == "CASE":
                depth += 1
            if self.now.upper == "END":
                if not depth:
                    self.take()
                    break
                depth -= 1
            if self.op(";"):
                out.append(statement)
                statement = []
            else:
                statement.append(self.take())
        return [s for s in [*out, statement] if s]

    def created_policy(self, out: Record) -> None:
        self.need("ON")
        out.table = self.identifier()
        out.restrictive = self.need("PERMISSIVE", "RESTRICTIVE") == "RESTRICTIVE" if self.word("AS") else False
        out.operation = self.need("ALL", "SELECT", "INSERT", "UPDATE", "DELETE") if self.word("FOR") else "ALL"
        out.roles = []
        if self.word("TO"):
            out.roles.append(self.identifier())
            while self.op(","):
                out.roles.append(self.identifier())
        out.using = out.check = ""
        if self.word("USING"):
            self.need("(")
            out.using = self.expression().condition
            self.need(")")
        if self.word("WITH", "CHECK"):
            self.need("(")
            out.check = self.expression().condition
            self.need(")")

    def read_drop(self) -> Record:
        what = self.need("TABLE", "VIEW", "MATERIALIZED", "INDEX", "COLLECTION", "TRIGGER", "PROCEDURE", "POLICY")
        if what == "MATERIALIZED":
            self.need("VIEW")
        quiet = self.exists_clause(False)
        out = Record(kind=f"drop_{what.lower()}", name=self.identifier(), quiet=quiet, table="")
        if self.word("ON"):
            out.table = self.identifier()
        self.any_word(*_ACTIONS)
        return out

    def read_alter(self) -> Record:
        self.need("TABLE")
        out = Record(kind="alter", table=self.identifier(), action="")
        holder = Record(constraints=[])
        if self.any_word("ENABLE", "DISABLE"):
            out.action = "enable_rls" if self.tokens[self.at - 1].upper == "ENABLE" else "disable_rls"
            for w in ("ROW", "LEVEL", "SECURITY"):
                self.need(w)
        elif self.word("ADD"):
            if self.now.upper in ("CONSTRAINT", "PRIMARY", "UNIQUE", "CHECK", "FOREIGN"):
                out.action, out.constraint = "add_constraint", self.table_constraint()
            else:
                self.word("COLUMN")
                out.action, out.column = "add_column", self.column(holder)
                out.constraints = holder.constraints
        elif self.word("DROP"):
            if self.word("CONSTRAINT"):
                out.action, out.name = "drop_constraint", self.identifier()
            else:
                self.word("COLUMN")
                out.action, out.name = "drop_column", self.identifier()
        else:
            self.need("RENAME")
            if self.word("TO"):
                out.action, out.to = "rename", self.identifier()
            else:
                self.word("COLUMN")
                out.action, out.name = "rename_column", self.identifier()
                self.need("TO")
                out.to = self.identifier()
        return out

    # the rest

    def read_call(self) -> Record:
        out = Record(kind="call", name=self.identifier(), args=[])
        if self.op("("):
            out.args = [a.text for a in self.list()]
        return out

    def read_begin(self) -> Record:
        self.any_word("TRANSACTION", "WORK")
        return Record(kind="begin")

    def read_start(self) -> Record:
        self.need("TRANSACTION")
        return Record(kind="begin")

    def read_commit(self) -> Record:
        self.any_word("TRANSACTION", "WORK")
        return Record(kind="commit")

    def read_rollback(self) -> Record:
        self.any_word("TRANSACTION", "WORK")
        if self.word("TO"):
            self.word("SAVEPOINT")
            return Record(kind="rollback", name=self.identifier())
        return Record(kind="rollback", name="")

    def read_savepoint(self) -> Record:
        return Record(kind="savepoint", name=self.identifier())

    def read_release(self) -> Record:
        self.word("SAVEPOINT")
        return Record(kind="release", name=self.identifier())

    def read_refresh(self) -> Record:
        self.need("MATERIALIZED")
        self.need("VIEW")
        return Record(kind="refresh", name=self.identifier())

    def read_vacuum(self) -> Record:
        return Record(kind="vacuum", table=self.identifier() if self.now.kind in ("word", "name") else "")

    def read_analyze(self) -> Record:
        self.word("TABLE")
        return Record(kind="analyze", table=self.identifier() if self.now.kind in ("word", "name") else "")

    def read_show(self) -> Record:
        what = self.take().upper
        if what == "CREATE":
            self.need("TABLE")
            return Record(kind="show_create", table=self.identifier())
        if what in ("COLUMNS", "INDEX", "INDEXES", "KEYS"):
            self.need("FROM", "IN")
            return Record(kind="describe" if what == "COLUMNS" else "show_index", table=self.identifier())
        if what in ("TABLES", "DATABASES"):
            return Record(kind=f"show_{what.lower()}")
        if what in ("STATUS", "VARIABLES", "WARNINGS", "ERRORS"):
            self.at = len(self.tokens) - 1
            return Record(kind="show_tables")
        raise DialectError(f"SHOW {what} is not known")

    def read_describe(self) -> Record:
        return Record(kind="describe", table=self.identifier())

    read_desc = read_describe

    def read_use(self) -> Record:
        return Record(kind="nothing", name=self.identifier())

    def read_set(self) -> Record:
        words = []
        while self.now.kind != "end" and self.now.text not in ("=", ";"):
            words.append(self.take().text)
        text = self.expression().text if self.op("=") else ""
        return Record(kind="set", name=" ".join(words), value=text)

    def read_explain(self) -> Record:
        inner = self.statement_inside()
        return Record(kind="explain", inner=inner)

    def statement_inside(self) -> Record:
        if self.now.upper in ("SELECT", "WITH"):
            return Record(kind="query", sql=self.query())
        reader = getattr(self, f"read_{self.now.upper.lower()}", None)
        if not reader:
            raise DialectError(f"EXPLAIN of {self.now.text!r}")
        self.take()
        return reader()
