"""The engine: SQL statements of the dialect over a Spark session."""

from __future__ import annotations

import copy
import importlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import replace
from itertools import accumulate, groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import library, types
from sedge.functions.scalars import Sql, text
from sedge.operators import recursion, routines, spatial
from sedge.plans.compiler import Compiler, From, Scope, children, kind_of, name
from sedge.plans.lexer import DialectError
from sedge.plans.nodes import Func, Lit, Query, Select, Source, Statement, TypeName
from sedge.plans.parser import parse, parse_expr
from sedge.sources.store import Column, Store, Table, same_file

RIGHTS = {"SELECT", "INSERT", "UPDATE", "DELETE", "ALL"}


class ConstraintError(DialectError):
    """A row breaks a constraint or doesn't fit its type."""


class Denied(DialectError):
    """The user lacks a right."""


class Sequences:
    """Counters of a session; never evaluated on executors."""

    def __init__(self):
        self.all: dict[str, list[int]] = {}  # last value or None, next, step

    def create(self, n: str, start: int, step: int) -> None:
        self.all[n.lower()] = [None, start, step]

    def allot(self, n: str, count: int) -> tuple[int, int]:
        """The first of so many values, and the step from one to the next."""
        own = self.all.setdefault(n.lower(), [None, 1, 1])
        first, step = own[1], own[2]
        if count:
            own[0], own[1] = first + step * (count - 1), first + step * count
        return first, step

    def __call__(self, what: str, args: list) -> int:
        own = self.all.setdefault(str(args[0]).lower(), [None, 1, 1])
        if what == "nextval":
            own[0] = own[1]
            own[1] += own[2]
        elif what == "setval":
            own[0], own[1] = args[1], args[1] + own[2]
        elif own[0] is None:
            raise DialectError(f"currval of {args[0]} before nextval")
        return own[0]


def _calls(x, function: str) -> bool:
    return isinstance(x, Func) and x.name == function or any(_calls(y, function) for y in children(x))


def _literal(x: Sql) -> bool:
    return x.literal is not None or x.kind == "null" or x.text.startswith("CAST(") and x.text[5:-11].isdigit() or x.text == "CAST(NULL AS BIGINT)"


def _rows(parts: list[tuple[str, list[tuple[str, Sql]]]], as_text: list[bool]) -> str:
    """One query of rows given by expressions: inline tables of literals, arrays of other expressions, and a balanced tree of unions, which the analyser walks without a deep stack."""
    names = ", ".join(name(n) for n, _ in parts[0][1])
    blocks: list[str] = []

    def kind(part) -> str:
        return "literals" if all(_literal(x) for _, x in part[1]) else "queries" if any("SELECT " in x.text for _, x in part[1]) else "expressions"

    for how, group in groupby(parts, key=kind):
        rows = [", ".join(str(text(x) if t and x.kind != "null" else x) for (_, x), t in zip(own, as_text, strict=True)) for _, own in group]
        if how == "literals":
            blocks.append(f"SELECT * FROM VALUES {', '.join(f'({r})' for r in rows)} AS _v({names})")
        elif how == "expressions" and len(rows) > 1:
            blocks += [f"SELECT * FROM (SELECT INLINE(ARRAY({', '.join(f'STRUCT({r})' for r in rows[i : i + 500])}))) AS _v({names})" for i in range(0, len(rows), 500)]
        else:
            blocks += [f"SELECT * FROM (SELECT {r}) AS _v({names})" for r in rows]
    while len(blocks) > 1:
        blocks = [f"SELECT * FROM ({' UNION ALL '.join(f'({b})' for b in blocks[i : i + 16])})" for i in range(0, len(blocks), 16)]
    return blocks[0]


class Engine:
    """semantics: "ansi" (Spark's NULL logic) or "compat" (two-valued logic). views: DataFrames or view names of the session that are tables too."""

    def __init__(self, spark: SparkSession, path: str | None = None, semantics: str = "ansi", recursion_limit: int = 8192):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        library.register(spark)
        self.spark, self.semantics, self.recursion_limit = spark, semantics, recursion_limit
        self.store, self.sequences = Store(spark, path), Sequences()
        self.frames: dict[str, DataFrame] = {}
        self.temporary: set[str] = set()
        self.user: str | None = None
        self.began, self.saves = None, []
        self.last_insert_rowid = self._changes = self._total = 0
        self.own: dict[str, Callable] = {}
        self.locks: dict[str, str] = {}
        self._id = uuid.uuid4().hex[:8]
        for n, r in self.store.state.routines.items():
            self.own[n] = routines.callable_of(self, n, r)

    # tables of the session
    def register(self, table: str, df: DataFrame) -> None:
        """A DataFrame as a table that can be read."""
        self.frames[table.lower()] = df
        df.createOrReplaceTempView(f"__{self._id}_{table.lower()}")

    def create_function(self, n: str, f: Callable, returns: str = "double", args: int = -1) -> None:
        """A Python function of values, run in Arrow batches; the latest of a name counts. args: their number, -1 for any."""
        kind = {"double": "real", "bigint": "int", "int": "int", "string": "text", "binary": "blob"}.get(returns, "other")
        registered = f"__{self._id}_{n}"
        self.spark.udf.register(registered, F.udf(f, returns, useArrow=True))

        def made(own: list[Sql]) -> Sql:
            if 0 <= args != len(own):
                raise DialectError(f"wrong number of arguments to {n}()")
            return Sql(f"{registered}({', '.join(map(str, own))})", kind)

        self.own[n.lower()] = made

    def load_extension(self, module: str) -> None:
        """A Python module with register(engine)."""
        importlib.import_module(module).register(self)

    def set_user(self, user: str | None) -> None:
        """None may do anything."""
        self.user = user

    def changes(self) -> int:
        return self._changes

    def total_changes(self) -> int:
        return self._total

    def current_version(self) -> int:
        return self.store.state.version

    # running statements
    def sql(self, statement: str, params=None) -> DataFrame | None:
        """Run statements; the DataFrame of the last one that has rows. params: a list, or a dict by name."""
        out = None
        for s, source in parse(statement):
            out = self.run(s, source, params)
        return out

    def rows(self, statement: str, params=None) -> list[tuple]:
        df = self.sql(statement, params)
        return [tuple(r) for r in df.collect()] if df is not None else []

    def stream(self, statement: str, params=None) -> Iterator[tuple]:
        """Rows one at a time, a partition in memory at once."""
        df = self.sql(statement, params)
        yield from (tuple(r) for r in df.toLocalIterator(prefetchPartitions=True)) if df is not None else ()

    def execute(self, statement: str, callback: Callable | None = None, params=None) -> None:
        """As text rows to a callback, which stops the run by a true result."""
        df = self.sql(statement, params)
        for r in df.toLocalIterator() if df is not None and callback else ():
            if callback([None if v is None else str(v) for v in r], df.columns):
                raise DialectError("aborted by the callback")

    def prepare(self, statement: str) -> Callable[..., DataFrame | None]:
        own = parse(statement)

        def bound(*args, **named):
            out = None
            for s, source in own:
                out = self.run(s, source, named or list(args))
            return out

        return bound

    def run(self, s, source: str, params=None) -> DataFrame | None:
        if isinstance(s, Query):
            return self._sequenced(s, params) or self.spark.sql(self.compiler(params).query(s)[0])
        made = getattr(self, f"_{s.kind}", None)
        if made is None:
            raise DialectError(f"can't run {s.kind}")
        reading = s.kind in ("explain", "begin", "commit", "rollback", "rollback_to", "savepoint", "release", "call", "lock", "analyze", "reindex")
        if reading or self.began is not None:
            return made(s, params)
        kept, before = copy.deepcopy(self.store.state), self.store.state.version
        self.store.state.version += 1
        try:
            out = made(s, params)
            self.store.save(before, self.temporary)
            return out
        except Exception:
            self.store.state = kept
            raise

    def _sequenced(self, q: Query, params) -> DataFrame | None:
        """A query over rows that selects NEXTVAL: each row gets a value of its own, from a range that is allotted once its rows are counted.

        The rows are written first, and numbered by file and place in it, so that a task run again numbers alike. None if there is no such query."""
        first = q.first
        if q.more or first.source is None:
            return None
        called = {i: x for i, (x, _) in enumerate(first.items) if isinstance(x, Func) and x.name == "nextval"}
        if not called:
            if any(_calls(x, "nextval") for x, _ in first.items):
                raise DialectError("NEXTVAL over rows stands alone in a select list")
            return None
        items = [(Lit(0), f"__seq{i}") if i in called else (x, a) for i, (x, a) in enumerate(first.items)]
        c = self.compiler(params)
        names = {i: str(c.expr(x.args[0], Scope([])).literal) for i, x in called.items()}
        rows = self.spark.sql(c.query(replace(q, first=replace(first, items=items)))[0])
        path = f"{self.store.path}/sequence-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        rows = self.spark.read.schema(rows.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        sizes = sorted((r["__file"], r["n"]) for r in rows.groupBy("__file").agg(F.count("*").alias("n")).collect())
        total = sum(n for _, n in sizes)
        before = self.spark.createDataFrame([(f, b) for (f, _), b in zip(sizes, accumulate([0, *(n for _, n in sizes)]), strict=False)], "__file string, __before long")
        numbered = rows.join(F.broadcast(before), "__file")
        made = []
        for n in rows.columns[:-2]:
            i = int(n[5:]) if n.startswith("__seq") else None
            if i is None:
                made.append(F.col(f"`{n}`"))
            else:
                start, step = self.sequences.allot(names[i], total)
                made.append((F.lit(start) + (F.col("__before") + F.col("__row")) * step).cast("long").alias(first.items[i][1] or "nextval"))
        return numbered.select(*made)

    def compiler(self, params=None, rights: str = "SELECT") -> Compiler:
        own = dict(self.own)
        fixed = {"last_insert_rowid": lambda: self.last_insert_rowid, "changes": self.changes, "total_changes": self.total_changes, "current_version": self.current_version}
        own |= {n: (lambda a, f=f: Sql(f"{f()}L", "int", f())) for n, f in fixed.items()}
        return Compiler(lambda n, v: self._relation(n, v, rights), lambda q: self.spark.sql(q).schema, params, self.semantics, own, lambda c, cte: recursion.evaluate(self, c, cte), self.sequences, spatial.tasks(self.spark))

    def _relation(self, n: str, version, right: str = "SELECT"):
        state, key = self.store.state, n.lower()
        if key in self.frames:
            df = self.frames[key]
            return name(f"__{self._id}_{key}"), [(f.name, kind_of(f.dataType)) for f in df.schema.fields], ()
        child = None
        if key not in state.tables and "__p" in key and key.rsplit("__p", 1)[1].isdigit():
            key, child = key.rsplit("__p", 1)
        if key in state.tables:
            self._allowed(right, key)
            table = state.tables[key]
            df = self.store.read(table, version)
            if child is not None:
                spec = table.options.get("hash")
                if not spec or int(child) >= spec["n"]:
                    return None
                df = df.where(F.pmod(F.xxhash64(*[F.col(c) for c in spec["columns"]]), F.lit(spec["n"])) == int(child))
            view = f"__{self._id}_{key}_{'now' if version is None else version}{'' if child is None else '_p' + child}_{uuid.uuid4().hex[:8]}"
            df.createOrReplaceTempView(view)
            return name(view), [(f.name, kind_of(f.dataType)) for f in df.schema.fields], [c.name for c in table.columns if c.hidden]
        if key in state.views:
            self._allowed(right, key)
            view = state.views[key]
            user, self.user = self.user, None
            try:
                own, columns = self.compiler().query(parse(view["text"])[0][0])
            finally:
                self.user = user
            if view["columns"]:
                columns = [(a, k) for a, (_, k) in zip(view["columns"], columns, strict=True)]
                return f"(SELECT * FROM ({own}) AS _v({', '.join(name(c) for c, _ in columns)}))", columns, ()
            return f"({own})", columns, ()
        if self.spark.catalog.tableExists(n):
            return name(n), [(f.name, kind_of(f.dataType)) for f in self.spark.table(n).schema.fields], ()
        return None

    def _allowed(self, right: str, table: str) -> None:
        if self.user is None:
            return
        grants = self.store.state.grants
        held = {r for u in (self.user.lower(), "public") for t in (table, "all") for r in grants.get(f"{u} {t}", [])}
        if right not in held and "ALL" not in held:
            raise Denied(f"{self.user} may not {right} {table}")

    def _table(self, n: str, right: str | None = None) -> Table:
        table = self.store.state.tables.get(n.lower())
        if table is None:
            raise DialectError(f"no such table: {n}")
        if right:
            self._allowed(right, n.lower())
        return table

    # rows in
    def _scope(self, table: Table, alias: str | None = None) -> Scope:
        return Scope([From(alias or table.name, [(f.name, kind_of(f.dataType)) for f in self.store.read(table).schema.fields])])

    def _finished(self, table: Table, given: DataFrame, params=None) -> tuple[DataFrame, list[str], str]:
        """Rows with generated columns, types and constraints applied: written, or an error. given has all columns but generated ones."""
        c = self.compiler(params)
        plain = {f.name: kind_of(f.dataType) for f in given.schema.fields}
        view = f"__{self._id}_given_{uuid.uuid4().hex[:8]}"
        given.createOrReplaceTempView(view)
        made, bad = [], []
        scope = Scope([From("_r", list(plain.items()))])
        for col in table.columns:
            if col.generated:
                x = c.expr(parse_expr(col.generated), scope)
            else:
                x = Sql(f"_r.{name(col.name)}", plain[col.name])
            if col.hidden:
                made.append(f"{x} AS {name(col.name)}")
                continue
            value, wrong = types.stored(x, TypeName(col.declared, col.args))
            made.append(f"CAST({value} AS {col.type}) AS {name(col.name)}")
            bad.append(f"WHEN {x} IS NOT NULL AND {wrong} THEN 'MISMATCH: {col.name} is no {col.declared}'")
            if col.not_null or col.primary and table.key is not col:
                bad.append(f"WHEN {x} IS NULL THEN 'NOT NULL: {col.name}'")
        typed = self.spark.sql(f"SELECT {', '.join(made)}, CASE {' '.join(bad)} END AS __bad FROM {name(view)} AS _r")
        checks = [col for col in table.columns if col.check]
        if checks:
            own = f"{view}_typed"
            typed.createOrReplaceTempView(own)
            scope = Scope([From("_r", [(f.name, kind_of(f.dataType)) for f in typed.schema.fields])])
            tests = " ".join(f"WHEN NOT COALESCE({c.condition(parse_expr(k.check), scope)}, TRUE) THEN 'CHECK: {k.name}'" for k in checks)
            typed = self.spark.sql(f"SELECT {', '.join('_r.' + name(k.name) for k in table.columns)}, CASE WHEN _r.__bad IS NOT NULL THEN _r.__bad {tests} END AS __bad FROM {name(own)} AS _r")
        files, folder = self.store.write(table, typed, ["__bad"])
        wrong = self.spark.read.parquet(folder).where("__bad IS NOT NULL").select("__bad").limit(1).collect()
        if wrong:
            raise ConstraintError(wrong[0][0])
        return self.store.read(table, files=files), files, folder

    def _publish(self, table: Table, files: list[str]) -> None:
        """The table is made of these files from this transaction on."""
        version = self.store.state.version
        if table.versions and table.versions[-1][0] == version:
            table.versions.pop()
        table.versions.append((version, files))

    def _returned(self, table: Table, rows: DataFrame, items, params) -> DataFrame | None:
        if not items:
            return None
        view = f"__{self._id}_returned_{uuid.uuid4().hex[:8]}"
        rows.createOrReplaceTempView(view)
        c = self.compiler(params)
        c.relation = lambda n, v: (name(view), [(f.name, kind_of(f.dataType)) for f in rows.schema.fields], [x.name for x in table.columns if x.hidden])
        return self.spark.sql(c.select(Select(items, Source(table.name)))[0])

    def _count(self, n: int) -> None:
        self._changes = n
        self._total += n

    def _insert(self, s: Statement, params) -> DataFrame | None:
        table = self._table(s.table, "INSERT")
        open_columns = [c for c in table.columns if not c.hidden and not c.generated]
        named = [table.column(n) for n in s.columns] if s.columns else open_columns
        if None in named:
            raise DialectError(f"{table.name} has no column {s.columns[named.index(None)]}")
        c = self.compiler(params)
        if s.query is not None:
            source = self._sequenced(s.query, params)
            own, columns = c.query(s.query) if source is None else ("", [(f.name, kind_of(f.dataType)) for f in source.schema.fields])
            if len(columns) != len(named):
                raise DialectError(f"{len(columns)} values for {len(named)} columns")
            source = source.toDF(*[f"_{i}" for i in range(len(named))]) if source is not None else self.spark.sql(f"SELECT * FROM ({own}) AS _i({', '.join(f'_{i}' for i in range(len(named)))})")
            values = {col.name: Sql(f"_i._{i}", k) for i, (col, (_, k)) in enumerate(zip(named, columns, strict=True))}
            if any(k == "bool" for _, k in columns):
                values = {n: Sql(f"CAST({v} AS INT)", "int") if v.kind == "bool" else v for n, v in values.items()}
            source.createOrReplaceTempView(v := f"__{self._id}_insert_{uuid.uuid4().hex[:8]}")
            selects = [(f"FROM {name(v)} AS _i", values)]
        else:
            selects = []
            for row in s.rows:
                if row and len(row) != len(named):
                    raise DialectError(f"{len(row)} values for {len(named)} columns")
                values = {col.name: c.expr(x, Scope([])) for col, x in zip(named, row, strict=False) if x is not None}
                selects.append(("", values))
        parts = []
        for source, values in selects:
            own = []
            for col in table.columns:
                if col.hidden:
                    own.append((col.name, Sql(f"CAST({self.store.state.version if col.name == 'row_start' else 'NULL'} AS BIGINT)", "int")))
                elif not col.generated:
                    x = values.get(col.name)
                    if x is None:
                        x = c.expr(parse_expr(col.default), Scope([])) if col.default is not None else Sql("NULL", "null")
                    own.append((col.name, x))
            parts.append((source, own))
        # columns of mixed kinds travel as text; types.stored() reads them
        kinds = [{own[i][1].kind for _, own in parts} - {"null"} for i in range(len(parts[0][1]))]
        as_text = [len(k) > 1 for k in kinds]
        rendered = [f"SELECT {', '.join(f'{text(x) if t and x.kind != 'null' else x} AS {name(n)}' for (n, x), t in zip(own, as_text, strict=True))} {source}" for source, own in parts]
        given = self.spark.sql(rendered[0] if s.query is not None else _rows(parts, as_text))
        key = table.key
        if key is not None:
            given = self._numbered(table, given, key, ordered=s.query is None)
        if s.action or s.update:
            return self._upsert(s, table, given, key, params)
        rows, files, folder = self._finished(table, given, params)
        self._publish(table, table.files() + files)
        n = rows.count()
        self._count(n)
        if key is not None and n:
            self.last_insert_rowid = rows.agg(F.max(key.name)).first()[0]
        return self._returned(table, rows, s.returning, params)

    def _numbered(self, table: Table, given: DataFrame, key: Column, ordered: bool) -> DataFrame:
        """Keys that are null become the next ones, in the order of the rows."""
        lacking = F.col(f"`{key.name}`").isNull()
        n = given.where(lacking).count()
        if not n:
            return given
        top = max(self.store.read(table).agg(F.max(key.name)).first()[0] or 0, given.agg(F.max(F.col(f"`{key.name}`").cast("long"))).first()[0] or 0)
        from pyspark.sql import Window

        if n == 1:
            number = F.lit(top + 1)
        else:  # numbers follow partitions, so no task holds all rows
            placed = given.withColumn("__at", F.monotonically_increasing_id())
            placed = placed.withColumn("__part", F.shiftright("__at", 33))
            sizes = {r["__part"]: r["n"] for r in placed.where(lacking).groupBy("__part").agg(F.count("*").alias("n")).collect()}
            before, total = {}, 0
            for part in sorted(sizes):
                before[part], total = total, total + sizes[part]
            start = F.element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), F.col("__part"))
            number = F.lit(top) + start + F.row_number().over(Window.partitionBy("__part", lacking).orderBy("__at"))
            given = placed
        return given.withColumn(key.name, F.when(lacking, number.cast("long")).otherwise(F.col(f"`{key.name}`").cast("long"))).drop("__at", "__part")

    def _upsert(self, s: Statement, table: Table, given: DataFrame, key: Column | None, params):
        rows, files, folder = self._finished(table, given, params)
        if key is None:
            self._publish(table, table.files() + files)
            self._count(rows.count())
            return self._returned(table, rows, s.returning, params)
        k = key.name
        if rows.count() != rows.select(k).distinct().count():
            if s.rows is None:
                raise ConstraintError(f"rows of one statement share the key {k}")
            out = None
            for row in s.rows:  # in order, as each sees the one before
                again = self._insert(Statement("insert", {**s.parts, "rows": [row]}), params)
                out = again if out is None or again is None else out.unionByName(again)
            self._changes = len(s.rows)
            return out
        existing = self.store.read(table)
        new = rows.join(existing.select(k), k, "left_anti").select(*rows.columns)
        hit = rows.join(existing.select(k), k, "left_semi").select(*rows.columns)
        if s.action == "IGNORE" and not s.update:
            added, _ = self.store.write(table, new)
            self._publish(table, table.files() + added)
            self._count(new.count())
            return self._returned(table, self.store.read(table, files=added), s.returning, params)
        keys = [r[0] for r in hit.select(k).limit(10_001).collect()]
        inside = f"{name(k)} IN ({', '.join(map(str, keys)) or 'NULL'})" if len(keys) <= 10_000 else "TRUE"
        touched = self.store.holding(table, inside, f"__{self._id}_hold") if keys else []
        kept = [f for f in table.files() if not any(same_file(f, t) for t in touched)]
        old = self.store.read(table, files=[f for f in table.files() if f not in kept])
        if s.update:
            hit_keys = hit.select(F.col(k).alias("__k"))
            c = self.compiler(params)
            scope = Scope([From(table.name, [(f.name, kind_of(f.dataType)) for f in old.schema.fields])])
            marked = old.join(hit_keys, F.col(f"`{k}`") == F.col("__k"), "left")
            marked.createOrReplaceTempView(v := f"__{self._id}_hit_{uuid.uuid4().hex[:8]}")
            test = "__k IS NOT NULL" + (f" AND COALESCE({c.condition(s.where, scope)}, FALSE)" if s.where is not None else "")
            changed = self._changed(table, c, s.update, scope, f"{name(v)} AS {name(table.name)}", test, params)
            rest = self.spark.sql(f"SELECT {', '.join(name(table.name) + '.' + name(x.name) for x in table.columns)} FROM {name(v)} AS {name(table.name)} WHERE NOT ({test})")
            delta, changed_files, _ = self._finished(table, changed, params)
        else:
            rest = old.join(hit.select(F.col(k).alias("__k")), F.col(f"`{k}`") == F.col("__k"), "left_anti")
            delta, changed_files = hit, self.store.write(table, hit)[0]
        rest_files, _ = self.store.write(table, rest)
        added, _ = self.store.write(table, new)
        self._publish(table, kept + rest_files + changed_files + added)
        out = delta.unionByName(self.store.read(table, files=added))
        self._count(out.count())
        return self._returned(table, out, s.returning, params)

    def _changed(self, table: Table, c: Compiler, sets, scope: Scope, source: str, test: str, params) -> DataFrame:
        new = {}
        for n, x in sets:
            col = table.column(n)
            if col is None:
                raise DialectError(f"{table.name} has no column {n}")
            if col.generated:
                raise DialectError(f"{n} is generated")
            new[col.name] = c.expr(x, scope)
        own = []
        for col in table.columns:
            if not col.generated:
                x = new.get(col.name)
                x = Sql(f"CAST({x} AS INT)", "int") if x is not None and x.kind == "bool" else x
                own.append(f"{x if x is not None else name(table.name) + '.' + name(col.name)} AS {name(col.name)}")
        return self.spark.sql(f"SELECT {', '.join(own)} FROM {source} WHERE {test}")

    def _update(self, s: Statement, params):
        table = self._table(s.table, "UPDATE")
        return self._rewrite(table, s, params, s.sets)

    def _delete(self, s: Statement, params):
        return self._rewrite(self._table(s.table, "DELETE"), s, params, None)

    def _rewrite(self, table: Table, s: Statement, params, sets):
        """New files for those that hold affected rows."""
        c, scope = self.compiler(params), self._scope(table)
        test = f"COALESCE({c.condition(s.where, scope)}, FALSE)" if s.where is not None else "TRUE"
        touched = self.store.holding(table, test, table.name) if s.where is not None else table.files()
        kept = [f for f in table.files() if not any(same_file(f, t) for t in touched)]
        old = self.store.read(table, files=[f for f in table.files() if f not in kept])
        old.createOrReplaceTempView(v := f"__{self._id}_old_{uuid.uuid4().hex[:8]}")
        source = f"{name(v)} AS {name(table.name)}"
        columns = ", ".join(f"{name(table.name)}.{name(x.name)}" for x in table.columns)
        files = []
        if s.where is not None and touched:
            files, _ = self.store.write(table, self.spark.sql(f"SELECT {columns} FROM {source} WHERE NOT {test}"))
        if sets is not None:
            delta, changed, _ = self._finished(table, self._changed(table, c, sets, scope, source, test, params), params)
            files += changed
            n = delta.count()
        else:
            delta = self.spark.sql(f"SELECT {columns} FROM {source} WHERE {test}")
            n = delta.count()
        if n:
            self._publish(table, kept + files)
        self._count(n)
        return self._returned(table, delta, s.returning, params)

    def _truncate(self, s: Statement, params) -> None:
        table = self._table(s.table, "DELETE")
        self._count(self.store.read(table).count())
        self._publish(table, [])

    # definitions
    def _column(self, table_name: str, d, n: int) -> Column:
        return Column(d.name, f"c{n}", types.spark_type(d.type), d.type.name, d.type.args, d.primary, d.not_null, d.default, d.check, d.generated)

    def _create_table(self, s: Statement, params) -> None:
        key, state = s.name.lower(), self.store.state
        if key in state.tables or key in state.views:
            if s.maybe:
                return
            raise DialectError(f"{s.name} exists already")
        columns = [self._column(s.name, d, i) for i, d in enumerate(s.columns)]
        query = None
        if s.query is not None:
            own, found = self.compiler(params).query(s.query)
            if columns and len(columns) != len(found):
                raise DialectError("the query has another number of columns")
            query = self.spark.sql(own)
            declared = {"int": "BIGINT", "real": "DOUBLE", "blob": "BLOB", "geom": "GEOMETRY", "decimal": "DECIMAL"}
            columns = columns or [Column(n, f"c{i}", f.dataType.simpleString(), declared.get(k, "TEXT")) for i, ((n, k), f) in enumerate(zip(found, query.schema.fields, strict=True))]
        if len({c.name.lower() for c in columns}) != len(columns):
            raise DialectError("two columns of one name")
        for c in columns:
            c.primary |= c.name.lower() in [p.lower() for p in s.primary]
        options = dict(s.options)
        if options.get("tablespace"):
            options["path"] = state.tablespaces.get(options["tablespace"].lower())
        made = len(columns)
        if options.get("system"):
            columns += [Column("row_start", f"c{made}", "bigint", "BIGINT", hidden=True), Column("row_end", f"c{made + 1}", "bigint", "BIGINT", hidden=True)]
            made += 2
        state.tables[key] = table = Table(s.name, columns, [(state.version, [])], options, made)
        if s.temp:
            self.temporary.add(key)
        if query is not None:
            visible = [c.name for c in columns if not c.hidden]
            given = query.toDF(*visible)
            for c in columns[len(visible):]:
                given = given.withColumn(c.name, F.lit(state.version if c.name == "row_start" else None).cast("long"))
            rows, files, _ = self._finished(table, given, params)
            self._publish(table, files)
            self._count(rows.count())

    def _create_view(self, s: Statement, params) -> None:
        key, state = s.name.lower(), self.store.state
        if key in state.tables or key in state.views and not s.replace:
            if s.maybe:
                return
            raise DialectError(f"{s.name} exists already")
        self.compiler(params).query(parse(s.text)[0][0])
        state.views[key] = {"text": s.text, "columns": s.columns, "materialized": s.materialized}

    def _create_index(self, s: Statement, params) -> None:
        """Recorded only: Parquet statistics prune scans, and there is no index to seek."""
        if s.name.lower() in self.store.state.indexes and not s.maybe:
            raise DialectError(f"{s.name} exists already")
        table = self._table(s.table)
        if missing := [c for c in s.columns if table.column(c) is None]:
            raise DialectError(f"{table.name} has no column {missing[0]}")
        self.store.state.indexes[s.name.lower()] = {"table": s.table.lower(), "columns": s.columns, "method": s.method, "unique": s.unique}

    def _create_sequence(self, s: Statement, params) -> None:
        self.sequences.create(s.name, s.start, s.step)

    def _create_tablespace(self, s: Statement, params) -> None:
        self.store.state.tablespaces[s.name.lower()] = s.path

    def _create_routine(self, s: Statement, params) -> None:
        key = s.name.lower()
        if key in self.own and not s.replace:
            raise DialectError(f"{s.name} exists already")
        own = {"params": s.params, "language": s.language, "body": s.body, "procedure": s.procedure}
        self.own[key] = routines.callable_of(self, key, own)
        self.store.state.routines[key] = own

    def _call(self, s: Statement, params) -> DataFrame | None:
        own = self.store.state.routines.get(s.name.lower())
        if own is None and s.name.lower() not in self.own:
            raise DialectError(f"no such routine: {s.name}")
        c = self.compiler(params)
        return self.spark.sql(f"SELECT {self.own[s.name.lower()]([c.expr(a, Scope([])) for a in s.args])} AS result")

    def _drop(self, s: Statement, params) -> None:
        state, key = self.store.state, s.name.lower()
        held = {"TABLE": state.tables, "VIEW": state.views, "INDEX": state.indexes, "TABLESPACE": state.tablespaces, "FUNCTION": state.routines, "PROCEDURE": state.routines, "SEQUENCE": self.sequences.all}.get(s.what)
        if held is None:
            raise DialectError(f"can't drop {s.what}")
        if key not in held:
            if s.maybe:
                return
            raise DialectError(f"no such {s.what.lower()}: {s.name}")
        del held[key]
        if s.what in ("FUNCTION", "PROCEDURE"):
            self.own.pop(key, None)
        if s.what == "TABLE":
            state.indexes = {k: v for k, v in state.indexes.items() if v["table"] != key}

    def _alter(self, s: Statement, params) -> None:
        state = self.store.state
        table = self._table(s.table)
        if s.action == "rename":
            if s.name.lower() in state.tables or s.name.lower() in state.views:
                raise DialectError(f"{s.name} exists already")
            del state.tables[s.table.lower()]
            table.name = s.name
            state.tables[s.name.lower()] = table
            for i in state.indexes.values():
                i["table"] = s.name.lower() if i["table"] == s.table.lower() else i["table"]
            return
        if s.action == "add":
            if table.column(s.column.name):
                raise DialectError(f"{s.column.name} exists already")
            col = self._column(table.name, s.column, table.made)
            rows = self.store.read(table)
            table.made += 1
            if col.default is not None or col.generated or col.not_null:
                default = self.compiler(params).expr(parse_expr(col.default), Scope([])) if col.default is not None else Sql("NULL", "null")
                table.columns.append(col)
                if col.not_null and default.kind == "null" and rows.limit(1).count():
                    raise ConstraintError(f"NOT NULL: {col.name}")
                given = rows if col.generated else rows.withColumn(col.name, F.expr(str(default)))
                _, files, _ = self._finished(table, given, params)
                self._publish(table, files)
            else:
                table.columns.append(col)
            return
        col = table.column(s.name)
        if col is None:
            raise DialectError(f"{table.name} has no column {s.name}")
        if s.action == "rename_column":
            if table.column(s.to):
                raise DialectError(f"{s.to} exists already")
            for i in state.indexes.values():
                if i["table"] == table.name.lower():
                    i["columns"] = [s.to if x.lower() == s.name.lower() else x for x in i["columns"]]
            col.name = s.to
            return
        if col.primary or col.hidden or len(table.columns) == 1 or any(i["table"] == table.name.lower() and s.name.lower() in [x.lower() for x in i["columns"]] for i in state.indexes.values()):
            raise DialectError(f"{s.name} can't be dropped: it is a key, indexed, hidden or the only column")
        table.columns.remove(col)

    def _comment(self, s: Statement, params) -> None:
        self.store.state.comments[f"{s.what} {s.name.lower()}"] = s.text

    def _grant(self, s: Statement, params) -> None:
        for user in s.users:
            own = self.store.state.grants.setdefault(f"{user.lower()} {s.table.lower()}", [])
            own += [r for r in self._rights(s) if r not in own]

    def _revoke(self, s: Statement, params) -> None:
        for user in s.users:
            key = f"{user.lower()} {s.table.lower()}"
            own = self.store.state.grants.get(key, [])
            rights = self._rights(s)
            self.store.state.grants[key] = [] if "ALL" in rights else [r for r in own if r not in rights]

    def _rights(self, s: Statement) -> list[str]:
        if self.user is not None:
            raise Denied("only the superuser grants rights")
        if unknown := [r for r in s.rights if r not in RIGHTS]:
            raise DialectError(f"no such right: {unknown[0]}")
        return s.rights

    def _lock(self, s: Statement, params) -> None:
        self._table(s.table)
        self.locks[s.table.lower()] = s.mode

    # transactions
    def _begin(self, s, params) -> None:
        if self.began is not None:
            raise DialectError("a transaction has begun already")
        self.began, self.saves = copy.deepcopy(self.store.state), []
        self.store.state.version += 1

    def _commit(self, s, params) -> None:
        if self.began is None:
            raise DialectError("no transaction has begun")
        self.store.save(self.began.version, self.temporary)
        self.began, self.saves, self.locks = None, [], {}

    def _rollback(self, s, params) -> None:
        if self.began is None:
            raise DialectError("no transaction has begun")
        self.store.state = self.began
        self.began, self.saves, self.locks = None, [], {}

    def _savepoint(self, s, params) -> None:
        if self.began is None:
            self._begin(s, params)
        self.saves.append((s.name.lower(), copy.deepcopy(self.store.state)))

    def _save_at(self, n: str) -> int:
        at = [i for i, (own, _) in enumerate(self.saves) if own == n.lower()]
        if not at:
            raise DialectError(f"no such savepoint: {n}")
        return at[-1]

    def _release(self, s, params) -> None:
        del self.saves[self._save_at(s.name):]

    def _rollback_to(self, s, params) -> None:
        at = self._save_at(s.name)
        self.store.state = copy.deepcopy(self.saves[at][1])
        del self.saves[at + 1:]

    # upkeep
    def _explain(self, s: Statement, params) -> DataFrame:
        if not isinstance(s.of, Query):
            return self.spark.createDataFrame([(f"{s.of.kind.upper()} {s.of.parts.get('table', '')}",)], "plan string")
        own, _ = self.compiler(params).query(s.of)
        return self.spark.sql(f"EXPLAIN FORMATTED {own}")

    def _analyze(self, s: Statement, params) -> None:
        if s.target is not None:
            self._table(s.target)

    def _reindex(self, s: Statement, params) -> None:
        pass

    def _vacuum(self, s: Statement, params) -> None:
        """Small files become few, and versions but the last are forgotten."""
        if self.began is not None:
            raise DialectError("VACUUM is refused inside a transaction")
        for table in self.store.state.tables.values():
            if len(table.files()) > 1:
                rows = self.store.read(table)
                size = max(1, len(table.files()) // 16)
                files, _ = self.store.write(table, rows.coalesce(size))
            else:
                files = table.files()
            table.versions = [(self.store.state.version, files)]
