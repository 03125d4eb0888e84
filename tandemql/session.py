"""A session: dialect SQL in, DataFrames out, over versioned tables with transactions.

Queries are lowered to Spark SQL and stay lazy. Statements that change a table make its next version, from
which ROLLBACK and savepoints return by keeping references.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemql.functions.registry import FunctionRegistry
from tandemql.operators import dml
from tandemql.sharding.pruning import shards_for
from tandemql.sharding.shard_map import ShardedTable, ShardMap
from tandemql.sharding.versions import ShardedVersions
from tandemql.sql import nodes as N
from tandemql.sql.dialect import Dialect, SqlError
from tandemql.sql.lowering import Lowering, Relation, Scope, text_literal, value_literal
from tandemql.sql.parser import parse
from tandemql.storage import fresh_path, materialise
from tandemql.tables import VersionedTable
from tandemql.transactions.distributed import DistributedTransaction
from tandemql.transactions.local import LocalTransaction
from tandemql.transactions.two_phase import ShardStore, recover
from tandemql.types import kind_of

PREPARED, PLANS = 128, 1024
_views = itertools.count()

#: Functions whose value is one for a whole statement, and those that give another one each time.
CLOCKS = {"NOW", "CURRENT_TIMESTAMP", "LOCALTIMESTAMP", "CURRENT_DATE", "CURDATE", "CURRENT_TIME", "CURTIME", "LOCALTIME", "UNIX_TIMESTAMP"}
DICE = {"RAND", "RANDOM", "UUID", "GEN_RANDOM_UUID"}


@dataclass
class DmlResult:
    affected_rows: int = 0
    success: bool = True
    message: str = ""
    returning: DataFrame | None = None


class Lru(OrderedDict):
    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def put(self, key, value) -> None:
        self[key] = value
        self.move_to_end(key)
        while len(self) > self.most:
            self.popitem(last=False)

    def find(self, key):
        if key in self:
            self.move_to_end(key)
            return self[key]
        return None


class Session:
    def __init__(self, spark: SparkSession, dialect: Dialect | str = Dialect.MYSQL, store: str | None = None):
        """``store`` is the folder of sharded tables that statements change; by default a fresh one in the shared folder."""
        self.spark, self.dialect = spark, Dialect.of(dialect)
        self.tables: dict[str, VersionedTable] = {}
        self.sharded: dict[str, ShardedTable] = {}
        self._keys: dict[str, tuple] = {}
        self._registered: dict[str, int] = {}
        self.functions = FunctionRegistry(self.dialect)
        self.variables: dict[str, object] = {}
        self.system: dict[str, object] = {"autocommit": 1}
        self.prepared: Lru = Lru(PREPARED)
        self.plans: Lru = Lru(PLANS)
        self.plan_hits = 0
        self.transaction = LocalTransaction(self.tables)
        self._store: ShardStore | None = None
        self._shard_views: dict[tuple, str] = {}
        self._outside = False  # whether the query at hand reads what the session doesn't know the version of
        self._ctes: N.With | None = None  # of the statement at hand
        if store is not None:
            self._distribute(store)

    # Tables

    def register(self, name: str, df: DataFrame, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> VersionedTable:
        self.tables[name.lower()] = table = VersionedTable.of(name, df, key, defaults)
        return table

    def register_sharded(self, table: ShardedTable, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> None:
        """A dealt table, for reading where it is. The first statement that changes it writes it to the store."""
        name = table.name.lower()
        self.tables.pop(name, None)
        self.sharded[name], self._registered[name] = table, next(_views)
        self._keys[name] = (key, defaults)

    def open_sharded(self, shard_map: ShardMap, key: list[str] | str = (), defaults: dict[str, object] | None = None) -> ShardedVersions:
        """A table that the store holds."""
        table = ShardedVersions.open(shard_map, self._distribute().store, key, defaults)
        name = table.name.lower()
        self._hold(name, table)
        return table

    def _hold(self, name: str, table: ShardedVersions) -> None:
        self.tables[name], self.sharded[name], self._registered[name] = table, table.as_sharded(), next(_views)

    def _distribute(self, store: str | None = None) -> DistributedTransaction:
        if not isinstance(self.transaction, DistributedTransaction):
            self._store = ShardStore(self.spark, store or fresh_path(self.spark, "shards"))
            self.transaction = DistributedTransaction(self.tables, self._store, self.transaction)
            recover(self._store, self.transaction.log)
        return self.transaction

    def _stored(self, name: str) -> ShardedVersions:
        transaction = self._distribute()
        table = ShardedVersions.of(self.sharded[name], transaction.store, *self._keys.get(name, ((), None)))
        DistributedTransaction({name: table}, transaction.store).publish()
        self._hold(name, table)
        transaction.enlist(name, table)
        return table

    def register_function(self, name: str, least: int, most: int, template: str | None = None, kind: str = "?") -> None:
        self.functions.register(name, least, most, template, kind)

    def table(self, parts: list[str]) -> VersionedTable:
        name = parts[-1].lower()
        if name in self.tables:
            return self.tables[name]
        if name in self.sharded:
            return self._stored(name)
        raise SqlError(f"no table {'.'.join(parts)}")

    def _find(self, parts: list[str], shards: dict[str, set[int]]) -> Relation | None:
        name = parts[-1].lower()
        needed = shards.get(name)
        if name in self.tables:
            table = self.tables[name]
            if needed is None or not isinstance(table, ShardedVersions):
                return Relation(table.view(), table.columns)
            return self._shard_view((name, table.version.number, frozenset(needed)), lambda: table.read(table.version.folders, needed))
        if name in self.sharded:
            table = self.sharded[name]
            return self._shard_view((name, -self._registered[name], None if needed is None else frozenset(needed)), lambda: table.read_shards(needed))
        if len(parts) == 1 and self.spark.catalog.tableExists(parts[0]):
            self._outside = True
            return Relation(parts[0], [(f.name, kind_of(f.dataType)) for f in self.spark.table(parts[0]).schema.fields])
        return None

    def _shard_view(self, state: tuple, read) -> Relation:
        if state not in self._shard_views:
            self._shard_views[state] = f"_tandemql_{state[0]}_{next(_views)}"
            read().createOrReplaceTempView(self._shard_views[state])
        view = self._shard_views[state]
        return Relation(view, [(f.name, kind_of(f.dataType)) for f in self.spark.table(view).schema.fields])

    def _lowering(self, node: N.Node | None = None) -> Lowering:
        shards = shards_for(node, self.sharded, self.dialect) if node is not None and self.sharded else {}
        return Lowering(self.dialect, lambda p: self._find(p, shards), self._analyse, self.functions, self.variables, self.system)

    def _analyse(self, text: str):
        params = {f"p{i}": None for i in range(1, 65)} if ":p" in text else None
        return self.spark.sql(text, args=params).schema if params else self.spark.sql(text).schema

    # Queries

    def lower(self, sql: str) -> str:
        """The Spark SQL of a query."""
        node = parse(sql, self.dialect)
        return self._lowering(node).query(node)

    def execute_query(self, sql: str, params: list | tuple = ()) -> DataFrame:
        versions = tuple(sorted((n, t.version.number) for n, t in self.tables.items()))
        shards = tuple(sorted(self._registered.items()))
        values = tuple(sorted(map(repr, self.variables.items()))), tuple(sorted(map(repr, self.system.items())))
        state = (sql, versions, shards, values, self.functions.changes, tuple(map(repr, params)))
        cached = self.plans.find(state)
        if cached is not None:
            self.plan_hits += 1
            return cached
        node = parse(sql, self.dialect)
        self._outside = False
        df = self._query(node, params)
        if not (self._outside or any(isinstance(n, N.Call) and n.name.upper() in CLOCKS | DICE for n in node.walk())):
            self.plans.put(state, df)
        return df

    def _query(self, node: N.Node, params: list | tuple = ()) -> DataFrame:
        if isinstance(node, N.Explain):
            return self._explain(node)
        if isinstance(node, N.Describe):
            return self._describe(node)
        if not isinstance(node, (N.Select, N.Compound, N.With, N.Values, N.Parenthesized)):
            raise SqlError("not a query; use execute_statement")
        text = self._lowering(node).query(node)
        df = self._run(text, params)
        if isinstance(node, N.Select) and node.into:
            self._into(node.into, df)
        return df

    def _run(self, text: str, params: list | tuple = ()) -> DataFrame:
        return self.spark.sql(text, args={f"p{i}": v for i, v in enumerate(params, 1)}) if params else self.spark.sql(text)

    def _into(self, into: N.Into, df: DataFrame) -> None:
        if into.kind == "VARIABLES":
            rows = df.limit(2).collect()
            if len(rows) > 1:
                raise SqlError("INTO variables wants one row")
            if rows:
                self.variables |= {v.lower(): x for v, x in zip(into.variables, rows[0], strict=True)}
            return
        from tandemql.sources.files import write_outfile

        write_outfile(df, into.path, into.options)

    def _explain(self, node: N.Explain) -> DataFrame:
        text = self._lowering(node.statement).query(node.statement)
        return self.spark.sql(f"EXPLAIN FORMATTED {text}")

    def _describe(self, node: N.Describe) -> DataFrame:
        relation = self._find(node.table, {})
        if relation is None:
            raise SqlError(f"no table {'.'.join(node.table)}")
        fields = [f for f in self.spark.table(relation.view).schema.fields if node.column is None or f.name.lower() == node.column.lower()]
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in fields], "col_name string, data_type string, nullable boolean")

    # Prepared statements

    def prepare(self, name: str, sql: str) -> None:
        self.prepared.put(name, sql)
        parse(sql, self.dialect)

    def execute_prepared(self, name: str, params: list | tuple = ()) -> DataFrame | DmlResult:
        sql = self.prepared.find(name)
        if sql is None:
            raise SqlError(f"no prepared statement {name}")
        return self.execute(sql, params)

    def deallocate(self, name: str) -> None:
        self.prepared.pop(name, None)

    # Statements

    def execute(self, sql: str, params: list | tuple = ()) -> DataFrame | DmlResult:
        node = parse(sql, self.dialect)
        if isinstance(node, N.Command) and node.kind == "EXECUTE":
            return self._execute_command(node)
        queries = (N.Select, N.Compound, N.Values, N.Parenthesized, N.Explain, N.Describe)
        if isinstance(node, queries) or isinstance(node, N.With) and isinstance(node.body, (*queries, N.With)):
            return self.execute_query(sql, params)
        return self.execute_statement(sql, params)

    def execute_statement(self, sql: str, params: list | tuple = ()) -> DmlResult:
        node = parse(sql, self.dialect)
        if isinstance(node, N.Command):
            return self._command(node)
        ctes = node if isinstance(node, N.With) else None
        if ctes is not None:
            node = node.body
        changes = {N.Insert: self._insert, N.Update: self._update, N.Delete: self._delete}
        others = {N.SetStatement: self._set, N.Do: self._do, N.LoadData: self._load}
        run = changes.get(type(node)) or others.get(type(node) if ctes is None else None)
        if run is None:
            raise SqlError(f"{type(node).__name__} isn't run")
        if type(node) in changes:
            node, params = self._settled(node, params), ()
            ctes = ctes and self._settled(ctes, ())
            self._targets(node)
        with self.transaction.statement():
            try:
                self._ctes = ctes
                return run(node, params)
            finally:
                self._ctes = None

    def _targets(self, node: N.Node) -> None:
        """Sharded tables that the statement changes come into the store before it begins."""
        if isinstance(node, N.Insert):
            self.table(node.table.parts)
        else:
            root = node.tables if isinstance(node, N.Update) else node.source
            found = [t for t in root.walk() if isinstance(t, N.Table)] + ([t for t in node.using.walk() if isinstance(t, N.Table)] if isinstance(node, N.Delete) and node.using is not None else [])
            for t in found:
                if t.parts[-1].lower() in self.sharded:
                    self.table(t.parts)

    def _settled(self, node: N.Node, params: list | tuple) -> N.Node:
        """The statement with its parameters, and with one value for each function that reads the clock."""
        known: dict[str, N.Fixed] = {}

        def change(n: N.Node) -> N.Node:
            if isinstance(n, N.Param):
                if n.number > len(params):
                    raise SqlError(f"no value for parameter {n.raw}")
                return parameter(params[n.number - 1])
            if isinstance(n, N.Call) and n.name.upper() in CLOCKS and not (n.name.upper() == "UNIX_TIMESTAMP" and n.args):
                sql, kind = self._lowering().expr(n, Scope())
                if sql not in known:
                    text, to = self.spark.sql(f"SELECT CAST({sql} AS STRING), typeof({sql})").first()
                    known[sql] = N.Fixed(f"CAST({text_literal(text)} AS {to})", kind)
                return known[sql]
            return n

        return _replaced(node, change)

    def _execute_command(self, node: N.Command) -> DataFrame | DmlResult:
        """``EXECUTE p``, ``EXECUTE p USING @a, @b`` or ``EXECUTE p(1, 'x')``."""
        from tandemql.sql.lexer import tokenize

        tokens = [t for t in tokenize(" ".join(node.words[2:]), self.dialect) if t.kind != "end"]
        if not tokens:
            return self.execute_prepared(node.words[1])
        text = " ".join(node.words[3:] if tokens[0].upper == "USING" else node.words[2:])
        values = parse(f"SELECT {text}", self.dialect).items
        if len(values) == 1 and isinstance(values[0].expr, N.Row):
            exprs = values[0].expr.items
        else:
            exprs = [v.expr for v in values]
        row = self._run(f"SELECT {', '.join(self._lowering().expr(e, Scope())[0] for e in exprs)}").first()
        return self.execute_prepared(node.words[1], list(row))

    def _command(self, node: N.Command) -> DmlResult:
        words = [w.upper() for w in node.words]
        if node.kind in ("BEGIN", "START_TRANSACTION"):
            self.transaction.begin()
        elif node.kind == "COMMIT":
            self.transaction.commit()
        elif node.kind == "ROLLBACK":
            if "TO" in words:
                self.transaction.rollback_to(node.target[-1])
            else:
                self.transaction.rollback()
        elif node.kind == "SAVEPOINT":
            name = node.target[-1]
            (self.transaction.release if words[0] == "RELEASE" else self.transaction.savepoint)(name)
        elif node.kind == "TRUNCATE":
            table = self.table(node.target)
            with self.transaction.statement():
                n = table.df.count()
                table.put(table.df.limit(0))
            return DmlResult(n)
        elif node.kind in ("USE", "LOCK", "UNLOCK", "RESET"):
            pass
        elif node.kind == "DEALLOCATE":
            self.deallocate(node.words[-1])
        elif node.kind == "PREPARE":
            self._prepare_command(node)
        elif node.kind == "EXECUTE":
            result = self._execute_command(node)
            return result if isinstance(result, DmlResult) else DmlResult(returning=result)
        else:
            raise SqlError(f"{node.kind} isn't run")
        return DmlResult()

    def _prepare_command(self, node: N.Command) -> None:
        from tandemql.sql.lexer import tokenize

        text = " ".join(node.words[3:])
        tokens = tokenize(text, self.dialect)
        self.prepare(node.words[1], tokens[0].value if tokens[0].kind == "string" else text)

    def _set(self, node: N.SetStatement, params: list | tuple) -> DmlResult:
        for item in node.items:
            value = item.value.parts[0] if isinstance(item.value, N.Name) else self._run(f"SELECT {self._lowering().expr(item.value, Scope())[0]}", params).first()[0]
            if isinstance(item.target, N.Variable) and not item.target.system:
                self.variables[item.target.name.lower()] = value
            else:
                name = (item.target.name if isinstance(item.target, N.Variable) else item.target.parts[-1]).split(".")[-1].lower()
                self.system[name] = value
                if name == "autocommit":
                    self.transaction.autocommit = str(value).upper() in ("1", "ON", "TRUE")
        if node.form == "TIME ZONE" and node.words:
            self.spark.conf.set("spark.sql.session.timeZone", node.words[-1].strip("'"))
        return DmlResult()

    def _do(self, node: N.Do, params: list | tuple) -> DmlResult:
        self._run("SELECT " + ", ".join(self._lowering().expr(e, Scope())[0] for e in node.exprs), params).collect()
        return DmlResult()

    def _load(self, node: N.LoadData, params: list | tuple) -> DmlResult:
        from tandemql.sources.files import read_infile

        table = self.table(node.table)
        columns = node.columns or [c for c, _ in table.columns]
        rows = read_infile(self.spark, node, len(columns))
        lowering, given = self._lowering(), {}
        rows = rows.toDF(*[c.lstrip("@") for c in columns])
        scope = Scope([("_in", [(c, "str") for c in rows.columns])])
        lowering.variables = {}
        for a in node.sets:
            text = lowering.expr(_variables_as_names(a.value), scope)[0]
            given[table.column(a.target.parts[-1])] = F.expr(text)
        plain = [c for c in columns if not c.startswith("@") and table.column(c) not in given]
        # Lenient, as loading is; and a strict cast might meet a skipped line, as filters move below the skipping.
        types = {f.name: f.dataType for f in table.df.schema.fields}
        new = rows.select(*[F.col(c).try_cast(types[table.column(c)]) for c in plain], *[e.try_cast(types[c]) for c, e in given.items()])
        new = materialise(dml.aligned(table.df, new, [*plain, *given], table.defaults), "loaded")
        n = new.count()
        if node.mode == "REPLACE" and table.key:
            table.put(dml.replace(table.df, new, table.key))
        else:
            table.append(new)
        return DmlResult(n)

    # Changes of tables

    def _insert(self, node: N.Insert, params: list | tuple) -> DmlResult:
        table = self.table(node.table.parts)
        names = [c for c, _ in table.columns]
        columns = [table.column(c) for c in node.columns] or ([] if node.source is None else names)
        if node.source is None:
            rows = self.spark.range(1).select()
        elif isinstance(node.source, N.Values):
            rows = self._values(table, columns, node.source, params)
        else:
            source = node.source if self._ctes is None else N.With(self._ctes.recursive, self._ctes.ctes, node.source)
            rows = self._run(self._lowering(source).query(source), params)
        order = "_order"
        numbered = isinstance(node.source, N.Values)
        if numbered:
            new = dml.aligned(table.df.withColumn(order, F.lit(0).cast("long")), rows, [*columns, order], table.defaults)
        else:
            new = dml.aligned(table.df, rows, columns, table.defaults).withColumn(order, F.monotonically_increasing_id())
        if not numbered or any(isinstance(x, N.Call) for x in node.source.walk()):
            new = materialise(new, "inserted")  # evaluated once, for the count, the table and what is returned
        n = new.count()
        if node.replace or node.conflict or node.ignore:
            key = [table.column(c) for c in (node.conflict.columns if node.conflict and node.conflict.columns else table.key)]
            if not key:
                raise SqlError(f"table {table.name} has no key to find conflicts by")
            new = dml.last_of_key(new, key, order)
            if node.replace:
                table.put(dml.replace(table.df, new, key))
            else:
                table.put(self._upsert(table, new, key, node))
        else:
            new = new.drop(order)
            table.append(new)
        return DmlResult(n, returning=self._returning(node.returning, table, new))

    def _values(self, table: VersionedTable, columns: list[str], values: N.Values, params: list | tuple) -> DataFrame:
        lowering, scope = self._lowering(), Scope()
        rows = []
        for i, row in enumerate(values.rows):
            if len(row) not in (len(columns), 0):
                raise SqlError(f"{len(columns)} columns but {len(row)} values")
            own = list(zip(columns, row, strict=True)) if row else [(c, N.Default()) for c in columns]
            texts = []
            for c, v in own:
                if isinstance(v, N.Default):
                    texts.append(value_literal(table.defaults.get(c))[0])
                else:
                    texts.append(lowering.expr(v, scope)[0])
            rows.append(f"SELECT {', '.join([f'{t} AS c{j}' for j, t in enumerate(texts)] + [f'{i}L AS _order'])}")
        return self._run(" UNION ALL ".join(rows), params)

    def _upsert(self, table: VersionedTable, new: DataFrame, key: list[str], node: N.Insert) -> DataFrame:
        sets = []
        only_if = None
        if node.conflict and node.conflict.sets:
            scope = Scope([("o", table.columns), ("excluded", table.columns)])
            if node.table.alias:
                scope.relations.append((node.table.alias, table.columns))
            lowering = self._lowering()

            def own(e: N.Node) -> str:
                return lowering.expr(_conflict_names(e, table.name, node.table.alias), scope)[0]

            sets = [(table.column(a.target.parts[-1]), F.expr(own(a.value))) for a in node.conflict.sets]
            only_if = F.expr(own(node.conflict.where)) if node.conflict.where else None
        return dml.upsert(table.df, new, key, sets, only_if)

    def _target(self, source: N.Node, name: str | None = None) -> tuple[VersionedTable, str]:
        """The table that a statement changes, and its name in the statement."""
        found = [t for t in source.walk() if isinstance(t, N.Table)]
        chosen = next((t for t in found if name and name.lower() in ((t.alias or "").lower(), t.parts[-1].lower())), found[0])
        return self.table(chosen.parts), chosen.alias or chosen.parts[-1]

    def _hits(self, table: VersionedTable, alias: str, source: N.Node, where: N.Node | None, tail: N.Tail, values: list[N.Node], params: list | tuple) -> tuple[DataFrame, DataFrame]:
        """(all rows with _rid, the hit rows' _rid and values): for statements with joins, subqueries or limits."""
        rows = table.with_row_ids()
        view = f"_tandemql_{table.name}_rows_{next(_views)}"
        rows.createOrReplaceTempView(view)
        lowering = self._lowering()
        inner = lowering.find
        lowering.find = lambda p: Relation(view, [*table.columns, ("_rid", "int")]) if p[-1].lower() == table.name.lower() else inner(p)
        items = [N.Item(N.Name([alias, "_rid"]), "_rid")] + [N.Item(v, f"_v{i}") for i, v in enumerate(values)]
        select: N.Node = N.Select(items, source, where, tail=tail)
        if self._ctes is not None:
            select = N.With(self._ctes.recursive, self._ctes.ctes, select)
        return rows, materialise(self._run(lowering.query(select), params).dropDuplicates(["_rid"]), "hits")

    def _routed(self, table: VersionedTable, node: N.Node) -> VersionedTable:
        """The table as the statement changes it: of a sharded one, the shards that its conditions leave."""
        if not isinstance(table, ShardedVersions):
            return table
        return self.transaction.route_dml(table, shards_for(node, self.sharded, self.dialect).get(table.name.lower()))

    def _by_chance(self, *nodes: N.Node | None) -> bool:
        """Whether an expression may give another value each time: by chance, or by a function of the user's own."""
        calls = [x.name.upper() for n in nodes if n is not None for x in n.walk() if isinstance(x, N.Call)]
        return any(c in DICE or self.functions.is_own(c) for c in calls)

    def _update(self, node: N.Update, params: list | tuple) -> DmlResult:
        table, alias = self._target(node.tables, node.sets[0].target.parts[-2] if len(node.sets[0].target.parts) > 1 else None)
        table = self._routed(table, node)
        sets = [(table.column(a.target.parts[-1]), N.Literal("null", None, "NULL") if isinstance(a.value, N.Default) else a.value) for a in node.sets]
        joined = node.source is not None or isinstance(node.tables, N.Join)
        nested = any(isinstance(x, (N.Subquery, N.Exists)) or isinstance(x, N.InList) and x.query or isinstance(x, N.Quantified) for e in [node.where, *[v for _, v in sets]] if e for x in e.walk())
        if not (joined or nested or node.tail.limit):
            lowering, scope = self._lowering(), Scope([(alias, table.columns)])
            hit = F.expr(lowering.truth(_unqualified(node.where, alias), scope)) if node.where else F.lit(True)
            exprs = [(c, F.expr(lowering.expr(_unqualified(v, alias), scope)[0])) for c, v in sets]
            if node.returning or self._by_chance(node.where, *[v for _, v in sets]):
                # Evaluated once: chance, and what is returned, must be what the table holds then.
                marked = materialise(dml.update(table.df, hit, exprs, mark="_hit"), "updated")
                table.put(marked.drop("_hit"))
                changed = marked.where("_hit").drop("_hit")
                return DmlResult(changed.count(), returning=self._returning(node.returning, table, changed))
            n = table.df.where(hit).count()
            table.put(dml.update(table.df, hit, exprs))
            return DmlResult(n)
        source = N.Join(node.tables, node.source, "COMMA") if node.source is not None else node.tables
        rows, hits = self._hits(table, alias, source, node.where, node.tail, [v for _, v in sets], params)
        both = rows.join(hits.withColumn("_hit", F.lit(True)), "_rid", "left")
        at = {c: i for i, (c, _) in enumerate(sets)}
        new = both.select(*[F.when(F.col("_hit"), F.col(f"_v{at[f.name]}").cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in at else F.col(f.name) for f in table.df.schema.fields], "_hit")
        n = hits.count()
        table.put(new.drop("_hit"))
        return DmlResult(n, returning=self._returning(node.returning, table, new.where("_hit").drop("_hit")))

    def _delete(self, node: N.Delete, params: list | tuple) -> DmlResult:
        joined = node.using is not None or isinstance(node.source, N.Join)
        names = node.targets or [None]
        nested = node.where and any(isinstance(x, (N.Subquery, N.Exists, N.Quantified)) or isinstance(x, N.InList) and x.query for x in node.where.walk())
        if not (joined or nested or node.tail.limit or node.targets):
            table, alias = self._target(node.source)
            table = self._routed(table, node)
            lowering, scope = self._lowering(), Scope([(alias, table.columns)])
            hit = F.expr(lowering.truth(_unqualified(node.where, alias), scope)) if node.where else F.lit(True)
            df = table.df
            if self._by_chance(node.where):
                df = materialise(df.withColumn("_hit", F.coalesce(hit, F.lit(False))), "deleted")
                hit = F.col("_hit")
            gone = df.where(hit)
            n = gone.count()
            table.put(dml.delete(df, hit))
            return DmlResult(n, returning=self._returning(node.returning, table, gone))
        source = node.source
        if node.using is not None:
            mentioned = {(t.alias or t.parts[-1]).lower() for t in node.using.walk() if isinstance(t, N.Table)}
            first = next(t for t in node.source.walk() if isinstance(t, N.Table))
            source = node.using if (first.alias or first.parts[-1]).lower() in mentioned else N.Join(node.source, node.using, "COMMA")
        done, total, returning = [], 0, None
        for name in names:
            table, alias = self._target(source if name else node.source, name)
            table = self._routed(table, node)
            rows, hits = self._hits(table, alias, source, node.where, node.tail, [], params)
            total += hits.count()
            done.append((table, rows.join(hits, "_rid", "left_anti").drop("_rid")))
            returning = self._returning(node.returning, table, rows.join(hits, "_rid", "left_semi").drop("_rid"))
        for table, df in done:
            table.put(df)
        return DmlResult(total, returning=returning)

    def _returning(self, items: list[N.Node], table: VersionedTable, rows: DataFrame | None) -> DataFrame | None:
        if not items or rows is None:
            return None
        view = f"_tandemql_{table.name}_returned_{next(_views)}"
        rows.createOrReplaceTempView(view)
        lowering = self._lowering()
        lowering.find = lambda p: Relation(view, table.columns)
        return self.spark.sql(lowering.query(N.Select(items, N.Table([table.name]))))


def parameter(value: object) -> N.Node:
    """A parameter's value as a node: a literal where it can be one."""
    if value is None:
        return N.Literal("null", None, "NULL")
    if isinstance(value, bool):
        return N.Literal("bool", value, str(value).upper())
    if isinstance(value, int):
        return N.Literal("int", value, str(value))
    if isinstance(value, str):
        return N.Literal("string", value, value)
    return N.Fixed(*value_literal(value))


def _unqualified(node: N.Node, alias: str) -> N.Node:
    """Names qualified by the statement's only table, without that."""
    return _replaced(node, lambda n: N.Name([n.parts[-1]]) if isinstance(n, N.Name) and len(n.parts) > 1 and n.parts[-2].lower() == alias.lower() else n)


def _replaced(node: N.Node, change) -> N.Node:
    """A copy of a tree with ``change`` applied to every node, from the leaves up."""
    import copy

    def inner(value):
        if isinstance(value, N.Node):
            return _replaced(value, change)
        return type(value)(map(inner, value)) if isinstance(value, (list, tuple)) else value

    node = copy.copy(node)
    for name, value in vars(node).items():
        setattr(node, name, inner(value))
    return change(node)


def _conflict_names(e: N.Node, table: str, alias: str | None) -> N.Node:
    """In an upsert's items: VALUES(c), excluded.c and alias.c are the new row's, c and table.c the old one's."""

    def change(n: N.Node) -> N.Node:
        if isinstance(n, N.Call) and n.name.upper() == "VALUES" and len(n.args) == 1:
            return N.Name(["n", n.args[0].parts[-1]])
        if isinstance(n, N.Name):
            head = n.parts[-2].lower() if len(n.parts) > 1 else ""
            if head == "n":
                return n
            new = head == "excluded" or alias is not None and head == alias.lower()
            return N.Name(["n" if new else "o", n.parts[-1]])
        return n

    return _replaced(e, change)


def _variables_as_names(e: N.Node) -> N.Node:
    return _replaced(e, lambda n: N.Name([n.name]) if isinstance(n, N.Variable) and not n.system else n)
