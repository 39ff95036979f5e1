"""WITH RECURSIVE. UNION ALL runs in Spark's own recursion; UNION, which Spark refuses, is a loop over frontiers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from sedge.plans.compiler import Compiler, _mentions, name
from sedge.plans.lexer import DialectError
from sedge.plans.nodes import Cte, Query


def evaluate(engine, compiler: Compiler, cte: Cte) -> tuple[str, list[tuple[str, str]]]:
    """Text to select from and columns of a CTE that mentions itself."""
    q = cte.query
    if not q.more or any(op not in ("UNION", "UNION ALL") for op, _ in q.more):
        raise DialectError(f"{cte.name}: a recursive CTE is a seed and arms joined by UNION or UNION ALL")
    arms = [q.first, *(s for _, s in q.more)]
    seeds = [s for s in arms if not _selects(s, cte.name)]
    steps = [s for s in arms if _selects(s, cte.name)]
    if not seeds or arms[: len(seeds)] != seeds:
        raise DialectError(f"{cte.name}: the seed comes first")
    distinct = any(op == "UNION" for op, _ in q.more)
    seed, columns = compiler.query(Query(seeds[0], [("UNION ALL", s) for s in seeds[1:]]))
    names = cte.columns or [n for n, _ in columns]
    if len(names) != len(columns):
        raise DialectError(f"{cte.name} has {len(columns)} columns, not {len(names)}")
    columns = [(n, k) for n, (_, k) in zip(names, columns, strict=True)]
    spark = engine.spark
    schema = spark.sql(seed).schema
    casts = ", ".join(f"CAST({name(n)} AS {_wide(f.dataType.simpleString())}) AS {name(n)}" for n, f in zip(names, schema.fields, strict=True))
    listed = ", ".join(map(name, names))
    seed = f"SELECT {casts} FROM ({seed}) AS _s({listed})"

    def step(relation: str) -> str:
        compiler.ctes[-1][cte.name.lower()] = (relation, columns)
        made = []
        for s in steps:
            own, theirs = compiler.select(s)
            if len(theirs) != len(columns):
                raise DialectError(f"{cte.name}: the arms have different numbers of columns")
            made.append(f"SELECT {casts} FROM ({own}) AS _s({listed})")
        del compiler.ctes[-1][cte.name.lower()]
        return " UNION ALL ".join(made)

    if not distinct and len(steps) == 1:
        own = f"_r{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.sql.cteRecursionLevelLimit", str(engine.recursion_limit))
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
        return f"(WITH RECURSIVE {own}({listed}) AS ({seed} UNION ALL {step(own)}) SELECT * FROM {own})", columns
    found = _loop(engine, seed, step, distinct)
    view = f"__{engine._id}_recursive_{uuid.uuid4().hex[:8]}"
    found.createOrReplaceTempView(view)
    return name(view), columns


def _loop(engine, seed: str, step, distinct: bool) -> DataFrame:
    """Frontier by frontier; each is written out, so plans stay short and lost executors cost little."""
    spark, folder = engine.spark, f"{engine.store.path}/recursive-{uuid.uuid4().hex}"
    done: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        done.append(f"{folder}/{len(done)}")
        df.write.parquet(done[-1])
        return spark.read.schema(df.schema).parquet(done[-1])

    first = spark.sql(seed)
    frontier = written(first.distinct() if distinct else first)
    schema = frontier.schema
    while not frontier.isEmpty():
        if len(done) > engine.recursion_limit:
            raise DialectError(f"recursion went on for more than {engine.recursion_limit} rounds")
        view = f"__{engine._id}_frontier_{uuid.uuid4().hex[:8]}"
        frontier.createOrReplaceTempView(view)
        new = spark.sql(step(name(view)))
        if distinct:
            so_far = spark.read.schema(schema).parquet(*done)
            new = new.subtract(so_far)
        frontier = written(new)
    return spark.read.schema(schema).parquet(*done)


def _wide(t: str) -> str:
    return {"int": "BIGINT", "smallint": "BIGINT", "tinyint": "BIGINT", "void": "STRING"}.get(t, t.upper())


def _selects(s, table: str) -> bool:
    return _mentions(Query(s), table)


