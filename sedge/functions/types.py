"""Declared types: which Spark type holds one, and what a value must satisfy to be stored in it."""

from __future__ import annotations

from sedge.functions.scalars import Sql, text
from sedge.plans.nodes import TypeName

GEOM = "struct<kind:string,rings:array<array<struct<x:double,y:double>>>>"
_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def spark_type(t: TypeName) -> str:
    """By the beginning of the name; unknown names are text."""
    n, args = t.name, t.args
    if n.startswith("BOOL"):
        return "int"
    for start, own in (("TINYINT", "tinyint"), ("SMALLINT", "smallint"), ("INT2", "smallint"), ("BIGINT", "bigint"), ("INT8", "bigint"), ("INTERVAL", "string"), ("INT", "int"),
                       ("REAL", "double"), ("FLOAT", "double"), ("DOUBLE", "double"), ("BINARY", "binary"), ("VARBINARY", "binary"), ("BYTEA", "binary"), ("BLOB", "binary"), ("RAW", "binary"), ("GEO", GEOM), ("POINT", GEOM)):
        if n.startswith(start):
            return own
    if n.startswith(("DECIMAL", "NUMERIC", "NUMBER")):
        return f"decimal({args[0]},{args[1] if len(args) > 1 else 0})" if args else "decimal(38,10)"
    return "string"


def stored(x: Sql, t: TypeName) -> tuple[str, str]:
    """The value as stored, and a condition that holds if it can't be (of values that aren't null)."""
    n, own = t.name, spark_type(t)
    if x.kind == "null":
        return f"CAST(NULL AS {own.upper() if own != GEOM else own})", "FALSE"
    if n.startswith("BOOL"):
        v = f"CASE WHEN LOWER({text(x)}) IN ('true', '1') THEN 1 WHEN LOWER({text(x)}) IN ('false', '0') THEN 0 END"
        return v, f"({v}) IS NULL"
    if own in _RANGES:
        if x.kind == "int":
            return f"TRY_CAST({x} AS {own.upper()})", f"TRY_CAST({x} AS {own.upper()}) IS NULL"
        v = f"TRY_CAST({text(x) if x.kind != 'bool' else f'CAST({x} AS INT)'} AS DECIMAL(38, 10))"
        return f"TRY_CAST({v} AS {own.upper()})", f"({v} IS NULL OR {v} <> FLOOR({v}) OR TRY_CAST({v} AS {own.upper()}) IS NULL)"
    if own == "double":
        return f"TRY_CAST({x} AS DOUBLE)", f"TRY_CAST({x} AS DOUBLE) IS NULL"
    if own.startswith("decimal"):
        v = f"TRY_CAST({text(x)} AS DECIMAL(38, 18))"
        return f"TRY_CAST({v} AS {own.upper()})", f"({v} IS NULL OR TRY_CAST({v} AS {own.upper()}) IS NULL OR TRY_CAST({v} AS {own.upper()}) <> {v})"
    if own == "binary":
        return (x.text if x.kind == "blob" else f"CAST({text(x)} AS BINARY)"), "TRUE" if x.kind != "blob" else (f"LENGTH({x}) > {t.args[0]}" if t.args else "FALSE")
    if own == GEOM:
        v = x.text if x.kind == "geom" else f"sg_geom({text(x)})"
        return v, f"({v}).kind <> 'POINT'" if n.startswith("POINT") else "FALSE"
    s = text(x)
    if n.startswith(("CHAR", "VARCHAR", "NCHAR", "NVARCHAR")):
        return s, f"OCTET_LENGTH({s}) > {t.args[0]}" if t.args else "FALSE"
    if n.startswith("BIT"):
        size = f" OR LENGTH({s}) {'>' if 'VARYING' in n else '<>'} {t.args[0]}" if t.args else ""
        return s, f"(NOT {s} RLIKE '^[01]*$'{size})"
    if n.startswith(("UUID", "GUID")):
        return s, f"LENGTH({s}) <> 36"
    if n.startswith("XML"):
        return s, f"(NOT {s} RLIKE '^[\\\\s]*<' OR TRY_CAST(SIZE(REGEXP_EXTRACT_ALL({s}, '<[A-Za-z][^>]*[^/]>|<[A-Za-z]>', 0)) AS INT) <> SIZE(REGEXP_EXTRACT_ALL({s}, '</', 0)))"
    if n.startswith("INTERVAL"):
        return s, f"NOT {s} RLIKE '^[-+0-9A-Za-z:., ]*[0-9][-+0-9A-Za-z:., ]*$'"
    if n.startswith(("DATE", "TIME")):
        return s, f"NOT {s} RLIKE '^[-+0-9:.TZ /]+$'"
    return s, "FALSE"
