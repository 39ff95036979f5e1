"""Helper functions as Spark SQL functions, which Catalyst inlines into the plan; the few Python ones are vectorised."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

GEOM = "STRUCT<kind: STRING, rings: ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>"



# Texts rather than functions where a lambda's variable is read, which SQL functions can't be given.
def _plain(x: str) -> str:
    return rf"REGEXP_REPLACE(REGEXP_REPLACE({x}, '(\\.[0-9]*?)0+$', '$1'), '\\.$', '')"


def _g(x: str) -> str:
    """Six significant digits."""
    fixed = _plain(f"FORMAT_STRING(CONCAT('%.', CAST(GREATEST(0, 5 - FLOOR(LOG10(ABS({x})))) AS STRING), 'f'), {x})")
    return f"""(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0' WHEN ISNAN({x}) OR ABS({x}) = DOUBLE('Infinity') THEN CAST({x} AS STRING)
        WHEN ABS({x}) >= 0.0001D AND ABS({x}) < 999999.5D THEN {fixed} ELSE REGEXP_REPLACE(FORMAT_STRING('%.5e', {x}), '[.]?0*e', 'e') END)"""


def _line(t: str) -> str:
    return rf"TRANSFORM(SPLIT({t}, ','), p -> NAMED_STRUCT('x', CAST(SPLIT(TRIM(p), '\\s+')[0] AS DOUBLE), 'y', CAST(SPLIT(TRIM(p), '\\s+')[1] AS DOUBLE)))"


def _inside(r: str, px: str, py: str) -> str:
    """Whether a ray from the point crosses the ring an odd number of times."""
    a, b = f"{r}[i]", f"{r}[(i + 1) % SIZE({r})]"
    return f"""(SIZE(FILTER(SEQUENCE(0, SIZE({r}) - 1), i -> ({a}.y > {py}) <> ({b}.y > {py})
        AND {px} < ({b}.x - {a}.x) * ({py} - {a}.y) / (CASE WHEN {b}.y = {a}.y THEN 1D ELSE {b}.y - {a}.y END) + {a}.x)) % 2 = 1)"""


def _line_text(r: str) -> str:
    return f"ARRAY_JOIN(TRANSFORM({r}, p -> CONCAT({_g('p.x')}, ' ', {_g('p.y')})), ', ')"


def _middle(g: str, axis: str) -> str:
    return f"((ARRAY_MIN(TRANSFORM(FLATTEN({g}.rings), p -> p.{axis})) + ARRAY_MAX(TRANSFORM(FLATTEN({g}.rings), p -> p.{axis}))) / 2)"


_BODY = r"REGEXP_EXTRACT(w, '\\((.*)\\)', 1)"

#: name and parameters, result, body
SQL = [
    ("sg_micros(m BIGINT)", "TIMESTAMP_NTZ", "TIMESTAMP_NTZ '1970-01-01 00:00:00' + MAKE_DT_INTERVAL(0, 0, 0, CAST(CAST(m AS DECIMAL(20, 0)) / 1000000 AS DECIMAL(18, 6)))"),
    ("sg_moment(x STRING)", "TIMESTAMP_NTZ", r"""CASE
        WHEN LOWER(TRIM(x)) = 'now' THEN CAST(CURRENT_TIMESTAMP() AS TIMESTAMP_NTZ)
        WHEN TRIM(x) RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$' THEN TRY_CAST(TRIM(x) AS TIMESTAMP_NTZ)
        WHEN TRIM(x) RLIKE '^[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?$' THEN TRY_CAST(CONCAT('2000-01-01 ', TRIM(x)) AS TIMESTAMP_NTZ)
        WHEN TRIM(x) RLIKE '^[0-9]+([.][0-9]+)?$' THEN sg_micros(CAST(ROUND((TRY_CAST(x AS DOUBLE) - 2440587.5D) * 86400000000D) AS BIGINT)) END"""),
    ("sg_rounded(t TIMESTAMP_NTZ)", "TIMESTAMP_NTZ", "CAST(DATE_TRUNC('SECOND', t + INTERVAL '0.5' SECOND) AS TIMESTAMP_NTZ)"),
    ("sg_julian(t TIMESTAMP_NTZ)", "DOUBLE", "unix_micros(CAST(t AS TIMESTAMP)) / 86400000000D + 2440587.5D"),
    ("sg_add_months(t TIMESTAMP_NTZ, n INT)", "TIMESTAMP_NTZ", "CAST(DATE_ADD(ADD_MONTHS(TRUNC(t, 'MM'), n), DAY(t) - 1) AS TIMESTAMP_NTZ) + (t - CAST(DATE_TRUNC('DAY', t) AS TIMESTAMP_NTZ))"),
    ("sg_substr(s STRING, p INT, n INT)", "STRING", "SUBSTRING(s, GREATEST(1, IF(p < 0, LENGTH(s) + p + 1, p)), GREATEST(n, 0))"),
    ("sg_g(x DOUBLE)", "STRING", _g("x")),
    ("sg_json_valid(x STRING)", "INT", "CAST(x IS NOT NULL AND TRY_PARSE_JSON(x) IS NOT NULL AS INT)"),
    ("sg_json(x STRING)", "STRING", "CASE WHEN TRY_PARSE_JSON(x) IS NOT NULL THEN x END"),
    ("sg_json_string(x STRING)", "STRING", r"""CASE WHEN x IS NULL THEN NULL ELSE SUBSTRING(TO_JSON(NAMED_STRUCT('v', x)), 6, LENGTH(TO_JSON(NAMED_STRUCT('v', x))) - 6) END"""),
    ("sg_json_text(x STRING)", "STRING", r"CASE WHEN x RLIKE '^[\\[{]' AND TRY_PARSE_JSON(x) IS NOT NULL THEN x ELSE sg_json_string(x) END"),
    ("sg_json_kind(r STRING)", "STRING", """CASE WHEN r IS NULL THEN NULL WHEN r IN ('null', 'true', 'false') THEN r WHEN r LIKE '{%' THEN 'object' WHEN r LIKE '[%' THEN 'array' WHEN r LIKE '"%' THEN 'text'
        WHEN r RLIKE '^-?[0-9]+$' THEN 'integer' ELSE 'real' END"""),
    ("sg_json_get(x STRING, p STRING)", "STRING", "CASE GET_JSON_OBJECT(x, p) WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE GET_JSON_OBJECT(x, p) END"),
    ("sg_json_got(g STRING, r STRING)", "STRING", "CASE r WHEN 'true' THEN '1' WHEN 'false' THEN '0' ELSE g END"),
    ("sg_json_array_length(x STRING, p STRING)", "INT", "COALESCE(JSON_ARRAY_LENGTH(GET_JSON_OBJECT(x, p)), 0)"),
    ("sg_pad(k BINARY, b INT)", "BINARY", "UNHEX(ARRAY_JOIN(TRANSFORM(SEQUENCE(1, 64), i -> LPAD(HEX(COALESCE(CAST(CONV(NULLIF(HEX(SUBSTRING(k, i, 1)), ''), 16, 10) AS INT), 0) ^ b), 2, '0')), ''))"),
    ("sg_hmac(k BINARY, m BINARY)", "STRING", "SHA2(CONCAT(sg_pad(IF(LENGTH(k) > 64, UNHEX(SHA2(k, 256)), k), 92), UNHEX(SHA2(CONCAT(sg_pad(IF(LENGTH(k) > 64, UNHEX(SHA2(k, 256)), k), 54), m), 256))), 256)"),
    ("sg_geom(w STRING)", GEOM, rf"""CASE WHEN w IS NULL THEN NULL
        WHEN UPPER(TRIM(w)) RLIKE '^POINT\\s*\\(\\s*[-+0-9.E]+\\s+[-+0-9.E]+\\s*\\)$' THEN NAMED_STRUCT('kind', 'POINT', 'rings', ARRAY({_line(_BODY)}))
        WHEN UPPER(TRIM(w)) RLIKE '^LINESTRING\\s*\\([-+0-9.E,\\s]+\\)$' THEN NAMED_STRUCT('kind', 'LINESTRING', 'rings', ARRAY({_line(_BODY)}))
        WHEN UPPER(TRIM(w)) RLIKE '^POLYGON\\s*\\(\\s*\\([-+0-9.E,()\\s]+\\)\\s*\\)$' THEN NAMED_STRUCT('kind', 'POLYGON', 'rings', TRANSFORM(SPLIT(REGEXP_EXTRACT(w, '\\(\\s*\\((.*)\\)\\s*\\)', 1), '\\)\\s*,\\s*\\('), r -> {_line('r')}))
        ELSE CAST(RAISE_ERROR(CONCAT('not a geometry: ', w)) AS STRUCT<kind: STRING, rings: ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>>) END"""),
    ("sg_point(x DOUBLE, y DOUBLE)", GEOM, "NAMED_STRUCT('kind', 'POINT', 'rings', ARRAY(ARRAY(NAMED_STRUCT('x', x, 'y', y))))"),
    (f"sg_minx(g {GEOM})", "DOUBLE", "ARRAY_MIN(TRANSFORM(FLATTEN(g.rings), p -> p.x))"),
    (f"sg_maxx(g {GEOM})", "DOUBLE", "ARRAY_MAX(TRANSFORM(FLATTEN(g.rings), p -> p.x))"),
    (f"sg_miny(g {GEOM})", "DOUBLE", "ARRAY_MIN(TRANSFORM(FLATTEN(g.rings), p -> p.y))"),
    (f"sg_maxy(g {GEOM})", "DOUBLE", "ARRAY_MAX(TRANSFORM(FLATTEN(g.rings), p -> p.y))"),
    (f"sg_midx(g {GEOM})", "DOUBLE", "(sg_minx(g) + sg_maxx(g)) / 2"),
    (f"sg_midy(g {GEOM})", "DOUBLE", "(sg_miny(g) + sg_maxy(g)) / 2"),
    (f"sg_x(g {GEOM})", "DOUBLE", "CASE WHEN g.kind = 'POINT' THEN g.rings[0][0].x END"),
    (f"sg_y(g {GEOM})", "DOUBLE", "CASE WHEN g.kind = 'POINT' THEN g.rings[0][0].y END"),
    (f"sg_distance(a {GEOM}, b {GEOM})", "DOUBLE", "SQRT(POWER(sg_midx(a) - sg_midx(b), 2) + POWER(sg_midy(a) - sg_midy(b), 2))"),
    (f"sg_intersects(a {GEOM}, b {GEOM})", "BOOLEAN", "sg_minx(a) <= sg_maxx(b) AND sg_maxx(a) >= sg_minx(b) AND sg_miny(a) <= sg_maxy(b) AND sg_maxy(a) >= sg_miny(b)"),
    (f"sg_contains(a {GEOM}, b {GEOM})", "BOOLEAN", f"""CASE WHEN a IS NULL OR b IS NULL THEN NULL
        WHEN a.kind = 'POLYGON' THEN {_inside('a.rings[0]', _middle('b', 'x'), _middle('b', 'y'))} AND NOT EXISTS(SLICE(a.rings, 2, SIZE(a.rings)), r -> {_inside('r', _middle('b', 'x'), _middle('b', 'y'))})
        ELSE sg_midx(b) BETWEEN sg_minx(a) AND sg_maxx(a) AND sg_midy(b) BETWEEN sg_miny(a) AND sg_maxy(a) END"""),
    (f"sg_astext(g {GEOM})", "STRING", f"CASE WHEN g IS NULL THEN NULL WHEN g.kind = 'POLYGON' THEN CONCAT('POLYGON(', ARRAY_JOIN(TRANSFORM(g.rings, r -> CONCAT('(', {_line_text('r')}, ')')), ', '), ')') ELSE CONCAT(g.kind, '(', {_line_text('g.rings[0]')}, ')') END"),
]


def register(spark: SparkSession) -> None:
    """Make the helpers known to the session, once."""
    if spark.catalog.functionExists("sg_astext"):
        return
    left = list(SQL)
    for _ in range(len(SQL)):  # a helper may use others
        later = []
        for signature, result, body in left:
            try:
                spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
            except Exception as e:
                if "ROUTINE" not in str(e):
                    raise
                later.append((signature, result, body))
        if not later:
            break
        left = later

    @F.pandas_udf("string")
    def pbkdf2(password: pd.Series, salt: pd.Series, rounds: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or s is None else hashlib.pbkdf2_hmac("sha256", p.encode(), s.encode(), int(r), int(n)).hex() for p, s, r, n in zip(password, salt, rounds, length, strict=True)])

    @F.pandas_udf("binary")
    def randomblob(n: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(min(max(1, int(x)), 16 << 20)) for x in n])

    spark.udf.register("sg_pbkdf2", pbkdf2)
    spark.udf.register("sg_randomblob", randomblob.asNondeterministic())
