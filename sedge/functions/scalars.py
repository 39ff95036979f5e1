"""Scalar functions of the dialect as Spark SQL text, built when a query is compiled.

Each entry takes the compiled arguments (text and kind) and gives the text and kind of the call. Kinds are int, real,
decimal, text, blob, bool, null, geom, row, date, ts and other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from sedge.plans.lexer import DialectError


@dataclass(frozen=True)
class Sql:
    text: str
    kind: str
    literal: object = None  # the value of a literal

    def __str__(self) -> str:
        return self.text


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text(x: Sql) -> str:
    """x as a string."""
    if x.kind == "text":
        return x.text
    if x.kind == "bool":
        return f"CAST(CAST({x} AS INT) AS STRING)"
    if x.kind == "real":
        return f"sg_g({x})"
    if x.kind == "geom":
        return f"sg_astext({x})"
    return f"CAST({x} AS STRING)"


def binary(x: Sql) -> str:
    return x.text if x.kind == "blob" else f"CAST({text(x)} AS BINARY)"


def number(x: Sql) -> str:
    return f"CAST({x} AS DOUBLE)"


def whole(x: Sql) -> str:
    return x.text if x.kind == "int" else f"CAST({x} AS BIGINT)"


def literal(x: Sql, what: str) -> str:
    if not isinstance(x.literal, str):
        raise DialectError(f"{what} must be a string literal")
    return x.literal


# dates -----------------------------------------------------------------------------------------------------------------

_UNIT = re.compile(r"\s*([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second|month|year)s?\s*$", re.I)
_START = {"start of day": "DAY", "start of month": "MONTH", "start of year": "YEAR"}
_LENGTH = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}


def moment(args: list[Sql]) -> str:
    """The time value and its modifiers as a timestamp without zone, NULL if either can't be read."""
    if not args:
        args = [Sql("'now'", "text", "now")]
    x, mods = args[0], [literal(a, "a time modifier").strip().lower() for a in args[1:]]
    if mods[:1] == ["unixepoch"]:
        out, mods = f"sg_micros(CAST(CAST({x} AS DOUBLE) * 1e6 AS BIGINT))", mods[1:]
    elif x.kind in ("int", "real", "decimal"):
        out = f"sg_micros(CAST(ROUND((CAST({x} AS DOUBLE) - 2440587.5D) * 86400000000D) AS BIGINT))"
    elif x.kind in ("ts", "date"):
        out = f"CAST({x} AS TIMESTAMP_NTZ)"
    elif isinstance(x.literal, str) and x.literal.lower() == "now":
        out = "CAST(CURRENT_TIMESTAMP() AS TIMESTAMP_NTZ)"
    else:
        out = f"sg_moment({text(x)})"
    for m in mods:
        if m in _START:
            out = f"CAST(DATE_TRUNC('{_START[m]}', {out}) AS TIMESTAMP_NTZ)"
        elif (found := _UNIT.match(m)) and found[2] in _LENGTH:
            out = f"sg_micros(unix_micros(CAST({out} AS TIMESTAMP)) + {round(float(found[1]) * _LENGTH[found[2]])}L)"
        elif found:
            months = int(float(found[1])) * (12 if found[2] == "year" else 1)
            out = f"sg_add_months({out}, {months})"
        else:
            return "CAST(NULL AS TIMESTAMP_NTZ)"
    return out


_FORMATS = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD"}


def strftime(fmt: str, at: str) -> str:
    pieces: list[str] = []
    i = 0
    while i < len(fmt):
        c = fmt[i]
        if c == "%" and i + 1 < len(fmt):
            i += 1
            f = fmt[i]
            if f in _FORMATS:
                pieces.append(f"DATE_FORMAT({at}, '{_FORMATS[f]}')")
            elif f == "s":
                pieces.append(f"CAST(unix_seconds(CAST({at} AS TIMESTAMP)) AS STRING)")
            elif f == "J":
                pieces.append(f"CAST(sg_julian({at}) AS STRING)")
            elif f == "f":
                pieces.append(f"DATE_FORMAT({at}, 'ss.SSS')")
            elif f == "w":
                pieces.append(f"CAST(DAYOFWEEK({at}) - 1 AS STRING)")
            else:
                pieces.append(quoted(f if f == "%" else "%" + f))
        else:
            pieces.append(quoted(c))
        i += 1
    return f"CONCAT({', '.join(pieces)})" if pieces else "''"


# formatted text ----------------------------------------------------------------------------------------------------------

_SPEC = re.compile(r"%([-+ 0#]*)(\d*)(?:\.(\d+))?(?:l|ll|h)?([diuxXofeEgGscqQw%])")


def printf(args: list[Sql]) -> Sql:
    fmt, rest, pieces, at = literal(args[0], "a format"), list(args[1:]), [], 0

    def padded(x: str, flags: str, width: str) -> str:
        if not width:
            return x
        return f"RPAD({x}, GREATEST({width}, LENGTH({x})), ' ')" if "-" in flags else f"LPAD({x}, GREATEST({width}, LENGTH({x})), ' ')"

    for m in _SPEC.finditer(fmt):
        if m.start() > at:
            pieces.append(quoted(fmt[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            pieces.append("'%'")
            continue
        x = rest.pop(0) if rest else Sql("NULL", "null")
        if kind in "diu":
            pieces.append(f"FORMAT_STRING('%{flags}{width}d', COALESCE(CAST({x} AS BIGINT), 0L))")
        elif kind in "xXo":
            pieces.append(f"FORMAT_STRING('%{flags.replace(' ', '').replace('+', '')}{width}{kind}', COALESCE(CAST({x} AS BIGINT), 0L))")
        elif kind in "feE":
            pieces.append(f"FORMAT_STRING('%{flags}{width}.{precision or 6}{kind}', COALESCE(CAST({x} AS DOUBLE), 0D))")
        elif kind in "gG":
            pieces.append(padded(f"sg_g(COALESCE(CAST({x} AS DOUBLE), 0D))", flags, width))
        elif kind == "c":
            pieces.append(padded(f"SUBSTRING(COALESCE({text(x)}, ''), 1, 1)", flags, width))
        else:
            own = f"COALESCE({text(x)}, '')"
            if kind in "qQ":
                own = f"REPLACE({own}, '\\'', '\\'\\'')"
            elif kind == "w":
                own = f"REPLACE({own}, '\"', '\"\"')"
            if precision:
                own = f"SUBSTRING({own}, 1, {precision})"
            if kind == "Q":
                own = f"CASE WHEN {x} IS NULL THEN 'NULL' ELSE CONCAT('\\'', {own}, '\\'') END"
            pieces.append(padded(own, flags, width))
    if at < len(fmt):
        pieces.append(quoted(fmt[at:]))
    return Sql(f"CONCAT({', '.join(pieces)})" if pieces else "''", "text")


def quote(x: Sql) -> Sql:
    if x.kind == "null":
        return Sql("'NULL'", "text")
    if x.kind == "blob":
        own = f"CONCAT('X\\'', LOWER(HEX({x})), '\\'')"
    elif x.kind in ("int", "real", "decimal", "bool"):
        own = text(x)
    else:
        own = f"CONCAT('\\'', REPLACE({text(x)}, '\\'', '\\'\\''), '\\'')"
    return Sql(f"COALESCE({own}, 'NULL')", "text")


_TYPEOF = {"int": "integer", "bool": "integer", "real": "real", "decimal": "text", "text": "text", "blob": "blob", "geom": "blob", "row": "composite", "null": "null"}


def typeof(x: Sql) -> Sql:
    return Sql("'null'" if x.kind == "null" else f"CASE WHEN {x} IS NULL THEN 'null' ELSE '{_TYPEOF.get(x.kind, 'text')}' END", "text")


# JSON --------------------------------------------------------------------------------------------------------------------


def json_value(x: Sql) -> str:
    if x.kind == "null":
        return "'null'"
    if x.kind in ("int", "decimal"):
        own = f"CAST({x} AS STRING)"
    elif x.kind == "bool":
        own = f"CAST(CAST({x} AS INT) AS STRING)"
    elif x.kind == "real":
        own = f"sg_g({x})"
    elif x.kind == "blob":
        own = f"CONCAT('\"', LOWER(HEX({x})), '\"')"
    else:
        own = f"sg_json_text({text(x)})"
    return f"COALESCE({own}, 'null')"


def json_object(args: list[Sql]) -> Sql:
    pairs = [f"CONCAT(sg_json_string({text(k)}), ':', {json_value(v)})" for k, v in zip(args[::2], args[1::2], strict=False)]
    return Sql(f"CONCAT('{{', CONCAT_WS(',', {', '.join(pairs)}), '}}')" if pairs else "'{}'", "text")


def json_array(args: list[Sql]) -> Sql:
    return Sql(f"CONCAT('[', CONCAT_WS(',', {', '.join(map(json_value, args))}), ']')" if args else "'[]'", "text")


def json_raw(doc: str, path: Sql) -> str:
    """What is at the path, as JSON text."""
    return f"TO_JSON(TRY_VARIANT_GET(TRY_PARSE_JSON({doc}), {quoted(literal(path, 'a JSON path'))}, 'variant'))"


def json_extract(args: list[Sql]) -> Sql:
    doc = text(args[0])
    if len(args) == 2:
        if isinstance(args[1].literal, str):  # truth values are 1 and 0, the texts "true" and "false" aren't
            return Sql(f"sg_json_got(GET_JSON_OBJECT({doc}, {text(args[1])}), {json_raw(doc, args[1])})", "text")
        return Sql(f"sg_json_get({doc}, {text(args[1])})", "text")
    return Sql(f"CONCAT('[', CONCAT_WS(',', {', '.join(f"COALESCE({json_raw(doc, p)}, 'null')" for p in args[1:])}), ']')", "text")


# the table -----------------------------------------------------------------------------------------------------------------

Maker = Callable[[list[Sql]], Sql]


def _fixed(pattern: str, kind: str, *how) -> Maker:
    """A pattern with {0}, {1} ... and how each argument is read."""
    return lambda a: Sql(pattern.format(*(h(x) for h, x in zip(how, a, strict=False))), kind)


def _same(name: str) -> Maker:
    def made(a: list[Sql]) -> Sql:
        kinds = {x.kind for x in a} - {"null"}
        kind = kinds.pop() if len(kinds) == 1 else "real" if kinds <= {"int", "real", "decimal"} and kinds else "text"
        own = [text(x) if kind == "text" else x.text for x in a]
        return Sql(f"{name}({', '.join(own)})", kind)

    return made


def _trim(how: str, regex: str) -> Maker:
    def made(a: list[Sql]) -> Sql:
        if len(a) == 1:
            return Sql(f"REGEXP_REPLACE({text(a[0])}, '{regex}', '')", "text")
        return Sql(f"CASE WHEN {text(a[1])} = '' THEN {text(a[0])} ELSE TRIM({how} {text(a[1])} FROM {text(a[0])}) END", "text")

    return made


def _round(a: list[Sql]) -> Sql:
    return Sql(f"ROUND({number(a[0])}{', ' + whole(a[1]).replace('BIGINT', 'INT') if len(a) > 1 else ''})", "real")


def _substr(a: list[Sql]) -> Sql:
    n = f"CAST({a[2]} AS INT)" if len(a) > 2 else "2147483647"
    return Sql(f"sg_substr({text(a[0])}, CAST({a[1]} AS INT), {n})", "text")


def _char(a: list[Sql]) -> Sql:
    return Sql("CONCAT(" + ", ".join(f"DECODE(UNHEX(LPAD(HEX({whole(x)}), 8, '0')), 'UTF-32')" for x in a) + ")" if a else "''", "text")


def _hex(a: list[Sql]) -> Sql:
    return Sql(f"LOWER(HEX({binary(a[0])}))", "text")


def _abs(a: list[Sql]) -> Sql:
    return Sql(f"ABS({a[0] if a[0].kind in ('int', 'real', 'decimal') else number(a[0])})", a[0].kind if a[0].kind in ("int", "real", "decimal") else "real")


def _row(a: list[Sql]) -> Sql:
    return Sql("NAMED_STRUCT(" + ", ".join(f"'_{i}', {x}" for i, x in enumerate(a, 1)) + ")", "row", tuple(a))


def _field(a: list[Sql]) -> Sql:
    made, i = a[0].literal, a[1].literal
    if not isinstance(i, int):
        raise DialectError("composite_extract takes a literal position")
    if isinstance(made, tuple):
        return made[i - 1] if 1 <= i <= len(made) else Sql("NULL", "null")
    return Sql(f"{a[0]}._{i}", "other")


def _aes(name: str, mode: str) -> Maker:
    def made(a: list[Sql]) -> Sql:
        key = f"UNHEX(SHA2({text(a[1])}, 256))"
        iv = f"SUBSTRING(UNHEX(SHA2(CONCAT({key}, X'01'), 256)), 1, 16)"
        if name == "encrypt":
            return Sql(f"SUBSTRING(AES_ENCRYPT({binary(a[0])}, {key}, 'CBC', 'PKCS', {iv}), 17)" if mode == "CBC" else f"AES_ENCRYPT({binary(a[0])}, {key}, 'GCM')", "blob")
        return Sql(f"TRY_CAST(TRY_AES_DECRYPT({f'CONCAT({iv}, {a[0]})' if mode == 'CBC' else a[0]}, {key}, '{mode}'{', ' + quoted('PKCS') if mode == 'CBC' else ''}) AS STRING)", "text")

    return made


def _digest(name: str) -> Maker:
    def made(a: list[Sql]) -> Sql:
        own = f"COALESCE({binary(a[0])}, CAST('' AS BINARY))"
        return Sql({"md5": f"MD5({own})", "sha1": f"SHA1({own})", "crc32": f"CRC32({own})"}.get(name, f"SHA2({own}, {name[3:]})"), "int" if name == "crc32" else "text")

    return made


FUNCTIONS: dict[str, tuple[int, int, Maker]] = {
    # name: least and most arguments (-1: any number), maker
    "length": (1, 1, lambda a: Sql(f"CAST(LENGTH({a[0] if a[0].kind == 'blob' else text(a[0])}) AS BIGINT)", "int")),
    "upper": (1, 1, _fixed("UPPER({0})", "text", text)),
    "lower": (1, 1, _fixed("LOWER({0})", "text", text)),
    "substr": (2, 3, _substr), "substring": (2, 3, _substr),
    "trim": (1, 2, _trim("BOTH", r"^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$")),
    "ltrim": (1, 2, _trim("LEADING", r"^[ \\t\\n\\x0B\\f\\r]+")),
    "rtrim": (1, 2, _trim("TRAILING", r"[ \\t\\n\\x0B\\f\\r]+$")),
    "replace": (3, 3, lambda a: Sql(f"CASE WHEN COALESCE({text(a[1])}, '') = '' THEN {text(a[0])} ELSE REPLACE({text(a[0])}, {text(a[1])}, COALESCE({text(a[2])}, '')) END", "text")),
    "instr": (2, 2, _fixed("CAST(COALESCE(INSTR({0}, {1}), 0) AS BIGINT)", "int", text, text)),
    "char": (0, -1, _char),
    "unicode": (1, 1, _fixed("ASCII(NULLIF({0}, ''))", "int", text)),
    "quote": (1, 1, lambda a: quote(a[0])),
    "printf": (1, -1, printf), "format": (1, -1, printf),
    "hex": (1, 1, _hex),
    "unhex": (1, 1, _fixed("UNHEX({0})", "blob", text)),
    "typeof": (1, 1, lambda a: typeof(a[0])),
    "coalesce": (1, -1, _same("COALESCE")), "ifnull": (2, 2, _same("COALESCE")),
    "nullif": (2, 2, lambda a: Sql(f"NULLIF({a[0]}, {a[1]})", a[0].kind)),
    "abs": (1, 1, _abs), "round": (1, 2, _round),
    "min": (2, -1, _same("LEAST")), "max": (2, -1, _same("GREATEST")), "least": (1, -1, _same("LEAST")), "greatest": (1, -1, _same("GREATEST")),
    "random": (0, 0, lambda a: Sql("XXHASH64(UUID())", "int")),
    "randomblob": (1, 1, lambda a: Sql(f"sg_randomblob(CAST({a[0]} AS INT))", "blob")),
    "version": (0, 0, lambda a: Sql("'0.1.0'", "text")),
    "date": (0, -1, lambda a: Sql(f"DATE_FORMAT({moment(a)}, 'yyyy-MM-dd')", "text")),
    "time": (0, -1, lambda a: Sql(f"DATE_FORMAT(sg_rounded({moment(a)}), 'HH:mm:ss')", "text")),
    "datetime": (0, -1, lambda a: Sql(f"DATE_FORMAT(sg_rounded({moment(a)}), 'yyyy-MM-dd HH:mm:ss')", "text")),
    "julianday": (0, -1, lambda a: Sql(f"sg_julian({moment(a)})", "real")),
    "unixepoch": (0, -1, lambda a: Sql(f"unix_seconds(CAST({moment(a)} AS TIMESTAMP))", "int")),
    "strftime": (1, -1, lambda a: Sql(strftime(literal(a[0], "a format"), moment(a[1:])), "text")),
    "current_date": (0, 0, lambda a: Sql("DATE_FORMAT(CURRENT_TIMESTAMP(), 'yyyy-MM-dd')", "text")),
    "current_time": (0, 0, lambda a: Sql("DATE_FORMAT(CURRENT_TIMESTAMP(), 'HH:mm:ss')", "text")),
    "current_timestamp": (0, 0, lambda a: Sql("DATE_FORMAT(CURRENT_TIMESTAMP(), 'yyyy-MM-dd HH:mm:ss')", "text")),
    "json": (1, 1, _fixed("sg_json({0})", "text", text)),
    "json_valid": (1, 1, _fixed("sg_json_valid({0})", "int", text)),
    "json_object": (0, -1, json_object), "json_array": (0, -1, json_array), "json_extract": (2, -1, json_extract),
    "json_type": (1, 2, lambda a: Sql(f"sg_json_kind({json_raw(text(a[0]), a[1] if len(a) > 1 else Sql(quoted('$'), 'text', '$'))})", "text")),
    "json_array_length": (1, 2, lambda a: Sql(f"sg_json_array_length({text(a[0])}, {text(a[1]) if len(a) > 1 else quoted('$')})", "int")),
    "md5": (1, 1, _digest("md5")), "sha1": (1, 1, _digest("sha1")), "sha256": (1, 1, _digest("sha256")), "sha384": (1, 1, _digest("sha384")), "sha512": (1, 1, _digest("sha512")), "crc32": (1, 1, _digest("crc32")),
    "hmac_sha256": (2, 2, _fixed("sg_hmac({0}, {1})", "text", binary, binary)),
    "base64_encode": (1, 1, _fixed("REPLACE(BASE64({0}), '\\r\\n', '')", "text", binary)),
    "base64_decode": (1, 1, _fixed("UNBASE64({0})", "blob", text)),
    "aes_encrypt": (2, 2, _aes("encrypt", "CBC")), "aes_decrypt": (2, 2, _aes("decrypt", "CBC")),
    "aes_gcm_encrypt": (2, 2, _aes("encrypt", "GCM")), "aes_gcm_decrypt": (2, 2, _aes("decrypt", "GCM")),
    "pbkdf2": (4, 4, lambda a: Sql(f"sg_pbkdf2({text(a[0])}, {text(a[1])}, CAST({a[2]} AS INT), CAST({a[3]} AS INT))", "text")),
    "row": (1, -1, _row), "composite": (1, -1, _row),
    "composite_extract": (2, 2, _field),
    "composite_count": (1, 1, lambda a: Sql(str(len(a[0].literal)) if isinstance(a[0].literal, tuple) else f"SIZE(JSON_OBJECT_KEYS(TO_JSON({a[0]}, MAP('ignoreNullFields', 'false'))))", "int")),
    "st_point": (2, 2, _fixed("sg_point({0}, {1})", "geom", number, number)),
    "st_astext": (1, 1, lambda a: Sql(f"sg_astext({a[0]})", "text")), "astext": (1, 1, lambda a: Sql(f"sg_astext({a[0]})", "text")),
    "st_x": (1, 1, lambda a: Sql(f"sg_x({a[0]})", "real")), "st_y": (1, 1, lambda a: Sql(f"sg_y({a[0]})", "real")),
    "st_distance": (2, 2, lambda a: Sql(f"sg_distance({a[0]}, {a[1]})", "real")),
    "st_dwithin": (3, 3, lambda a: Sql(f"CAST(sg_distance({a[0]}, {a[1]}) <= CAST({a[2]} AS DOUBLE) AS INT)", "int")),
    "st_contains": (2, 2, lambda a: Sql(f"CAST(sg_contains({a[0]}, {a[1]}) AS INT)", "int")),
    "st_within": (2, 2, lambda a: Sql(f"CAST(sg_contains({a[1]}, {a[0]}) AS INT)", "int")),
    "st_intersects": (2, 2, lambda a: Sql(f"CAST(sg_intersects({a[0]}, {a[1]}) AS INT)", "int")),
    "sqrt": (1, 1, _fixed("SQRT({0})", "real", number)), "floor": (1, 1, _fixed("FLOOR({0})", "int", number)), "ceil": (1, 1, _fixed("CEIL({0})", "int", number)), "ceiling": (1, 1, _fixed("CEIL({0})", "int", number)),
    "power": (2, 2, _fixed("POWER({0}, {1})", "real", number, number)), "pow": (2, 2, _fixed("POWER({0}, {1})", "real", number, number)), "exp": (1, 1, _fixed("EXP({0})", "real", number)), "log": (1, 1, _fixed("LN({0})", "real", number)),
    "sin": (1, 1, _fixed("SIN({0})", "real", number)), "cos": (1, 1, _fixed("COS({0})", "real", number)), "mod": (2, 2, _fixed("TRY_MOD({0}, {1})", "real", number, number)),
}
for _name in ("st_geomfromtext", "st_geometryfromtext", "geomfromtext"):
    FUNCTIONS[_name] = (1, 1, _fixed("sg_geom({0})", "geom", text))
