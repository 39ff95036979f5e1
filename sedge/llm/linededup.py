"""Line dedup over overlapping three-line windows.

Lines that hold more than white space are hashed with `window - 1` successors; a window seen before, anywhere in the
corpus (order: id, then position), is a later occurrence, and the lines that later occurrences cover, merged, go.

Only hashes travel in the global step, with partial aggregation before the shuffle. The join back to occurrences is with
windows that repeat only, and is salted, so one window that half of all documents hold is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def windows(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), p (number of the first line among those not blank), h1, h2, at (numbers of the covered lines)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(_trimmed(x).alias("t"), i.alias("i")))
    kept = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), F.filter(lines, lambda x: x["t"] != "").alias("kept"))
    starts = F.when(F.size("kept") >= window, F.sequence(F.lit(1), F.size("kept") - (window - 1))).otherwise(F.array().cast("array<int>"))

    def made(i: Column) -> Column:
        own = [F.element_at("kept", i + k) for k in range(window)]
        hashed = [x["t"] for x in own]
        return F.struct((i - 1).alias("p"), F.xxhash64(*hashed).alias("h1"), F.xxhash64(F.lit(1), *hashed).alias("h2"), F.array(*[x["i"] for x in own]).alias("at"))

    return kept.select("doc_id", "th", F.explode(F.transform(starts, made)).alias("w")).select("doc_id", "th", "w.*")


def removed_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, gone: the numbers (from 0) of the lines to remove, of documents that have any."""
    found = windows(docs, window, id_col, text_col)
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "p")).alias("first"), F.count("*").alias("n")).where("n > 1")
    spread = first.select("h1", "h2", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "p"), F.lit(SALTS)).cast("int"))
    later = salted.join(spread, ["h1", "h2", "salt"]).where(~(F.struct("doc_id", "p").eqNullSafe(F.col("first"))))
    return later.select("doc_id", "th", F.explode("at").alias("i")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("i")).alias("gone"))


def dedup(docs: DataFrame, window: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col rewritten and n_lines, n_removed, removed_lines ("3,4,5") added; clashing columns are replaced.

    Null and empty texts, and those with fewer lines than a window, stay as they are (a null text stays null). Blank lines
    are neither hashed nor removed. Rows that share id and text are the same document: the first occurrence in one is in
    both. A null id comes first in the order. A document may lose all its lines and is then empty. An empty table gives an empty one.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed", "removed_lines", "__th", "__gone")])
    gone = removed_lines(base, window, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("th").alias("__h"), F.col("gone").alias("__gone"))
    keyed = base.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    both = keyed.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__h")), "left")
    lines = F.split(F.col(text_col), "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    n_lines = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(F.size(F.split(F.col(text_col), "\n")))
    return both.withColumns({
        "n_lines": n_lines.cast("long"),
        "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "removed_lines": F.coalesce(F.array_join(F.col("__gone").cast("array<string>"), ","), F.lit("")),
        text_col: F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left),
    }).drop("__th", "__gone", "__id", "__h")


def oracle(window: int = 3) -> str:
    """The digest columns of op9 in DuckDB SQL, for windows of three lines."""
    assert window == 3
    return r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
    ), kept AS (
        SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT doc_id, i, regexp_replace(line, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS t FROM lines) WHERE t <> ''
    ), w AS (
        SELECT a.doc_id, a.p, a.t || chr(10) || b.t || chr(10) || c.t AS t, a.i AS i1, b.i AS i2, c.i AS i3
        FROM kept a JOIN kept b ON b.doc_id = a.doc_id AND b.p = a.p + 1 JOIN kept c ON c.doc_id = a.doc_id AND c.p = a.p + 2
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, p) AS k FROM w
    ), gone AS (
        SELECT DISTINCT doc_id, unnest([i1, i2, i3]) AS i FROM ranked WHERE k > 1
    ), left_over AS (
        SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM lines l ANTI JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
    ), lost AS (
        SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS at FROM gone GROUP BY doc_id
    )
    SELECT d.doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
           coalesce(x.n, 0)::BIGINT AS n_removed, coalesce(x.at, '') AS removed_lines, sha256(coalesce(o.text, '')) AS clean_sha256
    FROM documents d LEFT JOIN lost x USING (doc_id) LEFT JOIN left_over o USING (doc_id)
    """
