import hashlib

from pyspark.sql import functions as F

from sedge.llm import fingerprint
from tests.llm.helpers import docs, edge_rows


def expected(rows):
    own = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    out = []
    for n, (i, t) in enumerate(own):
        k = len(t) // 3
        after = own[(n + 1) % len(own)][1]
        out.append((i, len(t), hashlib.sha256((t[: len(t) - k] + after[:k]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edited_texts_of_odd_rows(spark):
    for blocks in (1, 3, 8):
        got = fingerprint.digests(docs(spark, edge_rows()), blocks=blocks).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == expected(edge_rows())


def test_equal_where_canonical_texts_are(spark):
    rows = [(1, "Straße  ﬁne"), (2, " strasse\nFINE "), (3, "éa"), (4, "éA"), (5, "other")]
    got = {r.doc_id: r for r in fingerprint.digests(docs(spark, rows)).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[5].fingerprint
    assert got[3].fingerprint == got[4].fingerprint
    assert got[2].near_next == 1.0 and got[5].near_next == 0.0
    assert all(0 <= r.near_edited <= 1 for r in got.values())


def test_collisions_are_told_apart(spark):
    rows = [(i, f"text number {i % 37}") for i in range(120)]
    got = fingerprint.digests(docs(spark, rows), bits=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.doc_id % 37)
    assert len(by) == 37 and all(len(x) == 1 for x in by.values())
    added = fingerprint.fingerprints(docs(spark, rows).withColumn("fingerprint", F.lit(1)), bits=3)
    assert added.select("fingerprint").distinct().count() == 37 and added.count() == 120


def test_empty_table_and_single_row(spark):
    assert fingerprint.digests(docs(spark, [])).count() == 0
    r = fingerprint.digests(docs(spark, [(1, "abcdef")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_main_path_is_native(spark):
    plan = fingerprint.edited(docs(spark, edge_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
