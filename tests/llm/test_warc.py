import base64
import gzip
import hashlib

import pytest
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from sedge.llm import warc


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>é two</p>"), (3, "http://b/3", "<p>one</p>"), (4, "http://b/4", None), (5, None, ""), (6, "http://c/6", "x" * 200000), (9, "http://c/9", "<p>one</p>"), (7, "http://c/7", "a\r\n\r\nWARC/1.1\r\n")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    got = {r.page_id: tuple(r) for r in warc.round_trip(frame(spark, PAGES)).collect()}
    top = {}
    for i, _, t in PAGES:
        top[t or ""] = max(i, top.get(t or "", 0))
    for i, _, t in PAGES:
        first = top[t or ""]
        assert got[i] == (i, len((t or "").encode()), digest(t), "response" if first == i else "revisit", None if first == i else first)
    assert len(got) == len(PAGES)


def test_odd_rows(spark):
    rows = [(1, "u", "t"), (1, "u", "t"), (None, "u", "t"), (None, "u", "z")]
    got = warc.round_trip(frame(spark, rows)).collect()
    assert len(got) == 4 and [r.record_type for r in got if r.page_id == 1] == ["response", "response"]
    assert warc.round_trip(frame(spark, [])).count() == 0


def test_pushdown_and_pruning(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.archive(frame(spark, PAGES).repartition(3), path)
    df = spark.read.format("warc").option("path", path).load()
    assert df.where("record_type = 'revisit'").count() == 3
    assert {r.page_id for r in df.where("target_uri like 'http://c%' and record_type in ('response')").collect()} == {6, 7, 9}
    assert df.where("payload_digest = '%s'" % digest("<p>one</p>")).count() == 3
    reader = warc.WarcReader({"path": path, "partitionbytes": "1"}, ["record_id"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit")]))
    parts = reader.partitions()
    assert not left and len(parts) == len(list(tmp_path.glob("w/*.warc.gz")))
    assert sorted(len(r) for x in parts for r in reader.read(x)) == [1, 1, 1]


def test_foreign_files_without_an_index(spark, tmp_path):
    records = [warc.record("response", f"http://x/{i}", "2024-01-01T00:00:00Z", b"body %d" % i, warc.digest(b"body %d" % i), f"<urn:uuid:{i}>") for i in range(5)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    warc.register(spark)
    df = spark.read.format("warc").option("path", str(tmp_path)).option("verify", "true").load()
    assert sorted(bytes(r.payload) for r in df.collect()) == sorted(2 * [b"body %d" % i for i in range(5)])
    bad = records[0].replace(b"body 0", b"body 9")
    (tmp_path / "b.warc").write_bytes(bad)
    with pytest.raises(Exception, match="isn't what its header says"):
        df.collect()


def test_members_of_many_records(spark, tmp_path):
    bodies = [b"body %d " % i * (1 + i * i) + b"\r\n\r\n" * (i % 3) for i in range(60)] + [b"z" * 9_000_000, b"end"]
    records = [warc.record("response", f"http://x/{i}", "2024-01-01T00:00:00Z", b, warc.digest(b), f"<urn:uuid:{i}>") for i, b in enumerate(bodies)]
    whole = b"".join(records)
    for data in (gzip.compress(whole), gzip.compress(whole[:5000]) + gzip.compress(whole[5000:]), b"".join(map(gzip.compress, records))):
        (tmp_path / "a.warc.gz").write_bytes(data)
        reader = warc.WarcReader({"path": str(tmp_path), "verify": "true"}, ["payload"])
        assert [bytes(r[0]) for x in reader.partitions() for r in reader.read(x)] == bodies
    (tmp_path / "b.warc").write_bytes(whole[:-500])
    for name, data in (("a.warc.gz", gzip.compress(whole)[:-300]), ("a.warc.gz", gzip.compress(whole[:5000])), ("b.warc", whole[:5000])):
        for old in tmp_path.iterdir():
            old.unlink()
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match="truncated"):
            list(row for x in reader.partitions() for row in reader.read(x))


def test_planning_does_nothing_for_each_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 2000)
    path = f"file://{tmp_path}/w"
    warc.register(spark)
    rows = [(i, f"http://a/{i}", f"body {i} {'%032x' % (i * 7919 ** 5 % 2**127)}".encode() * 3, warc.digest(b"%d" % i)) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, payload binary, payload_digest string").selectExpr("*", "'response' as record_type", "cast(null as long) as refers_to", "cast(null as string) as refers_uri")
    writer = warc.WarcWriter({"path": path})
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    messages = [writer.write(iter([r.asDict() for r in part])) for part in (df.where("page_id < 200").collect(), df.where("page_id >= 200").collect(), [])]
    writer.commit([*messages, None])
    monkeypatch.undo()
    opened = []
    real = warc.opened

    def watched(uri):
        system, root = real(uri)

        class Watched:
            def __getattr__(self, name):
                def call(path, *args, **kw):
                    if name.startswith("open"):
                        opened.append(path)
                    return getattr(system, name)(path, *args, **kw)

                return call

        return Watched(), root

    reader = warc.WarcReader({"path": path, "partitionbytes": "6000"}, ["page_id"])
    monkeypatch.setattr(warc, "opened", watched)
    parts = reader.partitions()
    assert [x.rsplit("/", 1)[1] for x in opened] == [warc.MANIFEST] and len(parts) > 5
    monkeypatch.undo()
    got = [r[0] for x in parts for r in reader.read(x)]
    assert sorted(got) == list(range(300))
    for x in tmp_path.glob("w/_files.json"):  # without the list, files are read by their indexes
        x.unlink()
    assert sorted(r[0] for x in reader.partitions() for r in reader.read(x)) == list(range(300))


def test_many_repeated_digests_are_joined_with_salts(spark):
    few, many = (sorted(map(str, warc.deduplicated(frame(spark, PAGES), most=n).drop("salt").collect())) for n in (1000, 0))
    assert few == many


def test_payloads_are_read_and_written_in_small_batches(spark, tmp_path):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(i, f"http://h/{i}", f"{i} " * 100_000) for i in range(40)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    reader = warc.Warc({"path": str(tmp_path / "a")}).reader(StructType([StructField("page_id", LongType()), StructField("payload", BinaryType())]))
    batches = [x for part in reader.partitions() for x in reader.read(part)]
    assert max(x.nbytes for x in batches) < 6 << 20 and sum(x.num_rows for x in batches) == 40
    assert sorted((i, bytes(p).decode()) for x in batches for i, p in zip(x["page_id"].to_pylist(), x["payload"].to_pylist())) == [(i, t) for i, _, t in rows]
