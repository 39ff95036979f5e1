"""WARC archives as a Python data source (format "warc"), for reading and writing.

Writing: a task writes one .warc.gz file, a gzip member per record, and beside it an index (.idx) with the offset, length
and type of every member. The driver publishes, on commit, the list of the files that count, those of failed or repeated
tasks not among them, and of each file which stretches of its index stand for about 8 MB of records.

Reading: partitions are planned from these stretches alone: large files are cut between records, small ones share a
partition, and the driver opens no index. A task reads its own stretch. Without a list, a file is a partition, with its
index if there is one. Filters on the record type and other header fields are pushed down. A type that isn't wanted is
skipped by the index without decompressing anything; of the rest the header is parsed first, and only records whose
header passes and whose payload is asked for are decoded further.

Paths are URIs that pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from sedge.llm.common import batch, cut, shared_dir, small_batches

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to_id string, payload_digest string, "
          "content_length long, http_status int, http_length long, page_id long, refers_to long, payload binary")
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
MANIFEST = "_files.json"
BATCH = 4 << 20  # bytes of rows that go to Spark at a time
STRETCH = 8 << 20  # bytes of records that a stretch of an index stands for
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str):
    """File system and path of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>"


def record(kind: str, uri: str | None, date: str, payload: bytes, payload_digest: str, own: str, refers: str | None = None, refers_uri: str | None = None, more: dict[str, str] | None = None) -> bytes:
    """A response or revisit record with its HTTP header; a revisit has no payload, but its length in the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}"}
    if kind == "revisit":
        fields |= {"WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": refers_uri, "WARC-Profile": PROFILE}
    fields |= {**(more or {}), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Header fields by lower-cased name; continued lines are joined."""
    found, last = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            found[last] = value.strip()
    return found


def _number(x: str | None) -> int | None:
    return int(x) if x and x.lstrip("-").isdigit() else None


class Member:
    """One gzip member (or plain bytes), inflated only as far as asked."""

    def __init__(self, data: bytes, zipped: bool = True):
        self.inflater, self.data, self.got = (zlib.decompressobj(31) if zipped else None), data, b"" if zipped else data

    def head(self) -> bytes | None:
        while (at := self.got.find(b"\r\n\r\n")) < 0:
            if not self.inflater or self.inflater.eof or not self.data:
                return None
            self.got += self.inflater.decompress(self.data, 4096)
            self.data = self.inflater.unconsumed_tail
        self.rest = at + 4
        return self.got[:at]

    def http(self, length: int) -> bytes:
        """The HTTP header of the block."""
        while (at := self.got.find(b"\r\n\r\n", self.rest)) < 0 and self.inflater and not self.inflater.eof and self.data and len(self.got) < self.rest + length:
            self.got += self.inflater.decompress(self.data, 4096)
            self.data = self.inflater.unconsumed_tail
        self.body = at + 4 if 0 <= at < self.rest + length else self.rest
        return self.got[self.rest : self.body]

    def payload(self, length: int) -> bytes:
        if self.inflater and not self.inflater.eof:
            self.got += self.inflater.decompress(self.data)
        return self.got[self.body : self.rest + length]


def inflated(f, path: str) -> Iterator[bytes]:
    """The bytes of gzip members one after another, however records lie in them."""
    left = f.read(1 << 20)
    while left:
        inflater = zlib.decompressobj(31)
        while not inflater.eof:
            left = left or f.read(1 << 20)
            if not left:  # the inflater may hold back the last output
                out = inflater.flush()
                if not inflater.eof:
                    raise ValueError(f"a truncated gzip member in {path}")
                yield out
                return
            out = inflater.decompress(left, 1 << 22)
            left = inflater.unused_data if inflater.eof else inflater.unconsumed_tail
            if out:
                yield out
        left = left or f.read(1 << 20)


@dataclass
class Part(InputPartition):
    pieces: list  # (path, first and last byte of a stretch of its index); None: of a file that isn't on a list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.verify = options.get("verify", "false").lower() == "true"
        self.size = int(options.get("partitionbytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        known = {"record_type", "target_uri", "record_id", "payload_digest", "warc_date", "refers_to_id", "page_id", "content_length"}
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in known and isinstance(f, EqualTo):
                self.tests.append((name, "in", frozenset([f.value])))
            elif name in known and isinstance(f, In):
                self.tests.append((name, "in", frozenset(f.value)))
            elif name in known and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            elif name in known and isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            else:
                yield f

    def wanted(self, name: str, value) -> bool:
        return all(value is not None and (value in x if how == "in" else how == "set" or value.startswith(x)) for n, how, x in self.tests if n == name)

    def partitions(self):
        from pyarrow import fs

        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type != fs.FileType.File and system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                pieces = [(f"{root}/{x}", a, b, size) for x, stretches in json.loads(f.read()) for a, b, size in stretches]
        else:
            files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
            pieces = sorted((x.path, None, None, x.size) for x in files if info.type == fs.FileType.File or x.path.endswith((".warc", ".warc.gz")))
        parts, own, room = [], [], self.size
        for path, a, b, size in pieces:
            if own and room < size:
                parts.append(Part(own))
                own, room = [], self.size
            own.append((path, a, b))
            room -= size
        return [*parts, Part(own)]

    def _members(self, path: str, a: int | None, b: int | None) -> Iterator[Member]:
        system, _ = opened(self.path)
        indexed = a is not None
        if not indexed:
            from pyarrow import fs

            index = system.get_file_info(f"{path}.idx")
            indexed, a, b = index.type == fs.FileType.File, 0, index.size
        if indexed:
            with system.open_input_file(f"{path}.idx") as f:
                entries = f.read_at(b - a, a).decode().split("\n")
            with system.open_input_file(path) as f:
                for entry in entries:
                    offset, length, kind = entry.split()
                    if self.wanted("record_type", kind):
                        yield Member(f.read_at(int(length), int(offset)))
            return
        with system.open_input_stream(path, compression=None) as f:  # records one after another, without an index
            blocks = inflated(f, path) if path.endswith(".gz") else iter(lambda: f.read(1 << 20), b"")
            buffer, at = b"", 0
            while True:
                while (end := buffer.find(b"\r\n\r\n", at)) <= at:  # line ends after the last record
                    if end == at:
                        at += 4
                        continue
                    more = next(blocks, None)
                    if more is None:
                        if buffer[at:].strip():
                            raise ValueError(f"a truncated record in {path}")
                        return
                    buffer, at = buffer[at:] + more, 0
                end += 4 + (_number(headers(buffer[at:end]).get("content-length")) or 0)
                if len(buffer) < end:
                    found, size = [buffer[at:]], len(buffer)
                    while size < end and (more := next(blocks, None)) is not None:
                        found.append(more)
                        size += len(more)
                    buffer, end, at = b"".join(found), end - at, 0
                    if len(buffer) < end:
                        raise ValueError(f"a truncated record in {path}")
                yield Member(buffer[at:end], False)
                at = end

    def read(self, partition: Part):
        for path, a, b in partition.pieces:
            for member in self._members(path, a, b):
                raw = member.head()
                if raw is None:
                    raise ValueError(f"a record without a header in {path}")
                h = headers(raw)
                row = {"record_id": h.get("warc-record-id"), "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "warc_date": h.get("warc-date"), "refers_to_id": h.get("warc-refers-to"),
                       "payload_digest": (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, "content_length": _number(h.get("content-length")), "page_id": _number(h.get("x-page-id")), "refers_to": _number(h.get("x-refers-to-page-id"))}
                if not all(self.wanted(n, row.get(n)) for n in {t[0] for t in self.tests}):
                    continue
                length = row["content_length"] or 0
                if {"http_status", "http_length", "payload"} & {*self.columns}:
                    http = member.http(length)
                    first = http.split(b"\r\n", 1)[0].split()
                    row["http_status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
                    row["http_length"] = _number(headers(http).get("content-length"))
                    if "payload" in self.columns:
                        row["payload"] = member.payload(length) if row["record_type"] != "revisit" else None
                        if self.verify and row["payload"] is not None:
                            if digest(row["payload"]) != row["payload_digest"] or len(row["payload"]) != row["http_length"]:
                                raise ValueError(f"the payload of {row['record_id']} in {path} isn't what its header says")
                yield tuple(row.get(c) for c in self.columns)


class BatchReader(WarcReader):
    """Gives Spark Arrow batches of some 4 MB, so that a worker and its executor hold few payloads, however many rows a batch may have."""

    def read(self, partition: Part):
        import pyarrow as pa

        if not self.columns:
            yield from super().read(partition)
            return
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        told = dict(x.split() for x in SCHEMA.split(", "))
        schema = pa.schema([(c, kinds[told[c]]) for c in self.columns])
        at = self.columns.index("payload") if "payload" in self.columns else None
        found, size = [], 0
        for row in super().read(partition):
            found.append(row)
            size += 256 + (len(row[at] or b"") if at is not None else 0)
            if size >= BATCH:
                yield batch(schema, list(zip(*found, strict=True)))
                found, size = [], 0
        if found:
            yield batch(schema, list(zip(*found, strict=True)))


@dataclass
class Written(WriterCommitMessage):
    files: list  # name, and of each stretch of its index the first and last byte, and the bytes of its records


class WarcWriter(DataSourceWriter):
    """Rows with page_id, url, payload, record_type, payload_digest, refers_to, refers_uri."""

    def __init__(self, options: dict):
        self.path, self.date, self.level = options["path"], options.get("date", "2024-01-01T00:00:00Z"), int(options.get("level", 3))

    def write(self, rows):
        from pyspark import TaskContext

        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        entries, at, sink, stretches, size = [], 0, None, [], 0
        try:
            for r in rows:
                if sink is None:
                    sink = system.open_output_stream(f"{root}/{name}", compression=None)
                payload = bytes(r["payload"])
                more = {"X-Page-Id": r["page_id"], "X-Refers-To-Page-Id": r["refers_to"]}
                refers = record_id(r["refers_to"]) if r["record_type"] == "revisit" else None
                raw = record(r["record_type"], r["url"], self.date, payload, r["payload_digest"], record_id(r["page_id"]), refers, r["refers_uri"], more)
                deflater = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = deflater.compress(raw) + deflater.flush()
                sink.write(data)
                entries.append(f"{at} {len(data)} {r['record_type']}")
                at += len(data)
        finally:
            if sink is not None:
                sink.close()
        if sink is None:
            return Written([])
        begin = end = 0
        for entry in entries:
            size += int(entry.split()[1])
            end += len(entry) + 1
            if size >= STRETCH:
                stretches.append((begin, end - 1, size))
                begin, size = end, 0
        if size:
            stretches.append((begin, end - 1, size))
        with system.open_output_stream(f"{root}/{name}.idx", compression=None) as f:
            f.write("\n".join(entries).encode())
        return Written([(name, stretches)])

    def commit(self, messages):
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages):
        system, root = opened(self.path)
        for x, _ in (x for m in messages if m for x in m.files):
            for name in (x, f"{x}.idx"):
                system.delete_file(f"{root}/{name}")


class Warc(DataSource):
    """Options: path; reading: verify (compare payloads with their digests), partitionBytes; writing: date, level.

    With .schema(...) only the named columns are made; without `payload` among them no payload is decoded."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        unknown = {*schema.names} - {*FIELDS}
        if unknown:
            raise ValueError(f"no such columns in a WARC record: {sorted(unknown)}")
        return BatchReader({k.lower(): v for k, v in self.options.items()}, schema.names)

    def writer(self, schema, overwrite):
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


SALTS = 16


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", most: int = 200_000, most_bytes: int = 64 << 20) -> DataFrame:
    """page_id, url, payload, payload_digest (hex), record_type, refers_to, refers_uri.

    Of rows with equal payloads those with the largest id are responses and the others revisit them; null payloads are
    empty ones. Only digests are grouped; those that repeat are joined back. They are broadcast, and no payload is shuffled,
    if they are at most `most` and their addresses `most_bytes`, which is counted; else the join is salted."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))
    hashed = own.withColumn("payload_digest", F.sha1("payload"))
    digests = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.sha1(F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")).alias("payload_digest"))
    many = digests.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    many = cut(many.select("payload_digest", F.col("top.page_id").alias("top"), F.col("top.url").alias("top_url")), "warc-repeated")
    n, size = many.agg(F.count("*"), F.coalesce(F.sum(F.length("top_url")), F.lit(0))).first()
    if n <= most and size <= most_bytes:
        both = hashed.join(F.broadcast(many), "payload_digest", "left")
    else:
        spread = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        both = hashed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(spread, ["payload_digest", "salt"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("top")) & F.col("top").isNotNull(), F.lit(False))
    return both.select("page_id", "url", "payload", F.col("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.when(revisit, F.col("top")).alias("refers_to"), F.when(revisit, F.col("top_url")).alias("refers_uri"))


def base32(hexed):
    """Upper-case base32 of a SHA-1 in hex: 160 bits are 32 letters, five bits each."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 2), 40, "0") for i in range(4)])
    letter = [F.substring(F.lit(alphabet), F.conv(F.substring(bits, 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    return F.concat(*letter)


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write pages as WARC files under path. An empty table gives an archive without files."""
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    rows = deduplicated(pages, id_col, url_col, payload_col)
    rows.withColumn("payload_digest", base32(F.col("payload_digest"))).write.format("warc").mode("append").option("path", path).save()


def round_trip(pages: DataFrame) -> DataFrame:
    """The rows of op2, as read back from archives of all pages.

    Null and empty payloads are records of length 0; repeated rows of one page with one payload are all responses (or
    all revisits); pages with one id but different payloads are records of their own; a null id stays null and is never
    the larger one; other columns are ignored; an empty table gives no rows."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    read = pages.sparkSession.read.format("warc").option("path", path).option("verify", "true")
    columns = "page_id long, record_type string, payload_digest string, http_length long, refers_to long, payload binary"
    full = read.schema(columns).load().where("record_type = 'response'")
    brief = read.schema(columns.replace(", payload binary", "")).load().where("record_type = 'revisit'")
    return full.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to").unionByName(
        brief.select("page_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
