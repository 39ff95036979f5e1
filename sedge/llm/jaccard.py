"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets link when their Jaccard similarity is at
least a threshold. The result is exact (but for collisions of 64-bit hashes within one pair of documents).

1. Equal sets are one class. The rest works on classes.
2. Blocks. Sets that link differ in at most d elements (a bound by their sizes). The hash space is cut into d + c parts;
   each element in which they differ spoils one, so at least c parts are equal in both, and their hashes are keys they
   share. Sets with fewer shared keys than that link with nothing and go, with all their keys, and then those that only
   shared keys with them: what have but a passage in common share a key here and there. Of the rest each key's group links
   its members to its least one, and components of these links are blocks: no linked pair is in two of them.
3. In every block, T-occurrence search over inverted lists: a set asks for those that hold at least T of its elements.
   The T - 1 or fewer longest lists are put aside, the short ones are heap-merged, and sets found often enough are
   probed for in the long lists by binary search. Sets already known to be connected aren't probed.
4. Blocks too large for one task are searched in pieces: those linked to a pivot are connected; the others are the
   queries, asked in batches against all members of the block in chunks.

Hot keys: of the sets in a task's buffer that share a key, a node that stands for them is sent, so a group of near copies
reaches the shuffle of keys as a row for each buffer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import batch, cut, rows_of, small_batches, worker_cache, words
from sedge.llm.components import components, lookup

U = np.uint64
_A, _B = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found

    def of(self, own: list[bytes]) -> np.ndarray:
        if len(self) > 250_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, own), U, len(own))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _A
    h = (h ^ (h >> U(27))) * _B
    return h ^ (h >> U(31))


def shingles(text: str | None, k: int = 4) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if it is shorter; none without words."""
    h = worker_cache("jaccard", WordHash).of(words(text))
    if not len(h):
        return h
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, U(n), U)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def identity(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two 64-bit hashes of a set, the first of them cut to some bits, as signed integers; None for an empty one."""
    if not len(own):
        return None, None
    a, b = mix(own ^ U(0x5ED6E)).sum(dtype=U), mix(own + U(0x9E3779B97F4A7C15)).sum(dtype=U)
    a, b = mix(np.array([a + U(len(own)), b], U))
    return tuple(int(x) for x in np.array([a >> U(64 - bits), b], U).view(np.int64))


class Rule:
    """100 * intersection >= percent * union, in integers."""

    def __init__(self, percent: int):
        if not 51 <= percent <= 100:
            raise ValueError("percent must be from 51 to 100")
        self.percent = percent

    def least_size(self, n: int) -> int:
        """Size of the smallest set that may link with one of n."""
        return -(-self.percent * n // 100)

    def overlap(self, n: int, m: int) -> int:
        return -(-self.percent * (n + m) // (100 + self.percent))

    def differ(self, n: int) -> int:
        """The most elements in which a set of n and one at least as large, linked with it, differ."""
        return (100 - self.percent) * (n + 100 * n // self.percent) // (100 + self.percent)


SHINGLES_A_TASK = 2_000_000  # of the sets whose keys one task sorts in step 2, on average: about as many keys in 50 MB, which don't spill
SHORT = 1 << 14  # the band of sets with so many empty parts that nothing is known of the others


class Keys:
    """The keys of step 2. Sizes are banded so that partners are in one band or neighbouring ones; edges are where bands begin."""

    def __init__(self, percent: int):
        self.rule, self.edges = Rule(percent), [1]

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and of each its band << 16 | the least number of the band's keys that a linked set shares."""
        n = len(own)
        while self.edges[-1] <= n:
            self.edges.append(100 * self.edges[-1] // self.rule.percent + 1)
        at = int(np.searchsorted(self.edges, n, "right")) - 1
        low = int(np.searchsorted(self.edges, max(1, self.rule.least_size(n)), "right")) - 1
        out, tags, short = [], [], False
        for i in range(low, at + 1):
            d = self.rule.differ(self.edges[i + 1] - 1)
            if not d:
                continue
            same = 3 + d // 3
            parts = U(d + same)
            place = (own >> U(8)) % parts
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            least = same - (d + same - len(first))  # empty parts may be among the equal ones
            short |= least < 1
            total = np.add.reduceat(mix(own[order]), first)
            out.append(mix(total + place[first] * _A + U((i + 1) * int(_B) % 2**64)))
            tags.append(np.full(len(first), i << 16 | min(max(least, 1), 0xFFFF)))
        if short:  # such sets share one of their least elements
            out.append(mix(own[: n - self.rule.least_size(n) + 1] ^ _A))
            tags.append(np.full(len(out[-1]), SHORT << 16 | 1))
        return (np.concatenate(out), np.concatenate(tags)) if out else (own[:0], np.zeros(0, np.int64))


def combined(keys: np.ndarray, sets: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows key, set, count << 32 | tag: a key of one set as it is; of several, a node that is no set stands for them.

    The node goes by the first of them and the band. It has each such key, once, and needs no shared keys itself; it and
    these sets have a key of the node in common, with a count of the keys for each set. So sets that go later part nothing."""
    order = np.argsort(keys, kind="stable")
    keys, sets, tags = keys[order], sets[order], tags[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    lead = np.repeat(sets[first], size)
    several = np.logical_or.reduceat(lead != sets, first)
    within = np.repeat(several, size)
    members, n = np.unique(np.stack([sets[within], lead[within], tags[within]], 1), axis=0, return_counts=True)
    one, stand = first[~several], first[several]
    node = lambda of, tag: mix(mix(of.astype(U)) + (tag >> 16).astype(U) * _A)
    nodes = node(sets[stand], tags[stand])
    unique, at = np.unique(nodes, return_index=True)
    empty = tags[stand] >> 16 << 16 | 1 << 32
    return (np.concatenate([keys[one].view(np.int64), keys[stand].view(np.int64), mix(unique + _B).view(np.int64), mix(node(members[:, 1], members[:, 2]) + _B).view(np.int64)]),
            np.concatenate([sets[one], nodes.view(np.int64), unique.view(np.int64), members[:, 0]]),
            np.concatenate([tags[one] | 1 << 32, empty, empty[at], n.astype(np.int64) << 32 | members[:, 2]]))


class Index:
    """Inverted lists over sets, in order of size."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int, mu: float = 0.001, heap: int = 256):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets, self.rule, self.mu, self.heap = [ids[i] for i in order], [sets[i] for i in order], Rule(percent), mu, heap
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.elements, codes = np.unique(np.concatenate([*self.sets, np.zeros(0, U)]), return_inverse=True)
        owner = np.repeat(np.arange(len(order)), self.sizes)
        by = np.argsort(codes, kind="stable")
        self.lists, self.n = owner[by], max(1, len(order))
        self.starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.elements)))].astype(np.int64)
        self.keys = codes[by].astype(np.int64) * self.n + self.lists  # sorted: a binary search in it is one in a list

    def _merged(self, lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
        """(set, occurrences) of those in at least so many of the sorted lists."""
        if sum(map(len, lists)) > self.heap:  # the same merge by numpy, of long inputs
            found, count = np.unique(np.concatenate(lists), return_counts=True)
            keep = count >= least
            return list(zip(found[keep].tolist(), count[keep].tolist(), strict=True))
        out, last, n = [], -1, 0
        for x in heapq.merge(*(x.tolist() for x in lists)):
            if x != last:
                if n >= least:
                    out.append((last, n))
                last, n = x, 0
            n += 1
        if n >= least:
            out.append((last, n))
        return out

    def linked(self, own: np.ndarray, stop: int | None = None, skip=None) -> Iterator[int]:
        """Positions below stop of the sets that link with own; those for which skip(position) holds aren't looked at."""
        size, rule = len(own), self.rule
        low = int(np.searchsorted(self.sizes, rule.least_size(size)))
        high = int(np.searchsorted(self.sizes, 100 * size // rule.percent, "right"))
        high = high if stop is None else min(high, stop)
        if low >= high or not size:
            return
        at = np.searchsorted(self.elements, own)
        at[at == len(self.elements)] = 0
        at = at[self.elements[at] == own] if len(self.elements) else at[:0]
        least = rule.least_size(size)
        if len(at) < least:
            return
        length = self.starts[at + 1] - self.starts[at]
        at = at[np.argsort(length, kind="stable")]
        n_long = min(least - 1, int(least / (self.mu * np.log2(max(2, length.max())) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        bounds = np.searchsorted(self.keys, np.r_[short * self.n + low, short * self.n + high])
        lists = [self.lists[a:b] for a, b in zip(bounds[: len(short)].tolist(), bounds[len(short) :].tolist(), strict=True) if a < b]
        base = long.astype(np.int64) * self.n
        for c, n in sorted(self._merged(lists, least - n_long), key=lambda x: -x[1]):
            if skip and skip(c):
                continue
            need = rule.overlap(size, int(self.sizes[c]))
            if n + len(long) >= need:
                want = base + c
                where = np.searchsorted(self.keys, want)
                where[where == len(self.keys)] = 0
                if n + int((self.keys[where] == want).sum()) >= need:
                    yield c


def solve(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(id, another id) that connect what is linked in one block."""
    index = Index(ids, sets, percent)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for q in range(len(ids)):
        for c in index.linked(index.sets[q], q, lambda c: find(c) == find(q)):  # noqa: B023
            if find(c) != find(q):
                parent[find(c)] = find(q)
                out.append((index.ids[q], index.ids[c]))
    return out


def _arrays(column: list) -> list[np.ndarray]:
    return [np.frombuffer(x, U) for x in column]


def link(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_elements: int = 400_000, pivots: int = 8, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) of every row.

    Null and empty texts have an empty set and are linked with nothing: their component is their own id. Equal sets are
    linked whatever their size. Rows that share an id are linked as texts of their own, and each row gives a row. A row
    whose id is null counts, and a component of such rows alone has the id null. Extra columns are ignored; an empty
    table gives no rows. block_elements: shingles of a block that one task searches; larger ones are searched in pieces.
    bits: of the first hash that names a set, fewer in tests; sets in which it is equal are named by the second.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sid", pa.int64()), ("sid2", pa.int64())])

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for doc_id, text in rows_of([got], "doc_id", "text"):
                own = shingles(text, k)
                rows.append((doc_id, len(own), *identity(own, bits)))
            if rows:
                yield batch(fields, list(zip(*rows, strict=True)))

    sets = cut(source.mapInArrow(classes, "doc_id long, n_shingles long, sid long, sid2 long"), "jaccard-sets")
    by_name = sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min("sid2").alias("lo"), F.max("sid2").alias("hi"))
    own = cut(by_name, "jaccard-classes")
    clash = frozenset(r["sid"] for r in own.where("lo <> hi").select("sid").collect())  # of n sets about n * n / 2**65
    if clash:
        sets = sets.withColumn("sid", F.when(F.col("sid").isin([*clash]), F.col("sid2")).otherwise(F.col("sid")))
        own = cut(sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.min("sid2").alias("lo"), F.max("sid2").alias("hi")), "jaccard-classes")
        if not own.where("lo <> hi").isEmpty():
            raise RuntimeError("two different sets have one 128-bit hash")

    def name(x: np.ndarray) -> int | None:
        a, b = identity(x, bits)
        return b if a in clash else a

    if percent == 100:
        merged = None
    else:
        n_shingles = own.agg(F.sum("n")).first()[0] or 0
        merged = _search(source, own, _blocks(source, k, percent, name, n_shingles), k, percent, block_elements, pivots, name)
    if merged is not None:
        linked = components(merged)
        named = linked.withColumnRenamed("node", "sid").join(own.select("sid", "rep"), "sid")
        least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        joined = cut(own.select("sid", "rep").join(lookup(linked, least, "root", "inner").select(F.col("node").alias("sid"), "component_id"), "sid", "left"), "jaccard-components")
        of = joined.select("sid", F.coalesce("component_id", "rep").alias("component_id"))
    else:
        of = own.select("sid", F.col("rep").alias("component_id"))
    return lookup(sets, of, "sid").select("doc_id", "n_shingles", F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _blocks(source: DataFrame, k: int, percent: int, name, n_shingles: int = 0) -> DataFrame:
    """sid, block of the sets that may link with others. n_shingles: of all sets, by which the keys are dealt."""
    fields = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("info", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seen, rows, n = Keys(percent), set(), [], 0
        for got in batches:
            for (text,) in rows_of([got], "text"):
                x = shingles(text, k)
                sid = name(x)
                if len(x) and sid not in seen:
                    seen.add(sid)
                    own, tags = keys.of(x)
                    rows.append((own, np.full(len(own), sid, np.int64), tags))
                    n += len(own)
                    if n > 400_000:
                        yield batch(fields, [*combined(*map(np.concatenate, zip(*rows, strict=True)))])
                        rows, n = [], 0
            if len(seen) > 200_000:
                seen.clear()
        if n:
            yield batch(fields, [*combined(*map(np.concatenate, zip(*rows, strict=True)))])

    keys = source.select("text").mapInArrow(keyed, "key long, sid long, info long")
    if (n_tasks := n_shingles // SHINGLES_A_TASK) > int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keys = keys.repartition(n_tasks, "key")
    w = Window.partitionBy("key").orderBy("sid")
    members = keys.select("sid", "info", F.first("sid").over(w).alias("to"), F.lag("sid").over(w).alias("same"), F.max("sid").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    members = members.where("to <> last and (same is null or same <> sid)")  # keys of several sets, each set once
    tag = F.col("info").bitwiseAND(F.lit(0xFFFFFFFF))
    found = members.groupBy("sid", "to", F.shiftright(tag, 16).alias("band")).agg(F.sum(F.shiftright("info", 32)).alias("n"), F.min(tag.bitwiseAND(F.lit(0xFFFF))).alias("least"))
    found = cut(found, "jaccard-keys").withColumns({"group": F.xxhash64("to", "band"), "own": F.xxhash64("sid", "band")}).select("sid", "own", "group", "n", "least")
    for i in range(2):
        if i:  # keys shared only with sets that went
            several = found.groupBy("group").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo <> hi").select("group")
            found = cut(found.join(several, "group", "left_semi"), "jaccard-keys")
        enough = found.groupBy("own").agg(F.sum("n").alias("total"), F.min("least").alias("need")).where("total >= need").select("own")
        found = cut(found.join(enough, "own", "left_semi"), "jaccard-keys")
    return cut(components(found.select(F.col("sid").alias("a"), F.col("group").alias("b"))), "jaccard-blocks").select(F.col("node").alias("sid"), F.col("root").alias("block"))


class Members:
    """Sets that are searched, in 25 bytes each, so that tasks pick their texts and none is shuffled for that."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("sid")
        ids = table["doc_id"].combine_chunks()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids, self.sids, self.block = ids.fill_null(0).to_numpy(), table["sid"].to_numpy(), table["block"].to_numpy()
        self.large = np.asarray(table["large"].to_numpy(), bool)
        self.known = np.unique(self.ids[~self.null])

    def of(self, got: pa.RecordBatch, column: str) -> pa.RecordBatch:
        """The rows with an id of a member."""
        ids = got.column(column)
        keep = np.isin(ids.fill_null(0).to_numpy(), self.known, kind="sort")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        return got.filter(pa.array(np.where(null, self.null.any(), keep)))

    def find(self, doc_id: int | None, sid: int | None) -> tuple[int, int, bool] | None:
        """block, sid, large of a member that goes by this id."""
        at = int(np.searchsorted(self.sids, sid)) if sid is not None else len(self.sids)
        if at < len(self.sids) and self.sids[at] == sid and (self.null[at] if doc_id is None else not self.null[at] and self.ids[at] == doc_id):
            return int(self.block[at]), sid, bool(self.large[at])
        return None


def _search(source: DataFrame, own: DataFrame, blocks: DataFrame, k: int, percent: int, block_elements: int, pivots: int, name, most_members: int = 500_000) -> DataFrame:
    """a, b: links that connect the classes of every block. most_members: beyond them the texts are shuffled to their sets."""
    members = cut(blocks.join(own, "sid").select("sid", "block", "rep", "n"), "jaccard-members")
    sizes = members.groupBy("block").agg(F.sum("n").alias("elements"))
    large = F.col("elements") > block_elements
    members = cut(members.join(sizes, "block").select(F.col("rep").alias("doc_id"), "sid", "block", large.alias("large")), "jaccard-members")
    fields = pa.schema([("block", pa.int64()), ("sid", pa.int64()), ("large", pa.bool_()), ("own", pa.binary())])
    ddl = "block long, sid long, large boolean, own binary"

    def sent(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for *of, x in rows:
            out.append((*of, x.tobytes()))
            n += len(x)
            if n > 1_000_000:
                yield batch(fields, list(zip(*out, strict=True)))
                out, n = [], 0
        if out:
            yield batch(fields, list(zip(*out, strict=True)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = ((block, sid, large, shingles(text, k)) for sid, block, large, text in rows_of([got], "sid", "block", "large", "text"))
            yield from sent(r for r in rows if name(r[-1]) == r[1])

    if members.limit(most_members + 1).count() <= most_members:
        told = source.sparkSession.sparkContext.broadcast(Members(members.toArrow()))

        def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                rows = ((doc_id, shingles(text, k)) for doc_id, text in rows_of([told.value.of(got, "doc_id")], "doc_id", "text"))
                yield from sent((*of, x) for doc_id, x in rows if (of := told.value.find(doc_id, name(x))))

        full = source.mapInArrow(picked, ddl)
    else:
        texts = source.withColumnRenamed("doc_id", "id").join(members, F.col("id").eqNullSafe(F.col("doc_id"))).select("sid", "block", "large", "text")
        full = texts.mapInArrow(gathered, ddl)
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    ddl = "a long, b long"

    def in_block(table: pa.Table) -> pa.Table:
        found = dict(zip(table["sid"].to_pylist(), _arrays(table["own"].to_pylist()), strict=True))
        got = solve(list(found), list(found.values()), percent)
        return pa.table([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], schema=pair)

    any_large = not sizes.where(F.col("elements") > block_elements).isEmpty()
    if not any_large:
        return cut(full.groupBy("block").applyInArrow(in_block, ddl), "jaccard-links")
    full = cut(full, "jaccard-full")
    out = full.where("not large").groupBy("block").applyInArrow(in_block, ddl)
    large = full.where("large").dropDuplicates(["sid"])
    # pivots: the sets of least hashed id of each large block; a bounded number per block
    ranked = large.groupBy("block").agg(F.min_by("sid", F.xxhash64("sid", F.lit(1))).alias("p0"), *[F.min_by("sid", F.xxhash64("sid", F.lit(i + 1))).alias(f"p{i}") for i in range(1, pivots)])
    chosen = ranked.select("block", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))).alias("pivot"))
    chosen = cut(chosen.join(large.select(F.col("sid").alias("pivot"), F.col("own").alias("pivot_own")), "pivot"), "jaccard-pivots")
    spread = chosen.groupBy("block").agg(F.collect_list(F.struct("pivot", "pivot_own")).alias("pivots")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    met = large.withColumn("salt", F.pmod(F.xxhash64("sid"), F.lit(32)).cast("int")).join(spread, ["block", "salt"])

    def to_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows, kept, index = [], None, None
            for block, sid, x, near in rows_of([got], "block", "sid", "own", "pivots"):
                if kept != block:
                    kept, index = block, Index([p["pivot"] for p in near], _arrays([p["pivot_own"] for p in near]), percent)
                rows += ((block, sid, index.ids[c]) for c in index.linked(np.frombuffer(x, U)))
            if rows:
                yield batch(pa.schema([("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]), list(zip(*rows, strict=True)))

    near = cut(met.mapInArrow(to_pivots, "block long, a long, b long"), "jaccard-near")
    # the pivot with most links: what it links is connected; all others ask
    counts = near.groupBy("block", "b").agg(F.count("*").alias("n"))
    best = counts.groupBy("block").agg(F.max(F.struct("n", "b")).alias("x")).select(F.col("x.b").alias("b"))
    core = near.join(F.broadcast(best), "b").select("a", "b")
    rest = cut(large.join(core.select(F.col("a").alias("sid")), "sid", "left_anti"), "jaccard-rest")
    per = max(1, block_elements // 2) * 8
    shares = large.groupBy("block").agg(F.ceil(F.sum(F.length("own")) / per).cast("int").alias("chunks")).join(rest.groupBy("block").agg(F.ceil(F.sum(F.length("own")) / per).cast("int").alias("batches")), "block")
    shares = F.broadcast(cut(shares, "jaccard-shares"))  # a row per large block
    asked = rest.join(shares, "block").withColumn("batch", F.pmod(F.xxhash64("sid", F.lit(5)), F.col("batches")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    against = large.join(shares, "block").withColumn("chunk", F.pmod(F.xxhash64("sid", F.lit(6)), F.col("chunks")).cast("int")).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    columns = ["block", "batch", "chunk", "sid", "own"]
    both = asked.select(*columns, F.lit(True).alias("asks")).unionByName(against.select(*columns, F.lit(False).alias("asks")))

    def in_piece(table: pa.Table) -> pa.Table:
        rows = list(zip(table["sid"].to_pylist(), _arrays(table["own"].to_pylist()), table["asks"].to_pylist(), strict=True))
        index = Index([r[0] for r in rows if r[2]], [r[1] for r in rows if r[2]], percent)
        got = [(sid, index.ids[c]) for sid, x, asks in rows if not asks for c in index.linked(x) if index.ids[c] != sid]
        return pa.table([pa.array([x[i] for x in got], pa.int64()) for i in (0, 1)], schema=pair)

    return cut(out.unionByName(core).unionByName(both.groupBy("block", "batch", "chunk").applyInArrow(in_piece, ddl)), "jaccard-links")
