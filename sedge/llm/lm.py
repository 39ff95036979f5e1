"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(cell | class, history) P(slot | cell, history) P(word | rest of the cell), with 16
classes of 16 cells of 16 slots. A word's cell is its ending (the most frequent endings have one each, the others share
one, the end of a text has its own); endings that end alike are in one class. A cell has slots for its most frequent
words; the last slot stands for all its other words, which share it by smoothed counts, one unknown word included, so the
model is a distribution. All three softmaxes are log-linear in hashed features of the history: the last word, skips to the
second and third last, and the last two together; the ending's softmax has the first three of these, the slot's the first
two; rare words of the history count by their ending. They start from the counts, so that features
only learn what the history adds.

Training: the training documents are dealt into rounds. In each, every task starts from the shared parameters, makes
gradient steps (scaled by row) on its documents of the round in batches, and gives back the rows it touched; rows are
averaged by how often they were touched, in two levels of aggregation. Parameters have a fixed size; counts, and what the
tasks give back, follow the corpus. Counts of frequent words, a bounded number, are sent to the tasks; those of all
others are joined by word.

A text is scored by itself: its features know nothing of its neighbours, and sums over a position's rows go in one order.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, cut, fold, rows_of, small_batches, worker_cache, words

END = b"\n"  # no word holds white space
WAYS, ROWS = 16, 1 << 15  # branches of each softmax; rows of its table
CELLS = WAYS * WAYS
USED = (4, 3, 2)  # features of each softmax
HEAD, CONTEXT = 131_072, 8_192
BLOCK = 2048
F32 = np.float32


@dataclass
class Lexicon:
    """What the tasks know of words: counts of the most frequent, endings with their classes, slots, and the rest of each class."""

    head: dict[bytes, int]
    floor: int  # the least level of counts in the head
    endings: dict[bytes, int]  # cells
    slots: dict[bytes, int]
    priors: tuple[np.ndarray, np.ndarray, np.ndarray]  # of classes, of cells by class, of slots by cell
    rest_total: np.ndarray  # by cell: training tokens outside the slots + 0.1 * (their types + 1)
    tokens: int
    types: int
    context: frozenset = field(default_factory=frozenset)
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def cell_of(self, word: bytes) -> int:
        return 0 if word == END else self.endings.get(word[-2:], 1)


class Words(dict):
    """Numbers of words within a worker, and what is known of each, as arrays; bounded."""

    def __init__(self, lexicon: Lexicon, most: int = 700_000):
        self.lexicon, self.most = lexicon, most
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words: list[bytes] = []
        self.symbol, self.cell, self.slot, self.count = array("I"), array("B"), array("B"), array("q")
        self.ends: dict[bytes, tuple[int, int]] = {}

    def __missing__(self, word: bytes) -> int:
        x, end = self.lexicon, word[-2:]
        known = self.ends.get(end)
        if known is None:
            known = self.ends[end] = x.cell_of(word), zlib.crc32(end, 0x5ED6E)
        count = x.head.get(word)
        self.cell.append(known[0])
        if count is None:
            self.count.append(-1)
            self.slot.append(WAYS - 1)
            self.symbol.append(known[1])
        else:
            self.count.append(count)
            self.slot.append(x.slots.get(word, WAYS - 1))
            self.symbol.append(zlib.crc32(word) if word in x.context else known[1])
        self[word] = i = len(self.words)
        self.words.append(word)
        return i

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, cells, slots and counts (-1: not among the most frequent) of words by number."""
        return tuple(np.take(np.frombuffer(a, t), ids) for a, t in ((self.symbol, np.uint32), (self.cell, np.uint8), (self.slot, np.uint8), (self.count, np.int64)))

    def of(self, text: str | None) -> np.ndarray:
        own = words(text)
        own.append(END)
        return np.fromiter(map(self.__getitem__, own), np.int32, len(own))


def words_of(lexicon: Lexicon) -> Words:
    """One per Python worker and lexicon, which serves its later tasks too."""
    return worker_cache(("lm", lexicon.key), lambda: Words(lexicon))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    a = (a ^ (a >> np.uint32(12))) * np.uint32(0x297A2D39)
    return a ^ (a >> np.uint32(15))


def features(symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashed features of every position's history, 4 by n: last word, skips of one and of two, last two words."""
    n, past = len(symbol), []
    since = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    for k in (1, 2, 3):
        x = np.full(n, k, np.uint32)
        x[k:] = symbol[: n - k] if n > k else symbol[:0]
        x[since < k] = k  # before the text
        past.append(x)
    f = [_mix(past[k] * np.uint32(2 * k + 3) + np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF)) for k in range(3)]
    f.append(_mix(f[0] ^ (past[1] * np.uint32(0x85EBCA6B))))
    return np.stack(f)


def rows_of_level(f: np.ndarray, level: int, cell: np.ndarray) -> np.ndarray:
    """Rows of the features in a softmax's table: those of the second go with the class, those of the third with the cell."""
    if not level:
        return (f % np.uint32(ROWS)).astype(np.intp)
    of = cell.astype(np.uint32) // WAYS if level == 1 else cell.astype(np.uint32) + np.uint32(CELLS)
    return (_mix(f[: USED[level]] * np.uint32(2 * CELLS) + of + np.uint32(77)) % np.uint32(ROWS)).astype(np.intp)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place; priors are logarithms of probabilities, so nothing overflows below hundreds of nats of evidence."""
    np.minimum(z, 80, out=z)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


class Model:
    def __init__(self, lexicon: Lexicon, tables: tuple[np.ndarray, ...] | None = None):
        self.lexicon = lexicon
        self.tables = tables or tuple(np.zeros((ROWS, WAYS), F32) for _ in USED)

    def forward(self, f: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each softmax, the rows of its features and the probabilities."""
        for level, prior in enumerate(self.lexicon.priors):
            rows, table = rows_of_level(f, level, cell), self.tables[level]
            z = np.take(table, rows[0], 0)
            for r in rows[1:]:
                z += np.take(table, r, 0)
            z += prior if not level else np.take(prior, cell // WAYS if level == 1 else cell, 0)
            yield rows, _softmax(z)

    def log10(self, symbol, cell, slot, starts) -> np.ndarray:
        """log10 probability of each position's class, cell and slot."""
        out = np.zeros(len(cell))
        for a, b, f in _pieces(features(symbol, starts)):
            at, own = np.arange(b - a), cell[a:b]
            for (_, p), target in zip(self.forward(f, own), (own // WAYS, own % WAYS, slot[a:b]), strict=True):
                out[a:b] += np.log10(np.maximum(p[at, target], 1e-30).astype(float))
        return out


class Trainer(Model):
    """Gradient steps, scaled per row by the gradients it has had."""

    def __init__(self, lexicon: Lexicon, tables, rate: float = 0.4, size: int = 16_384):
        super().__init__(lexicon, tuple(t.copy() for t in tables))
        self.rate, self.size = rate, size
        self.had = [np.full(ROWS, 1.0) for _ in tables]
        self.times = [np.zeros(ROWS, F32) for _ in tables]

    def learn(self, symbol, cell, slot, starts) -> None:
        for a, b, f in _pieces(features(symbol, starts), self.size):
            self.step(f, cell[a:b], slot[a:b])

    def step(self, f, cell, slot) -> None:
        at = np.arange(len(cell))
        for level, ((rows, p), target) in enumerate(zip(self.forward(f, cell), (cell // WAYS, cell % WAYS, slot), strict=True)):
            p[at, target] -= 1
            flat = rows.ravel().astype(np.uint16)
            order = np.argsort(flat, kind="stable")
            flat = flat[order]
            first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            met = flat[first].astype(np.int64)
            gradient = np.add.reduceat(np.take(p, np.take(np.tile(at, len(rows)), order), 0).view(np.complex64), first, axis=0).view(F32)  # two columns at a time
            self.had[level][met] += np.einsum("ij,ij->i", gradient, gradient)
            gradient *= (self.rate / np.sqrt(self.had[level][met]))[:, None].astype(F32)
            self.tables[level][met] -= gradient
            self.times[level][met] += np.diff(np.r_[first, len(flat)])


def _batches(vocabulary: Words, texts: Iterator, size: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(what came with the texts, word numbers, where texts begin), about `size` tokens at a time; longer texts alone."""
    keys, own, n = [], [], 0
    for key, text in texts:
        ids = vocabulary.of(text)
        keys.append(key)
        own.append(ids)
        n += len(ids)
        if n >= size:
            yield keys, np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])
            keys, own, n = [], [], 0
            if len(vocabulary) > vocabulary.most:
                vocabulary.reset()
    if keys:
        yield keys, np.concatenate(own), np.cumsum([0, *map(len, own[:-1])])


def _pieces(f: np.ndarray, size: int = 8192) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of at most `size` positions with their features, which were made before, so a cut forgets no history."""
    for a in range(0, f.shape[1], size):
        b = min(f.shape[1], a + size)
        yield a, b, f[:, a:b]


def _ship(trainer: Trainer) -> Iterator[tuple[int, int, bytes]]:
    for t, table in enumerate(trainer.tables):
        for b in range(ROWS // BLOCK):
            times = trainer.times[t][b * BLOCK : (b + 1) * BLOCK]
            at = np.flatnonzero(times).astype(np.uint16)
            yield t, b, b"".join([np.uint32(len(at)).tobytes(), at.tobytes(), times[at].astype(F32).tobytes(), table[b * BLOCK : (b + 1) * BLOCK][at].astype(np.float16).tobytes()])


def _merge(parts: list[bytes]) -> bytes:
    width = WAYS
    total, weight = np.zeros((BLOCK, width)), np.zeros(BLOCK)
    for part in parts:
        n = int(np.frombuffer(part, np.uint32, 1)[0])
        at = np.frombuffer(part, np.uint16, n, 4)
        times = np.frombuffer(part, F32, n, 4 + 2 * n)
        rows = np.frombuffer(part, np.float16, n * width, 4 + 6 * n).reshape(n, width)
        total[at] += rows.astype(float) * times[:, None]
        weight[at] += times
    at = np.flatnonzero(weight).astype(np.uint16)
    return b"".join([np.uint32(len(at)).tobytes(), at.tobytes(), weight[at].astype(F32).tobytes(), (total[at] / weight[at][:, None]).astype(np.float16).tobytes()])


def count(train: DataFrame) -> DataFrame:
    """w, c of the training texts' words and ends."""
    fields = pa.schema([("w", pa.binary()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            counts.update(words(text))
            counts[END] += 1
            if len(counts) > 400_000:
                yield batch(fields, list(zip(*counts.items(), strict=True)))
                counts.clear()
        if counts:
            yield batch(fields, list(zip(*counts.items(), strict=True)))

    return cut(train.select("text").mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c")), "lm-counts")


def _level():
    """Of a count: 64 levels for each factor of e."""
    return F.floor(F.log(F.col("c").cast("double")) * 64)


def lexicon(counts: DataFrame) -> Lexicon:
    """From the counts of all words; a bounded number of words and endings comes to the driver."""
    tokens, types, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.max(F.when(F.col("w") == F.lit(END), F.col("c")))).first()
    # the least level of counts above which there are at most HEAD words; levels are logarithmic, so few
    words_at = {r["level"]: r["n"] for r in counts.groupBy(_level().alias("level")).agg(F.count("*").alias("n")).collect()}
    floor, n = 1 << 20, 0
    for level in sorted(words_at, reverse=True):
        n += words_at[level]
        if n > HEAD:
            break
        floor = level
    got = counts.where(_level() >= floor).toArrow()
    top = sorted(zip(got["w"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    ending = F.substring("w", -2, 2)
    masses = counts.where(F.col("w") != F.lit(END)).groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("n"))
    found = {bytes(r["e"]): (r["c"], r["n"]) for r in masses.orderBy(F.desc("c"), "e").limit(CELLS - 2).collect()}
    endings = {e: i + 2 for i, e in enumerate(sorted(found, key=lambda e: e[::-1]))}  # cell 0: the end of a text; 1: all other endings
    head = dict(top)
    if ends:
        head[END] = ends
    mass, kinds = np.zeros(CELLS), np.zeros(CELLS)
    for e, i in endings.items():
        mass[i], kinds[i] = found[e]
    mass[0], kinds[0] = ends or 0, 1 if ends else 0
    mass[1], kinds[1] = (tokens or 0) - mass.sum(), types - kinds.sum()
    slots: dict[bytes, int] = {END: 0}
    used, taken = np.zeros(CELLS, int), np.zeros((CELLS, WAYS))
    used[0], taken[0, 0] = 1, head.get(END, 0)
    for w, c in top:
        k = 0 if w == END else endings.get(w[-2:], 1)
        if k and used[k] < WAYS - 1:
            slots[w] = int(used[k])
            taken[k, used[k]] = c
            used[k] += 1
    rest, rest_kinds = mass - taken.sum(1), kinds - used
    rest_total = rest + 0.1 * (np.maximum(rest_kinds, 0) + 1)
    slot_mass = taken.copy()
    slot_mass[:, WAYS - 1] = rest_total
    slot_mass[0] = [1.0] + [0.0] * (WAYS - 1)

    def logs(m: np.ndarray) -> np.ndarray:
        p = np.where(m > 0, np.log(np.maximum(m, 1e-9)), -60.0)
        return (p - np.log(np.exp(p).sum(-1, keepdims=True))).astype(F32)

    cells = (mass + rest_total - rest).reshape(WAYS, WAYS)
    return Lexicon(head, floor, endings, slots, (logs(cells.sum(1)), logs(cells), logs(slot_mass)), rest_total, int(tokens), int(types), frozenset(w for w, _ in top[:CONTEXT]))


def train(docs: DataFrame, known: Lexicon, rounds: int = 3) -> Model:
    """docs: doc_id, text of the training documents."""
    spark, model = docs.sparkSession, Model(known)
    shared_words = spark.sparkContext.broadcast(known)
    fields = pa.schema([("t", pa.int32()), ("b", pa.int32()), ("salt", pa.int32()), ("part", pa.binary())])
    merged = pa.schema([("t", pa.int32()), ("b", pa.int32()), ("part", pa.binary())])
    for r in range(rounds):
        tables = spark.sparkContext.broadcast(tuple(t.astype(np.float16) for t in model.tables))

        def learn(batches, tables=tables):
            trainer = Trainer(shared_words.value, tuple(t.astype(F32) for t in tables.value))
            own = words_of(shared_words.value)
            for _, ids, starts in _batches(own, ((None, text) for (text,) in rows_of(batches, "text")), 200_000):
                symbol, cell, slot, _ = own.look(ids)
                trainer.learn(symbol, cell, slot, starts)
            if any(t.any() for t in trainer.times):
                context = TaskContext.get()
                rows = [(t, b, (context.partitionId() if context else 0) % 64, part) for t, b, part in _ship(trainer)]
                yield batch(fields, list(zip(*rows, strict=True)))

        def add(table: pa.Table) -> pa.Table:
            t, b = table["t"][0].as_py(), table["b"][0].as_py()
            return pa.table([pa.array([t], pa.int32()), pa.array([b], pa.int32()), pa.array([_merge(table["part"].to_pylist())], pa.binary())], schema=merged)

        chosen = docs.where(F.pmod(F.coalesce(F.xxhash64("doc_id", F.lit(9)), F.lit(0)), F.lit(rounds)) == r)
        parts = chosen.select("text").mapInArrow(learn, "t int, b int, salt int, part binary")
        once = parts.groupBy("t", "b", "salt").applyInArrow(add, "t int, b int, part binary")
        for row in once.groupBy("t", "b").applyInArrow(add, "t int, b int, part binary").collect():  # of the parameters' size
            part, width = bytes(row["part"]), WAYS
            n = int(np.frombuffer(part, np.uint32, 1)[0])
            at = np.frombuffer(part, np.uint16, n, 4).astype(int) + row["b"] * BLOCK
            model.tables[row["t"]][at] = np.frombuffer(part, np.float16, n * width, 4 + 6 * n).reshape(n, width)
        tables.unpersist()
    return model


def score(docs: DataFrame, folds: int = 10, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Trained on the rows whose crc32 of the id as text isn't 0 mod folds; a null id is in training. Null and empty texts
    are an end alone. Repeated rows count and are scored each; ties among words go by their bytes; other columns are
    ignored; an empty table gives no rows; without training rows every token is unknown."""
    small_batches(docs.sparkSession)
    held = F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out"))
    learning = source.where("not held_out")
    counts = count(learning)
    known = lexicon(counts)
    model = train(learning, known, rounds)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((known, tuple(t.astype(np.float16) for t in model.tables)))
    all_log = float(np.log10(known.tokens + 0.1 * (known.types + 1)))
    fields = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_head", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("w", pa.binary()), ("tf", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, tables = shared.value
        model, own = Model(lex, tuple(t.astype(F32) for t in tables)), words_of(lex)
        rest_log = np.log10(lex.rest_total)
        context = TaskContext.get()
        rid = (context.partitionId() if context else 0) << 36
        texts = (((doc_id, held), text) for doc_id, held, text in rows_of(batches, "doc_id", "held_out", "text"))
        for keys, ids, starts in _batches(own, texts, 100_000):
            symbol, cell, slot, counted = own.look(ids)
            log = model.log10(symbol, cell, slot, starts)
            in_rest, head = slot == WAYS - 1, counted >= 0
            word_log = np.where(head, np.log10(np.maximum(counted, 0) + 0.1), 0.0)
            log += np.where(in_rest, word_log - rest_log[cell], 0.0)
            n = np.diff(np.r_[starts, len(ids)])
            of = np.arange(rid, rid + len(keys))
            rows = len(keys)
            none = [pa.nulls(rows, f.type) for f in fields]
            yield batch(fields, [of, [k[0] for k in keys], [k[1] for k in keys], n, np.add.reduceat(head, starts, dtype=np.int64), np.add.reduceat(word_log, starts) - n * all_log, np.add.reduceat(log, starts), *none[7:]])
            tail = np.flatnonzero(~head)
            if len(tail):
                pairs, tf = np.unique(np.repeat(np.arange(rows), n)[tail].astype(np.int64) << 32 | ids[tail], return_counts=True)
                named = own.words
                numbers = (pairs & 0xFFFFFFFF).tolist()
                none = [pa.nulls(len(pairs), f.type) for f in fields]
                yield batch(fields, [rid + (pairs >> 32), *none[1:7], [named[i] for i in numbers], tf.astype(np.int32)])
            rid += rows

    table = cut(source.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, w binary, tf int"), "lm-scores")
    rare = counts.where(_level() < known.floor)
    tail = table.where("w is not null").select("rid", "w", "tf").join(rare, "w", "left")
    per = tail.groupBy("rid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_tail"))
    both = table.where("w is null").join(per, "rid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).cast("long").alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
                       (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
