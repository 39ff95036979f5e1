"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merges by an agenda: adjacent symbols whose union is a piece are candidates, taken by score, then from the left.
With dropout each candidate taken is skipped by a draw of its own, from a keyed hash of (seed, text, place of the chunk in
it, number of the candidate in the chunk), so a text has many segmentations, but one for each seed. Chunks are what no
piece crosses: runs of spaces with what follows.

What becomes of a chunk follows from the numbers of the candidates skipped in it. So a worker keeps a table of outcomes
(a chunk and the numbers skipped so far: how many candidates are taken, and the ids), in which all occurrences of a block
of texts advance together, from one number skipped to the next; only outcomes that aren't in it yet are merged. The table
is bounded, and forgetting it changes nothing. Chunks of many letters are merged one by one where a candidate is skipped.

Ids decode to the exact text: characters that aren't pieces become byte pieces, as does the space mark itself where it
occurs in a text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, pairwise, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, small_batches, worker_cache
from sedge.llm.jaccard import mix

MARK = "▁"
_CHUNK = re.compile(rf" *[^ \n\t{MARK}]+| +|[\n\t{MARK}]")
_NEVER = -1
_NO = float("-inf")
LONG = 32  # letters of chunks whose outcomes are kept; they have under 3 * LONG candidates
_PLACE, _DRAW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


class Pieces:
    """A BPE model with byte fallback, read from a SentencePiece file."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0, most: int = 700_000, block: int = 100_000):
        import sentencepiece

        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be from 0 to 1")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.score, raw, self.byte_id = {}, {}, [], {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                if " " in piece.lstrip(" "):
                    raise ValueError("a piece crosses a space; its texts can't be cut into chunks")
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                raw.append(piece.encode())
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        self._pairs()
        self.raw, self.width = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self.seed, self.most, self.block = seed & 0xFFFFFFFFFFFFFFFF, most, block
        # chances in 2**63 that a run of candidates taken is at most so long; longer runs than the table has are drawn in parts
        self.runs = np.array([round((1 - (1 - dropout) ** (i + 1)) * 2**63) for i in range(4 * LONG)] if dropout else [], np.uint64)
        self._forget()

    def _pairs(self) -> None:
        """Tables for merging many chunks at once: pieces by code point, the rank of what two pieces join to, pieces by rank."""
        ranked = sorted((x for x in self.ids if len(x) > 1), key=lambda x: -self.score[x])
        tied = {x for a, b in pairwise(ranked) if self.score[a] == self.score[b] for x in (a, b)}
        self.unique = all(x.startswith("  ") for x in tied)  # ties go by place, not by rank: chunks with them are merged alone
        self.of_rank = np.array([self.ids[x] for x in ranked], np.int64)
        self.letter = np.full(0x110000, -1, np.int32)
        for x, i in self.ids.items():
            if len(x) == 1:
                self.letter[ord(x)] = i
        joins = {}
        for rank, x in enumerate(ranked):
            for k in range(1, len(x)):
                a, b = self.ids.get(x[:k]), self.ids.get(x[k:])
                if a is not None and b is not None:
                    joins[a << 32 | b] = rank
        # a hash table with room for the longest run beyond its end
        self.join_bits = max(4, (4 * len(joins)).bit_length())
        self.join_keys = np.full((1 << self.join_bits) + len(joins) + 1, -1, np.int64)
        self.join_ranks = np.zeros(len(self.join_keys), np.int32)
        for at, (key, rank) in zip(self._slot(np.array(list(joins), np.int64)).tolist(), joins.items(), strict=True):
            while self.join_keys[at] >= 0:
                at += 1
            self.join_keys[at], self.join_ranks[at] = key, rank

    def _forget(self) -> None:
        """The table of outcomes: by number the chunk, the outcome with a skip less and the last skip, how many candidates are taken, and where its ids end."""
        self.plain: dict[str, int] = {}
        self.after: dict[int, int] = {}
        self.chunk_of: list[str] = []
        self.before, self.last, self.taken, self.pool, self.ends = array("q"), array("q"), array("q"), array("I"), array("q", [0])

    def _run(self, h, n) -> np.ndarray:
        """Candidates taken before the next one skipped: draw n of an occurrence with hash h; the table's length means as many and more."""
        return np.searchsorted(self.runs, mix(h + n * _DRAW) >> np.uint64(1), "right")

    def skipped(self, h: np.uint64) -> Iterator[int]:
        """Numbers of an occurrence's candidates that are skipped, ascending, without end."""
        if not len(self.runs):
            return
        at, first, n = 0, 0, 8
        while True:
            run = self._run(h, np.arange(first, first + n, dtype=np.uint64))
            ends = run < len(self.runs)
            after = at + np.cumsum(run + ends)
            yield from (after[ends] - 1).tolist()
            at, first, n = int(after[-1]), first + n, min(2 * n, 8192)

    def scan(self, chunk: str, skips: Iterable[int]) -> tuple[list[str], int]:
        """Symbols after all merges but the skipped ones, and the candidates taken; the agenda is searched from the left, for few letters."""
        score = self.score.get
        symbols, agenda = list(chunk), [score(x, _NO) for x in map(add, chunk, chunk[1:])]
        taken, more = 0, iter(skips)
        skip = next(more, _NEVER)
        while agenda and (best := max(agenda)) > _NO:
            i = agenda.index(best)
            if taken == skip:
                agenda[i] = _NO
                skip = next(more, _NEVER)
            else:
                piece = symbols[i] + symbols.pop(i + 1)
                symbols[i] = piece
                del agenda[i]
                if i:
                    agenda[i - 1] = score(symbols[i - 1] + piece, _NO)
                if i < len(agenda):
                    agenda[i] = score(piece + symbols[i + 1], _NO)
            taken += 1
        return symbols, taken

    def merge(self, chunk: str, skips: Iterable[int]) -> tuple[list[str], int]:
        """The same with a heap as the agenda."""
        symbols: list[str | None] = list(chunk)
        n, score, taken, more = len(symbols), self.score, 0, iter(skips)
        skip = next(more, _NEVER)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(-s, i, piece) for i, piece in enumerate(map(add, chunk, chunk[1:])) if (s := score.get(piece)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != piece:
                continue  # what it would join is gone
            taken += 1
            if taken - 1 == skip:
                skip = next(more, _NEVER)
                continue
            symbols[i], symbols[j] = piece, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(longer := piece + symbols[k])) is not None:
                    heapq.heappush(agenda, (-s, i, longer))
            if (h := before[i]) >= 0 and (s := score.get(longer := symbols[h] + piece)) is not None:
                heapq.heappush(agenda, (-s, h, longer))
        return [x for x in symbols if x is not None], taken

    def ids_of(self, symbols: list[str]) -> list[int]:
        out = []
        for x in symbols:
            i = self.ids.get(x)
            out += [i] if i is not None else [self.byte_id[b] for b in x.encode()]
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of what two pieces join to; the number of ranks if nothing."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        out = np.full(len(key), len(self.of_rank), np.int32)
        left = np.arange(len(key))
        while len(left):  # along the table from a key's own place to the next free one
            found = np.take(self.join_keys, at)
            same = found == key
            out[left[same]] = np.take(self.join_ranks, at[same])
            more = np.flatnonzero(~same & (found >= 0))
            left, key, at = left[more], key[more], at[more] + 1
        return out

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * _PLACE >> np.uint64(64 - self.join_bits)).view(np.int64)

    def scan_many(self, codes: np.ndarray, lengths: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What scan() does for many chunks, a step of all of them at a time: ids, how many of them each chunk has, candidates taken.

        codes: pieces of the letters of all chunks; skips: a row each of ascending numbers. With each step a row loses a
        column: that of what was joined, or one of the empty ones at its end, of which it has one for each skip."""
        m, longest, none = len(lengths), int(lengths.max()), len(self.of_rank)
        width = longest + skips.shape[1] + 1
        symbols = np.full((m, width), -1, np.int32)
        symbols[np.arange(width) < lengths[:, None]] = codes
        ranks = np.full((m, width), none, np.int32)  # of the candidate that begins at a symbol
        a, b = symbols[:, : longest - 1], symbols[:, 1:longest]
        pair = b >= 0
        ranks[:, : longest - 1][pair] = self._rank(a[pair], b[pair])
        skips = np.hstack([skips, np.full((m, 1), _NEVER)])
        taken, done, done_ids = np.zeros(m, np.int64), np.zeros(m, np.int64), np.full((m, longest), -1, np.int32)
        row, at, steps = np.arange(m), np.zeros(m, np.int64), 0  # numbers of the rows still worked on; next skip
        while len(row):
            i = ranks.argmin(1)
            here = np.arange(len(row))
            best = ranks[here, i]
            if (over := best == none).any():
                out, left, n = row[over], np.flatnonzero(~over), min(longest, width)
                done_ids[out, :n] = symbols[over, :n]
                taken[out] = steps
                row, at, symbols, ranks, i, best = row[left], at[left], np.take(symbols, left, 0), np.take(ranks, left, 0), i[left], best[left]
                here = here[: len(row)]
                if not len(row):
                    break
            skip = skips[row, at] == steps
            at, x, steps = at + skip, np.flatnonzero(~skip), steps + 1
            ranks[here[skip], i[skip]] = none
            k = i[x]
            symbols[x, k] = joined = self.of_rank[best[x]]
            kept = np.ones(symbols.shape, bool)
            kept[here, np.where(skip, width - 1, i + 1)] = False
            symbols = symbols[kept].reshape(len(row), width - 1)
            kept = np.ones(ranks.shape, bool)
            kept[here, np.where(skip, width - 1, i)] = False
            width -= 1
            ranks = ranks[kept].reshape(len(row), width)
            if not width:
                continue
            right = np.where(k + 1 < width, symbols[x, np.minimum(k + 1, width - 1)], -1)
            r, l = np.flatnonzero(right >= 0), np.flatnonzero(k > 0)
            ranks[x, k] = none
            fresh = self._rank(np.concatenate([joined[r], symbols[x[l], k[l] - 1]]), np.concatenate([right[r], joined[l]]))
            ranks[x[r], k[r]] = fresh[: len(r)]
            ranks[x[l], k[l] - 1] = fresh[len(r) :]
        done = (done_ids >= 0).sum(1)
        return done_ids[done_ids >= 0], done, taken

    def _learn(self, chunks: list[str], before: np.ndarray, last: np.ndarray, skips: np.ndarray) -> np.ndarray:
        """Numbers of new outcomes: chunks, and a row each of the candidates skipped, the last of them and the outcome without it (-1: plain)."""
        numbers = np.arange(len(self.taken), len(self.taken) + len(chunks))
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        codes = self.letter[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin = np.cumsum(lengths) - lengths
        space, second = self.ids.get(" ", -2), np.minimum(begin + 1, len(codes) - 1)
        known = np.logical_and.reduceat(codes >= 0, begin) & (lengths <= LONG) & ~((lengths > 1) & (codes[begin] == space) & (codes[second] == space)) & self.unique
        ids, counts, taken = np.zeros(0, np.int64), np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        found: list[list[int]] = []
        order = np.concatenate([np.flatnonzero(known)[np.argsort(lengths[known], kind="stable")], np.flatnonzero(~known)])  # outcomes are numbered in this order
        n_known, parts = int(known.sum()), []
        bounds = np.searchsorted(lengths[order[:n_known]], [1, 5, 7, 9, 11, 14, 18, 24, LONG + 1])
        for a, b in zip(bounds, bounds[1:], strict=False):
            for c in range(a, b, 8192):
                own = order[c : min(b, c + 8192)]
                n = lengths[own]
                ids, counts[own], taken[own] = self.scan_many(codes[np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], n, skips[own])
                parts.append(ids)
        for i in order[n_known:].tolist():
            symbols, taken[i] = (self.scan if lengths[i] <= LONG else self.merge)(chunks[i], [x for x in skips[i].tolist() if x >= 0])
            found.append(self.ids_of(symbols))
            counts[i] = len(found[-1])
        for x in [*parts, *found]:
            self.pool.frombytes(np.asarray(x, "<u4").tobytes())
        self.ends.frombytes((self.ends[-1] + np.cumsum(counts[order])).astype(np.int64).tobytes())
        self.taken.frombytes(taken[order].tobytes())
        self.before.frombytes(before[order].astype(np.int64).tobytes())
        self.last.frombytes(last[order].astype(np.int64).tobytes())
        self.chunk_of += map(chunks.__getitem__, order.tolist())
        out = np.empty(len(chunks), np.int64)
        out[order] = numbers
        return out

    def _alone(self, chunk: str, skips: Iterator[int]) -> int:
        """Number of an outcome that isn't looked up again."""
        symbols, taken = self.merge(chunk, skips)
        self.pool.extend(self.ids_of(symbols))
        self.ends.append(len(self.pool))
        for table, x in ((self.taken, taken), (self.before, -1), (self.last, -1)):
            table.append(x)
        self.chunk_of.append("")
        return len(self.taken) - 1

    def _outcomes(self, chunks: list[str], h: np.ndarray) -> np.ndarray:
        """Numbers of the outcomes of occurrences with these hashes."""
        e = np.fromiter(map(self.plain.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(e < 0).tolist()
        if missing:
            new = list(dict.fromkeys(map(chunks.__getitem__, missing)))
            none = np.full(len(new), -1)
            self.plain.update(zip(new, self._learn(new, none, none, np.zeros((len(new), 0), np.int64)).tolist(), strict=True))
            e[missing] = [self.plain[chunks[i]] for i in missing]
        live, first, depth = np.arange(len(e) if len(self.runs) else 0), np.zeros(len(e), np.int64), 0
        if len(live):  # long chunks may have more candidates than a run can be long: they are drawn one by one
            longer = np.fromiter(map(len, chunks), np.int64, len(chunks)) > LONG
            for i in np.flatnonzero(longer).tolist():
                if next(self.skipped(h[i])) < self.taken[e[i]]:
                    e[i] = self._alone(chunks[i], self.skipped(h[i]))
            live = np.flatnonzero(~longer)
        while len(live):
            run = self._run(h[live], np.full(1, depth, np.uint64))
            skip = first[live] + run
            hit = (run < len(self.runs)) & (skip < np.frombuffer(self.taken, np.int64)[e[live]])
            live, skip, depth = live[hit], skip[hit], depth + 1
            if len(live):
                kinds, place = np.unique(e[live] * (4 * LONG) + skip, return_inverse=True)
                found = np.fromiter(map(self.after.get, kinds.tolist(), repeat(-1)), np.int64, len(kinds))
                fresh = np.flatnonzero(found < 0)
                if len(fresh):
                    was, last = np.divmod(kinds[fresh], 4 * LONG)
                    chain, at = [last], was
                    for _ in range(depth - 1):
                        chain.append(np.frombuffer(self.last, np.int64)[at])
                        at = np.frombuffer(self.before, np.int64)[at]
                    found[fresh] = self._learn([self.chunk_of[i] for i in was.tolist()], was, last, np.stack(chain[::-1], 1))
                    self.after.update(zip(kinds[fresh].tolist(), found[fresh].tolist(), strict=True))
                e[live] = found[place]
                first[live] = skip + 1
        return e

    def _blocks(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[np.ndarray], list[str]]]:
        """(numbers of the texts, hashes of their occurrences, chunks), about `block` chunks at a time."""
        of, hashes, chunks = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            key, at = np.uint64(xxhash.xxh64_intdigest(text.encode(), self.seed)), 0
            found = (m[0] for m in _CHUNK.finditer(" " + text)) if len(text) > 1 << 20 else iter(_CHUNK.findall(" " + text))
            while own := list(islice(found, self.block)):
                of.append(i)
                hashes.append(mix(key + np.arange(at, at + len(own), dtype=np.uint64) * _PLACE))
                chunks += own
                at += len(own)
                if len(chunks) >= self.block:
                    yield of, hashes, chunks
                    of, hashes, chunks = [], [], []
        if chunks:
            yield of, hashes, chunks

    def _ids(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of outcomes one after another, and where those of each end."""
        ends, pool = np.frombuffer(self.ends, np.int64), np.frombuffer(self.pool, "<u4")
        n = ends[e + 1] - ends[e]
        place = np.cumsum(n)
        return pool[np.repeat(ends[e + 1] - place, n) + np.arange(place[-1])], place

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for of, hashes, chunks in self._blocks(texts):
            if len(self.taken) > self.most or len(self.pool) > 16 * self.most:
                self._forget()
            e = self._outcomes(chunks, np.concatenate(hashes))
            ids, place = self._ids(e)
            for i, own in zip(of, np.split(ids, place[np.cumsum([len(x) for x in hashes])[:-1] - 1]), strict=True):
                out[i].append(own)
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, "<u4") for x in out]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text that was encoded."""
        own = np.asarray(ids, np.int64)
        out = []
        for at in range(0, len(own), 1 << 20):
            some = own[at : at + (1 << 20)]
            n = self.width[some]
            place = np.cumsum(n)
            out.append(self.raw[np.repeat(self.begin[some] - place + n, n) + np.arange(place[-1])].tobytes())
        return b"".join(out)[1:].decode()


def pieces(path: str, dropout: float = 0.1, seed: int = 0) -> Pieces:
    """One per Python worker and setting."""
    return worker_cache(("pieces", path, dropout, seed), lambda: Pieces(path, dropout, seed))


def encode(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row; null and empty texts have none. Other columns are ignored."""
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, dropout, seed)
        for got in batches:
            yield batch(fields, [got.column("doc_id"), [x.astype(np.int32) for x in model.encode_all(got.column("text").to_pylist())]])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row; null ids are an empty text."""
    fields = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for got in batches:
            yield batch(fields, [got.column("doc_id"), [model.decode(x or []) for x in got.column("ids").to_pylist()]])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of op7: doc_id, n_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), decoded_sha256, lossless.

    Each text is encoded and its ids decoded again. Null and empty texts have no ids; repeated rows and rows that share an
    id give a row each; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, dropout, seed)
        for got in batches:
            rows = []
            texts = got.column("text").to_pylist()
            for doc_id, text, ids in zip(got.column("doc_id").to_pylist(), texts, model.encode_all(texts), strict=True):
                back = model.decode(ids)
                rows.append((doc_id, len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            if rows:
                yield batch(fields, list(zip(*rows, strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, lossless boolean")
