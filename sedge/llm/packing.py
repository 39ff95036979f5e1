"""Packing: vector bin packing of token pieces into training sequences.

Every example is a vector of demands (tokens, segments, loss-bearing tokens) and every sequence a bin with a limit on
each. Bins are filled one at a time: of the waiting examples that fit, the one whose demand has the largest dot product
with what is left in the bin (both in units of the limits) goes in next. Examples may be cut, so where none fits, the
longest one is cut to fill the bin. A bin that ends short, for want of examples or by another limit, is cut into bins
whose lengths are powers of two, which need no padding.

Tasks pack what they read; nothing is shuffled and memory is bounded by `window` waiting examples. The sequence ids hold
the partition's number, so a task that is run again gives the same rows.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, small_batches, worker_cache

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Numbers(dict):
    """Numbers of parts of texts, in the order in which they are met."""

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        return n


class TextIds:
    """Ids of texts by a tokenizer that lower-cases and parts texts by a pattern, each part a word of its own to it.

    Texts are lower-cased and parted here; the tokenizer's own merges turn a part into ids once, which are remembered.
    Chunks between white space that hold anything but composed Latin letters, digits and signs (special tokens' marks among
    them) go through the whole tokenizer, and are remembered likewise. Beyond `most` parts the memory begins anew."""

    #: Latin code points that lower-case alone and are composed already, without the mark that special tokens begin with.
    PLAIN = "\x21-\x3b\x3d-\x7e\u00a1-\u012f\u0131-\u024f"
    BLANK = r"\x20\x09-\x0D"
    WHOLE = "\n"  # before a chunk that is encoded whole; no part holds it

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = [x for x in steps if x.get("type") == "Split" and x.get("invert")]
        lower = any(x.get("type") == "Lowercase" for x in (spec.get("normalizer") or {}).get("normalizers", []))
        own = lower and len(split) == 1 and steps[1:] and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")
        self.parts = self._latin(split[0]["pattern"]["Regex"]) if own else None
        self.strange = re.compile(f"[^{self.PLAIN}{self.BLANK}]" if own else f"[^{self.BLANK}]")
        plain = f"[{self.PLAIN}]*+" if own else ""
        self.chunk = regex.compile(f"(?<![^{self.BLANK}])({plain}{self.strange.pattern}[^{self.BLANK}]*+)")
        # byte-level letters: bytes that print stand for themselves, the others for the code points from 256 on
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.letters = {b: 256 + i for i, b in enumerate(other)}
        self._forget()

    @staticmethod
    def _latin(pattern: str) -> re.Pattern:
        """The pattern for lower-cased plain texts, their letters and digits listed."""
        known = sorted({x for c in map(chr, range(0x250)) for x in c.lower()})
        letters, digits = (re.escape("".join(c for c in known if regex.match(rf"\p{{{k}}}", c))) for k in "LN")
        return re.compile(re.sub(r"\\p\{([LN])\}", lambda m: letters if m[1] == "L" else digits, pattern))

    def _forget(self) -> None:
        self.numbers, self.ids, self.ends = Numbers(), array("I"), array("q", [0])

    def _split(self, text: str | None) -> list[str]:
        """Parts of a text, and chunks that are encoded whole."""
        if not text:
            return []
        if not self.strange.search(text):
            return self.parts.findall(text.lower())
        out: list[str] = []
        for i, own in enumerate(self.chunk.split(text)):
            if i % 2:
                out.append(self.WHOLE + own)
            elif self.parts:
                out += self.parts.findall(own.lower())
        return out

    def _learn(self, new: list[str]) -> None:
        ids, ends, merged = self.ids, self.ends, self.tokenizer.model.tokenize
        for x in new:
            if x[0] == self.WHOLE:
                ids.extend(self.tokenizer.encode(x[1:], add_special_tokens=False).ids)
            else:
                ids.extend([t.id for t in merged(x if x.isascii() else x.encode().decode("latin-1").translate(self.letters))])
            ends.append(len(ids))

    def encode(self, texts: list[str | None], end: int | None) -> list[np.ndarray]:
        """Ids of each text, with the end id after them."""
        if len(self.numbers) > self.most:
            self._forget()
        before = len(self.numbers)
        last = [] if end is None else [-1]
        split = [np.fromiter(chain(map(self.numbers.__getitem__, own), last), np.int64, len(own) + len(last)) for own in map(self._split, texts)]
        self._learn(list(islice(self.numbers, before, None)))
        ids, ends, out = np.frombuffer(self.ids, "<u4"), np.frombuffer(self.ends, np.int64), []
        for own in split:
            start = np.where(own < 0, 0, ends[own])
            n = np.where(own < 0, 1, ends[own + 1] - start)
            place = np.cumsum(n)
            found = np.empty(0, "<u4") if not len(own) else ids[np.repeat(start - place + n, n) + np.arange(place[-1])] if len(ids) else np.zeros(place[-1], "<u4")
            if last:
                found[-1] = end
            out.append(found)
        return out


def text_ids(path: str) -> TextIds:
    """One per Python worker, which serves many tasks."""
    return worker_cache(("packing", path), lambda: TextIds(path))


class Packer:
    """Dot-product packing of examples given as lengths and the position of their first loss-bearing token.

    feed() and finish() yield sequences, each a list of (example, start, length)."""

    def __init__(self, max_tokens: int = 2048, max_segments: int = 1024, max_loss: int = 2048, window: int = 512):
        if min(max_tokens, max_segments, max_loss, window) < 1:
            raise ValueError("limits must be positive")
        self.most = max_tokens, max_segments, max_loss
        self.limit = np.array(self.most, float)
        self.window = window
        self.demand = np.zeros((2 * window, 3))
        self.waiting: list[tuple[object, int, int, int]] = []  # example, start, length, first loss-bearing token

    @staticmethod
    def loss(start: int, length: int, first: int) -> int:
        return max(0, start + length - max(start, first))

    def _piece(self, start: int, length: int, first: int, tokens: int, loss: int) -> int:
        """The most of an example that goes within the two limits."""
        free = max(0, first - start)
        return min(length, tokens, free + loss)

    def feed(self, example, length: int, first: int = 0) -> Iterator[list]:
        start, (tokens, _, loss) = 0, self.most
        while length - start >= tokens:  # whole sequences of one example
            n = self._piece(start, length - start, first, tokens, loss)
            if n < tokens:
                break
            yield [(example, start, n)]
            start += n
        if length > start:
            self._wait(example, start, length - start, first)
            if len(self.waiting) >= 2 * self.window:
                yield from self._fill(self.window)

    def _wait(self, example, start, length, first):
        self.demand[len(self.waiting)] = length, 1, self.loss(start, length, first)
        self.waiting.append((example, start, length, first))

    def _take(self, i: int):
        last = len(self.waiting) - 1
        found, self.waiting[i] = self.waiting[i], self.waiting[last]
        self.demand[i] = self.demand[last]
        self.waiting.pop()
        return found

    def _fill(self, until: int) -> Iterator[list]:
        while len(self.waiting) > until:
            left, bin_ = self.limit.copy(), []
            while left.min() >= 1 and self.waiting:
                demand = self.demand[: len(self.waiting)]
                gain = np.where((demand <= left).all(1), demand @ (left / self.limit**2), -1.0)
                i = int(gain.argmax())
                if gain[i] >= 0:
                    example, start, length, first = self._take(i)
                else:
                    example, start, n, first = self._take(int(demand[:, 0].argmax()))
                    length = self._piece(start, n, first, int(left[0]), int(left[2]))
                    self._wait(example, start + length, n - length, first)
                bin_.append((example, start, length))
                left -= length, 1, self.loss(start, length, first)
            yield from self._closed(bin_)

    def finish(self) -> Iterator[list]:
        yield from self._fill(0)

    def _closed(self, bin_: list) -> Iterator[list]:
        """The bin itself if it is full, else cut into lengths that are powers of two."""
        total, most = sum(x[2] for x in bin_), self.most[0]
        if total == most:
            yield bin_
            return
        pieces, at = list(reversed(bin_)), total
        while at:
            room = 1 << (at.bit_length() - 1)
            at -= room
            own = []
            while room:
                example, start, length = pieces.pop()
                n = min(length, room)
                own.append((example, start, n))
                room -= n
                if n < length:
                    pieces.append((example, start + n, length - n))
            yield own


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", loss_from: str | None = None, end_id: int | None = 1,
         max_tokens: int = 2048, max_segments: int = 1024, max_loss: int = 2048, window: int = 512) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    tokenizer: path of a tokenizers file whose pre-tokenizer parts at white space. end_id closes each document (None: none).
    loss_from: a column with the number of leading ids that bear no loss (prompts of instruction data); null or absent: 0.
    Null and empty texts give the end id alone (no row without one); rows that share an id are packed as separate
    examples; a null id stays null; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        ids_of, packer = text_ids(tokenizer), Packer(max_tokens, max_segments, max_loss, window)
        rows: list = []

        def add(sequences) -> None:
            nonlocal sequence
            for own in sequences:
                at = 0
                for (doc_id, ids, first), start, length in own:
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, at, packer.loss(start, length, first)))
                    at += length
                sequence += 1

        for got in batches:
            for doc_id, ids, first in zip(got.column("doc_id").to_pylist(), ids_of.encode(got.column("text").to_pylist(), end_id), got.column("first").to_pylist(), strict=True):
                add(packer.feed((doc_id, ids, max(0, first or 0)), len(ids), max(0, first or 0)))
            if rows:
                yield batch(SCHEMA, list(zip(*rows, strict=True)))
                rows.clear()
        add(packer.finish())
        if rows:
            yield batch(SCHEMA, list(zip(*rows, strict=True)))

    small_batches(docs.sparkSession)
    first = F.col(loss_from).cast("long") if loss_from else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), first.alias("first")).mapInArrow(run, DDL)


def padding(lengths: list[int], max_tokens: int = 2048) -> dict[str, int]:
    """Tokens and padding of sequences with these lengths."""
    short = [n for n in lengths if n & (n - 1)]
    return dict(tokens=sum(lengths), padding=sum(max_tokens - n for n in short))
