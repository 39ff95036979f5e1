"""Language ID by cross-parsing entropy.

A suffix automaton is built per language from a bounded sample of labelled text. A text is parsed against each of them
into phrases, each the longest match from where the last one ended; fewer phrases mean a smaller cross entropy. A phrase
costs log2 of the sample's length, so the estimate is phrases * log2(sample) / letters, and the least one wins.

The automata become transition tables, dense for the most frequent letters and sorted for all others, and texts are parsed in lockstep: whole texts are cut into segments (a
phrase never crosses a cut), and one numpy step moves all segments on by one letter against all languages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, fold, small_batches, worker_cache

SEGMENT, LANES = 1024, 2048
DENSE = 2**26  # entries of all languages' dense tables at most, which bounds their letters and nothing else
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_letter", pa.float64())])
DDL = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_letter double"


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Model:
    """Tables of all languages. Entry of a state and letter: (where the next state's row begins) * 2 + (1 if a new phrase begins)."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        coded = {k: points(samples[k]) for k in self.langs}
        seen, counts = np.unique(np.concatenate([*coded.values(), np.zeros(0, np.uint32)]), return_counts=True)
        keep = letters()[seen]
        seen, counts = seen[keep], counts[keep]
        self.seen = seen[np.argsort(-counts, kind="stable")]
        self.width = len(seen) + 2  # until the tables' own is known: letters are 1 and up by frequency
        moves_of = {k: automaton(self.code(coded[k]).tolist()) for k in self.langs}
        states = sum(map(len, moves_of.values()))
        dense = min(len(seen), 253, max(1, DENSE // max(1, states) - 2))
        self.width = dense + 2  # 0: no letter, 1 to dense: frequent letters, then a letter not in any sample, then all others
        self.__dict__.pop("_codes", None)
        tables, self.roots, self.cost, base, rare_at, rare_to = [], [], [], 0, [], []
        self.stride = len(seen) + 2
        self.first_rare = np.zeros((len(self.langs), max(1, len(seen) - dense)), np.int32)
        for i, k in enumerate(self.langs):
            moves = moves_of[k]
            to = np.full((len(moves), self.width), -1, np.int64)
            self.first_rare[i] = base * 2 + 1
            for s, m in enumerate(moves):
                for c, t in m.items():
                    if c <= dense:
                        to[s, c] = t
                    else:  # such a letter's number is one more, after that of unknown ones
                        rare_at.append((base + s * self.width) * self.stride + c)
                        rare_to.append((base + t * self.width) * 2 + (not s))
                        if not s:
                            self.first_rare[i, c - dense - 1] = rare_to[-1]
            first = np.where(to[0] < 0, 0, to[0])
            table = np.where(to < 0, (base + first * self.width) * 2 + 1, (base + to * self.width) * 2)
            table[0] |= 1  # at the root a phrase begins, and an unknown letter is one and leads back there
            tables.append(table.astype(np.int32).ravel())
            self.roots.append(base)
            self.cost.append(np.log2(max(2, len(self.code(coded[k])))))
            base += len(moves) * self.width
        if base >= 2**30:
            raise ValueError("too many languages or too long samples for one table")
        self.table = np.concatenate([*tables, np.zeros(0, np.int32)])
        order = np.argsort(np.array(rare_at, np.int64), kind="stable")
        self.rare_at, self.rare_to = np.array(rare_at, np.int64)[order], np.array(rare_to, np.int32)[order]
        self.limits: dict[str, float] = {}  # bits a letter that held-out text of a language costs, by which reject() goes

    def rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries of states (by language) and letters that aren't in the dense tables."""
        c = codes.astype(np.int64) - 1
        want = state.astype(np.int64) * self.stride + c
        at = np.minimum(np.searchsorted(self.rare_at, want), len(self.rare_at) - 1)
        return np.where(self.rare_at[at] == want, self.rare_to[at], self.first_rare[:, codes - self.width])

    def code(self, at: np.ndarray) -> np.ndarray:
        """Letters as small numbers; runs of other characters as a single 0, none at the ends."""
        if not hasattr(self, "_codes"):
            number = np.arange(1, len(self.seen) + 1)
            self._codes = np.where(letters(), self.width - 1, 0).astype(np.int32)
            self._codes[self.seen] = number + (number > self.width - 2)
        codes = self._codes[at]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        codes = codes[keep]
        return codes[:-1] if len(codes) and not codes[-1] else codes

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_codes"}

    def phrases(self, segments: list[np.ndarray]) -> np.ndarray:
        """Phrases of each segment (rows) against each language (columns)."""
        order = sorted(range(len(segments)), key=lambda i: -len(segments[i]))
        n, k, lengths = len(order), len(self.langs), np.array([len(segments[i]) for i in order])
        grid = np.zeros((lengths.max(initial=0), n), np.int32)
        for j, i in enumerate(order):
            grid[: lengths[j], j] = segments[i]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], n, 1)
        count = np.zeros((k, n), np.int32)
        active = np.searchsorted(-lengths, -np.arange(len(grid)), "left")
        for row, m in zip(grid, active, strict=True):
            others = np.flatnonzero(row[:m] >= self.width)
            if len(others):
                known = row[:m].copy()
                known[others] = 0
                found = self.table[state[:, :m] + known]
                found[:, others] = self.rare(state[:, others], row[others])
            else:
                found = self.table[state[:, :m] + row[:m]]
            count[:, :m] += found & 1
            state[:, :m] = found >> 1
        out = np.empty((n, k), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score (the runner-up's excess over the best, 0 to 1) and bits a letter beyond the first phrase, which any text has."""
        owner, segments, total = [], [], np.zeros(len(texts), np.int64)
        found = np.zeros((len(texts), len(self.langs)), np.int64)

        def flush() -> None:
            if segments:
                np.add.at(found, owner, self.phrases(segments))
                owner.clear()
                segments.clear()

        for i, text in enumerate(texts):
            if text:
                codes = self.code(points(text))
                total[i] = len(codes)
                for at in range(0, len(codes), SEGMENT):
                    owner.append(i)
                    segments.append(codes[at : at + SEGMENT])
                    if len(segments) >= LANES:
                        flush()
        flush()
        bits = found * np.array(self.cost) / np.maximum(total, 1)[:, None]
        out = []
        for i in range(len(texts)):
            if not total[i] or not self.langs:
                out.append(("und", 0.0, None))
                continue
            best = int(bits[i].argmin())
            second = np.delete(bits[i], best).min(initial=np.inf)
            beyond = (found[i][best] - 1) * self.cost[best] / total[i]
            out.append((self.langs[best], 1.0 if np.isinf(second) else float(1 - bits[i][best] / second), float(beyond)))
        return out


def fit(labelled: DataFrame, sample_docs: int = 128, sample_chars: int = 16_384, max_langs: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Automata from at most sample_docs texts and sample_chars letters per language; of all languages, or the most frequent max_langs.

    The sample is that of the least hashes of the id, one per bucket, so it doesn't depend on order or partitioning. Only
    ids are grouped; the chosen texts, a bounded number, are then read, each from a hashed place in it. Equal shares of them
    are taken; what short ones lack comes in equal shares from the others."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    h = F.xxhash64(F.col(id_col), F.lit(7))
    least = usable.groupBy(F.col(lang_col).alias("lang"), F.pmod(h, F.lit(sample_docs)).alias("b")).agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("id"))).alias("x"), F.count("*").alias("n"))
    ordered = least.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).orderBy(F.desc("n"), "lang")
    chosen = {r["lang"]: r["texts"] for r in (ordered if max_langs is None else ordered.limit(max_langs)).collect()}
    top = list(chosen)
    ids = sorted({r["id"] for r in least.where(F.col("lang").isin(top)).select("x.id").collect()}) if top else []
    if not ids:
        return Model({})
    # four times the share, for want of letters elsewhere
    quota = F.create_map(*[F.lit(x) for k, n in chosen.items() for x in (k, -(-sample_chars * 4 // n))])[F.col(lang_col)]
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(8)), F.greatest(F.lit(1), F.length(text_col) - quota + 1)).cast("int") + 1
    got = usable.where(F.col(id_col).isin(ids) & F.col(lang_col).isin(top)).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.substring(F.col(text_col), place, quota).alias("t")).distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["id"], r["t"])):
        if any(c.isalpha() for c in r["t"]):
            texts.setdefault(r["lang"], []).append(r["t"])
    taken = {k: shares(v, sample_chars) for k, v in texts.items()}
    model = Model({k: " ".join(v) for k, v in taken.items()})
    model.limits = held_out_bits(taken, sample_chars)
    return model


def shares(texts: list[str], chars: int) -> list[str]:
    """Equal beginnings of the texts, so many that they have the given length, joined by spaces; shorter texts are whole."""
    room, level = chars - len(texts) + 1, 0
    for i, n in enumerate(sorted(map(len, texts))):
        level = max(1, room // (len(texts) - i))
        if n >= level:
            break
        room -= n
    return [t[:level] for t in texts]


def held_out_bits(texts: dict[str, list[str]], sample_chars: int) -> dict[str, float]:
    """Bits a letter, by language, that all but the dearest twentieth of its texts cost against the language's other half."""
    out: dict[str, float] = {}
    for k, v in texts.items():
        bits = []
        for half in (0, 1):
            model = Model({k: " ".join(v[half::2])[:sample_chars]})
            bits += [b for _, _, b in model.predict(v[1 - half :: 2]) if b is not None]
        out[k] = float(np.quantile(bits, 0.95)) if bits else 0.0
    return out


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, extra: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and bits_per_letter of every row; with extra=True the row's own columns and lang_pred, score, bits_per_letter.

    `und` with score 0 where the text is null or has no letter. Ties go to the language that comes first by name. Repeated
    rows are predicted each; an empty table gives no rows, and without labelled text all is `und`."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    if extra:
        kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "bits_per_letter")]
        base = docs.select(*[F.col(f"`{f.name}`") for f in kept])
        from pyspark.sql.types import DoubleType, StringType, StructField, StructType

        schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_letter", DoubleType())])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_cache("langid", dict)
            for got in batches:
                said = shared.value.predict(got.column(text_col).to_pylist())
                columns = [*got.columns, pa.array([x[0] for x in said], pa.string()), pa.array([x[1] for x in said], pa.float64()), pa.array([x[2] for x in said], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*got.schema.names, "lang_pred", "score", "bits_per_letter"])

        return base.mapInArrow(added, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("langid", dict)
        for got in batches:
            said = shared.value.predict(got.column("text").to_pylist())
            yield batch(SCHEMA, [got.column("doc_id"), got.column("held_out"), *([x[i] for x in said] for i in range(3))])

    held = F.coalesce(fold(F.col(id_col), folds) == 0, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, DDL)


def reject(docs: DataFrame, model: Model, max_bits: float = 8.0, text_col: str = "text") -> DataFrame:
    """The rows in a known language, with their own columns: without those that are `und` or cost too much a letter in every language.

    Too much is more than max_bits, or than a quarter above what held-out text of the predicted language costs if that is
    more; but never as much as letters that the language doesn't have."""
    said = classify(docs, model, text_col=text_col, extra=True)
    limit = F.lit(max_bits)
    for k, bits in model.limits.items():
        own = min(1.25 * bits, 0.97 * float(model.cost[model.langs.index(k)]))
        if own > max_bits:
            limit = F.when(F.col("lang_pred") == k, own).otherwise(limit)
    return said.where((F.col("lang_pred") != "und") & (F.col("bits_per_letter") <= limit)).select(*[F.col(f"`{c}`") for c in docs.columns])
