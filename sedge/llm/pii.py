"""PII: information-theoretic sanitisation.

Base spans (email, ip, card, phone) are found by linear scans. They are the protected entities. The corpus then tells
which terms reveal them: with D the number of documents, df the number that hold a term or an entity, and df(e, t) the
number that hold t within `reach` words of e, the information that t gives away about e is the pointwise mutual
information log2(D df(e, t) / (df(e) df(t))), and e itself is worth IC(e) = log2(D / df(e)). A term met in at least
`support` distinct contexts of e whose PMI is at least alpha * IC(e) discloses it: wherever both are in one text, it is a
span of kind `term`. With full disclosure (PMI = IC, the term is never without the entity) it is removed, else generalised:
replaced by the most frequent of the terms met with the entity that don't disclose it.

All counts are over all documents; copies of a context count once for the support. Hot entities and terms are pre-aggregated in the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, cut, rows_of, small_batches, worker_cache

KINDS = ("email", "ip", "card", "phone", "term")
_RANK = {k: i for i, k in enumerate(KINDS)}
# The patterns of the contract, each anchored so that a scan is linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, ordered by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += ((a, b, "email") for a, b in emails(text))
    found += ((m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += ((m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15)
    return sorted(found, key=lambda s: (s[0], _RANK[s[2]]))


def entity(text: str, span: Span) -> str:
    """The protected value, alike for spellings of one number."""
    value = text[span[0] : span[1]]
    return f"{span[2]}:{value.lower() if span[2] in ('email', 'ip') else _digits(value)}"


def contexts(text: str, spans: list[Span], reach: int) -> Iterator[tuple[str, frozenset[str]]]:
    """Each entity with the terms within `reach` words of it that aren't in a span."""
    words = [(m.start(), m.end(), m[0].lower()) for m in _TERM.finditer(text)]
    merged = merge(spans)
    free, k = [], 0
    for a, b, w in words:
        while k < len(merged) and merged[k][1] <= a:
            k += 1
        if k == len(merged) or merged[k][0] >= b:
            free.append((a, b, w))
    at = 0
    for span in spans:
        while at < len(free) and free[at][0] < span[0]:
            at += 1
        yield entity(text, span), frozenset(w for _, _, w in free[max(0, at - reach) : at + reach])


def merge(spans: list[Span]) -> list[tuple[int, int, str]]:
    """Overlapping spans as one, of the kind that starts first."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0], _RANK[s[2]])):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1]), out[-1][2]
        else:
            out.append((a, b, kind))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _key(*parts: str) -> bytes:
    return hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def disclosures(docs: DataFrame, alpha: float = 0.8, support: int = 3, reach: int = 8, text_col: str = "text", most: int = 200_000) -> DataFrame:
    """entity, term, full (boolean), instead: the terms that disclose an entity, and what stands for them ("" if they are removed). Empty if nothing does.

    `most`: candidate terms up to which their set is sent to the tasks that count them; with more, all terms are counted."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(text_col).alias("text"))
    schema = pa.schema([("e", pa.string()), ("t", pa.string()), ("ctx", pa.binary()), ("doc", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("pii", dict)
        for got in batches:
            rows = []
            for (text,) in rows_of([got], "text"):
                if text and (spans := base_spans(text)):
                    met = set()
                    for e, terms in contexts(text, spans, reach):
                        ctx = _key(*sorted(terms))
                        for t in (*terms, ""):  # the empty term stands for the entity itself
                            rows.append((e, t, ctx, 0 if (e, t) in met else 1))
                            met.add((e, t))
            if rows:
                yield batch(schema, list(zip(*rows, strict=True)))

    met = source.mapInArrow(pairs, "e string, t string, ctx binary, doc long")
    by_context = met.groupBy("e", "t", "ctx").agg(F.sum("doc").alias("docs"))
    counted = cut(by_context.groupBy("e", "t").agg(F.count("*").alias("ctxs"), F.sum("docs").alias("docs")).where(F.col("ctxs") >= support), "pii-pairs")
    pair = counted.where("t <> ''")
    some = pair.select("t").distinct().limit(most + 1).collect()
    if not some:
        return counted.select(F.col("e").alias("entity"), F.col("t").alias("term"), F.lit(True).alias("full"), F.lit("").alias("instead")).where("false")
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["t"] for r in some) if len(some) <= most else None)
    tallies = pa.schema([("t", pa.string()), ("n", pa.int64())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, only = Counter(), wanted.value
        for got in batches:
            for (text,) in rows_of([got], "text"):
                own = {m.lower() for m in _TERM.findall(text or "")}
                counts.update(own if only is None else own & only)
                counts[""] += 1
            if len(counts) > 200_000:
                yield batch(tallies, list(zip(*counts.items(), strict=True)))
                counts.clear()
        if counts:
            yield batch(tallies, list(zip(*counts.items(), strict=True)))

    df = cut(source.mapInArrow(tally, "t string, n long").groupBy("t").agg(F.sum("n").alias("df_t")), "pii-terms")
    total = float(df.where("t = ''").first()["df_t"])
    own = counted.where("t = ''").select("e", F.col("docs").alias("df_e"))
    pmi = F.log2(F.lit(total) * F.col("docs") / (F.col("df_e") * F.col("df_t")))
    scored = pair.join(own, "e").join(df, "t").withColumns({"pmi": pmi, "ic": F.log2(F.lit(total) / F.col("df_e"))}).where("ic > 0")
    tells = F.col("pmi") >= F.col("ic") * F.lit(float(alpha))
    general = scored.where(~tells).groupBy("e").agg(F.max_by("t", F.struct("df_t", "t")).alias("general"))
    full = F.col("docs") == F.col("df_t")
    instead = F.when(full, "").otherwise(F.coalesce("general", F.lit("[TERM]")))
    return scored.where(tells).join(general, "e", "left").select(F.col("e").alias("entity"), F.col("t").alias("term"), full.alias("full"), instead.alias("instead"))


def spans_of(text: str, known: dict[str, dict[str, str]]) -> tuple[list[Span], list[Span], dict[str, str]]:
    """Base spans, all spans, and what stands for the terms among them. known: by entity the terms with what stands for them."""
    base = base_spans(text)
    terms: dict[str, str] = {}
    for span in base:
        for t, instead in known.get(entity(text, span), {}).items():
            terms[t] = min(terms.get(t, instead), instead)  # what one entity demands to be removed is
    if not terms:
        return base, base, {}
    taken, found, k = merge(base), list(base), 0
    for m in _TERM.finditer(text):
        if m[0].lower() in terms:
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or taken[k][0] >= m.end():
                found.append((m.start(), m.end(), "term"))
    return base, sorted(found, key=lambda s: (s[0], _RANK[s[2]])), terms


def redact(text: str, spans: list[Span], terms: dict[str, str]) -> str:
    out, at = [], 0
    for a, b, kind in merge(spans):
        out.append(text[at:a])
        out.append(terms[text[a:b].lower()] if kind == "term" else f"[{kind.upper()}]")
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, found: DataFrame | None = None, text_col: str = "text", most: int = 100_000, digest: bool = True, id_col: str = "doc_id") -> DataFrame:
    """docs with what is found: digest=True the rows of op8 (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term), else docs with text_col sanitised and n_chars, if there, renewed.

    found: of disclosures(); None for base spans only. Up to `most` of its rows are broadcast after counting them; more
    are joined to the documents by the entities in them. Null text counts as empty in the digest and stays null when
    sanitised; repeated rows, ties, null ids and extra columns pass through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c != "__known"]
    base = docs.select(*[F.col(f"`{c}`") for c in names])
    known: dict[str, dict[str, str]] = {}
    large = False
    if found is not None:
        found = cut(found, "pii-disclosures")
        rows = found.limit(most + 1).collect()
        large = len(rows) > most
        for r in rows if not large else []:
            known.setdefault(r["entity"], {})[r["term"]] = r["instead"]
    if large:
        listed = base.select(F.xxhash64(text_col, F.lit(5)).alias("__h"), F.col(text_col).alias("text")).mapInArrow(_entities, "__h long, entity string").distinct()
        own = listed.join(found, "entity").groupBy("__h", "term").agg(F.min("instead").alias("instead")).groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct("term", "instead"))).alias("__known"))
        base = base.withColumn("__h", F.xxhash64(text_col, F.lit(5))).join(own, "__h", "left").drop("__h")
    shared = spark.sparkContext.broadcast(known)

    def known_of(got: pa.RecordBatch) -> Iterator[tuple[str | None, dict]]:
        texts = got.column(text_col).to_pylist()
        if not large:
            yield from ((t, shared.value) for t in texts)
            return
        for text, pairs in zip(texts, got.column("__known").to_pylist(), strict=True):
            own = dict(pairs or [])
            yield text, {entity(text, s): own for s in base_spans(text)} if text and own else {}

    if not digest:
        schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                out = []
                for text, mine in known_of(got):
                    out.append(text if text is None else redact(text, *spans_of(text, mine)[1:]))
                columns = {n: got.column(n) for n in names}
                columns[text_col] = pa.array(out, got.schema.field(text_col).type)
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64()).cast(got.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

        return base.mapInArrow(clean, schema)
    fields = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_term", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = []
            for doc_id, (text, mine) in zip(got.column(id_col).to_pylist(), known_of(got), strict=True):
                own, spans, _ = spans_of(text or "", mine)
                n = Counter(k for _, _, k in spans)
                rows.append((doc_id, *(n[k] for k in KINDS[:4]), hashlib.sha256(joined(own).encode()).hexdigest(), joined(spans), n["term"]))
            if rows:
                yield batch(fields, list(zip(*rows, strict=True)))

    needed = [F.col(id_col).cast("long").alias(id_col), F.col(text_col), *([F.col("__known")] if large else [])]
    return base.select(*needed).mapInArrow(digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long")


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("__h", pa.int64()), ("entity", pa.string())])
    for got in batches:
        rows = [(h, entity(text, s)) for h, text in rows_of([got], "__h", "text") if text for s in base_spans(text)]
        if rows:
            yield batch(schema, list(zip(*rows, strict=True)))
