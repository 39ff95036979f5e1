"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

Canonical form: NFKC, full case folding, NFKC again, each run of white space one space, none at the ends. Its 128-bit
xxhash (two chains of xxhash64 with different seeds) names a bucket. Within buckets that hold several documents the
canonical bytes are compared, and where they differ (a collision), the fingerprint carries their rank. So fingerprints
are equal exactly where canonical texts are. The normaliser is the one that Spark's own collations use, called by the
`reflect` SQL function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.common import cut


def canonical(text: Column) -> Column:
    """Canonical form of a text that is not null."""

    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.btrim(F.regexp_replace(folded, r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def wide(canon: Column, bits: int = 128) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; fewer bits (of the second, then the first) are for tests of collisions."""
    high, low = F.xxhash64(canon), F.xxhash64(F.lit(0x5ED6E), canon, F.lit(1))
    if bits < 128:
        low = F.shiftleft(F.shiftrightunsigned(low, 127 - max(64, bits)), 1) if bits > 64 else F.lit(0).cast("long")
        high = high if bits >= 64 else F.pmod(high, F.lit(1 << bits))
    return high, low


def collisions(members: DataFrame) -> DataFrame:
    """members: h1, h2, canon of buckets with several rows -> h1, h2, canon, rank of buckets whose canonical texts differ.

    Least and greatest bytes are pre-aggregated on the map side, so a bucket of a third of all rows is no burden; only
    buckets in which they differ, by chance none, are looked at further."""
    bound = members.groupBy("h1", "h2").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi")).where("lo <> hi").select("h1", "h2")
    bound = cut(bound, "fingerprint-bound")
    if bound.isEmpty():
        return members.select("h1", "h2", "canon", F.lit(0).cast("bigint").alias("rank")).where("false")
    split = members.join(bound, ["h1", "h2"], "left_semi").distinct()
    smaller = split.select("h1", "h2", F.col("canon").alias("other"))
    ranks = split.join(smaller, ["h1", "h2"]).where("other < canon").groupBy("h1", "h2", "canon").agg(F.count("*").alias("rank"))
    return split.join(ranks, ["h1", "h2", "canon"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def _digest(h1: str, h2: str, rank: Column) -> Column:
    name = F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))
    return F.when(rank > 0, F.concat(name, F.lit("-"), rank.cast("string"))).otherwise(name)


def fingerprints(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a column `fingerprint` (an own column of that name is replaced); rows stay as they are, repeated ones too.

    Null text counts as empty. Only texts in buckets with several rows are shuffled for the comparison of bytes."""
    own = docs.drop("fingerprint", "__h1", "__h2")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = own.withColumns(dict(zip(("__h1", "__h2"), wide(canonical(text), bits), strict=True)))
    many = hashed.groupBy(F.col("__h1").alias("h1"), F.col("__h2").alias("h2")).count().where("count > 1")
    members = hashed.select(F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), canonical(text).alias("canon")).join(many, ["h1", "h2"], "left_semi")
    odd = cut(collisions(members), "fingerprint-collisions")
    if odd.isEmpty():
        return hashed.withColumn("fingerprint", _digest("__h1", "__h2", F.lit(0))).drop("__h1", "__h2")
    odd = odd.select(F.col("h1").alias("__a"), F.col("h2").alias("__b"), F.col("canon").alias("__c"), "rank")
    hashed = hashed.withColumn("__canon", canonical(text))
    joined = hashed.join(odd, (F.col("__a") == F.col("__h1")) & (F.col("__b") == F.col("__h2")) & (F.col("__c") == F.col("__canon")), "left").drop("__canon")
    return joined.withColumn("fingerprint", _digest("__h1", "__h2", F.coalesce("rank", F.lit(0)))).drop("__h1", "__h2", "__a", "__b", "__c", "rank")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 if equal, else 0; an exact digest knows nothing between."""
    return (a == b).cast("double")


def block_of(ids: DataFrame, n: int) -> Column:
    """Number of the range of ids that a row's `doc_id` is in, of about n ranges with as many rows each.

    The bounds are n percentiles; a row is located in two steps of about sqrt(n) comparisons."""
    n = max(2, n)
    bounds = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    coarse = F.size(F.filter(heads, lambda x: x <= F.col("doc_id")))
    rest = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    fine = F.size(F.filter(F.element_at(rest, F.greatest(coarse, F.lit(1))), lambda x: x <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), 0).when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def bounded(df: DataFrame, most: int) -> DataFrame:
    """df to be broadcast if it has at most so many rows, which is counted; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def edited(docs: DataFrame, blocks: int | None = None, bits: int = 128) -> DataFrame:
    """doc_id, text, h1, h2, next_id, n1, n2 and edited: the last third of the code points replaced by the first as many (or all) of the next text.

    h1, h2 and n1, n2 are the wide hashes of the canonical text and of the next one. Next is in descending order of doc_id
    (rows that share one: of text too), and the first after the last; ids that are null come last. Texts are shuffled
    once, to ranges of ids; the first row of each range is copied to the range before it, as its next row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = blocks or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = base.withColumn("blk", block_of(base.select("doc_id"), n))
    top = placed.groupBy("blk").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("top")).select("blk", "top.doc_id").collect()
    order = sorted((r["blk"], r["doc_id"]) for r in top)  # one row per range
    before = {blk: order[(i + 1) % len(order)][0] for i, (blk, _) in enumerate(order)}
    firsts = placed.where(F.col("doc_id").isNull() | F.col("doc_id").isin([x for _, x in order if x is not None]))
    heads = firsts.groupBy("blk").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "text")).alias("x"))
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.create_map().cast("map<int,int>")
    guests = heads.select("x.doc_id", "x.text", F.element_at(to, F.col("blk")).alias("blk"), F.lit(1).alias("guest"))
    both = placed.select("doc_id", "text", "blk", F.lit(0).alias("guest")).unionByName(guests)
    both = both.withColumns(dict(zip(("h1", "h2"), wide(canonical(F.col("text")), bits), strict=True)))
    w = Window.partitionBy("blk").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    k = F.floor(F.length("text") / 3).cast("int")
    led = both.withColumns({a: F.lead(b).over(w) for a, b in (("next_id", "doc_id"), ("next_text", "text"), ("n1", "h1"), ("n2", "h2"))}).where("guest = 0")
    return led.select("doc_id", "text", "h1", "h2", "next_id", "n1", "n2", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - k), F.substring(F.col("next_text"), F.lit(1), k)).alias("edited"))


def digests(docs: DataFrame, bits: int = 128, blocks: int | None = None, most: int = 1_000_000) -> DataFrame:
    """The rows of op1: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Repeated rows give a row each; ids may be null; extra columns are ignored; an empty table gives no rows. A single
    document is its own next one. `most`: rows of ids or hashes up to which they are broadcast, after counting them."""
    e1, e2 = wide(canonical(F.col("edited")), bits)
    made = edited(docs, blocks, bits).select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", e1.alias("e1"), e2.alias("e2"), "n1", "n2")
    table = cut(made, "fingerprint-hashes")
    sides = table.select("h1", "h2").unionByName(table.select(F.col("e1").alias("h1"), F.col("e2").alias("h2")))
    many = bounded(cut(sides.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "fingerprint-buckets"), most)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def texts(ids: DataFrame) -> DataFrame:
        """Texts of these ids (one null id is kept too); others aren't shuffled if the ids are few."""
        wanted = bounded(cut(ids.distinct(), "fingerprint-ids"), most).withColumnRenamed("doc_id", "wanted")
        return text.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def hashed(canon: DataFrame) -> DataFrame:
        return canon.withColumns(dict(zip(("h1", "h2"), wide(F.col("canon"), bits), strict=True))).join(many, ["h1", "h2"], "left_semi").select("h1", "h2", "canon")

    members = hashed(texts(table.join(many, ["h1", "h2"], "left_semi").select("doc_id")).select(canonical(F.col("text")).alias("canon")))
    # edited texts in a bucket with others are rebuilt from the two texts, unless the editing changed nothing
    shared = cut(table.where("not (h1 = e1 and h2 = e2)").select("doc_id", "next_id", F.col("e1").alias("h1"), F.col("e2").alias("h2")).join(many, ["h1", "h2"], "left_semi").select("doc_id", "next_id"), "fingerprint-edited")
    if not shared.isEmpty():
        own = texts(shared.select("doc_id"))
        after = texts(shared.select(F.col("next_id").alias("doc_id"))).select(F.col("doc_id").alias("after_id"), F.col("text").alias("after"))
        k = F.floor(F.length("text") / 3).cast("int")
        pair = shared.distinct().withColumnRenamed("doc_id", "own_id").join(own, F.col("own_id").eqNullSafe(F.col("doc_id"))).join(after, F.col("next_id").eqNullSafe(F.col("after_id")))
        again = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - k), F.substring(F.col("after"), F.lit(1), k))
        members = members.unionByName(hashed(pair.select(canonical(again).alias("canon"))))
    odd = cut(collisions(members), "fingerprint-collisions")
    rank = {"h": F.lit(0), "e": F.lit(0), "n": F.lit(0)}
    named = table
    if not odd.isEmpty():  # texts that hash alike but differ: their rank, found by the text itself
        named = edited(docs, blocks, bits).select("doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h1", "h2", e1.alias("e1"), e2.alias("e2"), "n1", "n2", canonical(F.col("text")).alias("hc"), canonical(F.col("edited")).alias("ec"))
        after = text.select(F.col("doc_id").alias("after_id"), *[x.alias(y) for x, y in zip(wide(canonical(F.col("text")), bits), ("a1", "a2"), strict=True)], canonical(F.col("text")).alias("nc")).distinct()
        named = named.join(after, F.col("next_id").eqNullSafe(F.col("after_id")) & (F.col("a1") == F.col("n1")) & (F.col("a2") == F.col("n2")), "left")
        for side in rank:
            named = named.join(odd.select(F.col("h1").alias(f"{side}1"), F.col("h2").alias(f"{side}2"), F.col("canon").alias(f"{side}c"), F.col("rank").alias(f"{side}r")), [f"{side}1", f"{side}2", f"{side}c"], "left")
            rank[side] = F.coalesce(f"{side}r", F.lit(0))
    named = named.select("doc_id", "n_chars", "edited_sha256", *[_digest(f"{s}1", f"{s}2", rank[s]).alias(x) for s, x in (("h", "fingerprint"), ("e", "edited_fingerprint"), ("n", "next_fingerprint"))])
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
