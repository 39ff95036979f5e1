import random
import zlib
from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from sedge.llm import pii
from sedge.llm.queries import oracle_sql, queries, tokenizer_path
from tests.llm.helpers import docs, edge_rows
from tests.llm.test_jaccard import brute as linked
from tests.llm.test_jaccard import near_copies
from tests.llm.test_linededup import brute as deduped


#: In none of the labelled languages, so the first stage rejects it.
FOREIGN = "日本語 テキスト 漢字 書く 読む"


def corpus(rng):
    plain = {6: "the river and stone " * 5000, 8: "under the river walks and stone"}
    rows = [(300 + (i or 0), plain.get(i, t)) for i, t in edge_rows()]
    passage = "shared one line\nshared two line\nshared three line"
    for i in range(40):
        own = [" ".join(rng.choice(["the", "and", "river", "stone", "cloud", "walks", "under", f"word{rng.randrange(200)}"]) for _ in range(12)) for _ in range(6)]
        rows.append((i, "\n".join([*own[:3], *([passage] if i % 4 == 0 else []), *own[3:]]) + (" mail me@host.example.org" if i % 5 == 0 else "")))
    rows += [(100 + i, rows[11 + i][1].replace("\n", " ").replace("the", "THE", 1)) for i in range(0, 40, 7)]
    unlabelled = next(i for i in range(400, 500) if zlib.crc32(str(i).encode()) % 5 == 0)  # not among those that teach
    return [*rows, (unlabelled, FOREIGN)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(random.Random(8))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    now, frames = docs(spark, rows), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = frames[name] = spark.read.parquet(f"{tmp_path}/{name}")
    pairs = {k: [(r.doc_id, r.text) for r in v.collect()] for k, v in frames.items() if k != "packing"}
    assert sorted(pairs["language_id"], key=str) == sorted(((i, t) for i, t in rows if t and t != FOREIGN and any(c.isalpha() for c in t)), key=str)
    want = [(i, t) for i, t, n, _ in deduped(pairs["language_id"]) if not n or t.strip()]
    assert sorted(pairs["line_dedup"], key=str) == sorted(want, key=str)
    keep = {d for d, _, c in linked(pairs["line_dedup"]) if d == c}
    assert sorted(pairs["ngram_jaccard"], key=str) == sorted({r for r in pairs["line_dedup"] if r[0] in keep}, key=str)
    assert {i for i, _ in pairs["pii"]} == {i for i, _ in pairs["ngram_jaccard"]}
    assert not any(pii.base_spans(t) for _, t in pairs["pii"])
    for name in pairs:
        assert frames[name].columns == docs(spark, []).columns
    from tokenizers import Tokenizer

    tokenizer, total = Tokenizer.from_file(tokenizer_path()), defaultdict(int)
    for r in now.collect():
        total[r.doc_id] += r.length
    sizes = defaultdict(int)
    for i, t in pairs["pii"]:
        sizes[i] += len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert dict(total) == dict(sizes)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, now.select("doc_id", "start", "length", "ids_crc32").collect()))


def test_near_duplicates_share_five_word_shingles(spark):
    own = [f"w{i}" for i in range(100)]
    rows = [(i, t) for i, t in edge_rows() if i] + [(20, " ".join(own)), (21, " ".join(own[:90] + [f"x{i}" for i in range(10)]))]  # 86 of 106
    rows += [(30 + i, t) for i, t in near_copies(4)]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").select("doc_id", "text").collect()
    keep = {d for d, _, c in linked(rows, 5, 80) if d == c}
    assert 20 in keep and 21 not in keep and keep != {d for d, _, c in linked(rows) if d == c}
    assert sorted(map(tuple, got), key=str) == sorted({r for r in rows if r[0] in keep}, key=str)


def test_empty_documents(spark, tmp_path):
    now = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


def test_all_ten_are_registered():
    assert {int(k[2:].split("_")[0]) for k in queries()} == set(range(1, 11)) and set(oracle_sql()) <= set(queries())


def test_near_duplicates_broadcast_no_searched_sets(spark, monkeypatch):
    seen, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(df.columns) or broadcast(df))
    text = " ".join(f"w{i}" for i in range(60))
    rows = docs(spark, [(i, text + (" more" * (i % 2))) for i in range(6)] + [(9, "another text of some words in all")])
    kept = corpus_pipeline.near_duplicates(spark, rows, "").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == [0, 9]
    assert not [columns for columns in seen if "block" in columns]
