import random
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import jaccard
from sedge.llm.common import cut
from sedge.llm.components import components, lookup
from tests.llm.helpers import docs, edge_rows, words


def brute(rows, k=4, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) if sets[i] else (d, 0, d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed=1):
    rng, rows = random.Random(seed), []
    for _ in range(12):
        base = words(rng, rng.randrange(5, 120), 60)
        for _ in range(rng.randrange(1, 12)):
            own = list(base)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["zz", "W3", "q"])
            rows.append((len(rows) + 1, " ".join(own[: rng.randrange(max(1, len(own) - 4), len(own) + 1)])))
    return rows


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_against_brute_force(spark, percent):
    rows = near_copies() + [(500 + (i or 0), t) for i, t in edge_rows()]
    got = jaccard.link(docs(spark, rows), k=4, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, percent=percent)


def test_large_blocks_in_pieces(spark):
    rows = near_copies(2)
    rng, base = random.Random(5), words(random.Random(6), 80, 60)
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(0, 3)):
            own[rng.randrange(80)] = f"e{rng.randrange(9)}"
        rows.append((1000 + i, " ".join(own)))
    got = jaccard.link(docs(spark, rows), k=4, percent=85, block_elements=300, pivots=2).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_search_is_exact_by_heap_and_by_sort():
    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(60), rng.randrange(10, 40))), np.uint64) for _ in range(80)]
    for heap in (0, 10**6):
        for mu in (0.0001, 0.05, 1.0):
            index = jaccard.Index(list(range(80)), sets, 70, mu, heap)
            for s in sets[:20]:
                want = {i for i, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 70 * len(np.union1d(s, t))}
                assert {index.ids[c] for c in index.linked(s)} == want


def linked_pairs(rng, percent, longest=300):
    for _ in range(400):
        n = int(rng.integers(4, longest))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = a[rng.random(len(a)) > rng.random() * (100 - percent) / 120]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and both and len(a) + len(b) > 2 * both and 100 * both >= percent * (len(a) + len(b) - both):
            yield a, b


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_the_keys_they_need(percent):
    keys, n = jaccard.Keys(percent), 0
    for a, b in linked_pairs(np.random.default_rng(1), percent):
        (x, p), (y, q) = keys.of(a), keys.of(b)
        bands = {}
        for own, tags in ((x, p), (y, q)):
            for key, tag in zip(own.tolist(), tags.tolist(), strict=True):
                bands.setdefault(tag >> 16, []).append((key, tag & 0xFFFF))
        ok = False
        for found in bands.values():
            names = [k for k, _ in found]
            shared = len(names) - len(set(names))
            ok |= shared > 0 and shared >= max(t for _, t in found)
        assert ok
        n += 1
    assert n > 50


def test_hot_keys_are_combined():
    keys, sets, tags = np.repeat(np.arange(5, dtype=np.uint64), 1000), np.tile(np.arange(1000), 5), np.full(5000, 3 << 16 | 2)
    key, sid, info = jaccard.combined(np.r_[keys, np.uint64(99)], np.r_[sets, 7], np.r_[tags, 3 << 16 | 2])
    assert len(key) == 5 + 1 + 1 + 1000  # the hot keys once each for the node, one that is alone, the node's own key and its sets
    alone = [(s, i) for k, s, i in zip(key.tolist(), sid.tolist(), info.tolist(), strict=True) if k == 99]
    assert alone == [(7, 1 << 32 | 3 << 16 | 2)]
    assert sorted((s, i >> 32, i & 0xFFFF) for s, i in zip(sid.tolist(), info.tolist(), strict=True) if 0 <= s < 1000 and i >> 32 == 5) == [(s, 5, 2) for s in range(1000)]
    assert {(i >> 32, i & 0xFFFF) for s, i in zip(sid.tolist(), info.tolist(), strict=True) if not 0 <= s < 1000} == {(1, 0)}


def test_buffers_and_tasks_change_nothing(spark):
    rows = near_copies(3) * 2 + [(900 + i, t) for i, (_, t) in enumerate(near_copies(3))]
    whole = brute(rows, 5, 80)
    for n in (1, 9):
        assert sorted(map(tuple, jaccard.link(docs(spark, rows).repartition(n)).collect()), key=str) == whole


def test_equal_first_hashes(spark):
    rows = near_copies(4)
    got = jaccard.link(docs(spark, rows), k=4, percent=85, bits=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_components_in_rounds_and_at_once(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(300, 340)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a long, b long")
    at_once, rounds = ({tuple(r) for r in components(df, links=n).collect()} for n in (1000, 1))
    root = {x: x for p in pairs for x in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert at_once == rounds == {(n, r) for n, r in root.items() if any(root[a] == r and a != b for a, b in pairs)}


def test_components_in_rounds_take_few_jobs(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(300)] + [(x, 5_000) for x in range(6_000, 6_300)] + [(5_000, 4_000)]  # a path, and a hub with a node below it
    df, names = spark.createDataFrame(pairs, "a long, b long").repartition(16), []
    monkeypatch.setitem(components.__globals__, "cut", lambda df, name: names.append(name) or cut(df, name))
    spark.sparkContext.setJobGroup("rounds", "components in rounds")
    try:
        got = {tuple(r) for r in components(df, links=1).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(i, 0) for i in range(301)} | {(x, 4_000) for x in [4_000, 5_000, *range(6_000, 6_300)]}
    rounds = names.count("components") - 1
    assert 1 < rounds <= 20
    assert jobs <= 9 * rounds + 9, (jobs, rounds)  # each costs the driver memory


def test_broadcasts_dont_grow_with_the_rows(spark, monkeypatch):
    seen, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append((df.columns, df.count())) or broadcast(df))
    rows = spark.range(120_000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 1000 = 1 then null else id end as key")
    table = spark.range(60_000).selectExpr("id as key", "id + 1 as x")
    for how in ("left", "inner"):
        got = lookup(rows, table, "key", how).selectExpr("count(*)", "count(x)", "count(distinct id)", "sum(if(x <> key + 1, 1, 0))").first()
        want = rows.join(table, "key", how).selectExpr("count(*)", "count(x)", "count(distinct id)", "sum(if(x <> key + 1, 1, 0))").first()
        assert tuple(got) == tuple(want)
    assert max(n for _, n in seen) <= 50_000
    seen.clear()
    jaccard.link(docs(spark, near_copies()), k=4, percent=85).collect()
    assert not [columns for columns, _ in seen if "block" in columns]  # sets that are searched


def test_more_members_than_tasks_are_told(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_search", partial(jaccard._search, most_members=3))
    rows = near_copies() + [(500 + (i or 0), t) for i, t in edge_rows()] + [(None, t) for _, t in near_copies()[:4]]
    assert sorted(map(tuple, jaccard.link(docs(spark, rows), k=4, percent=85).collect()), key=str) == brute(rows)


def test_members_without_an_id_and_with_one_id(spark):
    rows = near_copies() + [(None, t + " more") for _, t in near_copies()[:9]] + [(0, t) for _, t in near_copies(3)]
    assert sorted(map(tuple, jaccard.link(docs(spark, rows), k=4, percent=85).collect()), key=str) == brute(rows)


def test_extra_columns(spark):
    df = docs(spark, near_copies(4))
    clash = df.withColumnRenamed("lang", "sid").withColumnRenamed("source", "component_id")
    assert sorted(map(tuple, jaccard.link(clash).collect())) == sorted(map(tuple, jaccard.link(df).collect()))


def test_empty_table(spark):
    assert jaccard.link(docs(spark, [])).count() == 0


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_shuffles_go_with_the_step_that_made_them(spark, monkeypatch):
    before, left = shuffle_files(spark), []
    monkeypatch.setattr(jaccard, "cut", lambda df, name: [cut(df, name), left.append(len(shuffle_files(spark) - before))][0])
    rows = near_copies()
    assert sorted(map(tuple, jaccard.link(docs(spark, rows), k=4, percent=85).collect()), key=str) == brute(rows)
    assert len(left) > 6 and max(left) <= 30, left


def test_keys_are_dealt_by_their_number(spark, monkeypatch):
    frame, dealt = type(spark.range(1)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *by: dealt.append(by) or deal(df, *by))
    monkeypatch.setattr(jaccard, "SHINGLES_A_TASK", 300)
    rows = near_copies(5)
    got = sorted(map(tuple, jaccard.link(docs(spark, rows), k=4, percent=85).collect()), key=str)
    assert got == brute(rows)
    assert [n for n, *key in dealt if key == ["key"]] == [sum(n for n, _ in {(n, t) for (_, t), (_, n, _) in zip(rows, brute(rows), strict=True)}) // 300]
