import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sedge.llm import lm
from tests.llm.helpers import docs, edge_rows


def brute(rows):
    counts = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), lm.END])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = [*(t or "").encode().lower().split(), lm.END]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(own), sum(w in counts for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return sorted(out, key=str)


@pytest.mark.parametrize("head", [131_072, 5])
def test_counts_and_base_against_brute_force(spark, head, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", head)
    rng = random.Random(1)
    rows = edge_rows() + [(100 + i, " ".join(rng.choice(["aa", "bb", "cc dd", f"r{rng.randrange(99)}"]) for _ in range(30))) for i in range(80)]
    got = sorted((tuple(r)[:6] + (r.score,) for r in lm.score(docs(spark, rows)).collect()), key=str)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])) and a[6] < 0 and math.isfinite(a[6])


def test_the_model_learns_what_follows(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        own = ["start"]
        for _ in range(40):
            own.append({"start": "left", "left": "right", "right": "left"}[own[-1]] if rng.random() < 0.9 else "start")
        rows.append((i, " ".join(own)))
    held = [r for r in lm.score(docs(spark, rows)).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def small_model():
    words = [b"aa", b"ba", b"ab", b"bb", b"cb", lm.END]
    rng = np.random.default_rng(1)
    priors = tuple(np.log(rng.dirichlet(np.ones(16), n)).astype(np.float32).reshape(shape) for n, shape in ((1, (16,)), (16, (16, 16)), (256, (256, 16))))
    lex = lm.Lexicon({w: 5 for w in words}, 0, {b"aa": 2, b"ab": 39}, {lm.END: 0, b"aa": 0, b"ab": 0}, priors, np.ones(lm.CELLS), 30, 6, frozenset([b"ba", b"cb"]))
    return lm.Model(lex, tuple(rng.normal(size=t.shape).astype(np.float32) for t in lm.Model(lex).tables))


def test_probabilities_sum_to_one():
    model = small_model()
    symbol, starts = np.array([1, 2, 3], np.uint32), np.array([0])
    total = sum(10 ** model.log10(symbol, np.full(3, c, np.uint8), np.full(3, s, np.uint8), starts) for c in range(lm.CELLS) for s in range(lm.WAYS))
    assert np.allclose(total, 1, atol=1e-4)


def plainly(model, text):
    """log10 of classes, cells and slots of a text, word by word, softmax by softmax."""
    def mix(x):
        x = ((x ^ x >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
        x = ((x ^ x >> 12) * 0x297A2D39) & 0xFFFFFFFF
        return x ^ x >> 15

    lex, own, total = model.lexicon, [*text.encode().lower().split(), lm.END], 0.0
    symbol = [zlib.crc32(w) if w in lex.context else zlib.crc32(w[-2:], 0x5ED6E) for w in own]
    for i, w in enumerate(own):
        past = [symbol[i - k] if i >= k else k for k in (1, 2, 3)]
        f = [mix((past[k] * (2 * k + 3) + 0x9E3779B1 * (k + 1)) & 0xFFFFFFFF) for k in range(3)]
        f.append(mix(f[0] ^ (past[1] * 0x85EBCA6B & 0xFFFFFFFF)))
        cell = 0 if w == lm.END else lex.endings.get(w[-2:], 1)
        rows = [[x % lm.ROWS for x in f], [mix((x * 512 + cell // 16 + 77) & 0xFFFFFFFF) % lm.ROWS for x in f[: lm.USED[1]]], [mix((x * 512 + cell + 256 + 77) & 0xFFFFFFFF) % lm.ROWS for x in f[: lm.USED[2]]]]
        for level, (prior, target) in enumerate(((lex.priors[0], cell // 16), (lex.priors[1][cell // 16], cell % 16), (lex.priors[2][cell], lex.slots.get(w, 15)))):
            z = [float(prior[k]) + sum(float(model.tables[level][r][k]) for r in rows[level]) for k in range(16)]
            total += (z[target] - math.log(sum(map(math.exp, z)))) / math.log(10)
    return total


def test_scores_against_plain_sums():
    model, rng = small_model(), random.Random(3)
    texts = [" ".join(rng.choice(["aa", "ba", "ab", "bb", "cb", "zz", "q"]) for _ in range(rng.randrange(0, 30))) for _ in range(30)]
    texts.append("aa cb " * 9000)  # longer than a cut of the matrix work
    own = lm.Words(model.lexicon)
    for _, ids, starts in lm._batches(own, ((None, t) for t in texts), 10**6):
        symbol, cell, slot, _ = own.look(ids)
        got = np.add.reduceat(model.log10(symbol, cell, slot, starts), starts)
    assert np.allclose(got[:-1], [plainly(model, t) for t in texts[:-1]], rtol=1e-4)
    assert math.isclose(got[-1] - plainly(model, "aa cb " * 3), 8997 * (plainly(model, "aa cb " * 4) - plainly(model, "aa cb " * 3)), rel_tol=1e-4)


def test_partitions_and_neighbours_change_no_score(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "ba", "ab", "bb", "cb", "zz"]) for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    model = small_model()
    own, seen = lm.Words(model.lexicon), []
    for order in (range(60), range(59, -1, -1)):
        for size in (1, 100, 10**6):
            got = {}
            for keys, ids, starts in lm._batches(own, ((i, texts[i]) for i in order), size):
                symbol, cell, slot, _ = own.look(ids)
                got.update(zip(keys, np.add.reduceat(model.log10(symbol, cell, slot, starts), starts).tolist(), strict=True))
            seen.append([got[i] for i in range(60)])
    assert all(x == seen[0] for x in seen)


def test_clashing_columns(spark):
    df = docs(spark, [(i, "a b c " * (i % 4)) for i in range(30)])
    clash = df.withColumnRenamed("lang", "score").withColumnRenamed("source", "w")
    got, want = ({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm.score(x).collect()} for x in (clash, df))
    assert got == want and len(got) == 30


def test_empty_table_and_no_training_rows(spark):
    assert lm.score(docs(spark, [])).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm.score(docs(spark, [(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)


def test_a_text_costs_the_same_wherever_it_lies(spark):
    rng = random.Random(7)
    text = " ".join(rng.choice(["aa", "ba", "cb", "dd", "ee"]) for _ in range(37))
    rows = [(i, text) for i in range(480)]  # 18,240 tokens in a row, so that cuts of the matrix work fall within texts
    got = [r.score for r in lm.score(docs(spark, rows).coalesce(1)).collect()]
    assert len(got) == 480 and max(got) - min(got) < 1e-4 * abs(min(got))
