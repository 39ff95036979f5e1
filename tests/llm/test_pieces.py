import itertools
import random

import numpy as np
import sentencepiece
import xxhash

from sedge.llm import pieces
from sedge.llm.jaccard import mix
from sedge.llm.queries import tokenizer_path
from tests.llm.helpers import docs, edge_rows

PATH = tokenizer_path("piece_bpe_32k.model")
TEXTS = ["Hello there  world", " lead", "trail ", "\n\ttabs\n", "日本語 café 😀", "a▁b ▁", "    ", "x" * 500, "The 123 quick-brown foxes"]


def test_without_dropout_as_the_library():
    own, library = pieces.Pieces(PATH, 0.0), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(1)
    for t in TEXTS + ["".join(rng.choice("abcde .é\n") for _ in range(60)) for _ in range(200)]:
        if "▁" not in t:
            assert own.encode(t).tolist() == library.encode(t)
        assert own.decode(own.encode(t)) == t


def test_dropout_varies_by_seed_and_decodes():
    t = "wonderful international conversations " * 20
    made = [pieces.Pieces(PATH, 0.2, seed).encode(t).tolist() for seed in (1, 2, 1)]
    assert made[0] == made[2] != made[1]
    assert all(pieces.Pieces(PATH).decode(m) == t for m in made)
    for t in TEXTS:
        own = pieces.Pieces(PATH, 0.5, 7)
        assert own.decode(own.encode(t)) == t
    letters = pieces.Pieces(PATH, 1.0)
    assert len(letters.encode("abc def")) == 8


def test_forgetting_changes_nothing():
    small, large = pieces.Pieces(PATH, 0.1, 3, most=2), pieces.Pieces(PATH, 0.1, 3)
    for t in TEXTS * 3:
        assert small.encode(t).tolist() == large.encode(t).tolist()


def agenda(model, chunk, skipped):
    """Plain merging: the best candidate of all, from the left, again and again; those whose numbers are in skipped stay unjoined till a neighbour changes."""
    symbols, barred, taken = list(chunk), set(), 0
    while True:
        best = None
        for i in range(len(symbols) - 1):
            s = model.score.get(symbols[i] + symbols[i + 1])
            if s is not None and i not in barred and (best is None or s > best[0]):
                best = s, i
        if best is None:
            return symbols
        i = best[1]
        if taken in skipped:
            barred.add(i)
        else:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            barred = {j if j < i - 1 else j - 1 for j in barred if j < i - 1 or j > i + 1}
        taken += 1


def slow(model, text):
    """Chunk by chunk with nothing remembered."""
    key, out = np.uint64(xxhash.xxh64_intdigest(text.encode(), model.seed)), []
    for j, chunk in enumerate(pieces._CHUNK.findall(" " + text)):
        h = mix(key + np.array([j], np.uint64) * pieces._PLACE)[0]
        skipped = {x for x in itertools.takewhile(lambda x, n=len(chunk): x < 3 * n, model.skipped(h))}
        for x in agenda(model, chunk, skipped):
            out += [model.ids[x]] if x in model.ids else [model.byte_id[b] for b in x.encode()]
    return out


def test_ways_to_merge_agree():
    model, rng = pieces.Pieces(PATH, 0.3, 1), random.Random(4)
    for _ in range(400):
        chunk = " " * rng.randrange(1, 3) + "".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 20)))
        skips = sorted(rng.sample(range(20), rng.randrange(0, 6)))
        want = agenda(model, chunk, set(skips))
        assert model.scan(chunk, skips)[0] == model.merge(chunk, skips)[0] == want
        assert model.scan(chunk, skips)[1] == model.merge(chunk, skips)[1]


def test_every_occurrence_has_draws_of_its_own():
    text, rng = "conversations " * 400, random.Random(3)
    prose = " ".join("".join(rng.choice(["the", "in", "er", "on", "é", "st", "x😀", "  ", "12"]) for _ in range(rng.randrange(1, 14))) for _ in range(300))
    for dropout in (0.001, 0.1, 0.5, 1.0):
        model = pieces.Pieces(PATH, dropout, 5, block=97)
        whole = pieces.Pieces(PATH, dropout, 5)
        for t in [text, prose, *TEXTS, *TEXTS]:
            assert model.encode(t).tolist() == slow(model, t) == whole.encode(t).tolist()
        assert [x.tolist() for x in whole.encode_all([None, prose, "", *TEXTS])] == [[], slow(whole, prose), [], *(slow(whole, t) for t in TEXTS)]
        numbers = list(itertools.takewhile(lambda x: x < 200_000, model.skipped(np.uint64(77))))
        assert sorted(set(numbers)) == numbers and abs(len(numbers) - 200_000 * dropout) <= 6 * (200_000 * dropout * (1 - dropout)) ** 0.5


def test_no_word_is_bound_to_a_few_segmentations():
    model, plain = pieces.Pieces(PATH, 0.1, 5), pieces.Pieces(PATH, 0.0)
    single = [w for w in "abcdefghijklmnopqrstuvwxyz" if len(plain.encode(w)) == 1]
    assert len(single) > 15
    for w in single:  # one candidate, of which a tenth is skipped, in any word
        split = len(model.encode(f"{w} " * 3000 + ".")) - len(plain.encode(f"{w} " * 3000 + "."))
        assert 0.07 * 3000 < split < 0.13 * 3000
    ids = " ".join(map(str, model.encode("conversations " * 4000).tolist()))
    assert len(set(ids.split(f" {plain.encode('conversations conversations').tolist()[-1]} "))) > 20


def test_tables(spark):
    df = docs(spark, edge_rows())
    got = pieces.round_trip(df, PATH).collect()
    assert len(got) == 11 and all(r.lossless for r in got) and {r.n_ids for r in got if r.doc_id in (1, 2)} == {0}
    back = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in edge_rows()), key=str)
    assert pieces.round_trip(docs(spark, []), PATH).count() == 0
    clash = df.withColumnRenamed("source", "ids").withColumnRenamed("lang", "n_ids")
    assert sorted(pieces.round_trip(clash, PATH).collect(), key=str) == sorted(got, key=str)
