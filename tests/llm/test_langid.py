import random

from sedge.llm import langid
from tests.llm.helpers import docs, edge_rows


def longest_matches(text: str, sample: str) -> int:
    """Phrases by plain search."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def coded(model, text):
    return "".join(map(chr, model.code(langid.points(text)).tolist()))


def test_phrases_against_plain_search():
    rng = random.Random(1)
    samples = {"xx": "".join(rng.choice("abc ") for _ in range(300)), "yy": "".join(rng.choice("abd ") for _ in range(200))}
    model = langid.Model(samples)
    texts = ["".join(rng.choice("abcde .") for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    segments = [model.code(langid.points(t)) for t in texts]
    got = model.phrases([s for s in segments if len(s)])
    for s, row in zip([s for s in segments if len(s)], got, strict=True):
        text = "".join(map(chr, s.tolist()))
        assert row.tolist() == [longest_matches(text, coded(model, samples[k])) for k in model.langs]


def test_held_out_accuracy(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "and", "er", "sh", "wh"], "de": ["sch", "ung", "der", "ein", "ü", "ich"], "fr": ["eau", "é", "les", "ou", "tion", "ç"]}
    rows = []
    for i in range(240):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang, "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(df.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    got = langid.classify(df, model).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == rows[r.doc_id][2] for r in got) and all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    df = docs(spark, edge_rows() + [(70, "12 .. 34")])
    model = langid.fit(df)
    got = langid.classify(df, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 12 and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[70].lang_pred == "und" and by[1].score == 0
    assert by[4].lang_pred == "en"
    assert {r.doc_id for r in langid.reject(df, model).collect()} == {4, 5, 6, 7, 8, 9, None}
    clash = langid.classify(df.withColumnRenamed("source", "score"), model, extra=True)
    assert clash.columns.count("score") == 1
    nothing = langid.fit(docs(spark, []))
    assert langid.classify(df, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.classify(docs(spark, []), model).count() == 0


def test_every_letter_of_the_samples_counts():
    rng = random.Random(3)
    han, hangul = [chr(0x4E00 + i) for i in range(3000)], [chr(0xAC00 + i) for i in range(900)]
    samples = {"ko": "".join(rng.choice(hangul) for _ in range(4000)), "zh": "".join(rng.choice(han) for _ in range(9000)), "xx": "abcab bca" * 20}
    for dense in (langid.DENSE, 1):
        whole, langid.DENSE = langid.DENSE, dense
        model = langid.Model(samples)
        langid.DENSE = whole
        texts = [samples["zh"][at : at + 30] + "".join(rng.choice(han + hangul + list("abz \u0416")) for _ in range(40)) for at in range(0, 3000, 100)]
        segments = [model.code(langid.points(t)) for t in texts]
        for s, row in zip(segments, model.phrases(segments), strict=True):
            text = "".join(map(chr, s.tolist()))
            assert row.tolist() == [longest_matches(text, coded(model, samples[k])) for k in model.langs]


def test_languages_of_many_letters_are_kept(spark):
    rng = random.Random(4)
    han = [chr(0x4E00 + i) for i in range(1500)]
    words = ["".join(rng.choice(han) for _ in range(2)) for _ in range(900)]
    rows = [(i, "".join(rng.choice(words) for _ in range(120)), "zh", "s", 0) for i in range(200)] + [(1000 + i, " ".join(rng.choice(["the", "river", "stone", "walks"]) for _ in range(60)), "en", "s", 0) for i in range(60)]
    rows += [(2000 + i, "word number here", f"l{i:03}", "s", 0) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert len(langid.fit(df).langs) == 72
    model = langid.fit(df.where("doc_id < 2000 and crc32(cast(doc_id as string)) % 5 <> 0"))
    left = {r.doc_id for r in langid.reject(df.where("doc_id < 2000"), model).collect()}
    assert left >= {r[0] for r in rows if r[2] in ("zh", "en")}
    foreign = spark.createDataFrame([(1, "".join(chr(0xAC00 + rng.randrange(2000)) for _ in range(200)), "zh", "s", 0)], df.schema)
    assert langid.reject(foreign, model).count() == 0


def test_every_chosen_text_teaches_its_share(spark):
    rows = [(i, "".join(chr(0x4E00 + 40 * i + j // 50) for j in range(2000)) if i else "ab", "zh", "s", 0) for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    seen = {(int(c) - 0x4E00) // 40 for c in model.seen if c >= 0x4E00}
    assert len(seen) > 70 and max(seen) > 190 and min(seen) < 10
    places = {(int(c) - 0x4E00) % 40 for c in model.seen if c >= 0x4E00}
    assert len(places) > 20  # not the beginnings alone
    assert [len(t) for t in langid.shares(["a" * 9, "b" * 100, "c" * 100], 101)] == [9, 45, 45]
    assert 16_000 < round(2 ** model.cost[0]) <= 16_384
