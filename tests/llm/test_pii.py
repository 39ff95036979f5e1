import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from sedge.llm import pii
from tests.llm.helpers import docs, edge_rows

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(t):
    def fits(kind, s):
        d = "".join(c for c in s if c in "0123456789")
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 14 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()

    found = [(m.start(), m.end(), k) for k, p in PLAIN.items() for m in re.finditer(p, t) if fits(k, m[0])]
    return sorted(found, key=lambda s: (s[0], list(PLAIN).index(s[2])))


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    for _ in range(30000):
        t = "".join(rng.choice("ab@@..-+ 0123456789012()é%") for _ in range(rng.randrange(0, 40)))
        assert pii.base_spans(t) == brute(t)


def test_long_texts_are_linear():
    for t in ("a" * 300000, "1" * 300000, "+1" * 100000, "a@" * 100000, "1." * 100000):
        pii.base_spans(t)


def test_terms_that_disclose(spark):
    rng = random.Random(3)
    common = ["apple", "river", "stone", "cloud", "table"]
    rows = [(i, f"{rng.choice(common)} {rng.choice(common)} zanzibarian writes to boss@corp.example.com about {rng.choice(common)} {i}") for i in range(12)]
    rows += [(100 + i, " ".join(rng.choice(common) for _ in range(30))) for i in range(60)]
    df = docs(spark, rows)
    found = pii.disclosures(df)
    terms = {r.term for r in found.collect()}
    assert "zanzibarian" in terms and not terms & set(common)
    for most in (100_000, 0):  # broadcast, and joined
        got = {r.doc_id: r for r in pii.detect(df, found, most=most).collect()}
        assert got[3].n_term >= 1 and got[3].n_email == 1 and got[103].spans == ""
        assert got[3].base_sha256 == hashlib.sha256(pii.joined(brute(dict(rows)[3])).encode()).hexdigest()
        clean = {r.doc_id: r.text for r in pii.detect(df, found, most=most, digest=False).collect()}
        assert "zanzibarian" not in clean[3] and "[EMAIL]" in clean[3] and clean[105] == dict(rows)[105]
    few, many = (sorted(map(tuple, pii.disclosures(df, most=m).collect())) for m in (200_000, 1))
    assert few == many


def plain_disclosures(rows, alpha, support, reach):
    """Entity, term, what stands for it, counted document by document."""
    df_t, df_e, both, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, t in rows:
        text, spans = t or "", brute(t or "")
        df_t.update({w.lower() for w in re.findall(r"[^\W\d_]{2,}", text)})
        met = set()
        for a, b, kind in spans:
            value = text[a:b].lower() if kind in ("email", "ip") else "".join(c for c in text[a:b] if c.isdigit())
            free = [(m.start(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{2,}", text) if not any(x < m.end() and m.start() < y for x, y, _ in spans)]
            k = sum(p < a for p, _ in free)
            near = frozenset(w for _, w in free[max(0, k - reach) : k + reach])
            for w in near:
                contexts[f"{kind}:{value}", w].add(near)
                met.add((f"{kind}:{value}", w))
            met.add((f"{kind}:{value}", ""))
        for e, w in met:
            (df_e if not w else both)[e if not w else (e, w)] += 1
    out, n = {}, len(rows)
    scored = {(e, w): math.log2(n * both[e, w] / (df_e[e] * df_t[w])) for (e, w), c in contexts.items() if len(c) >= support and df_e[e] < n}
    for (e, w), pmi in scored.items():
        if pmi >= alpha * math.log2(n / df_e[e]) - 1e-12:
            rest = [(df_t[x], x) for (y, x), p in scored.items() if y == e and p < alpha * math.log2(n / df_e[e]) - 1e-12]
            out[e, w] = "" if both[e, w] == df_t[w] else max(rest)[1] if rest else "[TERM]"
    return out


def test_disclosures_against_brute_force(spark):
    rng = random.Random(6)
    common = ["apple", "river", "stone", "cloud", "table", "of", "in"]
    rows = []
    for i in range(240):
        own = [rng.choice(common) for _ in range(rng.randrange(5, 25))]
        if i % 4 == 0:
            who = rng.randrange(4)
            names = [["lee", "kim"], ["van", "dyck"], ["ines"], ["zo"]][who]
            own[rng.randrange(len(own)) : 0] = [*names[: 1 + rng.randrange(len(names))], f"a{who}@corp.example.com" if who % 2 else f"10.0.0.{who}"]
        elif rng.random() < 0.1:
            own.append(rng.choice(["lee", "ines"]))
        rows.append((i, " ".join(own)))
    for alpha, support, reach in ((0.8, 3, 8), (0.5, 1, 2), (0.95, 2, 30)):
        got = {(r.entity, r.term): r.instead for r in pii.disclosures(docs(spark, rows), alpha, support, reach).collect()}
        assert got == plain_disclosures(rows, alpha, support, reach) and got
    found = pii.disclosures(docs(spark, rows))
    instead = {(r.entity, r.term): r.instead for r in found.collect()}
    assert "" in instead.values() and set(instead.values()) & {*common}
    clean = {r.doc_id: r.text for r in pii.detect(docs(spark, rows), found, digest=False).collect()}
    for i, t in rows:
        held = {pii.entity(t, x) for x in pii.base_spans(t)}
        own = {w: min(instead[e, x] for e, x in instead if x == w and e in held) for e, w in instead if e in held}
        words = [own.get(w, "[EMAIL]" if "@" in w else "[IP]" if w[0].isdigit() else w) for w in t.split(" ")]
        assert clean[i] == " ".join(words)


def test_odd_rows(spark):
    df = docs(spark, edge_rows() + [(50, "ip 1.2.3.4 card 4111 1111 1111 1111 é +1 (415) 555-2671")])
    got = pii.detect(df, pii.disclosures(df)).collect()
    assert len(got) == 12
    r = next(r for r in got if r.doc_id == 50)
    assert (r.n_ip, r.n_card, r.n_phone) == (1, 1, 1)
    assert next(r for r in got if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()
    kept = pii.detect(df, digest=False)
    assert kept.columns == df.columns and kept.where("text is null").count() == 1
    assert pii.detect(docs(spark, []), pii.disclosures(docs(spark, []))).count() == 0
