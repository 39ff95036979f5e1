import random

from sedge.llm import linededup
from tests.llm.helpers import docs, edge_rows


def brute(rows, k=3):
    white = " \t\n\v\f\r"
    seen, gone, out = {}, {}, []
    own = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in own:
        lines = [(n, x.strip(white)) for n, x in enumerate((t or "").split("\n")) if x.strip(white)]
        for p in range(len(lines) - k + 1):
            key = tuple(x for _, x in lines[p : p + k])
            if seen.setdefault(key, (i, p)) != (i, p):
                gone.setdefault((i, t), set()).update(n for n, _ in lines[p : p + k])
    for i, t in rows:
        lost = gone.get((i, t), set())
        text = t if not lost else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lost)
        out.append((i, text, len(lost), ",".join(map(str, sorted(lost)))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", " a ", "d" * 9]) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + edge_rows()
    got = linededup.dedup(docs(spark, rows)).select("doc_id", "text", "n_removed", "removed_lines").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_clashing_columns_and_empty_table(spark):
    df = docs(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc")]).selectExpr("*", "'q' as n_removed", "1 as __gone", "2 as n_lines")
    got = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert got[2].text == "x" and got[2].n_removed == 3 and got[1].text == "a\nb\nc\nd" and got[1].n_lines == 4
    assert linededup.dedup(docs(spark, [])).count() == 0
