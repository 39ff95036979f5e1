import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sedge.llm import packing
from sedge.llm.queries import tokenizer_path
from tests.llm.helpers import docs, edge_rows

PATH = tokenizer_path()


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 3, "max_loss": 50, "window": 4}])
def test_round_trip_within_limits(spark, limits):
    rng = random.Random(2)
    rows = edge_rows() + [(100 + i, " ".join(rng.choice(["Hello,", "it's", "naïve", "<|endoftext|>", "12.5%", "ab c", "İstanbul", "x" * 40]) for _ in range(rng.randrange(0, 200)))) for i in range(40)]
    got = packing.pack(docs(spark, rows), PATH, **limits).collect()
    most, segments, loss = (limits.get(k, d) for k, d in (("max_tokens", 2048), ("max_segments", 1024), ("max_loss", 2048)))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids, 1])
    for i, own in want.items():
        assert sum(r.length for r in pieces[i]) == sum(map(len, own))
        if len(own) == 1:
            at, ids = 0, np.array(own[0], "<u4")
            for r in sorted(pieces[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
                at += r.length
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most and (at == most or at & (at - 1) == 0) and len(own) <= segments and sum(r.loss_tokens for r in own) <= loss


def test_loss_of_prompts(spark):
    df = docs(spark, [(i, "a b c d e f g h " * 10) for i in range(9)]).selectExpr("*", "cast(30 as int) as prompt")
    got = packing.pack(df, PATH, loss_from="prompt", max_tokens=64, max_loss=20).collect()
    by = defaultdict(int)
    for r in got:
        by[r.sequence_id] += r.loss_tokens
    assert max(by.values()) <= 20 and sum(by.values()) == 9 * (81 - 30)


def test_limits_are_checked_and_empty_table(spark):
    with pytest.raises(ValueError):
        packing.Packer(max_tokens=0)
    assert packing.pack(docs(spark, []), PATH).count() == 0
