import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(packing.tokenizer_path())


def test_ids_are_the_tokenizer_s(spark, sf_dir, reference):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    odd = ["", " ", "It's WE'LL can't", "İI ı K", "<|endoftext|> x", "hello <|endoftext|> world", "a<|ENDOFTEXT|>b", "é<|startoftext|>\n\n <|endoftext|>", "<|endoftext", "a\x1cb\x85c d", "日本語 テキスト", "é é", "ﬁ ſs ß", "1234 12a", "\U0001f600\U0001f600", "x" * 5000, "n'tn't 're", "²³ ½", "﻿bom", "a b"]
    ids = packing.Ids(packing.tokenizer_path())
    for t in texts + odd:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == reference.encode(t, add_special_tokens=False).ids, t[:50]


def check(pieces, sizes, window):
    """Each token in one piece, sequences gapless, padded but at powers of two."""
    by_doc, by_sequence = {}, {}
    for d, start, length, s, offset in pieces:
        assert length > 0
        by_doc.setdefault(d, []).append((start, length))
        by_sequence.setdefault(s, []).append((offset, length))
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: n for d, n in sizes if n}
    for parts in (*by_doc.values(), *by_sequence.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    fills = [sum(n for _, n in p) for p in by_sequence.values()]
    assert all(f <= window and (f == window or f & (f - 1) == 0) for f in fills)
    assert sum(f < window for f in fills) <= 11


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    r = random.Random(seed)
    sizes = [(i, r.choice([0, 1, 5, 60, 700, 2048, 5000])) for i in range(r.choice([1, 3, 400]))]
    check(packing.pack(iter(sizes)), sizes, 2048)


def test_least_sum_of_squares():
    r = random.Random(6)
    levels = packing.Levels(64)
    for _ in range(200):
        levels.count[1:64] = [r.choice([0, 0, 1, 3]) for _ in range(63)]
        size = r.randrange(1, 64)

        def after(level):
            n = levels.count.copy()
            if level > 0:
                n[level] -= 1
            if max(level, 0) + size < 64:
                n[max(level, 0) + size] += 1
            return int((n[1:64] ** 2).sum())

        choices = [-1, *(x for x in range(1, 64 - size + 1) if levels.count[x])]
        got = levels.place(size)
        assert got in choices and after(got) == min(map(after, choices))


def test_documents(spark, odd, reference):
    ids = {}
    for r in odd.select("doc_id", "text").collect():
        ids.setdefault((r[0], len(x := reference.encode(r[1] or "", add_special_tokens=False).ids + [1])), x)
    out = packing.pack_documents(odd.repartition(2), with_ids=True).collect()
    total = 0
    for r in out:
        own = ids[r["doc_id"], r["doc_tokens"]]
        assert r["ids"] == own[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        total += r["length"]
    assert total == sum(len(reference.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in odd.select("text").collect())
