import random

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components


def by_hand(text, shingle=3):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(60):
        base = [r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 30, 200]))]
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 3])):
                if copy:
                    copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(" ".join(copy))
    return texts + ["É " * 5, "A b c d", "A B c d"]


def test_components_against_all_pairs(spark, corpus):
    df = spark.createDataFrame(list(enumerate(corpus)), "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fp = [by_hand(t) for t in corpus]
    root = classes(len(fp), [(a, b) for a in range(len(fp)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 2])
    assert got == {i: (f"{fp[i]:016x}", root[i]) for i in range(len(fp))}


def test_index_on_planted_fingerprints():
    """Each pair within two bits, wherever the bits lie, is in one component of what the index gives."""
    r = np.random.RandomState(1)
    base = r.randint(0, 2**62, 40).astype(np.int64)
    fps = set(map(int, base))
    for x in base:
        for _ in range(4):
            bits = r.choice(64, 2, replace=False)
            fps.add(int(np.array([x], np.int64)[0] ^ np.bitwise_xor.reduce(np.left_shift(np.int64(1), bits.astype(np.int64)))))
    fps = np.array(sorted(fps), np.int64)
    import pandas as pd

    nodes = pd.concat(simhash._spread(iter([pd.DataFrame({"fp": fps})]))).sort_values(["node", "gray"])
    a, b = simhash.linked(nodes["node"].to_numpy(), nodes["fp"].to_numpy())
    got = {tuple(sorted((int(nodes["fp"].iloc[i]), int(nodes["fp"].iloc[j])))) for i, j in zip(a, b)}
    want = {tuple(sorted((int(x), int(y)))) for i, x in enumerate(fps) for y in fps[:i] if (int(x) ^ int(y)) & (2**64 - 1) and ((int(x) ^ int(y)) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(None, 1), (7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = classes(400, [(a, b) for a, b in edges if a is not None])
    assert got == {n: root[n] for a, b in edges if a is not None and a != b for n in (a, b)}
