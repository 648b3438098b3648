"""Near copies by similarity against all pairs, with blocks and lists small enough to be split."""

import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import nearcopies

from .test_simhash import classes


def shingles(text, size=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode("utf-8", "surrogatepass").split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def groups(texts):
    """The least number of each text's group, by all pairs."""
    s = [shingles(t) for t in texts]
    return classes(len(s), [(a, b) for a in range(len(s)) for b in range(a) if min(len(s[a]), len(s[b])) >= 0.8 * max(len(s[a]), len(s[b])) and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])


def words(r, n, of=5000):
    return [f"w{r.randrange(of)}" for _ in range(n)]


def changed(r, text, n):
    out = list(text)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def star(r, n=220):
    base = words(r, 200)
    return [changed(r, base, r.randrange(1, 6)) for _ in range(n)]


def chain(r, n=260):
    texts = [words(r, 200)]
    while len(texts) < n:
        texts.append(changed(r, r.choice(texts[-60:]), r.randrange(2, 5)))
    return texts


def couples(r, n=120):
    bases = [words(r, 200) for _ in range(n)]
    return bases + [changed(r, b, r.randrange(3, 5)) for b in bases]


def family(r, n=150):
    """Texts of a similarity of about 0.7 to each other, of which some have a near copy."""
    core = [f"c{i}" for i in range(165)]
    texts = [core + [f"t{r.randrange(10**9)}" for _ in range(35)] for _ in range(n)]
    return texts + [t[:-18] + [f"u{k}x{i}" for i in range(18)] for k, t in enumerate(texts[:40])]


def short(r, n=150):
    return [words(r, r.randrange(1, 12), 3) for _ in range(n)] + [words(r, 9) for _ in range(20)]


def boilerplate(r, n=150):
    """Texts that share passages, and some of them most of their words."""
    parts = [words(r, 40) for _ in range(4)]
    out = []
    for i in range(n):
        own = [w for p in r.sample(parts, r.randrange(5)) for w in p] + words(r, r.choice([1, 5, 100]))
        out += [own, changed(r, own, 1)] if i % 5 == 0 else [own]
    return out


def kept(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r[0] for r in nearcopies.drop_near_copies(df, **options).select("doc_id").collect()}


@pytest.fixture(scope="module")
def corpus():
    """Texts of all these kinds, and their groups by all pairs."""
    r = random.Random(7)
    texts = [" ".join(t) for kind in (star, chain, couples, family, short, boilerplate) for t in kind(r)]
    r.shuffle(texts)
    return texts, set(groups(texts))


def test_against_all_pairs(spark, corpus):
    texts, want = corpus
    assert kept(spark, texts) == want


def test_blocks_and_lists_lose_nothing(spark, corpus, monkeypatch):
    for name, value in (("BLOCK", 32), ("HOT", 4), ("HOT_MOST", 50), ("CHUNK", 3000), ("LISTED", 3000), ("PAIRS", 500), ("POSTING", 30), ("COLUMNS", 64), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(nearcopies, name, value)
    texts, want = corpus
    assert kept(spark, texts) == want


def test_the_index_alone_finds_most(spark, corpus):
    """Without the exact completion most texts that can go are found, and no other goes."""
    texts, want = corpus
    got = kept(spark, texts, exact=False)
    assert got >= want and len(texts) - len(got) >= 0.85 * (len(texts) - len(want))


def test_similar_pairs():
    r = np.random.RandomState(2)
    sets = [np.unique(r.randint(0, 60, r.randint(1, 40))).astype(np.uint64) for _ in range(80)] + [np.arange(5000, dtype=np.uint64), np.arange(4000, dtype=np.uint64)]
    alike = lambda a, b: len(np.intersect1d(a, b)) >= 0.3 * len(np.union1d(a, b))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if alike(sets[i], sets[j])}
    assert set(zip(*map(list, nearcopies.similar_pairs(sets, 0.3)))) == want
    left = np.arange(len(sets)) % 3 == 0
    got = {tuple(sorted(map(int, p))) for p in zip(*nearcopies.similar_pairs(sets, 0.3, left))}
    assert got == {(i, j) for i, j in want if left[i] != left[j]}


def test_leaders_and_followers():
    r = np.random.RandomState(3)
    x = np.repeat(r.randint(0, 2**63, (4, 2)).astype(np.uint64), 300, axis=0)
    for row in x:
        for k in (0, 1):
            for bit in r.choice(64, r.randint(0, 5), replace=False):
                row[k] ^= np.uint64(1) << np.uint64(bit)
    node = np.repeat(np.arange(2), 600)
    a, b = nearcopies.led(node, x[:, 0].copy(), x[:, 1].copy())
    assert len(a) == 1196 and len(set(a)) == 4 and (node[a] == node[b]).all()
    assert (np.bitwise_count(x[a] ^ x[b]).sum(axis=1) <= nearcopies.FAR).all()


def test_components_in_rounds_and_at_once(spark, monkeypatch):
    from millrace.llm import components

    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    once = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "ONE_TASK", 20)
    assert sorted(map(tuple, components.components(df).collect())) == once
    root = classes(400, [e for e in edges if e[0] != e[1]])
    assert once == [(n, root[n]) for n in sorted({n for a, b in edges if a != b for n in (a, b)})]


def test_parts_of_a_long_list_stay_connected():
    """A list that fills chunks, of sizes that grow slowly to many times the first: neighbours connect it to its end."""
    n = np.sort(np.concatenate([np.arange(10, 200), np.arange(10, 200)]))
    th = np.arange(len(n))
    table = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int64)), pa.array(th), pa.array(n), pa.array(np.zeros(len(n), np.int64)), pa.array(n)], ["h", "th", "n", "pos", "last"])
    batches = [table.slice(i, 7) for i in range(0, len(n), 7)]
    posting, nearcopies.POSTING = nearcopies.POSTING, 20
    try:
        found = [nearcopies.sharing(*columns, 0.8)[0] for columns in nearcopies.grouped(iter(batches), 50, nearcopies.POSTING + 1)]
    finally:
        nearcopies.POSTING = posting
    assert len(found) > 3
    a, b = nearcopies.connect(*np.concatenate(found, axis=1))
    assert len(a) == len(n) - 1


def shuffled(spark, work):
    """Bytes that work() writes to shuffles."""
    status = spark._jsc.sc().statusStore()
    quantiles = spark._sc._gateway.new_array(spark._jvm.double, 0)

    def total() -> int:
        stages = status.stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch, tmp_path):
    """Where there are too many near copies to be broadcast, the texts of all others stay where they are."""
    monkeypatch.setattr(nearcopies, "BROADCAST_ROWS", 3)
    r = random.Random(3)
    couple = [words(r, 60) for _ in range(20)]
    texts = [" ".join(t) for t in couple + [changed(r, t, 1) for t in couple]]
    long = [" ".join(f"{r.getrandbits(2400):x}" for _ in range(6)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts + long)), "doc_id long, text string").repartition(5)
    df.write.parquet(f"{tmp_path}/docs")
    df, kept_rows = spark.read.parquet(f"{tmp_path}/docs"), []
    moved = shuffled(spark, lambda: kept_rows.extend(nearcopies.drop_near_copies(df).collect()))
    assert len(kept_rows) == 420
    assert moved < sum(map(len, long))


def test_a_common_passage_makes_no_family(spark):
    """Texts that only share a passage aren't brought together, wherever the hashes of its shingles lie."""
    r = random.Random(4)
    passage = words(r, 30)
    texts = [" ".join(words(r, 120, 10**6) + passage) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = nearcopies.kept(nearcopies.described(df, 5))
    assert nearcopies.exact_candidates(df, rows, 5, 0.8).count() == 0


def test_the_index_holds_the_links_of_the_operator(spark, corpus):
    """Fingerprints are those of `simhash`, repeats included, and texts that it links are candidates."""
    from millrace.llm import simhash

    texts = corpus[0] + ["a b c d e " * 30 + f"x{i} y z" for i in range(3)] + ["", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nearcopies.kept(nearcopies.described(df, 5))
    want = simhash.near_duplicates(df).select("doc_id", "fp", "component_id")
    assert sorted(map(tuple, rows.select("doc_id", "fp").collect())) == sorted(map(tuple, want.select("doc_id", "fp").collect()))
    root = {r["node"]: r["root"] for r in nearcopies.components(nearcopies.linked_candidates(rows.select("th", "fp").distinct())).collect()}
    own = {r["doc_id"]: root.get(r["th"], r["th"]) for r in rows.select("doc_id", "th").collect()}
    one = {r["doc_id"]: r["component_id"] for r in want.collect()}
    assert len(set(own.values())) == len(set(one.values())) == len(set((own[i], one[i]) for i in own)) < len(set(texts))


def test_blocks_meet_in_rounds(spark, monkeypatch):
    """The sets that are shuffled for pairs of blocks at once have a bound, whatever the number of pairs; no link is lost by it."""
    for name, value in (("BLOCK", 8), ("ROOM", 1)):
        monkeypatch.setattr(nearcopies, name, value)
    r = random.Random(8)
    texts = [" ".join(t) for t in family(r, 80)]
    r.shuffle(texts)
    calls, one = [], nearcopies.verified

    def verified(wanted, *rest):
        wanted = nearcopies.kept(wanted)
        calls.append(wanted.selectExpr("sum(n * size(keys))").head()[0] if "keys" in wanted.columns else 0)
        return one(wanted, *rest)

    monkeypatch.setattr(nearcopies, "verified", verified)
    assert kept(spark, texts) == set(groups(texts))
    whole = sum(len(shingles(t)) for t in texts)
    assert len(calls) > 3 and max(calls) < whole < sum(calls)
