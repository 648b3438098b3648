import hashlib
import random

from millrace.llm import winnowing as w


def chosen_by_hand(hashes, window):
    """Windows one by one: least hash, the rightmost of equal ones."""
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        at = max(j for j, h in enumerate(part) if h == min(part)) + i
        if at not in out:
            out.append(at)
    return out


def test_windows():
    import numpy as np

    r = random.Random(1)
    for n in (1, 5, 63, 64, 65, 200, 1000):
        h = [r.randrange(6 if n % 2 else 2**32) for _ in range(n)]
        at, values = w.choose(np.array(h, np.uint64))
        assert at.tolist() == chosen_by_hand(h, w.WINDOW) and values.tolist() == [h[i] for i in at.tolist()]


def test_rolling_hash_depends_on_the_gram_alone():
    import numpy as np

    r = random.Random(2)
    text = "".join(r.choice("ab\U0001f600") for _ in range(300))
    with np.errstate(over="ignore"):
        h = w.gram_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    grams = [text[i : i + w.K] for i in range(len(text) - w.K + 1)]
    assert len(h) == len(grams)
    first = {}
    assert all(first.setdefault(g, x) == x for g, x in zip(grams, h.tolist()))


def test_match_guarantee():
    """Any common part of window + k - 1 characters gives a common hash."""
    r = random.Random(3)
    letters = "abcdefghij klmno"
    for _ in range(50):
        part = "".join(r.choice(letters) for _ in range(w.WINDOW + w.K - 1))
        a, b = ("".join(r.choice(letters) for _ in range(r.randrange(300))) + part + "".join(r.choice(letters) for _ in range(r.randrange(300))) for _ in range(2))
        assert set(w.fingerprint(a)[1].tolist()) & set(w.fingerprint(b)[1].tolist())


def test_rows(spark):
    r = random.Random(4)
    texts = {i: "".join(r.choice("abc \n") for _ in range(r.choice([0, 3, 40, 400]))) for i in range(0, 90, 2)} | {91: None}
    texts[50] = texts[48]
    got = w.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)).collect()
    order = sorted(texts, reverse=True)
    follows = dict(zip(order, order[1:] + order[:1]))
    assert len(got) == len(texts)
    for x in got:
        own, other = texts[x["doc_id"]] or "", texts[follows[x["doc_id"]]] or ""
        n = len(own) // 3
        new = own[: len(own) - n] + other[:n]
        assert x["n_chars"] == len(own) and x["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert x["fingerprint"] == w.written(w.fingerprint(own)) and x["edited_fingerprint"] == w.written(w.fingerprint(new))
        assert 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
        assert x["near_next"] == w.likeness(w.fingerprint(own)[1], w.fingerprint(other)[1])
    assert [x["near_next"] for x in got if x["doc_id"] == 50] == [1.0]


def test_one_row_is_its_own_next(spark):
    (x,) = w.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert x["near_next"] == 1.0 and x["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_short_texts_keep_their_likeness():
    """Two thirds of a text are found again in its edited form, whatever its length and the next text's."""
    r = random.Random(5)
    for n in list(range(1, 130)) + [200, 400]:
        for rest in (0, 1, 5, 400):
            text, other = ("".join(r.choice("abcdefghijklmno pqrstuvwxyz") for _ in range(size)) for size in (n, rest))
            assert w.likeness(w.fingerprint(text)[1], w.fingerprint(w.edited(text, other))[1]) > 0, (n, rest)


def test_matches_of_31_code_points_are_found():
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefghij klmno") for _ in range(n))
    for _ in range(100):
        part = text(31)
        a, b = (text(r.randrange(300)) + part + text(r.randrange(300)) for _ in range(2))
        assert set(w.fingerprint(a)[1].tolist()) & set(w.fingerprint(b)[1].tolist())


def test_no_row_is_lost_where_estimated_bounds_do_not_occur(spark):
    """Ids beyond what doubles hold, beside a null one: each row comes, edited with the one that follows it."""
    rows = [(2**53 + 2 * i + 1, f"text {i} of a few words {i * i}") for i in range(60)] + [(None, "no id at all")]
    got = {r["doc_id"]: r for r in w.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    order = rows[:-1][::-1] + rows[-1:]
    assert len(got) == 61
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        assert got[i]["edited_sha256"] == hashlib.sha256(w.edited(text, following).encode()).hexdigest()
