import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import pseudonyms as p

VALID = {
    "email": ["anna.k@example.org", "x@a-b.co.uk"],
    "ip": ["10.0.0.1", "255.254.1.0"],
    "date": ["1999-12-31", "31.12.1999", "02/28/2004", "2020/02/29"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "card": ["4111111111111111", "5500 0000 0000 0004", "3782 822463 10005"],
    "ssn": ["078-05-1120", "899-99-9999"],
    "phone": ["+49 30 1234567", "(555) 123-4567", "555-123-4567"],
}
INVALID = ["4111111111111112", "300.1.1.1", "1999-13-01", "000-12-3456", "666-12-3456", "DE00370400440532013000", "nobody@", "12", "1.2.3.4.5"]


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.asDict() for r in p.pseudonymise(df, **({"key": "k"} | options)).orderBy("doc_id").collect()]


def test_kinds_formats_and_restoring(spark):
    values = [v for vs in VALID.values() for v in vs]
    out = run(spark, [f"<{v}>" for v in values])
    assert [r["kinds"] for r in out] == [k for k, vs in VALID.items() for _ in vs]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", t)))
    for v, r in zip(values, out):
        assert r["text"] != f"<{v}>"
        assert "ip" == r["kinds"] or shape(r["text"]) == shape(f"<{v}>")
    back = run(spark, [r["text"] for r in out], restore=True)
    assert [r["text"] for r in back] == [f"<{v}>" for v in values]
    # pseudonyms are valid values of their kind
    assert [r["kinds"] for r in run(spark, [r["text"] for r in out])] == [r["kinds"] for r in out]


def test_invalid_values_stay(spark):
    assert [r["text"] for r in run(spark, INVALID)] == INVALID


def test_equal_values_stay_linked(spark):
    out = run(spark, ["call +49 30 1234567 now", "x +49 30 1234567, y +49 30 1234567", "card 4111 1111 1111 1111", "card 4111111111111111", "call +49 30 1234567", "call +49301234567"])
    phone = re.search(r"\+49[ 0-9]+\d", out[0]["text"])[0]
    assert out[1]["text"].count(phone) == 2 and out[1]["n_found"] == 2
    assert out[2]["text"].replace(" ", "") == out[3]["text"].replace(" ", "")
    assert out[0]["text"][5:8] == "+49"
    one, other = (re.sub(r"[^+0-9]", "", r["text"]) for r in out[4:])
    assert one == other and one.startswith("+49")
    assert run(spark, ["a@b.org"], key="other")[0]["text"] != run(spark, ["a@b.org"])[0]["text"]


def test_permutations(spark):
    """Numbers in a small domain are permuted one to one, and back."""
    df = spark.range(17 * 23)
    x = p.feistel_number(F.floor(F.col("id") / 23), F.col("id") % 23, 17, 23, "test", "k", False)
    df = df.select("id", x.alias("x"))
    y = p.feistel_number(F.col("x.l"), F.col("x.r"), 17, 23, "test", "k", True)
    rows = df.select("id", (F.col("x.l") * 23 + F.col("x.r")).alias("to"), (y["l"] * 23 + y["r"]).alias("back")).collect()
    assert {r["to"] for r in rows} == set(range(17 * 23)) and all(r["back"] == r["id"] for r in rows)


def test_dates_are_restored_whatever_their_layout(spark):
    days = [f"{d:02d}/{m:02d}/2003" for d in range(1, 29) for m in range(1, 13)]
    out = [r["text"] for r in run(spark, days)]
    assert [r["text"] for r in run(spark, out, restore=True)] == days and len(set(out)) == len(days)
    late = [x for d, x in zip(days, out) if d[:2] > "12"]
    assert len(late) == 192 and all(x[:2] > "12" for x in late)


def test_texts_are_permuted_one_to_one(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    to = df.select("s", p.feistel_text(F.col("s"), "test", "k", False).alias("t"))
    rows = to.select("s", "t", p.feistel_text(F.col("t"), "test", "k", True).alias("back")).collect()
    assert {r["t"] for r in rows} == {r["s"] for r in rows} and all(r["back"] == r["s"] for r in rows)


def test_long_texts(spark):
    """Texts of a million characters of what the patterns are made of."""
    units = ["x@" + "a." * 60_000 + "a", "x" * 120_000 + "@", "1." * 60_000, "1999-12-" * 15_000, "DE89 " * 25_000, "4111 " * 25_000, "078-05-" * 17_000, "+49 30 " * 17_000]
    texts = [(u * 9)[:1_000_000] for u in units]
    assert [len(r["text"]) for r in run(spark, texts)] == [len(t) for t in texts]


def test_the_query_takes_the_session_s_key(spark, sf_dir):
    with pytest.raises(TypeError):
        p.pseudonymise(spark.range(1))
    one = p.query(spark, sf_dir).where("n_found > 0").orderBy("doc_id").limit(20).collect()
    spark.conf.set(p.SETTING, "another")
    try:
        assert p.query(spark, sf_dir).where("n_found > 0").orderBy("doc_id").limit(20).collect() != one
    finally:
        spark.conf.unset(p.SETTING)


def test_clean_texts_stay(spark, sf_dir):
    texts = ["version 3.14 of 2 files", "chapter 12, pages 100-120", "at 10:30", "ISBN 978-3-16-148410-0", "π ≈ 3.14159265358979"]
    assert [r["text"] for r in run(spark, texts)] == texts
