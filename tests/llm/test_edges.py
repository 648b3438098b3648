"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for each operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import licenses, linededup, mixing, nearcopies, packing, pseudonyms, secrets, simhash, toxicity, winnowing

LINKS = [toxicity.Link("low_quality", {"word1": 1.0}, [], -1.0, 0.5), toxicity.Link("toxic", {"hunter": 9.0}, [0.1], -3.0, 0.5)]
PER_ROW = {
    "licenses": licenses.scan,
    "pseudonyms": lambda docs: pseudonyms.pseudonymise(docs, "k"),
    "secrets": secrets.scan,
    "winnowing": winnowing.fingerprints,
    "simhash": simhash.near_duplicates,
    "mixing": mixing.mix,
    "toxicity": lambda docs: toxicity.classify(docs, LINKS),
    "linededup": linededup.dedup,
}


@pytest.fixture(scope="module")
def rows(odd):
    """Each operator's rows, made once."""
    return {name: operator(odd).collect() for name, operator in PER_ROW.items()}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_each(odd, rows, name):
    assert Counter(r["doc_id"] for r in rows[name]) == Counter(r[0] for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(odd, name):
    assert PER_ROW[name](odd.limit(0)).collect() == []


def test_empty_tables_of_the_rest(odd):
    empty = odd.limit(0)
    assert packing.pack_documents(empty).collect() == nearcopies.drop_near_copies(empty).collect() == []
    assert mixing.copies(empty, mixing.mix(empty)).collect() == []


def test_all_columns_pass(odd):
    for out in (linededup.dedup(odd.drop("n_removed")).drop("n_removed"), nearcopies.drop_near_copies(odd.drop("n_removed")), mixing.copies(odd, mixing.mix(odd)).drop("n_removed"), toxicity.reject(odd, LINKS).drop("n_removed")):
        assert out.columns == odd.drop("n_removed").columns and out.collect()
        assert {tuple(r) for r in out.select("d", F.lit("t"), "key", "w").collect()} == {("d", "t", None, "w")}


def test_null_and_empty_texts(odd, rows):
    by = {name: {r["doc_id"]: r for r in own} for name, own in rows.items()}
    r = by["licenses"]
    assert (r[2]["n_words"], r[2]["labels"], r[2]["score"]) == (0, "", 0.0) and r[8]["base_labels"] == "mit"
    assert by["secrets"][3]["spans"] == "" and by["secrets"][9]["n_assign"] == 1
    assert by["winnowing"][2]["fingerprint"] == ""
    assert by["simhash"][3]["fingerprint"] == "0" * 16
    assert by["pseudonyms"][2]["text"] is None and by["pseudonyms"][3]["text"] == ""
    assert by["linededup"][2]["text"] is None
    assert by["mixing"][2]["size"] == 0 and by["mixing"][2]["taken"] == 0
    p = [r for r in packing.pack_documents(odd).collect() if r["doc_id"] == 2]
    assert [(r["length"], r["doc_tokens"]) for r in p] == [(1, 1)]


def test_near_copies_keep_one_of_repeated_rows(odd):
    kept = Counter((r["doc_id"], r["text"]) for r in nearcopies.drop_near_copies(odd).select("doc_id", "text").collect())
    assert max(kept.values()) == 1
    assert [i for i, t in kept if t == "a b c d e f g h"] == [1]
    assert [i for i, t in kept if not (t or "").strip()] == [2]  # texts without words are alike


def test_large_ids_beside_nulls(spark, odd):
    """Ids beyond what doubles hold, and a null one, come out of each operator as they are."""
    big = 2**53
    rows = [(big + 2 * i + 1, f"text number {i} of a few words", "en", "s", None) for i in range(60)] + [(None, "no id here at all", "en", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    want = Counter(r[0] for r in rows)
    for name, operator in PER_ROW.items():
        assert Counter(r["doc_id"] for r in operator(df).collect()) == want, name
    assert Counter(r["doc_id"] for r in packing.pack_documents(df).where("start = 0").collect()) == want
    assert Counter(r["doc_id"] for r in nearcopies.drop_near_copies(df).collect()) == want
