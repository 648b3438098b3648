"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Each run of three consecutive lines of a document is a window, told by two 64-bit hashes of its lines. A window that
occurs more than once in the corpus stays where it occurs first (least doc_id, null last, then hash of the text, then
position); the lines that its later occurrences cover are removed. Covered positions are merged, so a repeated passage of
any length of three lines or more goes as a whole, but for its first occurrence.

First occurrences are minima, combined before the shuffle; only windows that occur more than once come back. The join that
finds the later ones is a plain equi-join whose hot keys AQE splits. Positions are then gathered per document, which its
own lines bound, and only these meet the texts.

Nulls and edges: a null text stays null; an empty one, and one of fewer than three lines, stays as it is. Lines end at a
line feed, and are compared as they are. Rows equal in doc_id and text count as one document and get the same result. An
empty table gives no rows. Columns other than text and n_chars pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, packed, unpacked

LINES = 3


def windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, th, pos, h1, h2) for each window of each row of rows (doc_id, th, text)."""
    r = rows.select("doc_id", "th", F.split("text", "\n").alias("l"))
    r = r.where(F.size("l") >= lines)
    at = F.sequence(F.lit(0), F.size("l") - lines)

    def window(i: Column) -> Column:
        parts = [F.get("l", i + k) for k in range(lines)]
        return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("second"), *reversed(parts)).alias("h2"))

    return r.select("doc_id", "th", F.inline(F.transform(at, window)))


def covered(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """(doc_id, th, starts): sorted starts of each document's windows that occurred before."""
    w = windows(rows, lines)
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th", "pos")
    # written down, so that the join reads two plain exchanges, whose large partitions AQE can split
    first = kept(w.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first"))
    later = w.join(first, ["h1", "h2"]).where(order > F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with the covered lines removed from text, and n_removed, which replaces a column of that name."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("th"), docs["text"].cast("string").alias("text"))
    gone = covered(rows, lines)
    d = packed(docs).select("d", F.col("d.doc_id").cast("long").alias("id"), F.xxhash64("d.text").alias("hash"))
    # the texts go to hash tables of the documents that lose lines, and need no sort
    d = d.join(gone.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    hit = F.col("starts").isNotNull()
    # merged positions: each start covers up to the next start, or `lines` lines
    positions = F.flatten(F.transform("starts", lambda s, i: F.sequence(s, F.least(s + lines, F.coalesce(F.get("starts", i + 1), s + lines)) - 1)))
    d = d.withColumn("l", F.when(hit, F.split("d.text", "\n")))
    d = d.withColumn("left", F.when(hit, F.array_except(F.sequence(F.lit(0), F.size("l") - 1), positions)))
    d = d.withColumn("new", F.when(hit, F.array_join(F.transform("left", lambda i: F.get("l", i)), "\n")).otherwise(F.col("d.text")))
    changed = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("new")).otherwise(F.col("d.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*unpacked([c for c in docs.columns if c != "n_removed"], changed), F.when(hit, F.size("l") - F.size("left")).otherwise(F.lit(0)).cast("long").alias("n_removed"))


def query(spark, sf_dir):
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = """
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
places AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM lines WHERE len(l) >= 3),
windows AS (SELECT doc_id, pos, l[pos + 1 : pos + 3] AS w FROM places),
later AS (SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later),
all_lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM lines),
found AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM all_lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN n_removed IS NULL THEN d.text ELSE coalesce(o.text, '') END AS text, coalesce(n_removed, 0)::bigint AS n_removed
FROM documents d LEFT JOIN found USING (doc_id) LEFT JOIN left_over o USING (doc_id)"""
