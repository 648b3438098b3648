"""License scans by a positional rare-token index, in DataFrame functions only.

A template is a phrase or a longer header with a label and one mandatory key phrase. A key phrase's anchors are its two words
with the highest IDF over the whole corpus: a file that can match holds the phrase whole, so these are also the file's own
highest-IDF words of it. The index is one map from anchor words to postings (template, position). A file's anchor words are
looked up in it, each hit telling a template and where it would start; hits of both anchors that agree in the start are
what the intersection leaves. Only there the key phrase is verified word by word, and the template's other words are
compared for the score. All of it happens inside a row, so no shuffle moves a text, a hot phrase costs no more than its
places, and the plan doesn't grow with the templates.

Nulls and edges: a null or empty text has no words, no labels and score 0. Repeated rows each get their own result row.
Extra columns are not read. Words are those of the lower-cased text; A-Z alone changes which words are found, because
no other letter's lower case has an ASCII non-word character, and of ASCII letters only 'k' and 'i' arise (from U+212A
and U+0130, the latter followed by U+0307, hence another word). U+212A is kept apart by a replacement.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        """Where the key phrase starts in the template's words."""
        n, k = self.words, self.key_words
        return next(i for i in range(len(n) - len(k) + 1) if n[i : i + len(k)] == k)


TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("apache-2", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("gpl-3", "under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "under the gnu affero general public license", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute this software"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "creative commons cc0 1 0 universal", "creative commons cc0"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd"),
)


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é"))), F.lit(WORD), F.lit(0))


def idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text") -> dict[str, float]:
    """IDF over all documents of each key-phrase word, in one pass; one number per such word comes to the driver."""
    vocabulary = sorted({w for t in templates for w in t.key_words})
    row = docs.select(F.array_intersect(words_of(docs[text]), F.array(*map(F.lit, vocabulary))).alias("w"))
    found = row.agg(F.count("*").alias("total"), *(F.count_if(F.array_contains("w", w)).alias(f"n{i}") for i, w in enumerate(vocabulary))).collect()[0]
    return {w: math.log((found["total"] + 1) / (found[f"n{i}"] + 1)) for i, w in enumerate(vocabulary)}


def anchors(t: Template, weight: dict[str, float]) -> list[tuple[str, int]]:
    """The key phrase's rarest words with their positions in the phrase; ties go to the earlier word."""
    first: dict[str, int] = {}
    for i, w in enumerate(t.key_words):
        first.setdefault(w, i)
    return sorted(first.items(), key=lambda x: (-weight.get(x[0], 0.0), x[1]))[:ANCHORS]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (array of label, start, score)."""
    weight = idf(docs, templates, text)
    postings: dict[str, list[tuple[int, int]]] = {}
    alone = []  # templates whose key phrase has one distinct word
    for k, t in enumerate(templates):
        own = anchors(t, weight)
        alone += [k] * (len(own) < ANCHORS)
        for word, position in own:
            postings.setdefault(word, []).append((k, position))
    each = lambda values: F.array(*map(F.lit, values))
    index = F.map_from_arrays(each(postings), F.array(*(F.array(*(F.struct(F.lit(k).alias("template"), F.lit(p).alias("position")) for k, p in own)) for own in postings.values())))
    keys, texts = (F.array(*(each(words) for words in part)) for part in ([t.key_words for t in templates], [t.words for t in templates]))
    labels, sizes, key_at = each([t.label for t in templates]), each([len(t.key_words) for t in templates]), each([t.key_at for t in templates])

    df = docs.select(docs[id_column].cast("long").alias("doc_id"), words_of(docs[text]).alias("w"))
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(*postings))
    df = df.withColumn("at", F.when(F.size("w") > 0, at).otherwise(F.array().cast("array<int>")))
    looked_up = lambda i: F.transform(F.element_at(index, F.get("w", i)), lambda e: F.struct(e["template"].alias("template"), (i - e["position"]).alias("start")))
    df = df.withColumn("hits", F.array_sort(F.flatten(F.transform("at", looked_up))))
    # each anchor tells a start once, so where both do, two equal hits lie side by side
    agreed = F.array_distinct(F.filter("hits", lambda h, j: h["template"].isin(*(alone or [-1])) | (h == F.get("hits", j + 1))))
    verified = F.filter(agreed, lambda h: (h["start"] >= 0) & (F.slice("w", F.greatest(h["start"], F.lit(0)) + 1, F.get(sizes, h["template"])) == F.get(keys, h["template"])))

    def score(h: Column) -> Column:
        words = F.get(texts, h["template"])
        same = F.filter(words, lambda x, j: F.coalesce(F.get("w", h["start"] + j - F.get(key_at, h["template"])) == x, F.lit(False)))
        return F.round(F.size(same) / F.size(words), 6)

    df = df.withColumn("places", F.transform(verified, lambda h: F.struct(h["template"].alias("template"), F.get(labels, h["template"]).alias("label"), h["start"].cast("long").alias("start"), score(h).alias("score"))))
    base = [k for k, t in enumerate(templates) if t.base]
    df = df.withColumn("base", F.filter("places", lambda p: p["template"].isin(base)))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(F.col(f"{c}.label"))), ",")
    return df.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"),
        F.array_max("base.start").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max("places.score"), F.lit(0.0)).alias("score"),
        "places",
    )


def query(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("places")


def _sql() -> str:
    hits = []
    for k, t in enumerate(TEMPLATES):
        size, at = len(t.key_words), t.key_at
        agree = " + ".join([str(size), *(f"coalesce((w[i + {j - at}] = '{x}')::int, 0)" for j, x in enumerate(t.words) if not at <= j < at + size and j > at)] + [f"(CASE WHEN i + {j - at} >= 1 THEN coalesce((w[i + {j - at}] = '{x}')::int, 0) ELSE 0 END)" for j, x in enumerate(t.words) if j < at])
        same = " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(t.key_words))
        hits.append(f"SELECT doc_id, {k} AS template, '{t.label}' AS label, {str(t.base).lower()} AS base, i - 1 AS start, round(({agree})::double / {float(len(t.words))}, 6) AS score FROM places WHERE {same}")
    return rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(replace(coalesce(text, ''), chr(8490), 'é')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
hits AS ({' UNION ALL '.join(hits)}),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM words LEFT JOIN found USING (doc_id)"""


SQL = _sql()
