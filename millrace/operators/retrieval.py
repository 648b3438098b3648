"""Boolean retrieval: a query in reverse Polish notation becomes one boolean column over one scan of the postings.

AND and OR in capitals are operators; every other token is a term, as it stands. An unknown term has no documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet


def parse(query: str, strict: bool = True) -> tuple[list[str], Column]:
    """The query's terms, and its expression over boolean columns t0, t1, ... in their order.

    An operator without two operands raises ValueError. So do leftovers, unless strict is false: then the last one counts.
    """
    stack, terms = [], []
    for token in query.split():
        if token in ("AND", "OR"):
            if len(stack) < 2:
                raise ValueError(f"{token} lacks an operand in {query!r}")
            b, a = stack.pop(), stack.pop()
            stack.append(a & b if token == "AND" else a | b)
        else:
            if token not in terms:
                terms.append(token)
            stack.append(F.col(f"t{terms.index(token)}"))
    if not stack:
        raise ValueError("an empty query")
    if strict and len(stack) > 1:
        raise ValueError(f"{len(stack) - 1} operands are left over in {query!r}")
    return terms, stack[-1]


def search(postings: DataFrame, query: str, strict: bool = True) -> DataFrame:
    """(doc): documents that satisfy the query. postings: (term, doc, ...), filtered to the query's terms at the scan."""
    terms, satisfied = parse(query, strict)
    hits = postings.where(F.col("term").isin(terms)).groupBy("doc").agg(*(F.bool_or(F.col("term") == t).alias(f"t{i}") for i, t in enumerate(terms)))
    return hits.where(satisfied).select("doc")


def search_index(index: DataFrame, query: str, strict: bool = True) -> DataFrame:
    """(doc) from an encoded index of either layout: only the query's terms are read and decoded."""
    from .index import read

    return search(read(index.where(F.col("term").isin(parse(query, strict)[0]))), query, strict)


def search_texts(docs: DataFrame, query: str, strict: bool = True) -> DataFrame:
    """(doc) straight from (doc_id, text), without an index and without a shuffle but for rows of the same doc_id."""
    from ..functions.text import tokens

    terms, satisfied = parse(query, strict)
    words = docs.select(F.col("doc_id").alias("doc"), tokens(F.col("text")).alias("w"))
    found = words.select("doc", *(F.array_contains("w", t).alias(f"t{i}") for i, t in enumerate(terms)))
    any_of = reduce(lambda a, b: a | b, (F.col(f"t{i}") for i in range(len(terms))))
    return found.where(any_of).groupBy("doc").agg(*(F.bool_or(f"t{i}").alias(f"t{i}") for i in range(len(terms)))).where(satisfied).select("doc")


def snippets(found: DataFrame, docs: DataFrame, most: int = 80) -> DataFrame:
    """(doc, line): each document found, its text cut to `most` characters."""
    return docs.select(F.col("doc_id").alias("doc"), "text").join(found, "doc", "left_semi").select("doc", snippet(F.col("text"), most).alias("line"))
