"""Writers: text results, tables clustered by a key, and graph state by iteration. Each replaces what was there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tsv(df: DataFrame, path: str, key: int = 1) -> None:
    """key and value, tab-separated: the first `key` columns, if several as `(a, b)`, then the others."""
    def side(columns: list[str]):
        cells = [F.col(c).cast("string") for c in columns]
        return cells[0] if len(cells) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(")"))

    parts = [side(df.columns[:key]), *([side(df.columns[key:])] if df.columns[key:] else [])]
    df.select(F.concat_ws("\t", *parts).alias("value")).write.mode("overwrite").text(path)


def tuples(df: DataFrame, path: str) -> None:
    """Lines `(a,b,...)`."""
    df.select(F.concat(F.lit("("), F.concat_ws(",", *(F.col(c).cast("string") for c in df.columns)), F.lit(")")).alias("value")).write.mode("overwrite").text(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def clustered(df: DataFrame, path: str, *keys: str, files: int = 0) -> None:
    """Parquet ranged and sorted by the keys: a look-up by key reads the few row groups whose bounds hold it. `files` of them, or
    as many as the session's shuffles have partitions."""
    df.repartitionByRange(*([files] if files else []), *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def iteration_path(base: str, i: int) -> str:
    """Where the state after iteration i lies."""
    return f"{base}/iter{i:04d}"
