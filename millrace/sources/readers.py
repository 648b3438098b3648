"""Readers for the text formats of the batch programs. Parquet tables are read by `millrace.tables.table`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the '|'-separated tables, in file order.
TBL = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string, l_commitdate string, l_receiptdate string, l_shipinstruct string, l_shipmode string, l_comment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string, o_clerk string, o_shippriority int, o_comment string",
    "customer": "c_custkey long, c_name string, c_address string, c_nationkey int, c_phone string, c_acctbal double, c_mktsegment string, c_comment string",
    "part": "p_partkey long, p_name string, p_mfgr string, p_brand string, p_type string, p_size int, p_container string, p_retailprice double, p_comment string",
    "supplier": "s_suppkey long, s_name string, s_address string, s_nationkey int, s_phone string, s_acctbal double, s_comment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int, n_comment string",
}


def tbl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A '|'-separated table; dates become timestamps, and only the columns that a plan asks for are parsed."""
    df = spark.read.csv(path, sep="|", schema=TBL[name])
    return df.withColumns({c: F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd")) for c in df.columns if c.endswith("date")})


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) for each line of text files, compressed ones too."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def lines_with_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each line with its byte offset as a long. Compressed files, in a folder too, have no offsets to seek to, so
    they raise."""
    if path.endswith(".gz") or any(name.endswith(".gz") for name in file_names(spark, path)):
        raise ValueError("a gzip file can't be sought in; decompress the collection first")
    kinds = "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    return spark.createDataFrame(spark.sparkContext.newAPIHadoopFile(path, *kinds), "doc_id long, text string")


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files that a path, a folder or a pattern holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = []
    for found in fs.globStatus(p) or ():
        files = fs.listFiles(found.getPath(), True)
        while files.hasNext():
            names.append(files.next().getPath().getName())
    return names


def document_lines(docs: DataFrame) -> DataFrame:
    """(line) for each line of documents' texts."""
    return docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))


def adjacency(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lines `node neighbour neighbour ...`; a node without neighbours is dangling."""
    ids = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.col("x")[0] != "").select(F.transform("x", lambda i: i.cast("long")).alias("x"))
    nodes = ids.select(F.col("x")[0].alias("id"))
    return nodes, ids.select(F.col("x")[0].alias("src"), F.explode(F.slice("x", 2, F.size("x"))).alias("dst"))


def instances(spark: SparkSession, path: str) -> DataFrame:
    """(docid, label, features) of lines `docid label f f ...`; repeated features are kept."""
    x = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("x")).where(F.size("x") > 1)
    return x.select(F.col("x")[0].alias("docid"), F.col("x")[1].alias("label"), F.transform(F.slice("x", 3, F.size("x")), lambda f: f.cast("int")).alias("features"))


def model(spark: SparkSession, path: str) -> DataFrame:
    """(feature, weight) of lines `(feature,weight)`; of repeated features the last line stands."""
    x = spark.read.text(path).select(F.split(F.regexp_replace(F.trim("value"), "[()]", ""), ",").alias("x"), F.monotonically_increasing_id().alias("at")).where(F.size("x") == 2)
    return x.select(F.col("x")[0].cast("int").alias("feature"), F.col("x")[1].cast("double").alias("weight"), "at").groupBy("feature").agg(F.max_by("weight", "at").alias("weight"))


def models(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, feature, weight, at) of the files part-00000, part-00001, ... of a folder, one model each; `at` grows with the lines,
    so that of repeated features the last stands."""
    x = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("model_id"), F.split(F.regexp_replace(F.trim("value"), "[()]", ""), ",").alias("x"), F.monotonically_increasing_id().alias("at"))
    return x.where((F.size("x") == 2) & F.col("model_id").isNotNull()).select("model_id", F.col("x")[0].cast("int").alias("feature"), F.col("x")[1].cast("double").alias("weight"), "at")
