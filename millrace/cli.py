"""One subcommand for each batch tool: `python -m millrace.cli word-count --input in --output out`.

Text in, text out, as the tools' formats are; indexes, graphs and models are Parquet, models optionally text.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import LINE_WORDS
from .operators import bigrams, cooccurrence, counts, graph, index, linear, relational, retrieval
from .session import session
from .sources import readers, writers


def _count(operator):
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        df = operator(readers.lines(spark, a.input))
        writers.tsv(_dealt(df, a), a.output)

    return run


def _dealt(df: DataFrame, a: argparse.Namespace) -> DataFrame:
    return df.coalesce(a.reducers) if a.reducers else df


def pmi(spark, a):
    lines = readers.lines(spark, a.input)
    if a.form == "pairs":
        writers.tsv(_dealt(cooccurrence.pmi_pairs(lines, most=LINE_WORDS).select("x", "y", "pmi"), a), a.output, 2)
    else:
        cells = F.transform(F.array_sort(F.map_entries("stripe")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        writers.tsv(_dealt(cooccurrence.pmi_stripes(lines).select("word", F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}")).alias("stripe")), a), a.output)


def bigram(spark, a):
    lines = readers.lines(spark, a.input)
    if a.form == "pairs":
        writers.tsv(_dealt(bigrams.pairs(lines), a), a.output, 2)
    else:
        cells = F.transform(F.array_sort(F.map_entries("stripe")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        writers.tsv(_dealt(bigrams.stripes(lines).select("left", F.concat(F.lit("{"), F.array_join(cells, ", "), F.lit("}")).alias("stripe")), a), a.output)


def index_build(spark, a):
    writers.clustered(index.build(readers.lines_with_offsets(spark, a.input), wide=a.layout == "wide-row"), a.output, "term", files=a.reducers)


def index_query(spark, a):
    table = spark.read.parquet(a.index)
    if a.layout and (a.layout == "wide-row") != ("qualifier" in table.columns):
        raise SystemExit(f"the index does not have the layout {a.layout}")
    found = retrieval.search_index(table, a.query, strict=not a.lenient)
    docs = readers.lines_with_offsets(spark, a.collection)
    for row in retrieval.snippets(found, docs).orderBy("doc").toLocalIterator():
        print(row["doc"], row["line"], sep="\t")


def graph_build(spark, a):
    _nodes_given(a)
    nodes, edges = readers.adjacency(spark, a.input)
    writers.parquet(nodes, f"{a.output}/nodes")
    writers.parquet(edges, f"{a.output}/edges")
    writers.parquet(graph.initial(nodes, _ids(a.sources)), writers.iteration_path(a.output, 0))


def _nodes_given(a: argparse.Namespace) -> None:
    """The number of nodes is counted from the records where it matters; a given one must make sense."""
    if a.numNodes is not None and a.numNodes <= 0:
        raise SystemExit("--numNodes must be above 0")


def graph_partition(spark, a):
    _nodes_given(a)
    edges = spark.read.parquet(f"{a.input}/edges")
    dealt = edges.repartitionByRange(a.numPartitions, "src") if a.range else edges.repartition(a.numPartitions, "src")
    writers.parquet(dealt.sortWithinPartitions("src"), f"{a.output}/edges")
    for part in ("nodes", "iter0000"):
        writers.parquet(spark.read.parquet(f"{a.input}/{part}"), f"{a.output}/{part}")


def ppr_run(spark, a):
    _nodes_given(a)
    nodes, edges = spark.read.parquet(f"{a.base}/nodes"), spark.read.parquet(f"{a.base}/edges")
    prepared = graph.prepared(nodes, edges)
    for i in range(a.start, a.end):
        state = spark.read.parquet(writers.iteration_path(a.base, i))
        if a.sources:
            state = state.where(F.col("source").isin(_ids(a.sources)))
        writers.parquet(graph.step(state, prepared, graph.ALPHA), writers.iteration_path(a.base, i + 1))


def ppr_top(spark, a):
    ranks = spark.read.parquet(a.input)
    if a.sources:
        ranks = ranks.where(F.col("source").isin(_ids(a.sources)))
    topped = graph.report(graph.top(ranks, a.top))
    if a.output:
        writers.tsv(topped.select("source", "line"), a.output)
    last = None
    for row in topped.orderBy("source", "rank").toLocalIterator():
        if row["source"] != last:
            print("" if last is None else "\n", f"Source: {row['source']}", sep="")
            last = row["source"]
        print(row["line"])


def tpch(spark, a):
    t = lambda name: readers.tbl(spark, f"{a.input}/{name}.tbl", name) if a.format == "tbl" else spark.read.parquet(f"{a.input}/{name}.parquet")
    clerk, priority = ("o_clerk", "o_shippriority") if a.format == "tbl" else ("o_orderpriority", "o_orderpriority")
    if a.query != "q5" and not a.date:
        raise SystemExit(f"{a.query} needs --date")
    df = {
        "q1": lambda: relational.shipped_count(t("lineitem"), a.date),
        "q2": lambda: relational.shipped_orders(t("lineitem"), t("orders"), a.date, clerk),
        "q3": lambda: relational.shipped_parts(t("lineitem"), t("part"), t("supplier"), a.date),
        "q4": lambda: relational.nation_counts(t("lineitem"), t("orders"), t("customer"), t("nation"), a.date),
        "q5": lambda: relational.monthly_counts(t("lineitem"), t("orders"), t("customer"), t("nation")),
        "q6": lambda: relational.pricing_summary(t("lineitem"), a.date),
        "q7": lambda: relational.unshipped_revenue(t("lineitem"), t("orders"), t("customer"), a.date, priority),
    }[a.query]()
    for row in df.toLocalIterator():
        print(f"ANSWER={row['cnt']}" if a.query == "q1" else f"({','.join(map(str, row))})")


def model_train(spark, a):
    model = linear.train(readers.instances(spark, a.input), shuffle_seed=a.seed if a.shuffle else None)
    writers.tuples(model, a.model)


def model_apply(spark, a):
    writers.tuples(linear.apply(readers.instances(spark, a.input), readers.model(spark, a.model)), a.output)


def model_ensemble(spark, a):
    writers.tuples(linear.ensemble(readers.instances(spark, a.input), readers.models(spark, a.model), a.method), a.output)


def _ids(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="millrace")
    top.add_argument("--master", default="local[*]")
    sub = top.add_subparsers(required=True)

    def tool(name, run, *required, **options):
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for o, kw in options.items():
            p.add_argument(f"--{o}", **kw)
        return p

    reducers, forms, flag = {"type": int, "default": 0}, {"choices": ("pairs", "stripes"), "default": "pairs"}, {"action": "store_true"}
    layout = {"choices": ("file", "wide-row"), "default": "file"}
    tool("word-count", _count(counts.word_count), "input", "output", reducers=reducers, imc=flag)
    tool("prefix-count", _count(counts.prefix_count), "input", "output", reducers=reducers, imc=flag)
    tool("pmi", pmi, "input", "output", reducers=reducers, form=forms)
    tool("bigrams", bigram, "input", "output", reducers=reducers, form=forms)
    tool("index-build", index_build, "input", "output", reducers=reducers, layout=layout)
    tool("index-query", index_query, "index", "collection", "query", layout={"choices": ("file", "wide-row")}, lenient=flag)
    tool("graph-build", graph_build, "input", "output", "sources", numNodes={"type": int})
    tool("graph-partition", graph_partition, "input", "output", numNodes={"type": int}, numPartitions={"type": int, "default": 8}, range=flag)
    tool("ppr-run", ppr_run, "base", start={"type": int, "default": 0}, end={"type": int, "required": True}, numNodes={"type": int}, sources={}, useCombiner=flag)
    tool("ppr-top", ppr_top, "input", output={}, top={"type": int, "default": 10}, sources={})
    p = tool("tpch", tpch, "input", date={}, format={"choices": ("tbl", "parquet"), "default": "tbl"})
    p.add_argument("query", choices=[f"q{i}" for i in range(1, 8)])
    tool("model-train", model_train, "input", "model", shuffle=flag, seed={"type": int, "default": 0})
    tool("model-apply", model_apply, "input", "model", "output")
    tool("model-ensemble", model_ensemble, "input", "model", "output", method={"choices": ("average", "vote"), "required": True})
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.getActiveSession() or session(a.master), a)


if __name__ == "__main__":
    main()
