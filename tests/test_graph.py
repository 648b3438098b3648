import random

import pytest

from millrace.operators import graph


def by_hand(nodes, edges, source, iterations, alpha=0.15):
    p = {n: float(n == source) for n in nodes}
    out = {n: [d for s, d in edges if s == n] for n in nodes}
    for _ in range(iterations):
        into = dict.fromkeys(nodes, 0.0)
        for n in nodes:
            for d in out[n]:
                if d in into:
                    into[d] += p[n] / len(out[n])
        missing = max(0.0, 1 - sum(into.values()))
        p = {n: (alpha + (1 - alpha) * (into[n] + missing)) if n == source else (1 - alpha) * into[n] for n in nodes}
    return p


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_python(spark, seed):
    r = random.Random(seed)
    nodes = list(range(20))
    edges = [(r.randrange(15), r.randrange(22)) for _ in range(60)]  # 15 to 19 dangle; 20 and 21 have no record; edges repeat
    got = graph.filled(graph.pagerank(*frames(spark, nodes, edges), [3, 16], 4), frames(spark, nodes, edges)[0], [3, 16]).collect()
    for s in (3, 16):
        want = by_hand(nodes, edges, s, 4)
        assert {x["id"]: x["p"] for x in got if x["source"] == s} == pytest.approx(want)
        assert sum(want.values()) == pytest.approx(1)


def test_all_dangling(spark):
    got = graph.pagerank(*frames(spark, [1, 2], []), [1], 3).collect()
    assert [(x["id"], x["p"]) for x in got] == [(1, pytest.approx(1.0))]


def test_unknown_and_repeated_sources(spark):
    nodes, edges = frames(spark, [1, 2], [(1, 2), (2, 1)])
    assert graph.pagerank(nodes, edges, [99], 2).count() == 0
    assert {x["p"] for x in graph.filled(graph.pagerank(nodes, edges, [99], 2), nodes, [99]).collect()} == {0.0}
    ranks = graph.pagerank(nodes, edges, [1, 1], 2)
    twice = sorted((x["id"], round(x["p"], 9)) for x in graph.filled(ranks, nodes, [1, 1]).collect())
    once = sorted((x["id"], round(x["p"], 9)) for x in graph.filled(ranks, nodes, [1]).collect())
    assert twice == sorted(once + [(1, 0.0), (2, 0.0)])
    with pytest.raises(ValueError):
        graph.pagerank(*frames(spark, [1, 1], [(1, 1)]), [1], 1)


def test_resumes(spark):
    nodes, edges = frames(spark, [1, 2, 3], [(1, 2), (2, 3), (3, 1), (1, 3)])
    whole = {x["id"]: x["p"] for x in graph.pagerank(nodes, edges, [1], 5).collect()}
    part = graph.pagerank(nodes, edges, [1], 2)
    assert {x["id"]: x["p"] for x in graph.pagerank(nodes, edges, [1], 3, ranks=part).collect()} == pytest.approx(whole)


def test_top_and_report(spark):
    ranks = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (1, 3, 0.25)], "source long, id long, p double")
    assert [x["line"] for x in graph.report(graph.top(ranks, 2)).orderBy("rank").collect()] == ["0.50000 1", "0.25000 2"]


def test_records_and_stats(spark):
    nodes, edges = frames(spark, [1, 2, 3], [(1, 2), (1, 3), (2, 3)])
    assert tuple(graph.stats(nodes, edges).head()) == (3, 3, 2, 1)
    assert sorted(map(tuple, graph.records(nodes, edges).collect())) == [(1, 2, 0, 2, 3), (2, 1, 1, 3, 3), (3, 0, 2, None, None)]
