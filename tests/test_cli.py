import glob

import pytest

from millrace import cli


def written(path):
    return sorted(x for f in glob.glob(f"{path}/part-*") for x in open(f).read().splitlines())


@pytest.fixture
def text(tmp_path):
    (tmp_path / "in.txt").write_text("the cat of the dog\nthe dog\ncat and dog\n" * 12)
    return str(tmp_path / "in.txt")


def test_counts(spark, text, tmp_path):
    cli.main(["word-count", "--input", text, "--output", f"{tmp_path}/w", "--imc"])
    assert written(f"{tmp_path}/w") == ["and\t12", "cat\t24", "dog\t36", "of\t12", "the\t36"]
    cli.main(["prefix-count", "--input", text, "--output", f"{tmp_path}/p", "--reducers", "1"])
    assert "th\t36" in written(f"{tmp_path}/p")


def test_pmi_and_bigrams(spark, text, tmp_path):
    for form in ("pairs", "stripes"):
        cli.main(["pmi", "--form", form, "--input", text, "--output", f"{tmp_path}/pmi-{form}"])
        cli.main(["bigrams", "--form", form, "--input", text, "--output", f"{tmp_path}/big-{form}"])
    assert any(x.startswith("(the, dog)\t") for x in written(f"{tmp_path}/pmi-pairs"))
    assert any(x.startswith("cat\t{") for x in written(f"{tmp_path}/pmi-stripes"))
    assert "(of, *)\t12.0" in written(f"{tmp_path}/big-pairs") and "of\t{the=1.0}" in written(f"{tmp_path}/big-stripes")


@pytest.mark.parametrize("layout", ["file", "wide-row"])
def test_index(spark, text, tmp_path, capsys, layout):
    cli.main(["index-build", "--input", text, "--output", f"{tmp_path}/i", "--layout", layout])
    cli.main(["index-query", "--index", f"{tmp_path}/i", "--collection", text, "--query", "the cat AND", "--layout", layout])
    out = capsys.readouterr().out.splitlines()
    with pytest.raises(SystemExit):
        cli.main(["index-query", "--index", f"{tmp_path}/i", "--collection", text, "--query", "the", "--layout", "file" if layout == "wide-row" else "wide-row"])
    assert len(out) == 12 and out[0] == "0\tthe cat of the dog"


def test_gzip_is_refused(spark, tmp_path):
    from millrace.sources.readers import lines_with_offsets

    with pytest.raises(ValueError):
        lines_with_offsets(spark, "x.gz")
    (tmp_path / "part-0").write_text("a\n")
    assert lines_with_offsets(spark, str(tmp_path)).count() == 1
    (tmp_path / "part-1.gz").write_bytes(b"")
    with pytest.raises(ValueError):
        lines_with_offsets(spark, str(tmp_path))


def test_graph(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("1 2 3\n2 3\n3 1\n4\n")
    cli.main(["graph-build", "--input", f"{tmp_path}/g.txt", "--output", f"{tmp_path}/g", "--numNodes", "4", "--sources", "1,4"])
    cli.main(["graph-partition", "--input", f"{tmp_path}/g", "--output", f"{tmp_path}/h", "--numPartitions", "2", "--range"])
    cli.main(["ppr-run", "--base", f"{tmp_path}/h", "--start", "0", "--end", "3", "--numNodes", "4", "--sources", "1,4"])
    cli.main(["ppr-top", "--input", f"{tmp_path}/h/iter0003", "--top", "2", "--sources", "1,4"])
    out = capsys.readouterr().out
    cli.main(["ppr-top", "--input", f"{tmp_path}/h/iter0003", "--top", "1", "--sources", "4", "--output", f"{tmp_path}/top"])
    assert written(f"{tmp_path}/top") == ["4\t1.00000 4"]
    with pytest.raises(SystemExit):
        cli.main(["graph-build", "--input", f"{tmp_path}/g.txt", "--output", f"{tmp_path}/x", "--numNodes", "0", "--sources", "1"])
    assert out.startswith("Source: 1\n") and "Source: 4\n1.00000 4\n" in out


def test_models(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a spam 1 2 2\nb ham 3 1\nc spam 2\n")
    cli.main(["model-train", "--input", f"{tmp_path}/t.txt", "--model", f"{tmp_path}/m"])
    cli.main(["model-apply", "--input", f"{tmp_path}/t.txt", "--model", f"{tmp_path}/m", "--output", f"{tmp_path}/o"])
    assert any(x.startswith("(c,spam,") and x.endswith(",spam)") for x in written(f"{tmp_path}/o"))
    (tmp_path / "e").mkdir()
    for i in range(3):
        (tmp_path / f"e/part-0000{i}").write_text(f"(1,{i - 1.0})\n(2,1.0)\n")
    cli.main(["model-ensemble", "--input", f"{tmp_path}/t.txt", "--model", f"{tmp_path}/e", "--method", "vote", "--output", f"{tmp_path}/v"])
    assert "(a,spam,3.0,spam)" in written(f"{tmp_path}/v")


@pytest.mark.parametrize("query", [f"q{i}" for i in range(1, 8)])
def test_tpch_over_parquet_and_tbl(spark, sf_dir, tmp_path, capsys, query):
    cli.main(["tpch", query, "--input", sf_dir, "--format", "parquet", "--date", "1996-01-01" if query == "q7" else "1996-01"])
    assert capsys.readouterr().out.startswith("ANSWER=" if query == "q1" else "(")
    (tmp_path / "lineitem.tbl").write_text("1|2|3|1|17|21168.23|0.04|0.02|N|O|1996-03-13|1996-02-12|1996-03-22|IN PERSON|TRUCK|c|\n")
    (tmp_path / "orders.tbl").write_text("1|4|O|1.0|1996-01-02|5-LOW|Clerk#1|0|c|\n")
    (tmp_path / "customer.tbl").write_text("4|Customer#4|a|3|p|1.0|BUILDING|c|\n")
    (tmp_path / "part.tbl").write_text("2|part two|m|b|t|1|JAR|1.0|c|\n")
    (tmp_path / "supplier.tbl").write_text("3|Supplier#3|a|3|p|1.0|c|\n")
    (tmp_path / "nation.tbl").write_text("3|CANADA|1|c|\n")
    cli.main(["tpch", query, "--input", str(tmp_path), "--date", "1996-02-01" if query == "q7" else "1996-03"])
    want = {"q1": "ANSWER=1", "q2": "(Clerk#1,1)", "q3": "(1,part two,Supplier#3)", "q4": "(3,CANADA,1)", "q5": "(1996-03,CANADA,1)", "q7": "(Customer#4,1,20321.5008,1996-01-02,0)"}
    out = capsys.readouterr().out
    assert out.strip() == want[query] if query in want else out.startswith("(N,O,17.0,21168.23,20321.5008,")
