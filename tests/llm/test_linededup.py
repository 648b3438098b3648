import random

from millrace.llm import linededup


def by_hand(rows):
    seen, out = {}, []
    for i, text in sorted(rows):
        lines = text.split("\n")
        for p in range(len(lines) - 2):
            seen.setdefault(tuple(lines[p : p + 3]), (i, p))
    for i, text in rows:
        lines = text.split("\n")
        gone = {q for p in range(len(lines) - 2) if seen[tuple(lines[p : p + 3])] != (i, p) for q in (p, p + 1, p + 2)}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone)))
    return sorted(out)


def test_against_plain_python(spark):
    r = random.Random(7)
    passage = [f"shared line {i}" for i in range(12)]
    rows = []
    for i in range(150):
        lines = [f"own {i} {j}" if r.random() < 0.7 else r.choice(["a", "b"]) for j in range(r.randrange(12))]
        if r.random() < 0.5:
            at, n = r.randrange(9), r.randrange(2, 8)
            lines[len(lines) // 2 : len(lines) // 2] = passage[at : at + n]
        rows.append((i, "\n".join(lines)))
    rows += [(200, rows[3][1]), (201, "a\na\na\na\na"), (202, "a\na\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(x) for x in linededup.dedup(df).collect()) == by_hand(rows)
