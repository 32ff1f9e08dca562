import random

from tidemark.llm.lines import dedup_lines

SCHEMA = "doc_id long, text string, n_lines string, row int, key int, pos int"


def brute(rows):
    seen, gone = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if w in seen:
                gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
            seen.add(w)
    out = []
    for i, t, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for p, x in enumerate(lines) if p not in gone.get((i, t), ())]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    r = random.Random(7)
    rows = [(i, "\n".join(r.choice("abc") if r.random() < 0.8 else r.choice(["", " ", "long line " * 5, "é"]) for _ in range(r.randint(0, 12)))) for i in range(200)]
    rows += [(300, None), (None, "x\ny\nz\nw"), (301, "x\ny\nz"), (302, ""), (303, "q\nq\nq\nq\nq"), (303, "q\nq\nq\nq\nq"), (304, "\n".join(map(str, range(3000)))), (305, "\n".join(map(str, range(1000, 3500))))]
    got = dedup_lines(spark.createDataFrame([(*x, "s", 1, 2, 3) for x in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "row", "key", "pos", "n_lines", "n_removed"]
    assert sorted(((g.doc_id, g.text, g.n_lines, g.n_removed) for g in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python(spark):
    plan = dedup_lines(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
