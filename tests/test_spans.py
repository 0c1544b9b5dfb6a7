"""Merged cells: random tables against a plain walk over the grid, and the parts in which they are told."""

import random

from foliary.operators import tables


def plain(cells):
    """{(row, g): (rowspan, colspan, area)} of one table, by the rules, cell by cell."""
    at = {}
    for row in sorted({c[0] for c in cells}):
        g = 0
        for _, _, span, state in sorted(c for c in cells if c[0] == row):
            for k in range(span):
                at[row, g + k] = (g, span, state)
            g += span
    runs, covered = {}, set()
    for (row, g), (start, span, state) in at.items():
        if state == "restart":
            n = 1
            while at.get((row + n, g), (0, 0, ""))[2] == "continue":
                n += 1
            runs[row, g] = n
            if g == start:
                covered |= {(row + i, g + j) for i in range(1, n) for j in range(span)}
    out = {}
    for (row, g), (start, span, state) in at.items():
        area = g != start or (row, g) in covered
        out[row, g] = (1 if area else runs.get((row, g), 1), 1 if area else span, area)
    return out


def test_random_tables(spark):
    rng, rows = random.Random(3), []
    for t in range(60):
        rows += [(t, r, c, rng.choice([1, 1, 2, 3]), rng.choice([None, "restart", "continue", "continue"])) for r in range(rng.randint(1, 8)) if rng.random() < 0.95 for c in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "t long, row long, tc long, colspan long, v_state string")
    got = {(r.t, r.row, r.g): (r.rowspan, r.colspan, r.is_merged_area) for r in tables.merged_spans(df, ["t"]).collect()}
    assert got == {(t, *k): v for t in range(60) for k, v in plain([x[1:] for x in rows if x[0] == t]).items()}


def test_parts_follow_the_session(spark):
    """Rows that compress to nothing still come in as many parts as there are shuffle partitions, and are dealt once; before, one part held them all."""
    df = spark.range(20_000).selectExpr("id as t", "0L as row", "0L as tc", "1L as colspan", "cast(null as string) as v_state")
    spans = tables.merged_spans(df, ["t"])
    assert spans.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Join" not in spans._jdf.queryExecution().optimizedPlan().toString()
