"""Running values by ranges, subtrees by intervals, and tables of any depth, on long and skewed input."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary.operators import books, intervals, lookups, outline, runs, scan, tables, versions
from foliary.sources import packages


def skewed(spark, n=20_000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.randint(1, 6)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, i long, x int, level int").repartition(5)


def test_running_values_equal_windows(spark):
    df = skewed(spark, 3000)
    kinds = {"n": ("sum", F.lit(1)), "s": ("sum", F.col("x")), "top": ("max", F.col("x")), "low": ("min", F.col("x")), "prev": ("last", F.col("x"))}
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    want = df.withColumns({"n": zero(F.sum(F.lit(1)).over(w)), "s": zero(F.sum("x").over(w)), "top": F.max("x").over(w), "low": F.min("x").over(w), "prev": F.last("x", True).over(w)})
    got = scan.running(df, ["k"], ["i"], kinds, ranges=7)
    assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    whole = scan.running(df, [], ["i"], {"n": ("sum", F.lit(1))}, ranges=7)
    assert [(r.i, r.n) for r in whole.orderBy("i").select("i", "n").collect()] == [(i, i) for i in range(3000)]
    assert scan.running(df.limit(0), ["k"], ["i"], kinds).count() == 0


def test_a_hot_key_is_no_one_task(spark):
    df = skewed(spark)
    placed = scan.running(df.withColumn("at", F.lit(0)), ["k"], ["i"], {"n": ("sum", F.lit(1))}, ranges=8)
    # Ranges are drawn on key and order, so the rows that a window sees are those of a range.
    parts = df.repartitionByRange(8, "k", "i").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) <= 2 * 20_000 / 8 and placed.count() == 20_000
    kept = runs.without_repeats(df, ["k"], "i", "x")
    w = Window.partitionBy("k").orderBy("i")
    want = df.withColumn("a", F.lag("x").over(w)).where("a is null or a <> x").count()
    assert kept.count() == want


def test_long_outline_equals_outline(spark):
    heads = skewed(spark, 4000).where("k is not null").select(F.col("k").alias("doc_id"), (F.col("i") + 1).alias("ord"), F.col("level").cast("long").alias("level"))
    columns = ["doc_id", "ord", "parent_ord", "section_ord", "play_order", "needs_top"]
    a, b = (sorted(map(tuple, f(heads).select(columns).collect())) for f in (outline.outline, outline.long_outline))
    assert a == b


def tree(n, seed=2):
    """Random elements: (node_id, last_id, parent, ancestors, tag)."""
    rng, kids, path, last = random.Random(seed), {}, {0: []}, {}
    rows = [0]
    stack = [0]
    for i in range(1, n):
        while len(stack) > 1 and rng.random() < 0.4:
            stack.pop()
        path[i] = [*path[stack[-1]], stack[-1]]
        kids.setdefault(stack[-1], []).append(i)
        rows.append(i)
        stack.append(i)
    for i in reversed(rows):
        last[i] = max([i, *(last[c] for c in kids.get(i, []))])
    return [(1, i, last[i], path[i], rng.choice("ttpqr")) for i in rows]


def test_intervals_equal_paths(spark):
    rows = tree(2000)
    df = spark.createDataFrame(rows, "doc_id long, node_id long, last_id long, ancestors array<long>, tag string").repartition(3)
    tag = {r[1]: r[4] for r in rows}
    is_q = F.col("tag") == "q"
    got = {r.node_id: r.x for r in df.withColumn("x", intervals.inside(is_q, ["doc_id"])).collect()}
    assert got == {r[1]: any(tag[a] == "q" for a in r[3]) for r in rows}
    top = {r.node_id: r.top for r in intervals.outermost(df, is_q, ["doc_id"], "top").collect()}
    assert top == {r[1]: next((a for a in [*r[3], r[1]] if tag[a] == "q"), None) for r in rows}


def test_a_long_book(spark):
    """One book of 60,000 elements, a tenth of them page numbers, in text and in order."""
    parts = "".join(f"<p id='p{i}'>a{i}<pagenum>{i}</pagenum> b<em>c</em></p>" + ("<x/>" * 5 if i % 2 else "<x><x/></x>") for i in range(6000))
    xml = f"<dtbook><book><bodymatter><level1>{parts}</level1></bodymatter></book></dtbook>".encode()
    nodes = packages.xml_nodes(spark.createDataFrame([(1, "dtbook.xml", xml)], "doc_id long, path string, content binary"))
    targets = nodes.where("tag = 'p'").select("doc_id", "node_id", F.col("attrs")["id"].alias("id"))
    got = {r.id: r.text for r in books.texts(nodes, targets).join(targets, ["doc_id", "node_id"]).collect()}
    assert got == {f"p{i}": f"a{i} b c" for i in range(6000)}


def cells(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, table_id string, row long, tc long, colspan long, v_state string, text string")


def test_tables_of_any_depth(spark):
    """Nine levels by ids alone, and a table under a merged cell that goes with it."""
    chain = ["t1"]
    for _ in range(8):
        chain.append(f"{chain[-1]}_cell_0_0_nested_0")
    rows = [(1, t, 0, 0, 1, None, f"d{i}") for i, t in enumerate(chain)]
    rows += [(1, "t2", 0, 0, 1, "restart", "a"), (1, "t2", 1, 0, 1, "continue", "gone"), (1, "t2_cell_1_0_nested_0", 0, 0, 1, None, "gone too"), (1, "t2_cell_1_0_nested_0_cell_0_0_nested_0", 0, 0, 1, None, "and this")]
    got = {r.table_id: r for r in tables.rendered(cells(spark, rows)).collect()}
    assert [got["t1"].html.index(f">d{i}<") for i in range(9)] == sorted(got["t1"].html.index(f">d{i}<") for i in range(9))
    assert got["t1"].html.count("<table>") == got["t1"].html.count("</table>") == 9 and got["t1"].pars.count("<par ") == 9
    assert "gone" not in got["t2"].html and "and this" not in got["t2"].html and 'rowspan="2"' in got["t2"].html


def test_nearest_by_path(spark):
    rows = tree(500, seed=5)
    df = spark.createDataFrame(rows, "doc_id long, node_id long, last_id long, ancestors array<long>, tag string")
    tag = {r[1]: r[4] for r in rows}
    found = lookups.nearest_by_path(df, df.where("tag = 'r'").select("doc_id", "node_id", "ancestors"), ("q", "p")).collect()

    def want(path):
        for t in "qp":
            for a in reversed(path):
                if tag[a] == t:
                    return a
        return None

    assert {r.node_id: r.near for r in found} == {r[1]: want(r[3]) for r in rows if r[4] == "r"}


def test_versions_of_a_table(spark, tmp_path):
    """Three batches, a crash between write and commit, two writers at once; only buckets that a batch meets are written."""
    folder, schema = str(tmp_path / "jobs"), "job string, k string, v string, at long"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: {(r.job, r.k): r.v for r in versions.current(spark, folder, schema).collect()}
    assert read() == {}
    assert versions.merge(folder, rows(*((f"j{i}", "s", "old", 1) for i in range(200))), ["job", "k"], ["at"], 16) == 1
    before = versions._manifest(spark, folder)["buckets"]
    versions.merge(folder, rows(("j3", "s", "new", 2), ("j3", "t", None, 2), ("j4", "s", "late", 0)), ["job", "k"], ["at"], 16)
    after = versions._manifest(spark, folder)["buckets"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3
    versions.prepared(folder, rows(("j5", "s", "lost", 9)), ["job", "k"], ["at"], 16)  # a crash ahead of the commit
    want = {(f"j{i}", "s"): "old" for i in range(200)} | {("j3", "s"): "new", ("j3", "t"): None}
    assert read() == want
    one, two = (versions.prepared(folder, rows((j, "s", "x", 3)), ["job", "k"], ["at"], 16) for j in ("j6", "j7"))
    versions._commit(spark, folder, one)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, folder, two)
    assert versions.merge(folder, rows(("j7", "s", "x", 3)), ["job", "k"], ["at"], 16) == 4
    assert read() == want | {("j6", "s"): "x", ("j7", "s"): "x"}
