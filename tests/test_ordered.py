"""Groups cut into chunks must give what one window over the group gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkshard.operators import conversion_log as L
from inkshard.operators import structure as S
from inkshard.operators import tables as T
from inkshard.operators.ordered import over_groups
from inkshard.operators.text import join_text

#: Chunks of a few positions, and one chunk for everything.
CUT, WHOLE = 4, 1 << 40


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(k, pos, rng.choice([1, 1, -1, 0]), rng.choice(["a", "b", None])) for k, n in ((1, 40), (2, 3), (3, 4), (4, 9)) for pos in range(n)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k int, pos int, d int, v string").coalesce(3).cache()


def same(df, body):
    results = []
    for chunk in (CUT, WHOLE):
        out = over_groups(df, ["k"], ["pos"], body, chunk)
        results.append(sorted(map(str, out.select(*sorted(out.columns)).collect())))
    assert results[0] == results[1]
    assert results[0]


BODIES = {
    "running": lambda df, s: s.running(df, a=("sum", F.col("d")), b=("min", F.col("d")), c=("last", F.col("v"))),
    "before": lambda df, s: s.running(df, include_current=False, a=("sum", F.col("d")), b=("max", F.col("d")), c=("last", F.col("v"))),
    "backwards": lambda df, s: s.running(df, include_current=False, backwards=True, c=("last", F.col("v")), n=("sum", F.col("d"))),
    "totals": lambda df, s: s.totals(df, a=("sum", F.col("d")), f=("first", F.col("v")), g=("last", F.col("v"))),
    "neighbours": lambda df, s: s.neighbours(df, lag={"a": F.col("v")}, lead={"b": F.col("v"), "c": F.col("d")}),
    "neighbours_after_filter": lambda df, s: s.neighbours(df.filter("pos % 5 > 2"), lag={"a": F.col("pos")}, lead={"b": F.col("pos")}),
    "ordinal": lambda df, s: s.ordinal(df, "n", F.col("d") == 1),
    "count_since": lambda df, s: s.count_since(df, n=(F.col("d") == 1, F.col("d") == -1), m=(F.col("v") == "a", F.col("v") == "b")),
    "floored": lambda df, s: s.floored_level(df, "level", F.col("d")),
    "finer": lambda df, s: s.by("k", "d").running(df, a=("last", F.col("pos"))),
}


@pytest.mark.parametrize("name", BODIES)
def test_chunks_equal_windows(rows, name):
    same(rows, BODIES[name])


@pytest.mark.parametrize("name", ["running", "before", "backwards", "totals", "neighbours", "count_since", "floored"])
def test_ordinary_groups_need_no_summary(rows, name):
    out = over_groups(rows, ["k"], ["pos"], BODIES[name])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Window" in plan and "Join" not in plan


def test_against_one_window(rows):
    """The carried form itself, against plain windows over whole groups."""
    w = Window.partitionBy("k").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum("d").over(up)
    want = rows.select("k", "pos", s.alias("a"), F.last("v", True).over(up).alias("c"), F.lag("v").over(w).alias("p"), F.max("d").over(Window.partitionBy("k")).alias("t"), s.alias("s"))
    want = want.withColumn("level", F.col("s") - F.least(F.lit(0), F.min("s").over(up))).drop("s")

    def body(df, scan):
        df = scan.together(df, running={"a": ("sum", F.col("d")), "c": ("last", F.col("v"))}, totals={"t": ("max", F.col("d"))})
        return scan.neighbours(scan.floored_level(df, "level", F.col("d")), lag={"p": F.col("v")})

    got = over_groups(rows, ["k"], ["pos"], body, CUT)
    columns = ["k", "pos", "a", "c", "p", "t", "level"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_null_keys_and_positions(spark):
    df = spark.createDataFrame([(None, 1, 1), (None, 9, 2), (1, None, 3), (1, 9, 4)], "k int, pos int, d int")
    out = over_groups(df, ["k"], ["pos"], lambda x, s: s.running(x, n=("sum", F.col("d"))), CUT)
    assert {r.d: r.n for r in out.filter("k = 1").collect()} == {3: 3, 4: 7}


def test_floored_level_never_negative(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([-1, -1, 1, 1, -1, -1, -1, 1])], "k int, pos int, d int")
    out = over_groups(df, ["k"], ["pos"], lambda x, s: s.floored_level(x, "n", F.col("d")), CUT)
    assert [r.n for r in out.orderBy("pos").collect()] == [0, 0, 1, 2, 1, 0, 0, 1]


def test_joined_parts_make_the_whole_text(spark):
    df = spark.createDataFrame([(k, i, f"<{i}>") for k, n in ((1, 25), (2, 3)) for i in range(n)], "k int, pos int, t string")
    out = join_text(df, ["k"], ["pos"], "t", part=CUT).orderBy("k", "part").collect()
    assert len([r for r in out if r.k == 1]) > 3 and max(r.n for r in out) <= CUT
    assert "".join(r.text for r in out if r.k == 1) == "".join(f"<{i}>" for i in range(25))
    assert [(r.part, r.text) for r in out if r.k == 2] == [(0, "<0><1><2>")]


def executed(df):
    """Scans of files and shuffles that the query really ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("FileScan"), sum(line.split("Exchange")[0].strip(" +-:|*()0123456789") == "" for line in plan.splitlines() if "Exchange" in line and "Reused" not in line and "Broadcast" not in line)


def test_huge_group_spreads_and_plan_is_bounded(spark, tmp_path):
    """A million rows in one group, a few megabytes on disk: same rows as many small groups, several tasks, few scans."""
    n = 1_000_000
    spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 10 == 0).alias("is_break")).write.parquet(str(tmp_path / "one"))
    spark.range(n).select((F.col("id") / 10).cast("int").alias("doc_id"), (F.col("id") % 10).cast("int").alias("pos"), (F.col("id") % 10 == 0).alias("is_break")).write.parquet(str(tmp_path / "many"))
    one, many = (S.assign_sections(spark.read.parquet(str(tmp_path / p))) for p in ("one", "many"))
    assert one.agg(F.sum("section_idx"), F.count(F.lit(1))).first() == (sum((p + 9) // 10 for p in range(n)), n)
    assert many.agg(F.sum("section_idx"), F.count(F.lit(1))).first() == (n // 10 * 9, n)
    assert one.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 3
    scans, shuffles = executed(one)
    assert scans <= 3 and shuffles <= 4


def brute_grid(cells, n_cols):
    covered, grid = {}, []
    for r in sorted({c[0] for c in cells}):
        queue, at = [c for c in cells if c[0] == r], 1
        while at <= n_cols:
            if (r, at) in covered:
                span = covered[r, at]
                grid.append((r, at, span, True))
            elif queue:
                _, _, tall, span = queue.pop(0)
                grid.append((r, at, span, False))
                covered.update({(r + d, at): span for d in range(1, tall)})
            else:
                break
            at += span
    return sorted(grid)


@pytest.mark.parametrize("chunk", [2, WHOLE])
def test_table_grid(spark, chunk):
    rng = random.Random(11)
    cells = {t: [(r, o, rng.choice([1, 1, 2, 3]) if t < 4 else 1, rng.choice([1, 2])) for r in range(8) for o in range(rng.randint(1, 4))] for t in range(6)}
    df = spark.createDataFrame([(t, *c, "s", 5) for t, cs in cells.items() for c in cs], "table_id int, row int, ord int, row_span int, col_span int, style string, n_cols int")
    got = T.table_grid(df, chunk=chunk).collect()
    for t, cs in cells.items():
        mine = sorted((r.row, r.grid_col, r.col_span, r.is_continuation) for r in got if r.table_id == t)
        assert mine == brute_grid(cs, 5)


CELLS = "table_id int, row int, ord int, row_span int, col_span int, style string, n_cols int"


@pytest.mark.parametrize("chunk", [4])
def test_band_handed_from_piece_to_piece(spark, chunk):
    """Spans over many pieces, over pieces without cells, and of one table without a name."""
    rng = random.Random(3)
    cells = {t: [(r, o, rng.choice([1, 1, 4, 9]), rng.choice([1, 2])) for r in range(20) if rng.random() < 0.8 for o in range(rng.randint(1, 3))] for t in (None, 1, 2)}
    cells[3] = [(0, 0, 100, 1), (0, 1, 1, 1), (50, 0, 1, 1), (99, 0, 1, 1), (100, 0, 1, 1)]
    df = spark.createDataFrame([(t, *c, "s", 5) for t, cs in cells.items() for c in cs], CELLS)
    got = T.table_grid(df, chunk=chunk).collect()
    for t, cs in cells.items():
        assert sorted((r.row, r.grid_col, r.col_span, r.is_continuation) for r in got if r.table_id == t) == brute_grid(cs, 5)
    assert T.table_grid(df.filter("false"), chunk=chunk).collect() == []


def test_huge_band_spreads(spark):
    """One band of 1,000,000 rows under one span: several tasks, and the last row still knows the span."""
    n = 1_000_000
    rows = spark.range(n).select((F.col("id") % 1).cast("int").alias("table_id"), F.col("id").cast("int").alias("row"), F.lit(1).alias("ord"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit("s").alias("style"), F.lit(2).alias("n_cols"))
    top = spark.createDataFrame([(0, 0, 0, n, 1, "top", 2)], CELLS)
    grid = T.table_grid(top.unionByName(rows)).withColumn("task", F.spark_partition_id())
    found = grid.groupBy("is_continuation", "grid_col").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"), F.min("style").alias("style")).collect()
    assert sorted((r.is_continuation, r.grid_col, r.n, r.row, r.style) for r in found) == [(False, 1, 1, 0, "top"), (False, 2, n, n - 1, "s"), (True, 1, n - 1, n - 1, "top")]
    assert grid.select("task").distinct().count() > 3


def test_trailing_rate_over_bucket_borders(spark):
    times = [0, 100, 3500, 3599, 3600, 3700, 7199, 7200, 7201, 9000]
    df = spark.createDataFrame([("a", "b", i, t * 1_000_000) for i, t in enumerate(times)], "source_format string, target_format string, event_id bigint, ts_us bigint")
    got = {r.event_id: r.rate for r in L.trailing_rate(df, 300).collect()}
    assert got == {i: sum(t - 300 <= u <= t for u in times) / 300 for i, t in enumerate(times)}


def test_grid_writes_its_rows_once(spark, monkeypatch):
    made, written = [], T.written
    monkeypatch.setattr(T, "written", lambda df: made.append(df.columns) or written(df))
    cells = spark.createDataFrame([(1, r, 0, 2, 1, "s", 2) for r in range(3)], "table_id int, row int, ord int, row_span int, col_span int, style string, n_cols int")
    assert T.table_grid(cells).count() >= 3
    assert not [c for c in made if "_fresh" in c]
