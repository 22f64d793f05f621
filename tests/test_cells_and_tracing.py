"""Cells of mixed kinds, traced functions, warnings counted with the rows."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions import cells, folds
from gridweave.functions import values as V
from gridweave.functions.tracing import Row, choose, expression
from gridweave.functions.values import GridError
from gridweave.functions.watch import Watch
from gridweave.operators.grid import Grid
from gridweave.plans.workplan import as_grid

MIXED = [1, "1", 1.0, True, None, 2.5, "", 0, [1, "a", [2.0]], (1 << 53) + 1, float("nan"), -0.0, "a\"b\\", float("-inf")]


def kinds(grid, column):
    return [r[0] for r in grid.df.orderBy("__pos").select(cells.kind_of(F.col(column))).collect()]


def test_cells_keep_their_kinds(spark):
    grid = Grid.table(spark, a=MIXED)
    assert grid.kinds == {"a": "variant"}
    names = ["int", "string", "float", "bool", "null", "float", "string", "int", "list", "int", "float", "float", "string", "float"]
    assert kinds(grid, "a") == names
    product = grid.product(Grid.table(spark, b=["x", "y"])).project("a")
    assert kinds(product, "a") == names and product.length() == len(MIXED)
    shown = [r[0] for r in grid.df.orderBy("__pos").select(V.text_of(F.col("a"), "variant")).collect()]
    assert shown == ["1", "1", "1.0", "true", "None", "2.5", "", "0", "[1,a,[2.0]]", "9007199254740993", "NaN", "0.0", 'a"b\\', "-Inf"] or shown[11] == "-0.0"
    truth = [r[0] for r in grid.df.orderBy("__pos").select(V.truthy(F.col("a"), "variant")).collect()]
    assert truth == [True, True, True, True, False, True, False, False, True, True, True, False, True, True]


def test_equality_by_kind(spark):
    grid = Grid.table(spark, a=MIXED).product(Grid.table(spark, b=MIXED).rename(b="b"))
    found = {(r.i, r.j): r.same for r in grid.df.select((F.col("__pos") / len(MIXED)).cast("int").alias("i"), (F.col("__pos") % len(MIXED)).cast("int").alias("j"), V.equals(F.col("a"), F.col("b"), ("variant", "variant")).alias("same")).collect()}
    for i, a in enumerate(MIXED):
        for j, b in enumerate(MIXED):
            expected = V.equal(a, b) if not (a is None or b is None) else a is b
            assert found[i, j] == expected, (a, b)
    mixed = Grid.table(spark, a=cells.cells(1 << 53, (1 << 53) + 1)).df
    assert [r[0] for r in mixed.orderBy("__pos").select(V.equals(F.col("a"), F.lit(float(1 << 53)), ("variant", "double"))).collect()] == [True, True]


def test_shared_mixed_columns_and_unique(spark):
    a = Grid.table(spark, k=cells.cells(1), x=[1])
    assert a.product(Grid.table(spark, k=[1.0], y=["y"])).length() == 1
    with pytest.raises(Exception, match="E042"):
        a.product(Grid.table(spark, k=["1"], y=["y"])).rows()
    grid = Grid.table(spark, a=[1, "1", 1.0, True, "1", None, None, -0.0, 0, "n:1"])
    assert kinds(grid.unique(), "a") == ["int", "string", "bool", "null", "float", "string"]
    assert [r.duplicated for r in grid.duplicated().orderBy("__pos").collect()] == [False, False, True, False, True, False, True, False, True, False]
    rows = Grid.from_rows(spark, [{"a": 1, "b": "x"}, {"a": "1", "b": "x"}, {"a": 1.0, "b": "x"}])
    assert rows.unique().length() == 2 and Grid.rbind(rows, rows).unique().length() == 2


def test_operators_on_cells(spark):
    grid = Grid.table(spark, a=[1, 2.5, "x", "ab", (1 << 63) - 1], b=[2, 2, "y", 3, 1]).compute(s=lambda r: choose(r.a.str() == "ab", r.a * r.b, r.a + r.b))
    assert [r[0] for r in grid.df.orderBy("__pos").select(V.text_of(F.col("s"), "variant")).collect()] == ["3", "4.5", "xy", "ababab", "-9223372036854775808"]
    ordered = Grid.table(spark, a=[1, "b"], b=[1.5, "a"])
    assert [r[0] for r in ordered.df.orderBy("__pos").select(V.compare("<", F.col("a"), F.col("b"), ("variant", "variant"))).collect()] == [True, False]
    for code, f in (("E105", lambda r: r.a - r.b), ("E110", lambda r: r.a < r.b)):
        with pytest.raises(Exception, match=code):
            Grid.table(spark, a=["x", 1], b=[1, True]).compute(s=f).rows()
    whole = Grid.table(spark, a=[1, "7", 2.9, True]).compute(i=lambda r: r.a.int(), f=lambda r: r.a.float())
    assert whole.column("i") == [1, 7, 2, 1] and whole.column("f") == [1.0, 7.0, 2.9, 1.0]
    with pytest.raises(Exception, match="E106"):
        Grid.table(spark, a=[None, "7", 1]).compute(i=lambda r: r.a.int()).rows()


def test_traced_predicates_wrap_and_stay_in_the_jvm(spark):
    big = 1 << 62
    grid = Grid.table(spark, a=[big, 3, -1, 0], b=[2, 2, 5, 7], t=["", "x", "y", "z"])
    kept = grid.filter(lambda r: r.a * r.b > 0)
    assert kept.column("a") == [3]  # 2^62 * 2 wraps to a negative number
    assert "Python" not in kept.df._jdf.queryExecution().toString()
    assert grid.filter(lambda r: r.a).warnings == ("W101",) and grid.filter(lambda r: r.a).length() == 3
    assert grid.filter(lambda r: (r.t == "x") | ~r["a"]).column("t") == ["x", "z"]
    assert grid.filter(lambda r: 1 + r.b % 2 == 2).column("b") == [5, 7]
    assert grid.filter(lambda r: r.a / 2 < 0.5).column("a") == [-1, 0]
    assert grid.trace(lambda r: r.a * r.b > 0).tree() == (">", ("*", "bigint", "bigint"), "bigint")
    with pytest.raises(TypeError, match="choose"):
        grid.filter(lambda r: r.a > 0 and r.b > 0)
    for bad in (lambda r: r.none, lambda r: r.t % 2, lambda r: r.t < 1, lambda r: r.t - 1):
        with pytest.raises(GridError):
            grid.filter(bad)


def test_traced_closures_and_recursion(spark):
    """Free names, defaults and recursion are Python's own; what they leave is an expression."""
    limit = 4

    def power(x, n=3):
        return x * power(x, n - 1) if n else expression(1)

    grid = Grid.table(spark, a=[1, 2, 3])
    assert grid.filter(lambda r: power(r.a) > limit).column("a") == [2, 3]
    assert grid.compute(c=lambda r: power(r.a)).column("c") == [1, 8, 27]


def test_vectors_in_traces(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [10, 20]), (1, [], [1])], "i long, v array<bigint>, w array<int>")
    grid = Grid.scan(df, "i").compute(s=lambda r: r.v + r.w, d=lambda r: r.v * 2, e=lambda r: r.v == 2, n=lambda r: -r.v, o=lambda r: ~r.v)
    first, second = grid.rows()
    assert (first["s"], first["d"], first["e"], first["n"], first["o"]) == ([11, 22, 13], [2, 4, 6], [False, True, False], [-1, -2, -3], [False] * 3)
    assert second["s"] == second["d"] == []
    assert Grid.scan(df, "i").filter(lambda r: r.v).length() == 1
    assert Grid.scan(df, "i").head(1).compute(x=lambda r: r.v[-1] + r.w[0]).column("x") == [13]


def test_functions_over_lists(spark):
    df = spark.createDataFrame([([3, 1, 2, 0],)], "v array<bigint>")
    v, kind = F.col("v"), "bigint"
    row = df.select(
        folds.filter_list(v, lambda x: x, kind).alias("a"), folds.filter_list(v, lambda x: x % 2 == 1, kind).alias("b"), folds.map_list(v, lambda x: x * x - 1, kind).alias("c"),
        folds.sort_list_by(v, lambda x, y: x > y, kind).alias("d"), folds.reduce_list_by(v, lambda x, y: x * 10 + y, kind).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ([3, 1, 2], [3, 1], [8, 0, 3, -1], [3, 2, 1, 0], 3120)
    with pytest.raises(GridError):
        folds.reduce_list_by(v, lambda x, y: x > y, kind)


def test_unique_lists_of_floats_and_cells(spark):
    row = spark.range(1).select(
        folds.unique_list(F.array(F.lit(0.0), F.lit(-0.0), F.lit(1.0)), "array<double>").alias("a"),
        folds.duplicated_list(F.array(F.lit(0.0), F.lit(-0.0)), "array<double>").alias("b"),
        F.transform(folds.unique_list(F.array(*(cells.from_literals(F.lit(cells.literal(x))) for x in (1, "1", 1.0, True))), "array<variant>"), cells.kind_of).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ([0.0, 1.0], [False, True], ["int", "string", "bool"])


def test_warnings_are_counted_with_the_rows(spark):
    watch = Watch()
    grid = Grid.table(spark, a=[1 << 62, 1, -(1 << 63)], b=[2, 2, 1]).compute(watch, p=lambda r: r.a * r.b, q=lambda r: choose(r.b == 1, -r.a, r.a))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("watched", "one pass")
    grid.df.write.format("noop").mode("overwrite").save()
    jobs = len(tracker.getJobIdsForGroup("watched"))
    assert watch.counts() == {"W102": 2}
    assert len(tracker.getJobIdsForGroup("watched")) == jobs  # no job for the count
    assert grid.column("p") == [-(1 << 63), 2, -(1 << 63)]
    sorted_twice = Watch()
    Grid.table(spark, a=[1 << 62, 1, 2, 1]).compute(sorted_twice, p=lambda r: r.a * 2).column("p")
    assert sorted_twice.shares() == {"W102": 0.25}
    assert as_grid(spark, [[1], 2, "x", (3,)], "n").warnings == ("W314", "W314")


def test_conversions_refuse_what_does_not_fit(spark):
    one = lambda sql: spark.sql(f"SELECT {sql} AS v")
    for sql, to, kind in (("'9223372036854775808'", V.to_int, "string"), ("'1e400'", V.to_float, "string"), ("double('NaN')", V.to_int, "double"), ("9.3e18D", V.to_int, "double"), ("' 1'", V.to_int, "string")):
        with pytest.raises(Exception, match="E106"):
            one(sql).select(to(F.col("v"), kind)).collect()
    assert one("'-9223372036854775808'").select(V.to_int(F.col("v"), "string")).first()[0] == -(1 << 63)
    assert one("-2.9D").select(V.to_int(F.col("v"), "double")).first()[0] == -2
    assert one("true").select(V.to_float(F.col("v"), "boolean")).first()[0] == 1.0
    big = spark.sql("SELECT 9007199254740992 AS a, 9007199254740993 AS b")
    assert not big.select(V.equals(F.col("a"), F.col("b"), ("bigint", "bigint"))).first()[0]
    with pytest.raises(GridError, match="E106"):
        V.number_range((1 << 63) - 3, (1 << 63) - 1, 2 * 5)
    assert V.number_range((1 << 63) - 3, (1 << 63) - 2) == [(1 << 63) - 3]
    with pytest.raises(GridError, match="E106"):
        V.number_range(0.0, float("inf"), 1.0)


def test_rows_name_their_columns():
    with pytest.raises(GridError, match="unknown column"):
        Row({"a": "bigint"}).b
