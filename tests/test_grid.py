"""Table algebra: the identity cases first, then order, errors and properties."""

import pytest
from pyspark.sql import functions as F

from gridweave.functions.positions import POS, densify, position_by
from gridweave.functions.values import GridError
from gridweave.operators.grid import Grid


@pytest.fixture
def grid(spark):
    one = lambda **c: Grid.table(spark, **c)
    return one(x=[1, 2, 3, 1, 2, 3]).product(one(y=["a", "a", "b", "b"])).product(one(z=["x", "y"]))


def test_projection_goes_by_source_rows(grid):
    assert grid.length() == 48
    assert [grid.project(*c).length() for c in (("x",), ("y",), ("z",), ("y", "z"))] == [6, 4, 2, 8]
    assert grid.project("x").column("x") == [1, 2, 3, 1, 2, 3]
    assert grid.project("y", "z").project("z").length() == 2  # idempotent in steps


def test_projection_of_a_cyclic_table(spark):
    table = Grid.table(spark, x=[1], y=["a", "b"])
    assert (table.length(), table.project("x").length(), table.project("y").length()) == (2, 1, 2)


def test_rbind_keeps_arguments_apart(spark, grid):
    other = Grid.table(spark, x=[1, 2, 3, 1, 2, 3]).product(Grid.table(spark, y=["a", "a", "b", "b"])).product(Grid.table(spark, z=["x", "y"]))
    both = Grid.rbind(grid, other)
    assert (both.project("y", "z").length(), both.project("x").length()) == (16, 12)
    same = Grid.rbind(grid, grid)
    assert (same.project("y", "z").length(), same.project("z").length()) == (16, 4)


def test_rows_round_trip_makes_new_sources(spark, grid):
    again = Grid.from_rows(spark, grid.rows())
    assert [again.project(c).length() for c in ("x", "y", "z")] == [48] * 3


def test_gather_and_mask_keep_sources(grid):
    twice = grid.gather([0, 0])
    assert (twice.length(), twice.project("x").length()) == (2, 1)
    half = grid.mask([True, False])
    assert (half.length(), half.project("z").length()) == (24, 1)
    assert grid.mask([]).length() == 0
    with pytest.raises(GridError):
        grid.gather([48])


def test_product_is_left_major(spark):
    rows = Grid.table(spark, a=[1, 2]).product(Grid.table(spark, b=["x", "y"])).rows()
    assert rows == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    assert Grid.table(spark, a=[1]).product(Grid.table(spark, b=[])).length() == 0


def test_shared_columns_agree_or_fail(spark):
    left, right = Grid.table(spark, a=[1], b=[2]), Grid.table(spark, a=[1], c=[3])
    assert left.product(right).rows() == [{"a": 1, "b": 2, "c": 3}]
    clash = left.product(Grid.table(spark, a=[9], c=[3]))
    with pytest.raises(Exception, match="E042"):
        clash.rows()
    with pytest.raises(Exception, match="E042"):
        clash.project("c").rows()  # pruning doesn't lose the check


def test_merge_repeats_the_shorter(spark):
    a, b = Grid.table(spark, a=[1, 2, 3, 4]), Grid.table(spark, b=["x", "y"])
    assert a.merge(b).column("b") == ["x", "y", "x", "y"]
    assert a.merge(b).warnings == ()
    assert a.merge(Grid.table(spark, b=["x", "y", "z"])).warnings == ("W101",)
    assert a.merge(Grid.table(spark, b=[])).length() == 0
    assert a.merge(Grid.table(spark, b=[5, 6, 7, 8])).column("b") == [5, 6, 7, 8]


def test_rbind_follows_the_first_tables_columns(spark):
    a = Grid.from_rows(spark, [{"id": 1, "label": "a"}, {"id": 2, "label": "b"}])
    b = Grid.from_rows(spark, [{"label": "c", "id": 3}])
    assert Grid.rbind(a, b).rows() == [{"id": 1, "label": "a"}, {"id": 2, "label": "b"}, {"id": 3, "label": "c"}]
    assert Grid.rbind(Grid.rbind(a, b), a).rows() == Grid.rbind(a, Grid.rbind(b, a)).rows()
    with pytest.raises(GridError):
        Grid.rbind(a, Grid.table(spark, id=[1]))


def test_unique_is_the_mask_of_first_rows(spark):
    t = Grid.from_rows(spark, [{"id": i, "label": x} for i, x in ((1, "a"), (2, "b"), (1, "a"))])
    assert t.unique().rows() == t.rows()[:2]
    flags = [r.duplicated for r in t.duplicated().orderBy(POS).collect()]
    assert flags == [False, False, True]
    assert t.mask([not f for f in flags]).rows() == t.unique().rows()
    assert Grid.table(spark, v=[0.0, -0.0, 1.0]).unique().length() == 2


def test_rename_head_tail_order_sample(spark):
    t = Grid.table(spark, a=[3, 1, 2, 1], b=["p", "q", "r", "s"])
    assert t.rename(a="b", b="a").rows()[0] == {"b": 3, "a": "p"}
    with pytest.raises(GridError):
        t.rename(a="b")
    assert t.head(2).column("a") == [3, 1] and t.tail(2).column("b") == ["r", "s"]
    assert t.filter(F.col("a") < 3).head(2).column("b") == ["q", "r"]
    assert t.order("a").column("b") == ["q", "s", "r", "p"]
    assert t.order(F.col("a") * -1).column("b") == ["p", "r", "q", "s"]
    drawn = t.sample(3, seed=1)
    assert drawn.rows() == t.sample(3, seed=1).rows() and drawn.length() == 3 and drawn.project("a").length() == 3
    assert t.sample(9, replace_rows=True, seed=1).length() == 9
    with pytest.raises(GridError):
        t.sample(5)
    assert t.filter(F.lit(None).cast("boolean")).length() == 0


def test_names_are_checked(spark):
    with pytest.raises(GridError):
        Grid.table(spark, **{"a b": [1]})
    with pytest.raises(GridError):
        Grid.table(spark, a=[1, object()])
    with pytest.raises(GridError):
        Grid.table(spark, a=[], b=[1])
    assert Grid.table(spark, a=[1, 2, 3], b=[1, 2]).warnings == ("W101",)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_positions_are_dense(spark, block):
    sparse = spark.range(50).select((F.col("id") * 7 + 3).alias(POS)).repartition(5)
    assert sorted(map(tuple, densify(sparse.withColumn("v", F.col(POS)), block).select("v", POS).collect())) == [(i * 7 + 3, i) for i in range(50)]
    rows = spark.range(500).select(F.col("id").alias(POS), (F.col("id") % 3).alias("k"))
    ranked = [r.k for r in position_by(rows, [F.col("k")], 4).orderBy(POS).collect()]
    assert ranked == sorted(ranked) and len(ranked) == 500
