"""Workplans, status roll-ups, streaming extraction and the entry point."""

import importlib
import os
from itertools import product

import pytest

from gridweave.functions.values import GridError
from gridweave.operators.grid import Grid
from gridweave.plans import status, workplan
from gridweave.plans.workplan import Import, Step
from gridweave.sources import sinks
from gridweave.streaming.files import stream_rows


@pytest.fixture
def grid(spark):
    one = lambda **c: Grid.table(spark, **c)
    return one(x=[1, 2, 3, 1, 2, 3]).product(one(y=["a", "a", "b", "b"])).product(one(z=["x", "y"]))


def test_lineage_restricts_a_second_import(grid):
    plan = workplan.build([Step("s0", (Import("g", grid, ("x",)),)), Step("s1", (Import("g", grid, ("y",)),), ("s0",))])
    s0, s1 = (workplan.drawn(plan, n, "g").orderBy("row").collect() for n in ("s0", "s1"))
    assert [r.positions for r in s0] == [8] * 6
    assert len(s1) == 24 and {r.positions for r in s1} == {2} and [r.row for r in s1] == list(range(24))
    assert [r.row for r in plan.states["s1"].orderBy("row").collect()] == list(range(24))


def test_parameter_table(spark):
    p0 = Grid.table(spark, a=list(range(6)), b=["a", "b", "c"]).product(Grid.table(spark, c=["x", "y"]))
    plan = workplan.build([Step("step0", (Import("p0", p0, ("a", "b")),)), Step("step1", (Import("p0", p0, ("c",)),), ("step0",))])
    rows = workplan.parameters(plan).collect()
    assert sorted(r.step for r in rows) == ["step0"] * 6 + ["step1"] * 12
    assert [(r["p0.a"], r["p0.c"]) for r in sorted((r for r in rows if r.step == "step1"), key=lambda r: r.row)][:3] == [("0", "x"), ("0", "y"), ("1", "x")]


def test_limit_and_selection(grid):
    plan = workplan.build([Step("s0", (Import("g", grid, ("x",)),)), Step("s1", (Import("g", grid, ("y",)),), ("s0",)), Step("s2", (Import("h", grid, ("z",)),))])
    kept = workplan.limited_parents(plan, "s1", 5)
    assert (kept["s1"].count(), sorted(r.row for r in kept["s0"].collect())) == (5, [0, 1])
    assert workplan.ancestors(plan, ["s1"]) == {"s0", "s1"} and workplan.ancestors(plan, ["*"]) == {"s0", "s1", "s2"}
    assert workplan.terminal(plan) == ["s1", "s2"]


def test_several_parents_and_imports(spark):
    a, b, c = (Grid.table(spark, **{n: [1, 2]}) for n in "abc")
    plan = workplan.build([Step("p", (Import("a", a),)), Step("q", (Import("b", b),)), Step("r", (Import("c", c),), ("p", "q"))])
    assert [(r.a, r.b, r.c) for r in plan.states["r"].orderBy("row").collect()] == [(i, j, k) for i in (1, 2) for j in (1, 2) for k in (1, 2)]
    diamond = workplan.build([Step("p", (Import("a", a),)), Step("q", (), ("p",)), Step("r", (), ("p",)), Step("s", (), ("q", "r"))])
    with pytest.raises(Exception, match="E500"):
        diamond.states["s"].collect()


def test_parents_that_draw_differently_from_one_source_still_meet(spark):
    source = Grid.from_rows(spark, [{"a": i, "b": f"b{i}", "c": -i} for i in range(3)])
    parents = [Step("p", (Import("g", source, ("a",)),)), Step("q", (Import("g", source, ("b",)),))]
    plan = workplan.build([*parents, Step("child", (), ("p", "q")), Step("again", (Import("g", source, ("c",)),), ("child",))])
    met = plan.states["child"].orderBy("row").collect()
    assert [(r.a, r.b) for r in met] == [(i, f"b{j}") for i in range(3) for j in range(3)]
    assert sorted((r.a, r.b, r.c) for r in plan.states["again"].collect()) == [(i, f"b{i}", -i) for i in range(3)]


def test_imports_of_one_step_meet_freely(spark):
    source = Grid.from_rows(spark, [{"a": i, "b": f"b{i}", "c": -i} for i in range(3)])
    plan = workplan.build([Step("s", (Import("g", source, ("a",)), Import("g", source, ("b",)))), Step("t", (Import("g", source, ("c",)),), ("s",))])
    assert plan.states["s"].count() == 9
    assert sorted(r.positions for r in workplan.drawn(plan, "s", "g").collect()) == [0] * 6 + [1] * 3
    assert sorted((r.a, r.b, r.c) for r in plan.states["t"].collect()) == [(i, f"b{i}", -i) for i in range(3)]


def brute_lineage(sizes, picks):
    """Rows of a chain of steps, each of which projects a grid of so many values a column to its picks: by positions."""
    positions = list(product(*map(range, sizes)))
    states = [((), set(positions))]
    for columns in picks:
        states = [
            ((*shown, *key), left)
            for shown, held in states
            for key in dict.fromkeys(tuple(p[c] for c in columns) for p in positions)
            if (left := {p for p in held if tuple(p[c] for c in columns) == key})
        ]
    return [(shown, len(held)) for shown, held in states]


@pytest.mark.parametrize("most", [1 << 62, 100])
def test_chains_of_imports_by_brute_force(spark, monkeypatch, most):
    """Sets over more than one word, with numbers that run out and are given anew, and with ones that don't."""
    monkeypatch.setattr(workplan, "MOST_SETS", most)
    one = lambda **c: Grid.table(spark, **c)
    grid = one(a=list(range(3))).product(one(b=list(range(5)))).product(one(c=list(range(4)))).product(one(d=[0, 1]))
    picks = [("a",), ("c", "d"), ("b",)]
    steps = [Step(f"s{k}", (Import("g", grid, p),), (f"s{k - 1}",) if k else ()) for k, p in enumerate(picks)]
    plan = workplan.build(steps)
    for k in range(len(picks)):
        shown = [c for p in picks[: k + 1] for c in p]
        found = plan.states[f"s{k}"].join(workplan.drawn(plan, f"s{k}", "g"), "row").orderBy("row").collect()
        assert [(tuple(r[c] for c in shown), r.positions) for r in found] == brute_lineage((3, 5, 4, 2), [["abcd".index(c) for c in p] for p in picks[: k + 1]])


@pytest.mark.parametrize("most", [1 << 62, 100])
def test_chains_of_imports_of_a_grid_that_is_no_product(spark, monkeypatch, most):
    """A filter forgets that a grid was a product, so its sets have words; their numbers, and those of met parents, are given anew."""
    monkeypatch.setattr(workplan, "MOST_SETS", most)
    one = lambda **c: Grid.table(spark, **c)
    grid = one(a=list(range(3))).product(one(b=list(range(5)))).product(one(c=list(range(4)))).product(one(d=[0, 1])).filter(lambda r: r.a >= 0)
    assert grid.factors is None
    picks = [("a",), ("c", "d"), ("b",)]
    plan = workplan.build([Step(f"s{k}", (Import("g", grid, p),), (f"s{k - 1}",) if k else ()) for k, p in enumerate(picks)])
    shown = [c for p in picks for c in p]
    found = workplan.with_drawn(plan, "s2", "g").orderBy("row").collect()
    assert [(tuple(r[c] for c in shown), r.positions) for r in found] == brute_lineage((3, 5, 4, 2), [["abcd".index(c) for c in p] for p in picks])
    parents = [Step("p", (Import("g", grid, ("a",)),)), Step("q", (Import("g", grid, ("c", "d")),)), Step("r", (Import("g", grid, ("b",)),))]
    plan = workplan.build([*parents, Step("child", (), ("p", "q", "r"))])
    met = workplan.with_drawn(plan, "child", "g").orderBy("row").collect()
    assert [(r.a, r.c, r.d, r.b, r.positions) for r in met] == [(a, c, d, b, 1) for a in range(3) for c in range(4) for d in (0, 1) for b in range(5)]


def test_projections_of_a_product_make_no_table_of_positions(spark, monkeypatch):
    """Lineage goes by the rows of the factors: nothing is written, no position is a row, and what all agree on is joined."""
    def refused(*_):
        raise AssertionError("positions became rows")

    monkeypatch.setattr(workplan, "settled", refused)
    monkeypatch.setattr(workplan, "_words", refused)
    grid = Grid.table(spark, k=["a", "b"]).product(Grid.ordered(spark.range(100).selectExpr("id AS v", "id % 7 AS w"), "v")).product(Grid.table(spark, z=[1, 2, 3]))
    plan = workplan.build([Step("s0", (Import("g", grid, ("k", "z")),)), Step("s1", (Import("g", grid, ("z", "v", "k")),), ("s0",)), Step("s2", (Import("g", grid, ("w",)),), ("s1",))])
    for name in ("s1", "s2"):
        found = workplan.with_drawn(plan, name, "g").orderBy("row").collect()
        assert [(r.k, r.z, r.v, r.row, r.positions) for r in found] == [(k, z, v, i, 1) for i, (k, z, v) in enumerate(product("ab", (1, 2, 3), range(100)))]
    assert {r.w - r.v % 7 for r in found} == {0} and plan.sizes["s2"]() == 600
    assert {r.positions for r in workplan.drawn(plan, "s0", "g").collect()} == {100}


def test_parents_that_share_factors_meet_where_their_rows_agree(spark):
    one = lambda **c: Grid.table(spark, **c)
    grid = one(a=[0, 1]).product(one(b=[0, 1, 2])).product(one(c=[0, 1])).product(one(d=[0, 1]))
    other = grid.filter(lambda r: r.a >= 0)
    for second in (grid, other):  # by rows of factors, and by words against them
        parents = [Step("p", (Import("g", grid, ("a", "b"), None),)), Step("q", (Import("g", grid.rename(b="e"), ("c",)), Import("g", second.rename(b="e"), ("e",))))]
        plan = workplan.build([*parents, Step("child", (), ("p", "q")), Step("again", (Import("g", second, ("d",)),), ("child",))])
        met = workplan.with_drawn(plan, "child", "g").orderBy("row").collect()
        assert [(r.a, r.b, r.c, r.e, r.positions) for r in met] == [(a, b, c, e, 2 * (b == e)) for a in (0, 1) for b in range(3) for c in (0, 1) for e in range(3)]
        again = workplan.with_drawn(plan, "again", "g").orderBy("row").collect()
        assert [(r.a, r.b, r.c, r.e, r.d, r.row, r.positions) for r in again] == [(*x, d, i, 1) for i, (x, d) in enumerate(product([(a, b, c, b) for a in (0, 1) for b in range(3) for c in (0, 1)], (0, 1)))]


def test_lineage_rows_have_a_fixed_size(spark):
    """A choice that most of a source shares holds no list of positions anywhere in the plan."""
    grid = Grid.table(spark, k=["a", "b"]).product(Grid.scan(spark.range(20000).toDF("v"), "v"))
    plan = workplan.build([Step("s0", (Import("g", grid, ("k",)),)), Step("s1", (Import("g", grid, ("v",)),), ("s0",))])
    assert "collect_" not in plan.states["s0"]._jdf.queryExecution().toString()
    assert not [t for n in ("s0", "s1") for df in (plan.states[n], plan.sets[n]["g"].words) for _, t in df.dtypes if t.startswith(("array", "binary"))]
    assert {r.positions for r in workplan.drawn(plan, "s0", "g").collect()} == {20000} and plan.states["s1"].count() == 40000


def test_aliases(spark):
    source = Grid.from_rows(spark, [{"a": i, "b": f"b{i}"} for i in range(3)])
    steps = [Step("p", (Import("g", source, ("a",), "x"),)), Step("q", (Import("g", source, ("a",), "x"), Import("g", source, ("b",))), ("p",))]
    plan = workplan.build(steps)
    assert sorted((r.x, r.b) for r in plan.states["q"].collect()) == [(i, f"b{i}") for i in range(3)]
    assert set(workplan.parameters(plan).columns) == {"g.a", "g.b", "row", "step"}
    swapped = workplan.build([Step("s", (Import("g", source, ("a",), "b"), Import("g", source, ("b",), "a")))])
    assert sorted((r.a, r.b) for r in swapped.states["s"].collect()) == [(f"b{j}", i) for j in range(3) for i in range(3)]
    for imports, code in (
        ((Import("g", source, ("a", "b"), "x"),), "E023"), ((Import("g", source, ("c",)),), "E021"), ((Import("g", source, ("a",), "no name"),), "E106"),
        ((Import("g", source, ("a",), "b"), Import("g", source, ("b",))), "E214"),
    ):
        with pytest.raises(GridError, match=code):
            workplan.build([Step("s", imports)])


def test_parents_may_not_show_two_things_under_one_name(spark):
    one, two = Grid.table(spark, a=[1]), Grid.table(spark, a=[1])
    with pytest.raises(GridError, match="E214"):
        workplan.build([Step("p", (Import("one", one),)), Step("q", (Import("two", two),)), Step("r", (), ("p", "q"))])


def test_selection_of_steps_and_analyses(spark):
    a = Grid.table(spark, a=[1])
    plan = workplan.build([Step("p", (Import("a", a),)), Step("q", (), ("p",)), Step("r", (Import("a", a),))], {"of_q": "q", "of_p": "p"})
    assert workplan.selected(plan) == (["p", "q", "r"], ["of_q", "of_p"])
    assert workplan.selected(plan, ["q"]) == (["p", "q"], [])
    assert workplan.selected(plan, ["of_p", "r"]) == (["p", "r"], ["of_p"])
    assert workplan.limit_targets(plan) == ["p", "q"] and workplan.limit_targets(workplan.build([Step("p", (Import("a", a),))])) == ["p"]
    with pytest.raises(GridError, match="E212"):
        workplan.selected(plan, ["no"])
    with pytest.raises(GridError, match="E410"):
        workplan.build([Step("p", (Import("a", a),))], {"x": "no"})


def test_values_become_grids(spark):
    assert workplan.as_grid(spark, 3, "n").rows() == [{"n": 3}]
    assert workplan.as_grid(spark, [[1, 2], "x"], "n").rows() == [{"n": "[1,2]"}, {"n": "x"}]
    assert workplan.as_grid(spark, {"a": [1, 2], "b": "x"}).rows() == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    for bad in (None, len):
        with pytest.raises(GridError, match="E420"):
            workplan.as_grid(spark, bad)
    with pytest.raises(GridError, match="E219"):
        workplan.build([Step("s", (Import("g", workplan.as_grid(spark, 1)),), nproc=-1)])


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"run_id": "000001", "steps": [{"name": "s0"}], "work": [{"step": "s0", "row": 0, "values": {"a": "1"}}, {"step": "s0", "row": 1, "values": {"a": "2"}}]}')
    assert [(r.run_id, r.step, r.row, r["values"]) for r in status.read_manifest(spark, str(tmp_path)).orderBy("row").collect()] == [("000001", "s0", 0, {"a": "1"}), ("000001", "s0", 1, {"a": "2"})]


def test_plan_errors(spark):
    a = Grid.table(spark, a=[1])
    for steps, code in (
        ([Step("p"), Step("p")], "E211"), ([Step("p", (), ("q",))], "E212"), ([Step("p", (), ("q",)), Step("q", (), ("p",))], "E213"),
        ([Step("p", (Import("a", a), Import("b", a)))], "E214"), ([Step("p")], "E420"),
    ):
        with pytest.raises(GridError, match=code):
            workplan.build(steps)


def test_status(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"status": "ERROR", "step": "s", "row": 1, "duration": 2.5}')
    (tmp_path / "v.json").write_text('{"status": "FINISHED", "step": "t", "row": 0}')
    records = status.read_status(spark, str(tmp_path))
    rows = {r.step: r for r in status.pivot(records).collect()}
    assert (rows["s"].error, rows["t"].finished, rows[None].total, rows[None].duration) == (1, 1, 2, 2.5)
    assert status.final_status(records).first().status == "ERROR"
    assert status.final_status(records.limit(0)).first().status == "FINISHED"
    assert {(r.step, r.status) for r in status.final_status(records, "step").collect()} == {("s", "ERROR"), ("t", "FINISHED")}


def test_text_files_are_shared_by_many_tasks_and_lie_as_spark_lays_them(spark, tmp_path, monkeypatch):
    """One partition of many rows isn't one task that writes all files; names, odd ones too, and texts are Spark's."""
    monkeypatch.setattr(sinks, "TASK_FILES", 4)
    odd = ["a/b", "50%", "x=y", "ä {b", "", None, "#", "'q'", 'w"', "[", "]", "^", "?", "*", ":", "\\", "\t", "}"]
    rows = [(n, f"text of {n}\nsecond") for n in odd if n] + [(None, "nobody"), ("empty", ""), ("null", None)] + [(str(i), f"v{i} ü") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, body string").coalesce(1)
    group = str(tmp_path)
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "stale.txt").write_text("of an earlier run")
    spark.sparkContext.setJobGroup(group, "")
    sinks.write_texts(df, f"file://{tmp_path}/mine", "id", "body")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    tasks = [tracker.getStageInfo(k).numTasks for j in tracker.getJobIdsForGroup(group) for k in tracker.getJobInfo(j).stageIds]
    assert max(tasks) == len(rows) // 4 + 1
    df.select(df.id.alias("run"), df.body.alias("value")).write.partitionBy("run").text(f"file://{tmp_path}/theirs")
    held = lambda name: {f.parent.relative_to(tmp_path / name): f.read_bytes() for f in (tmp_path / name).rglob("*.txt")}
    assert held("mine") == held("theirs") and len(held("mine")) == len(rows)
    assert {f.name[:5] for f in (tmp_path / "mine").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))} == {"part-"}


def test_streamed_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("v=1 v=2")
    query = stream_rows(spark, str(folder), {"v": "v=%d"}).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        (folder / "b.txt").write_text("v=3")
        query.processAllAvailable()
        assert sorted(r.v for r in spark.table("seen").collect()) == [1, 2, 3]
    finally:
        query.stop()


def test_entry_names_and_columns(spark):
    entry = importlib.import_module("__spark_entry__")
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "extract_url" in queries
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).count() > 0


def test_catalogue_against_duckdb(spark):
    duckdb = pytest.importorskip("duckdb")
    from gridweave.queries import ORACLE_SQL, QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    db = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name, text in ORACLE_SQL.items():
        df = QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        result = db.execute(text)
        at = [[d[0] for d in result.description].index(c) for c in columns]
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=repr), name
