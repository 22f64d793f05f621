"""Types from data, substitution by spans, publication, draws, blocked work, delimited files."""

import random

import pytest
from pyspark.sql import functions as F

from gridweave.functions.draws import Seeds, draw
from gridweave.functions.values import GridError
from gridweave.operators.extract import analyse, extract, merged_type, substitute
from gridweave.operators.grid import Grid
from gridweave.plans import frontier, workplan, worktypes
from gridweave.plans.workplan import Import, Step
from gridweave.sources.publish import _Folder, prune, publish, published
from gridweave.sources.tables import delimiter, exact_files, read_csv


# Types of work values ---------------------------------------------------------------------------------------------


def test_values_get_the_types_of_their_rows(spark):
    rows = [("s", 0, {"i": "1", "f": "1", "b": "true", "t": "x", "big": "9223372036854775808"}), ("s", 1, {"i": "-7", "f": "2.5", "b": "false", "t": "1", "m": "true"}), ("s", 2, {"m": "1"}), ("o", 0, {"i": "x"})]
    work = spark.createDataFrame([("r", *r) for r in rows], "run_id string, step string, row long, values map<string,string>")
    tables = worktypes.typed_steps(work)
    assert set(tables) == {"s", "o"} and dict(tables["o"].dtypes)["i"] == "string"
    assert tables["s"].dtypes == [("run_id", "string"), ("row", "bigint"), ("b", "boolean"), ("big", "double"), ("f", "double"), ("i", "bigint"), ("m", "string"), ("t", "string")]
    first, second, third = (r.asDict() for r in tables["s"].orderBy("row").collect())
    assert (first["i"], first["f"], first["b"], first["m"]) == (1, 1.0, True, None) and second["f"] == 2.5 and third["m"] == "1" and third["i"] is None
    kinds = worktypes.value_kinds(work)
    assert worktypes.type_over_steps(kinds, "i") == merged_type(["bigint", "string"]) == "string"
    with pytest.raises(GridError, match="E413"):
        worktypes.typed(work, [("row", "bigint")])


def test_cells_give_their_own_types(spark):
    text = spark.createDataFrame([("s", 0, "1", "1"), ("s", 1, "2.5e0", '"1"')], "step string, row long, a string, b string")
    work = text.select("step", "row", F.create_map(F.lit("a"), F.parse_json("a"), F.lit("b"), F.parse_json("b")).alias("values"))
    table = worktypes.typed_steps(work, ["row"])["s"]
    assert table.dtypes[1:] == [("a", "double"), ("b", "string")]
    assert [(r.a, r.b) for r in table.orderBy("row").collect()] == [(1.0, "1"), (2.5, "1")]


# Substitution by spans --------------------------------------------------------------------------------------------


def spans(spark, text, pattern, *values):
    return spark.createDataFrame([(text,)], "t string").select(substitute(F.col("t"), pattern, *map(F.lit, values))).first()[0]


def test_groups_are_replaced_where_they_stand(spark):
    assert spans(spark, "x = 1, y = old", "x = ([0-9]+), y = ([A-Za-z]+)", "42", "new") == "x = 42, y = new"
    assert spans(spark, "k=1 k=23", "(?:k=([0-9]+) ?)+", "v") == "k=1 k=v"  # of a repeated group the last place
    assert spans(spark, "Été=ß;", r"(?:(\S+)=(\S));", "l", "r") == "l=r;"
    assert spans(spark, "aXb", "(?i)(?:(x))", "y") == "ayb"


def test_groups_that_overlap_or_are_missing_are_errors(spark):
    for text, pattern, values, said in (
        ("ab", "(a(b))", ("x", "y"), "overlap"), ("b", "(a)?b", ("x",), "without group 1"), ("b", "(?:(a)|b)", ("x",), "without group 1"), ("zz", "(?:(a))?b", ("x",), "no match"),
    ):
        with pytest.raises(Exception, match=said):
            spans(spark, text, pattern, *values)
    with pytest.raises(GridError, match="2 values are needed"):
        spans(spark, "x=1A", "x=([0-9]+)([A-Z]+)", "1")


def test_spans_keep_built_in_functions_for_plain_patterns(spark):
    plan = lambda pattern: spark.range(1).select(substitute(F.lit("a1"), pattern, F.lit("x")))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan("a([0-9])") and "ArrowEvalPython" in plan("(?:a([0-9]))+")


# Publication ------------------------------------------------------------------------------------------------------


def test_tables_become_visible_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    one, two = spark.range(3), spark.createDataFrame([("a", 1)], "k string, v int")
    assert publish({"one": one, "two": two}, root) == 1
    broken = spark.range(1).where(F.raise_error(F.lit("broken")).cast("boolean"))
    with pytest.raises(Exception, match="broken"):
        publish({"one": spark.range(99), "two": broken}, root)
    held = published(spark, root)
    assert set(held) == {"one", "two"} and held["one"].count() == 3 and held["two"].collect() == two.collect()
    assert publish({"three": one.limit(0)}, root, {"three": []}) == 2
    assert set(published(spark, root)) == {"three"} and published(spark, root)["three"].dtypes == [("id", "bigint")] and published(spark, root, 1)["one"].count() == 3
    assert prune(spark, root) == 1 and published(spark, root)["three"].count() == 0
    with pytest.raises(GridError):
        published(spark, root, 1)
    with pytest.raises(GridError, match="E413"):
        publish({"x": spark.range(1).select(F.lit(1).alias("a"), F.lit(1).alias("A"))}, root)


def test_a_second_writer_of_a_version_is_told(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/set"
    publish({"one": spark.range(1)}, root)
    monkeypatch.setattr(_Folder, "versions", lambda self: [])
    with pytest.raises(GridError, match="another writer"):
        publish({"one": spark.range(2)}, root)
    monkeypatch.undo()
    assert published(spark, root)["one"].count() == 1


# Draws ------------------------------------------------------------------------------------------------------------


def test_draws_are_even_and_repeat(spark):
    grid = Grid.scan(spark.range(10).select("id", (F.col("id") * 2).alias("v")), "id")
    big = grid.sample(200_000, replace_rows=True, seed=3)
    assert "LocalTableScan" not in big.df._jdf.queryExecution().toString()
    counts = {r.v: r["count"] for r in big.df.groupBy("v").count().collect()}
    assert len(counts) == 10 and all(abs(n - 20_000) < 5 * 20_000**0.5 for n in counts.values())
    assert big.head(50).rows() == grid.sample(50, replace_rows=True, seed=3).rows() != grid.sample(50, replace_rows=True, seed=4).rows()
    assert big.head(20).project("v").length() == 20  # a source of its own
    assert grid.sample(0, replace_rows=True).length() == 0 and grid.sample().length() == 10
    with pytest.raises(GridError):
        grid.filter(F.lit(False)).sample(1, replace_rows=True)


def test_rejection_leaves_no_bias(spark):
    n = (1 << 62) + (1 << 61)  # without rejection the lower third would come twice as often
    low = spark.range(20_000).select(draw(F.col("id"), n, 5).alias("x")).where(F.col("x") < (1 << 61)).count()
    assert abs(low / 20_000 - 1 / 3) < 0.02


def test_seeds_follow_each_other(spark):
    grid = Grid.scan(spark.range(100).select("id", F.col("id").alias("v")), "id")
    seeds = Seeds(1)
    first = [grid.sample(5, seed=seeds).column("v") for _ in range(3)]
    seeds.set(1)
    assert [grid.sample(5, seed=seeds).column("v") for _ in range(3)] == first and len({tuple(x) for x in first}) == 3


# Blocked and ready work -------------------------------------------------------------------------------------------


def test_blocking_spreads_like_brute_force(spark):
    """A diamond of three levels with products, records of all statuses, some of them missing."""
    one = lambda **c: Grid.table(spark, **c)
    steps = [Step("a", (Import("x", one(x=[1, 2, 3])),)), Step("b", (Import("y", one(y=[1, 2])),), ("a",)), Step("c", (Import("z", one(z=[1, 2])),)), Step("d", (), ("b", "c"))]
    plan = workplan.build(steps)
    pairs = {s: {p: [tuple(r) for r in df.collect()] for p, df in parents.items()} for s, parents in frontier.edges(plan).items()}
    draw_ = random.Random(4)
    for _ in range(3):
        statuses = {(s, r): draw_.choice(["NOTSTARTED", "NOTSTARTED", "INTERRUPTED", "FINISHED", "FINISHED", "FINISHED", "RUNNING", "ERROR", "BLOCKED"]) for s in plan.order for r in range({"a": 3, "b": 6, "c": 2, "d": 12}[s])}
        gone = draw_.choice(list(statuses))
        del statuses[gone]
        expected, ready = dict(statuses), {}
        for s in plan.order:
            for key in [k for k in expected if k[0] == s]:
                above = [expected.get((p, q)) for p, rows in pairs[s].items() for r, q in rows if r == key[1]]
                if expected[key] in frontier.OPEN and any(x in frontier.FAILED for x in above):
                    expected[key] = "BLOCKED"
                ready[key] = expected[key] in frontier.OPEN and all(x == "FINISHED" for x in above)
        records = spark.createDataFrame([(s, r, x) for (s, r), x in statuses.items()], "step string, row long, status string")
        found = frontier.resolved(records, frontier.edges(plan)).collect()
        assert {(r.step, r.row): (r.status, r.ready) for r in found} == {k: (x, ready[k]) for k, x in expected.items()}


# Sources ----------------------------------------------------------------------------------------------------------


def test_delimiters(spark, tmp_path):
    assert [delimiter(*x) for x in (("a.tsv", "x,y"), ("a.CSV", "x\ty"), ("a", "x\ty"), ("a", "x,y\tz"), ("a", "x;y"), ("a", None))] == ["\t", ",", "\t", ",", ",", ","]
    (tmp_path / "cases").write_text("\r\n\na\tb;c\n1\t2\n".replace("b;c", "b"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "cases")).collect()] == [(1, 2)]
    (tmp_path / "semi").write_text("a;b\n1;2\n")
    with pytest.raises(GridError, match="invalid column names"):
        read_csv(spark, str(tmp_path / "semi"))


def test_only_files_with_quoted_line_ends_are_read_as_a_whole(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a,b\n1,"x ""y"" z"\n2,"p, q"\n')
    (tmp_path / "lines.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    plain, lines = (read_csv(spark, str(tmp_path / n)) for n in ("plain.csv", "lines.csv"))
    assert [tuple(r) for r in plain.collect()] == [(1, 'x "y" z'), (2, "p, q")] and [tuple(r) for r in lines.collect()] == [(1, "x\ny"), (2, "z")]


def test_a_missing_file_is_an_error_whatever_is_selected(spark, tmp_path):
    (tmp_path / "r0").mkdir()
    (tmp_path / "r1").mkdir()
    (tmp_path / "r0" / "job.out").write_text("v=1")
    runs = spark.createDataFrame([("r0",), ("r1",)], "run_id string")
    with pytest.raises(Exception, match="E411"):
        exact_files(spark, str(tmp_path), runs, "job.out").select("run_id").collect()
    assert exact_files(spark, str(tmp_path), runs.limit(1), "job.out").count() == 1


def test_floats_that_overflow_are_no_captures(spark):
    with pytest.raises(Exception, match="not a double"):
        extract(spark.createDataFrame([("v=1e999",)], "text string"), {"v": "v=%f"}).collect()


def test_parameter_titles(spark):
    n, letters = workplan.as_grid(spark, 3.0, "n"), workplan.as_grid(spark, ["x", "y"], "letters")
    plan = workplan.build([Step("s", (Import("n", n), Import("letters", letters), Import("t", Grid.table(spark, t=[1]))))])
    rows = workplan.parameters(plan, benchmark="b").collect()
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.row)] == [("b", "3.0", "x", "1", 0, "s"), ("b", "3.0", "y", "1", 1, "s")]
    assert list(rows[0].asDict()) == ["benchmark", "n", "letters", "t.t", "row", "step"]
    none = workplan.build([Step("s", (Import("t", Grid.table(spark, t=[1])),)), Step("e", (Import("u", Grid.table(spark, u=[])),))])
    assert workplan.parameters(none).columns == ["t.t", "row", "step"]




def test_analyses_name_their_columns(spark):
    work = spark.createDataFrame([("r0", 7, "n=1 p=a-2 n=3")], "run_id string, v long, text string")
    helpers = [("n", "n=%d"), ("p", "p=([a-z])-%d"), ("unused", "(")]
    with pytest.raises(GridError):
        analyse(work, helpers, ["unused"])  # only then is it compiled
    rows = analyse(work, helpers, ["p", "v", "n"], ["v"]).orderBy("match_ix").collect()
    assert list(rows[0].asDict()) == ["run_id", "match_ix", "p.0", "p.1", "v", "n"] and [tuple(r) for r in rows] == [("r0", 0, "a", 2, 7, 1), ("r0", 1, None, None, 7, 3)]
    for args, code in ((([*helpers, ("n", "x%d")], ["n"]), "E414"), (([("v", "x%d")], ["v"], ["v"]), "E413"), ((helpers, ["w"]), "E415"), ((helpers, ["n", "n"]), "E413")):
        with pytest.raises(GridError, match=code):
            analyse(work, *args)


def test_rows_are_counted_once_or_not_at_all(spark):
    counted = []
    base = Grid.scan(spark.range(6).select("id", (F.col("id") % 2).alias("k")), "id")
    literal = Grid.table(spark, x=[1, 2, 3])
    spark.sparkContext.setJobGroup("lengths", "")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("lengths"))
    product = literal.product(Grid.table(spark, y=[1, 2])).rename(x="z")
    assert product.length() == 6 and product.merge(Grid.table(spark, w=[1])).length() == 6 and Grid.rbind(product, product).length() == 12 and jobs() == 0
    assert base.length() == 6 and base.project("k").length() == 6 and base.product(literal).length() == 18
    counted.append(jobs())
    assert base.filter(lambda r: r.k == 1).length() == 3 and base.order("k").length() == 6 and counted[0] <= 2


def test_rows_of_maps_become_a_grid(spark):
    rows = spark.range(40).select("id", F.expr("map('n', CAST(id AS STRING), 'half', CAST(IF(id % 2 = 0, id DIV 2, id / 2) AS STRING), 'yes', IF(id > 3, 'true', 'false'), 'a', IF(id = 7, 'x', '1'))").alias("row"))
    grid = worktypes.grid_of_maps(rows, "id", "row")
    assert grid.names == ("n", "half", "yes", "a") and grid.length() == 40
    assert grid.kinds == {"n": "bigint", "half": "double", "yes": "boolean", "a": "string"}
    assert grid.rows()[7] == {"n": 7, "half": 3.5, "yes": True, "a": "x"}
    assert grid.project("a").length() == 40  # one source, so equal values stay apart
    for uneven in ("IF(id = 5, map('n', '1'), row)", "IF(id = 5, CAST(NULL AS map<string, string>), row)"):
        with pytest.raises(GridError, match="same keys"):
            worktypes.grid_of_maps(rows.withColumn("row", F.expr(uneven)), "id", "row")
    with pytest.raises(GridError, match="invalid column"):
        worktypes.grid_of_maps(rows.withColumn("row", F.expr("map('1 x', 'v')")), "id", "row")
    empty = worktypes.grid_of_maps(rows.limit(0), "id", "row")
    assert empty.names == () and empty.length() == 0


def test_projection_keeps_first_rows_of_keys(spark):
    mixed = Grid.table(spark, a=["x", "x", "y"], f=[0.0, -0.0, 1.0]).product(Grid.table(spark, b=[1, 2]))
    for names, found in ((("a",), ["x", "x", "y"]), (("b",), [1, 2])):
        grid = mixed.project(*names)
        assert grid.column(names[0]) == found
        assert "Window" not in grid.df._jdf.queryExecution().optimizedPlan().toString()
    assert [str(v) for v in mixed.project("f").column("f")] == ["0.0", "-0.0", "1.0"]
    assert mixed.project("a", "b").length() == 6
