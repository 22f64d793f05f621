"""Values, patterns, extraction, sources and sinks."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridweave.functions import folds
from gridweave.functions import values as V
from gridweave.functions.patterns import compile_pattern
from gridweave.functions.values import GridError
from gridweave.operators.extract import extract, extract_strict, extract_weak, merged_type, substitute, substitution_count
from gridweave.sources.sinks import table_name, write_csv, write_sqlite, write_texts
from gridweave.sources.tables import exact_files, infer, read_csv, read_files, run_files

LONGS = [0, 1, -1, 2, -2, 2**31, -(2**31), 2**62, -(2**62), 2**63 - 1, -(2**63)]


def test_wrap_is_twos_complement(spark):
    pairs = spark.createDataFrame([(a, b) for a in LONGS for b in LONGS], "a long, b long")
    fold = lambda x: (x + 2**63) % 2**64 - 2**63
    for op, f in (("+", lambda a, b: a + b), ("-", lambda a, b: a - b), ("*", lambda a, b: a * b)):
        assert all(r.x == fold(f(r.a, r.b)) for r in pairs.select("a", "b", V.wrap(op, F.col("a"), F.col("b")).alias("x")).collect())


def test_conversions(spark):
    df = spark.createDataFrame([("12", "1e3"), ("-7", ".5")], "i string, f string")
    assert [tuple(r) for r in df.select(V.to_int(F.col("i"), "string"), V.to_float(F.col("f"), "string")).collect()] == [(12, 1000.0), (-7, 0.5)]
    for bad in (" 5", "1.0", "x", "1d", "9" * 30):
        row = spark.createDataFrame([(bad,)], "s string")
        with pytest.raises(Exception, match="E106|null") if bad != "9" * 30 else pytest.raises(Exception):
            assert row.select(V.to_int(F.col("s"), "string").alias("x")).first().x is not None
    assert spark.range(1).select(V.to_int(F.lit(-2.9), "double").alias("x")).first().x == -2


def test_vectors_repeat_the_shorter(spark):
    df = spark.createDataFrame([([1, 2, 3], [10, 20]), ([], [1])], "a array<bigint>, b array<bigint>")
    assert [r.x for r in df.select(V.cyclic(F.col("a"), F.col("b"), lambda x, y: x + y).alias("x")).collect()] == [[11, 22, 13], []]


def test_literals():
    assert V.text([1.0, "a", None, True]) == "[1.0,a,None,true]"
    assert V.equal(1, 1.0) and not V.equal(1, True) and not V.equal([1], (1,)) and not V.equal("1", 1)
    assert V.number_range(5) == [0, 1, 2, 3, 4] and V.number_range(3, 0) == [3, 2, 1] and V.number_range(0.0, 0.3, 0.1) == [0.0, 0.1, 0.2, 0.1 + 0.1 + 0.1][:3] + ([0.1 + 0.1 + 0.1] if 0.1 + 0.1 + 0.1 < 0.3 else [])
    with pytest.raises(GridError):
        V.number_range(0, 5, 0)


@settings(max_examples=50, deadline=None)
@given(st.integers(-50, 50), st.integers(-50, 50), st.integers(-5, 5).filter(bool))
def test_ranges_equal_pythons(a, b, step):
    assert V.number_range(a, b, step) == list(range(a, b, step))


def test_patterns():
    p = compile_pattern("a %d (?P<name>x+) [[:digit:]a-c] 100%% (?:n) %f")
    assert p.kinds == ("int", "string", "float") and "[0-9a-c]" in p.regex and "100%" in p.regex
    for bad in ("no group", "%q", r"(a)\1", "(?=x)(a)", "[[:nope:]](a)"):
        with pytest.raises(GridError):
            compile_pattern(bad)


def work(spark, *texts):
    return spark.createDataFrame([(f"{i:06}", t, "FINISHED") for i, t in enumerate(texts)], "run_id string, text string, status string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("run_id", "match_ix").collect()]


def test_extraction_cases(spark):
    assert rows(extract(work(spark, "Number: 42\n"), {"number": "Number: %d"}, ["run_id"]), "run_id", "number") == [("000000", 42)]
    both = extract(work(spark, "Number: 1\nLetter: a\nNumber: 2\n"), {"number": "Number: %d", "letter": "Letter: %w"}, ["run_id"])
    assert rows(both, "number", "letter") == [(1, "a"), (2, None)]
    pair = extract(work(spark, "Pair: AA-17\n"), {"pair": r"Pair: (\w+)-%d"}, ["run_id"])
    assert [(r["pair.0"], r["pair.1"]) for r in pair.collect()] == [("AA", 17)]
    assert extract(work(spark, "nothing", None), {"x": "(y+)"}, ["run_id"]).count() == 0
    assert extract(work(spark, "nothing"), {}, ["run_id"]).count() == 1
    assert rows(extract(work(spark, "ab:1"), {"n": "([[:digit:]]+)"}, ["run_id"]), "n") == [("1",)]
    with pytest.raises(Exception, match="not a int|not a bigint"):
        extract(work(spark, "n=99999999999999999999999"), {"n": "n=%d"}, ["run_id"]).collect()
    with pytest.raises(GridError):
        extract(work(spark, "x"), {"run_id": "(x)"}, ["run_id"])


def test_weak_and_strict_modes(spark):
    df = work(spark, "v=1", "v=2", "none").withColumn("status", F.when(F.col("run_id") == "000001", "ERROR").otherwise("FINISHED")).withColumn("p", F.lit(9))
    got = [(r.run_id, r.v, r.p, r.run_status) for r in extract_weak(df, {"v": "v=%d"}, "run_id", ["p"]).orderBy("run_id").collect()]
    assert got == [("000000", 1, 9, "FINISHED"), ("000001", None, None, "ERROR")]
    with pytest.raises(Exception, match="unfinished work"):
        extract_strict(df, {"v": "v=%d"}, "run_id").collect()


def test_type_merging_and_substitution(spark):
    assert (merged_type(["bigint", "double"]), merged_type(["bigint"]), merged_type(["bigint", "string"])) == ("double", "bigint", "string")
    df = spark.createDataFrame([("a.b a.b",)], "t string")
    assert df.select(substitute(F.col("t"), r"a\.b", F.lit(r"$0\x"))).first()[0] == r"$0\x $0\x"
    with pytest.raises(Exception, match="no match"):
        df.select(substitute(F.col("t"), "zzz", F.lit("y"))).collect()


def test_inference(spark):
    df = spark.createDataFrame(
        [("true", "1", "1", "true", "", " 1", "1e400"), ("FALSE", "-2", "2.5", "1", "3", "2", "1"), ("true", "3", "3e1", "1", "3", "2", "1")], "a string, b string, c string, d string, e string, f string, g string"
    )
    assert [t for _, t in infer(df).dtypes] == ["boolean", "bigint", "double", "string", "string", "string", "string"]
    assert {t for _, t in infer(df.limit(0)).dtypes} == {"string"}
    assert infer(df).first().a is True


def test_csv_files_and_sinks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n2,\n")
    assert read_csv(spark, str(path)).collect() == [(1, "x"), (2, "")]
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception):
        read_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "dup.csv").write_text("a,a\n1,2\n")
    with pytest.raises(GridError):
        read_csv(spark, str(tmp_path / "dup.csv"))
    (tmp_path / "t.tsv").write_text("a\tb\n1.5\ttrue\n")
    assert read_csv(spark, str(tmp_path / "t.tsv")).collect() == [(1.5, True)]
    logs = tmp_path / "run" / "logs"
    logs.mkdir(parents=True)
    (logs / "job.out").write_text("t=1.5\nt=2\n")
    (tmp_path / "run" / "job.0.out").write_text("t=3")
    files = read_files(spark, str(tmp_path / "run"), r"job.*\.out$")
    assert sorted(r.rel_path for r in files.collect()) == ["job.0.out", "logs/job.out"]
    found = extract(files, {"t": "t=%f"}, ["rel_path"])
    assert sorted((r.rel_path, r.t) for r in found.collect()) == [("job.0.out", 3.0), ("logs/job.out", 1.5), ("logs/job.out", 2.0)]
    name = table_name("bench", "000001", "s0")
    write_sqlite({name: found.withColumn("ok", F.lit(True))}, str(tmp_path / "out.db"))
    write_sqlite({name: found.withColumn("ok", F.lit(True))}, str(tmp_path / "out.db"))
    with sqlite3.connect(tmp_path / "out.db") as db:
        assert db.execute(f'SELECT count(*), sum(t), max(ok) FROM "{name}"').fetchone() == (3, 6.5, 1)
    with pytest.raises(GridError):
        write_sqlite({"x": spark.createDataFrame([(1, 2)], "a int, b int").selectExpr("a", "b AS `A`")}, str(tmp_path / "out.db"))
    write_csv(found, str(tmp_path / "csv"), ["rel_path", "match_ix"])
    parts = list((tmp_path / "csv").glob("part-*"))
    assert len(parts) == 1 and parts[0].read_text().splitlines()[0] == "rel_path,match_ix,t"


def test_number_text_needs_the_whole_cell(spark):
    cell = spark.createDataFrame([("12\n",)], "s string")
    with pytest.raises(Exception, match="E106"):
        cell.select(V.to_int(F.col("s"), "string")).collect()
    with pytest.raises(Exception, match="E106"):
        cell.select(V.to_float(F.col("s"), "string")).collect()
    assert infer(cell).dtypes == [("s", "string")]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_portable_patterns(spark):
    cases = [
        ("Number: %d$", "Number: 42\n", []), ("a: (.*)", "a: x\r\nb", ["x\r"]), ("([a&&c]+)", "a&c", ["a&c"]), (r"(\++|[0-9]+)", "++12", ["++", "12"]), (r"(?U)(a+)", "aa", ["a", "a"]),
        (r"(\s+)", "a\x0b b", [" "]), ("(?s)(a.b)", "a\nb", ["a\nb"]), ("([]a]+)", "]a]", ["]a]"]), (r"(?m)^(\w*)$", "a\nb\r\n", ["a", ""]), ("(?i)(k)", "K", ["K"]),
    ]
    for pattern, text, expected in cases:
        assert one(spark, F.regexp_extract_all(F.lit(text), F.lit(compile_pattern(pattern).regex), F.lit(1))) == expected, pattern
    for bad in ("(a++)", "(a)(?=b)", "(?<=a)(b)", "(a", "a)", "*a", "(a**)", "(a{2}{3})", r"(\Z)", "(a{1001})", "(?>a)"):
        with pytest.raises(GridError):
            compile_pattern(bad)


def test_group_wise_substitution(spark):
    text = F.lit("a=1, b=2; a=3, b=4")
    assert one(spark, substitute(text, r"a=(\d), b=(\d)", F.lit("$x\\"), F.lit("9"))) == "a=$x\\, b=9; a=$x\\, b=9"
    assert one(spark, substitute(text, r"[[:digit:]]", F.lit("0"))) == "a=0, b=0; a=0, b=0"
    assert one(spark, substitution_count(text, r"a=(\d)")) == 2
    for pattern, n in (("(a)=", 2), ("a", 2), ("(?:(a)=)+", 2)):
        with pytest.raises(GridError):
            substitute(text, pattern, *[F.lit("x")] * n)
    for pattern, n in (("((a)=)", 2), ("(a)?=", 1), ("(a)|(b)", 2)):  # by span, and refused where the rows show it
        with pytest.raises(Exception, match="E402"):
            one(spark, substitute(text, pattern, *[F.lit("x")] * n))
    assert one(spark, substitute(text, "(?:(a)=)+", F.lit("x"))) == "x=1, b=2; x=3, b=4"


def test_value_operators_at_the_edges(spark):
    with pytest.raises(Exception, match="E107"):
        one(spark, V.divide(F.lit(1), F.lit(0)))
    with pytest.raises(Exception, match="E107"):
        one(spark, V.remainder(F.lit(1), F.lit(0)))
    least = F.lit(-(1 << 63))
    assert one(spark, V.remainder(least, F.lit(-1))) == 0
    assert one(spark, V.negative(least, "bigint")) == -(1 << 63)
    for kinds in (("boolean", "boolean"), ("string", "bigint")):
        with pytest.raises(GridError):
            V.compare("<", F.lit(1), F.lit(2), kinds)
    nothing, nan = F.lit(None).cast("double"), F.lit(float("nan"))
    assert one(spark, V.equals(nothing, nothing, ("double", "double"))) and not one(spark, V.equals(nan, nan, ("double", "double")))
    with pytest.raises(Exception, match="E106"):
        one(spark, V.arithmetic("*", F.lit("ab"), F.lit(-1).cast("long"), ("string", "bigint")))
    numbers = [0.1, 123456.5, 1234567.5, 0.00012, 0.00001234, 100.0, -3.0, 1e22, 0.0, -2.5e-7, 1.5e300, float("inf"), float("nan")]
    shown = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", V.text_of(F.col("x"), "double").alias("t")).collect()
    assert [r.t for r in shown[:10]] == ["0.1", "123456.5", "1.2345675e+06", "0.00012", "1.234e-05", "100.0", "-3.0", "10000000000000000000000.0", "0.0", "-2.5e-07"]
    assert [r.t for r in shown[11:]] == ["+Inf", "NaN"]
    assert all(r.t == V.float_text(r.x) for r in shown if abs(r.x) < 1e37)


def test_folds(spark):
    big = (1 << 63) - 1
    rows = spark.createDataFrame([(big,), (big,), (None,)], "x long")
    assert rows.agg(folds.column_sum(F.col("x"), "bigint")).first()[0] == -2
    assert rows.limit(0).agg(folds.column_sum(F.col("x"), "bigint"), folds.column_every(F.col("x"), "bigint"), folds.column_some(F.col("x"), "bigint")).first()[:] == (0, True, False)
    longs = lambda *x: F.array(*(F.lit(v).cast("long") for v in x)).cast("array<bigint>")
    assert one(spark, folds.fold("+", longs(), "bigint")) == 0 and one(spark, folds.fold("*", longs(), "bigint")) == 1
    with pytest.raises(Exception, match="E106"):
        one(spark, folds.reduce_list(longs(), lambda a, x: a + x, "bigint"))
    by_tens = lambda a, b: F.floor(a / 10) < F.floor(b / 10)
    assert one(spark, folds.sort_list(longs(25, 11, 21, 19, 3), by_tens)) == [3, 11, 19, 25, 21]
    assert one(spark, folds.order_list(longs(2, 1, 2))) == [1, 0, 2]
    assert one(spark, folds.duplicated_list(longs(2, 1, 2))) == [False, False, True]
    repeated = lambda n: one(spark, folds.repeat_list(longs(1, 2), F.lit(n).cast("long"), "array<bigint>"))
    assert repeated(2) == [1, 2, 1, 2] and repeated(0) == []
    for n in (-1, 1 << 20):
        with pytest.raises(Exception, match="E106"):
            repeated(n)
    assert one(spark, folds.as_list(F.lit("a"), "string")) == ["a"] and one(spark, folds.as_list(longs(1), "array<bigint>")) == [1]
    with pytest.raises(GridError):
        folds.as_list(F.create_map(), "map<string,bigint>")
    assert one(spark, folds.join_lists(longs(1), longs(), longs(2))) == [1, 2]


def test_texts_as_files(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "k: 1\nk: 2"), ("r 2+é", "")], "run string, text string")
    write_texts(rows, str(tmp_path / "o u+t"), "run", "text")
    found = {r.run_id: r.text for r in run_files(spark, str(tmp_path / "o u+t"), r"\.txt$").collect()}
    assert found == {"run=r1": "k: 1\nk: 2\n", "run=r 2+é": "\n"}


def test_run_files(spark, tmp_path):
    for run, name in (("r1", "b.out"), ("r1", "a.out"), ("r2", "log/a.out"), ("r2", "x.txt")):
        path = tmp_path / run / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    found = run_files(spark, str(tmp_path), r"\.out$").orderBy("run_id", "file_ix").collect()
    assert [(r.run_id, r.file_ix, r.rel_path) for r in found] == [("r1", 0, "a.out"), ("r1", 1, "b.out"), ("r2", 0, "log/a.out")]
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    assert [r.text for r in exact_files(spark, str(tmp_path), runs.limit(1), "a.out").collect()] == ["a.out"]
    with pytest.raises(Exception, match="E411"):
        exact_files(spark, str(tmp_path), runs, "b.out").collect()
    with pytest.raises(GridError):
        exact_files(spark, str(tmp_path), runs, "../b.out")
