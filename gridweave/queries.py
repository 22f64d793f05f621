"""The catalogue: one query per operator over the test tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells, folds
from .functions import values as V
from .functions.draws import Seeds
from .functions.patterns import compile_pattern
from .functions.shared import settled, shared_folder
from .functions.tracing import choose
from .functions.watch import Watch
from .operators.extract import analyse, extract, extract_strict, extract_weak, matches, merged_type, substitute, substitute_all, substitution_count, summary
from .operators.grid import Grid
from .plans import frontier, status, workplan, worktypes
from .plans.workplan import Import, Step
from .sources.publish import publish, published
from .sources.sinks import write_csv_parts, write_sqlite, write_texts
from .sources.tables import exact_files, read_csv, run_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _region(s: SparkSession, d: str) -> Grid:
    return Grid.scan(_t(s, d, "region"), "r_regionkey")


def _nation(s: SparkSession, d: str) -> Grid:
    return Grid.scan(_t(s, d, "nation"), "n_nationkey")


def _orders(s: SparkSession, d: str, *columns: str) -> Grid:
    return Grid.scan(_t(s, d, "orders").select("o_orderkey", *columns), "o_orderkey")


def _mixed_events(s: SparkSession, d: str) -> Grid:
    """Events with a cell of one of five kinds."""
    e = F.col("event_id")
    n = e % 7
    cell = F.when(e % 5 == 0, n.cast("variant")).when(e % 5 == 1, n.cast("double").cast("variant")).when(e % 5 == 2, n.cast("string").cast("variant")).when(e % 5 == 3, (n > 3).cast("variant"))
    return Grid.scan(_t(s, d, "events").select("event_id", cell.alias("c")), "event_id")


# Table algebra ---------------------------------------------------------------------------------------------------


@query("SELECT n_name, r_name, n_nationkey, n_regionkey, r_regionkey FROM nation CROSS JOIN region")
def product(s: SparkSession, d: str) -> DataFrame:
    return _nation(s, d).product(_region(s, d)).visible()


@query("SELECT CAST(n_nationkey * 5 + r_regionkey AS BIGINT) AS pos, n_name, r_name FROM nation CROSS JOIN region")
def product_pos(s: SparkSession, d: str) -> DataFrame:
    return _nation(s, d).product(_region(s, d)).positioned().select("pos", "n_name", "r_name")


@query("SELECT 'x' AS k, n_name, n_nationkey, n_regionkey, r_name, r_regionkey FROM nation CROSS JOIN region")
def product_shared_col(s: SparkSession, d: str) -> DataFrame:
    nations = Grid.scan(_t(s, d, "nation").withColumn("k", F.lit("x")), "n_nationkey")
    return nations.product(Grid.scan(_t(s, d, "region").withColumn("k", F.lit("x")), "r_regionkey")).visible()


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name, r_name FROM nation JOIN region ON n_nationkey % 5 = r_regionkey")
def merge_cyclic(s: SparkSession, d: str) -> DataFrame:
    return _nation(s, d).merge(_region(s, d)).positioned().select("pos", "n_name", "r_name")


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name, r_name FROM nation JOIN region ON n_nationkey % 3 = r_regionkey")
def merge_uneven(s: SparkSession, d: str) -> DataFrame:
    return _nation(s, d).merge(_region(s, d).head(3)).positioned().select("pos", "n_name", "r_name")


@query("SELECT o_orderkey AS pos, o_orderstatus, event_type FROM orders JOIN events ON event_id = o_orderkey % (SELECT count(*) FROM events)")
def merge_large(s: SparkSession, d: str) -> DataFrame:
    events = Grid.scan(_t(s, d, "events").select("event_id", "event_type"), "event_id")
    return _orders(s, d, "o_orderstatus").merge(events).positioned().select("pos", "o_orderstatus", "event_type")


@query("SELECT r_name FROM region")
def project_identity_factor(s: SparkSession, d: str) -> DataFrame:
    return _region(s, d).product(_nation(s, d)).project("r_name").visible()


@query("SELECT r_name, k FROM region CROSS JOIN (SELECT unnest(['x', 'y', 'x', 'z']) AS k)")
def project_identity_pair(s: SparkSession, d: str) -> DataFrame:
    return _region(s, d).product(_nation(s, d)).product(Grid.table(s, k=["x", "y", "x", "z"])).project("r_name", "k").visible()


@query("SELECT o_orderstatus FROM orders")
def project_row_keyed(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderstatus").project("o_orderstatus").visible()


@query("SELECT n_name FROM nation UNION ALL SELECT n_name FROM nation")
def rbind_namespaces(s: SparkSession, d: str) -> DataFrame:
    both = _nation(s, d).product(_region(s, d))
    return Grid.rbind(both, both).project("n_name").visible()


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name FROM nation UNION ALL SELECT CAST(25 + r_regionkey AS BIGINT), r_name FROM region")
def rbind_order(s: SparkSession, d: str) -> DataFrame:
    regions = _region(s, d).project("r_name").rename(r_name="n_name")
    return Grid.rbind(_nation(s, d).project("n_name"), regions).positioned()


@query("SELECT p AS pos, o_orderkey, o_totalprice FROM orders JOIN (SELECT CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS p, unnest([7, 3, 3, 0]) AS k) ON k = o_orderkey")
def gather(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_totalprice").gather([7, 3, 3, 0]).positioned()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 1")
def mask_cyclic(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d).mask([True, False, True]).visible()


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 10")
def filter_pred(s: SparkSession, d: str) -> DataFrame:
    events = Grid.scan(_t(s, d, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    return events.filter((F.col("event_type") == "click") & (F.col("value") > 10)).visible().select("event_id", "user_id", "value")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def filter_truthy(s: SparkSession, d: str) -> DataFrame:
    lines = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return lines.where(V.truthy(F.col("l_discount"), "double"))


@query("SELECT c_name AS c_mktsegment, c_mktsegment AS c_name, c_custkey AS id FROM customer")
def rename_swap(s: SparkSession, d: str) -> DataFrame:
    grid = Grid.scan(_t(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("c_custkey") - 1)
    return grid.rename(c_name="c_mktsegment", c_mktsegment="c_name", c_custkey="id").visible()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 12")
def head(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderstatus").head(12).visible()


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= (SELECT count(*) FROM orders) - 12")
def tail(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderstatus").tail(12).visible()


@query("SELECT doc_id, md5(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def unique_first(s: SparkSession, d: str) -> DataFrame:
    texts = Grid.scan(_t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    once = texts.project("text").unique().df
    return once.select(F.col("__pos").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS duplicated FROM documents")
def duplicated_mask(s: SparkSession, d: str) -> DataFrame:
    texts = Grid.scan(_t(s, d, "documents").select("doc_id", "text"), "doc_id").project("text")
    return texts.duplicated().select(F.col("__pos").alias("doc_id"), "duplicated")


@query("SELECT row_number() OVER (ORDER BY o_orderstatus, o_orderkey) - 1 AS pos, o_orderkey, o_orderstatus FROM orders")
def order_stable(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderstatus").order("o_orderstatus").positioned()


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def sort_desc(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_totalprice").order(-F.col("o_totalprice")).positioned().select("pos", "o_orderkey")


@query(None)
def sample_size(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderstatus").sample(100, seed=7).positioned()


# Values, vectors and folds ---------------------------------------------------------------------------------------


@query("SELECT CAST(sum(event_id) AS BIGINT) AS total, round(sum(value), 4) AS value_sum, CAST((sum(CAST(event_id AS HUGEINT) * 2305843009213693951) + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS wrapped FROM events")
def fold_sum(s: SparkSession, d: str) -> DataFrame:
    large = V.wrap("*", F.col("event_id"), F.lit((1 << 61) - 1))
    return _t(s, d, "events").agg(
        folds.column_sum(F.col("event_id"), "bigint").alias("total"), F.round(folds.column_sum(F.col("value"), "double"), 4).alias("value_sum"), folds.column_sum(large, "bigint").alias("wrapped")
    )


@query("SELECT o_orderkey, [o_orderkey % 7, o_orderkey % 3, o_orderkey % 5] AS v, list_sum(v)::BIGINT AS s, list_product(v)::BIGINT AS p, list_min(v) AS least FROM orders")
def fold_lists(s: SparkSession, d: str) -> DataFrame:
    v = F.array(*(F.col("o_orderkey") % k for k in (7, 3, 5)))
    rows = _t(s, d, "orders").select("o_orderkey", v.alias("v"))
    least = folds.reduce_list(F.col("v"), lambda a, x: F.least(a, x), "bigint")
    return rows.select("o_orderkey", "v", folds.fold("+", F.col("v"), "bigint").alias("s"), folds.fold("*", F.col("v"), "bigint").alias("p"), least.alias("least"))


@query("SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 400000) AS some FROM orders GROUP BY o_orderstatus")
def all_any(s: SparkSession, d: str) -> DataFrame:
    above = lambda x: F.col("o_totalprice") > x
    return _t(s, d, "orders").groupBy("o_orderstatus").agg(folds.column_every(above(1000), "boolean").alias("every"), folds.column_some(above(400000), "boolean").alias("some"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x <> 0)) = len(embedding) AS every, len(list_filter(embedding, lambda x: x > 1)) > 0 AS some FROM embeddings")
def all_any_lists(s: SparkSession, d: str) -> DataFrame:
    items = F.col("embedding")
    return _t(s, d, "embeddings").select("vec_id", folds.every(items, "float").alias("every"), folds.some(F.transform(items, lambda x: x > 1), "boolean").alias("some"))


@query("SELECT count(*) AS n FROM orders")
def len_rows(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(_orders(s, d).length(),)], "n long")


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2 + 1)), 3) AS total, len(embedding) AS n FROM embeddings")
def map_vector(s: SparkSession, d: str) -> DataFrame:
    two, one = F.array(F.lit(2.0)), F.array(F.lit(1.0))
    times = V.cyclic(F.col("embedding"), two, lambda x, y: V.arithmetic("*", x, y, ("double", "double")))
    moved = V.cyclic(times, one, lambda x, y: V.arithmetic("+", x, y, ("double", "double")))
    return _t(s, d, "embeddings").select("vec_id", F.round(folds.fold("+", moved, "double"), 3).alias("total"), V.length(F.col("embedding"), "array<float>").alias("n"))


@query("SELECT p_partkey, list_sort(string_split(p_name, ' ')) AS rising, list_reverse_sort(string_split(p_name, ' ')) AS falling FROM part")
def sort_lists(s: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return _t(s, d, "part").select("p_partkey", folds.sort_list(words).alias("rising"), folds.sort_list(words, lambda a, b: a > b).alias("falling"))


@query("SELECT vec_id, CAST(embedding[-1] AS DOUBLE) AS last, CAST(embedding[vec_id % 3 + 1] AS DOUBLE) AS picked, list_reverse(embedding)[1] = embedding[-1] AS turned, len([embedding[1], embedding[1], embedding[-2]]) AS n FROM embeddings")
def list_items(s: SparkSession, d: str) -> DataFrame:
    items = F.col("embedding")
    return _t(s, d, "embeddings").select(
        "vec_id", folds.item(items, -1, "float").cast("double").alias("last"), folds.item(items, F.col("vec_id") % 3, "float").cast("double").alias("picked"),
        (folds.item(folds.reverse(items), 0, "float") == folds.item(items, -1, "float")).alias("turned"),
        V.length(folds.items_at(items, F.array(F.lit(0), F.lit(0), F.lit(-2)), "float"), "array<float>").alias("n"),
    )


@query("SELECT event_id, [event_id, 1, 2, 1, 2, event_id] AS joined, list_transform(range(event_id % 4), lambda x: event_type) AS repeated, [-event_id, -1] AS turned, [event_id = 0, false] AS none FROM events")
def list_operators(s: SparkSession, d: str) -> DataFrame:
    e, pair = F.col("event_id"), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))
    mine = F.array(e, F.lit(1).cast("long"))
    return _t(s, d, "events").select(
        "event_id", folds.join_lists(folds.as_list(e, "bigint"), folds.repeat_list(pair, F.lit(2), "array<bigint>"), folds.as_list(e, "bigint")).alias("joined"),
        folds.repeat_list(folds.as_list(F.col("event_type"), "string"), e % 4, "array<string>").alias("repeated"),
        folds.each(mine, lambda x: V.negative(x, "bigint")).alias("turned"), folds.each(mine, lambda x: ~V.truthy(x, "bigint")).alias("none"),
    )


@query("SELECT event_id, event_id % 4 AS a, CASE WHEN event_id % 2 = 0 THEN event_id ELSE 7 END AS b, CAST(-1 AS BIGINT) AS c, ['a', 'b'] AS names FROM events")
def map_entries(s: SparkSession, d: str) -> DataFrame:
    left = F.create_map(F.lit("a"), F.col("event_id") % 4, F.lit("b"), F.lit(7).cast("long"))
    right = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.col("event_id"))).otherwise(F.create_map().cast("map<string,bigint>"))
    rows = _t(s, d, "events").select("event_id", folds.update(left, right).alias("m"))
    get = lambda k: folds.entry(F.col("m"), F.lit(k), "bigint").alias(k)
    return rows.select("event_id", get("a"), get("b"), folds.entry_or(F.col("m"), F.lit("c"), F.lit(-1).cast("long")).alias("c"), F.map_keys("m").alias("names"))


@query("SELECT list(r_name ORDER BY r_regionkey) AS r_name, list(r_regionkey ORDER BY r_regionkey) AS r_regionkey FROM region")
def grid_lists(s: SparkSession, d: str) -> DataFrame:
    return _region(s, d).lists()


@query("SELECT event_id, [event_id % 3, event_id % 2, event_id % 4] AS v, list_distinct(v) IS NOT NULL AS known, [false, v[2] = v[1], v[3] = v[1] OR v[3] = v[2]] AS again FROM events")
def duplicated_lists(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "events").select("event_id", F.array(*(F.col("event_id") % k for k in (3, 2, 4))).alias("v"))
    return rows.select("event_id", "v", (F.size(folds.unique_list(F.col("v"))) > 0).alias("known"), folds.duplicated_list(F.col("v")).alias("again"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name, r_name, k FROM nation JOIN region ON n_nationkey % 5 = r_regionkey JOIN (SELECT unnest(['a', 'b']) AS k, unnest([0, 1]) AS i) ON n_nationkey % 2 = i")
def fold_tables_sum(s: SparkSession, d: str) -> DataFrame:
    return Grid.sum(_nation(s, d), _region(s, d), Grid.table(s, k=["a", "b"])).positioned().select("pos", "n_name", "r_name", "k")


@query("SELECT CAST((r_regionkey * 25 + n_nationkey) * 2 + i AS BIGINT) AS pos, r_name, n_name, k FROM region, nation, (SELECT unnest(['a', 'b']) AS k, unnest([0, 1]) AS i)")
def fold_tables_prod(s: SparkSession, d: str) -> DataFrame:
    return Grid.prod(_region(s, d), _nation(s, d), Grid.table(s, k=["a", "b"])).positioned().select("pos", "r_name", "n_name", "k")


@query("SELECT row_number() OVER (ORDER BY o_orderpriority DESC, o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def order_text_desc(s: SparkSession, d: str) -> DataFrame:
    return _orders(s, d, "o_orderpriority").order("o_orderpriority", descending=True).positioned().select("pos", "o_orderkey")


@query("""
SELECT event_id, CAST(event_id - 5000 AS DOUBLE) / 7 AS quotient, (event_id - 5000) % 7 AS rest, 5000 - event_id AS turned, event_id + value AS added,
       event_id - 1 AS less, event_id::DOUBLE < value AS below, event_type >= 'login' AS late, value > 10 AND event_type <> '' AS both, value > 10 OR event_id % 2 <> 0 AS either,
       event_id::DOUBLE = value AS same, CASE WHEN event_id % 2 <> 0 THEN event_type ELSE 'even' END AS chosen FROM events
""")
def value_operators(s: SparkSession, d: str) -> DataFrame:
    e, v, t = F.col("event_id"), F.col("value"), F.col("event_type")
    off = V.arithmetic("-", e, F.lit(5000), ("bigint", "bigint"))
    more = V.compare(">", v, F.lit(10.0), ("double", "double"))
    odd = V.remainder(e, F.lit(2))
    return _t(s, d, "events").select(
        "event_id", V.divide(off, F.lit(7)).alias("quotient"), V.remainder(off, F.lit(7)).alias("rest"), V.negative(off, "bigint").alias("turned"),
        V.arithmetic("+", e, v, ("bigint", "double")).alias("added"), V.arithmetic("-", e, F.lit(1), ("bigint", "bigint")).alias("less"),
        V.compare("<", e, v, ("bigint", "double")).alias("below"), V.compare(">=", t, F.lit("login"), ("string", "string")).alias("late"),
        V.logic("and", more, t, ("boolean", "string")).alias("both"), V.logic("or", more, odd, ("boolean", "bigint")).alias("either"),
        V.equals(e, v, ("bigint", "double")).alias("same"), V.choose(odd, "bigint", t, F.lit("even")).alias("chosen"),
    )


@query("SELECT event_id, CASE WHEN value = trunc(value) THEN printf('%.1f', value) ELSE CAST(value AS VARCHAR) END AS float_text, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS truth, '[' || event_id || ',1]' AS list_text FROM events")
def text_form(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "events")
    both = F.array(F.col("event_id"), F.lit(1).cast("long"))
    return rows.select("event_id", V.text_of(F.col("value"), "double").alias("float_text"), V.text_of(F.col("event_id") % 2 == 0, "boolean").alias("truth"), V.text_of(both, "array<bigint>").alias("list_text"))


@query("SELECT o_orderkey, [o_orderkey + 1, o_orderkey + 20, o_orderkey + 1 + 2] AS v FROM (SELECT o_orderkey FROM orders)")
def vector_cyclic(s: SparkSession, d: str) -> DataFrame:
    a, b = F.array(F.col("o_orderkey"), F.col("o_orderkey") + 0, F.col("o_orderkey") + 2), F.array(F.lit(1).cast("long"), F.lit(20).cast("long"))
    return _t(s, d, "orders").select("o_orderkey", V.cyclic(a, b, lambda x, y: x + y).alias("v"))


@query("SELECT event_id, CAST((((CAST(event_id AS HUGEINT) * 9223372036854775807 + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616) - 9223372036854775808 AS BIGINT) AS wrapped FROM events")
def wrap_product(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", V.wrap("*", F.col("event_id"), F.lit((1 << 63) - 1)).alias("wrapped"))


@query("SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def conv_int(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "customer").select("c_custkey", V.to_int(F.col("c_acctbal"), "double").alias("whole"))


@query("SELECT event_id, CAST(CAST(event_id AS VARCHAR) || '.5' AS DOUBLE) AS x FROM events")
def conv_float(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", V.to_float(F.concat(F.col("event_id").cast("string"), F.lit(".5")), "string").alias("x"))


@query("SELECT event_id, event_id % 3 <> 0 AS b, event_type <> '' AS t FROM events")
def conv_bool(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", V.truthy(F.col("event_id") % 3, "bigint").alias("b"), V.truthy(F.col("event_type"), "string").alias("t"))


@query("SELECT p_partkey, p_brand || CAST(p_size AS VARCHAR) AS joined, repeat(p_brand, 2) AS twice FROM part")
def concat_repeat(s: SparkSession, d: str) -> DataFrame:
    joined = V.arithmetic("+", F.col("p_brand"), F.col("p_size").cast("bigint"), ("string", "bigint"))
    return _t(s, d, "part").select("p_partkey", joined.alias("joined"), V.arithmetic("*", F.col("p_brand"), F.lit(2).cast("bigint"), ("string", "bigint")).alias("twice"))


@query("SELECT r_name, CAST(x AS BIGINT) AS x FROM region CROSS JOIN (SELECT unnest(generate_series(10, 2, -2)) AS x WHERE true) WHERE x > 2")
def range_grid(s: SparkSession, d: str) -> DataFrame:
    return _region(s, d).project("r_name").product(Grid.table(s, x=V.number_range(10, 2, -2))).visible()


@query("""
WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'string' WHEN 3 THEN 'bool' ELSE 'null' END AS kind, event_id % 7 AS n FROM events),
t AS (SELECT *, CASE kind WHEN 'int' THEN n::VARCHAR WHEN 'float' THEN n || '.0' WHEN 'string' THEN n::VARCHAR WHEN 'bool' THEN CASE WHEN n > 3 THEN 'true' ELSE 'false' END ELSE 'None' END AS shown FROM m)
SELECT event_id, r_name, kind, shown, kind IN ('int', 'float') AND n = r_regionkey AS same,
       CASE kind WHEN 'bool' THEN n > 3 WHEN 'string' THEN true WHEN 'null' THEN false ELSE n <> 0 END AS truth FROM t CROSS JOIN region
""")
def variant_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of five kinds keep them through a product."""
    found = _mixed_events(s, d).product(_region(s, d)).df
    c = F.col("c")
    return found.select(
        "event_id", "r_name", cells.kind_of(c).alias("kind"), V.text_of(c, "variant").alias("shown"), V.equals(c, F.col("r_regionkey"), ("variant", "int")).alias("same"), V.truthy(c, "variant").alias("truth"),
    )


@query("""
WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'n' WHEN 2 THEN 's' WHEN 3 THEN 'b' ELSE '' END AS k,
                  CASE event_id % 5 WHEN 4 THEN 0 WHEN 3 THEN (event_id % 7 > 3)::INT ELSE event_id % 7 END AS n FROM events)
SELECT min(event_id) AS event_id, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY k, m.n
""")
def variant_unique(s: SparkSession, d: str) -> DataFrame:
    """First rows of distinct cells; whole numbers and floats of one value are one, texts and truth values are not."""
    grid = _mixed_events(s, d)
    once = grid.project("c").unique().df.select(F.col("__pos").alias("event_id"), cells.key(F.col("c")).alias("key"))
    counts = grid.df.groupBy(cells.key(F.col("c")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return once.join(counts, "key").select("event_id", "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey * 1000 + l_linenumber) % 7 = 3 AND (l_quantity > 25 OR l_returnflag = 'R') AND CASE WHEN l_tax <> 0 THEN l_shipdate IS NOT NULL ELSE l_discount <> 0 END")
def filter_traced(s: SparkSession, d: str) -> DataFrame:
    """A Python function of a row as a typed expression."""
    lines = _t(s, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("string"))
    kept = lambda r: ((r.l_orderkey * 1000 + r.l_linenumber) % 7 == 3) & ((r.l_quantity > 25) | (r.l_returnflag == "R")) & choose(r.l_tax, r.l_shipdate, r.l_discount)
    grid = Grid.scan(lines, F.monotonically_increasing_id()).filter(kept)
    return grid.visible().select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH w AS (SELECT event_id, CAST(event_id AS HUGEINT) * 4611686018427387904 AS p FROM events)
SELECT event_id, CAST((p + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS p, (SELECT count(*) FROM w WHERE p > 9223372036854775807) AS wrapped FROM w
""")
def warnings_counted(s: SparkSession, d: str) -> DataFrame:
    """Products that wrap, with the number of rows that did, counted while the rows are written."""
    watch = Watch()
    grid = Grid.scan(_t(s, d, "events").select("event_id"), "event_id").compute(watch, p=lambda r: r.event_id * (1 << 62))
    return settled(grid.visible()).withColumn("wrapped", F.lit(watch.counts().get("W102", 0)).cast("long"))


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS n, round(list_sum(list_transform(list_filter(embedding, lambda x: x > 0), lambda x: CAST(x AS DOUBLE) * 2 + 1)), 3) AS total FROM embeddings")
def filter_lists(s: SparkSession, d: str) -> DataFrame:
    kept = folds.filter_list(F.col("embedding"), lambda x: x > 0, "float")
    moved = folds.map_list(kept, lambda x: x * 2 + 1, "float")
    return _t(s, d, "embeddings").select("vec_id", F.size(kept).cast("long").alias("n"), F.round(folds.fold("+", moved, "double"), 3).alias("total"))


# Extraction ------------------------------------------------------------------------------------------------------


@query(r"""
SELECT page_id, unnest(regexp_extract_all(url, '/(\S\S)/([+-]?\d+)\?page=([+-]?\d+)', 1)) AS lang,
       CAST(unnest(regexp_extract_all(url, '/(\S\S)/([+-]?\d+)\?page=([+-]?\d+)', 2)) AS BIGINT) AS section,
       CAST(unnest(regexp_extract_all(url, '/(\S\S)/([+-]?\d+)\?page=([+-]?\d+)', 3)) AS BIGINT) AS page FROM pages
""")
def extract_url(s: SparkSession, d: str) -> DataFrame:
    rows = extract(_t(s, d, "pages"), {"u": r"/(\S\S)/%d\?page=%d"}, ["page_id"], "url")
    return rows.select("page_id", F.col("`u.0`").alias("lang"), F.col("`u.1`").alias("section"), F.col("`u.2`").alias("page"))


@query(r"""SELECT event_id, CAST(unnest(regexp_extract_all(props, '"k": ([+-]?\d+)', 1)) AS BIGINT) AS k FROM events""")
def extract_props(s: SparkSession, d: str) -> DataFrame:
    return extract(_t(s, d, "events"), {"k": '"k": %d'}, ["event_id"], "props").drop("match_ix")


@query(r"""
WITH m AS (SELECT page_id, regexp_extract_all(html, '<p>([A-Za-z]+)', 1) AS a, regexp_extract_all(html, 'href="/([a-z]+)"', 1) AS b FROM pages),
n AS (SELECT page_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM m)
SELECT page_id, CAST(i - 1 AS INTEGER) AS match_ix, a[i] AS first_word, b[i] AS link FROM n
""")
def extract_multi_zip(s: SparkSession, d: str) -> DataFrame:
    return extract(_t(s, d, "pages"), {"first_word": "<p>([[:alpha:]]+)", "link": 'href="/([a-z]+)"'}, ["page_id"], "html")


@query("SELECT event_id, 0 AS match_ix, k FROM (SELECT event_id, unnest(regexp_extract_all(props, '\"k\": ([0-9]*7)[^0-9]', 1)) AS k FROM events)")
def extract_nomatch(s: SparkSession, d: str) -> DataFrame:
    """Rows without a match give no rows."""
    return extract(_t(s, d, "events"), {"k": '"k": ([0-9]*7)[^0-9]'}, ["event_id"], "props")


@query("SELECT page_id, url, 0 AS match_ix FROM pages")
def extract_values_only(s: SparkSession, d: str) -> DataFrame:
    return extract(_t(s, d, "pages"), {}, ["page_id", "url"], "html")


@query(r"""
WITH w AS (SELECT *, CASE WHEN page_id % 4 = 1 THEN 'ERROR' ELSE 'FINISHED' END AS status FROM pages),
f AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<title>([A-Za-z]+)', 1)) AS title FROM w WHERE status = 'FINISHED')
SELECT page_id, url, title, 'FINISHED' AS run_status FROM f UNION ALL SELECT page_id, NULL, NULL, status FROM w WHERE status <> 'FINISHED'
""")
def extract_weak_mode(s: SparkSession, d: str) -> DataFrame:
    work = _t(s, d, "pages").withColumn("status", F.when(F.col("page_id") % 4 == 1, "ERROR").otherwise("FINISHED"))
    return extract_weak(work, {"title": "<title>([A-Za-z]+)"}, "page_id", ["url"], "html").drop("match_ix")


@query("SELECT CAST(c_custkey AS DOUBLE) AS v, c_mktsegment AS w FROM customer UNION ALL SELECT p_retailprice, CAST(p_size AS VARCHAR) FROM part")
def type_merge(s: SparkSession, d: str) -> DataFrame:
    number, text = merged_type(["bigint", "double"]), merged_type(["string", "int"])
    a = _t(s, d, "customer").select(F.col("c_custkey").cast(number).alias("v"), F.col("c_mktsegment").cast(text).alias("w"))
    return a.unionByName(_t(s, d, "part").select(F.col("p_retailprice").cast(number).alias("v"), F.col("p_size").cast(text).alias("w")))


@query("SELECT event_id, regexp_replace(props, '[0-9]+', 'a$1b', 'g') AS props FROM events")
def substitute_literal(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", substitute(F.col("props"), "[0-9]+", F.lit("a$1b")).alias("props"))


@query(r"""SELECT event_id, regexp_replace(props, '"([a-z]+)": ([0-9]+)', '"' || event_type || '": ' || event_id, 'g') AS props FROM events""")
def substitute_groups(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", substitute(F.col("props"), '"([a-z]+)": ([0-9]+)', F.col("event_type"), F.col("event_id").cast("string")).alias("props"))


@query(r"""SELECT event_id, CAST(len(regexp_extract_all(props, '[0-9]')) AS BIGINT) AS n, regexp_replace(regexp_replace(props, '[0-9]', 'x', 'g'), 'x+', 'y', 'g') AS props FROM events""")
def substitute_rules(s: SparkSession, d: str) -> DataFrame:
    rules = [("[0-9]", [F.lit("x")]), ("x+", [F.lit("y")])]
    return _t(s, d, "events").select("event_id", substitution_count(F.col("props"), "[0-9]").alias("n"), substitute_all(F.col("props"), rules).alias("props"))


@query(r"""
SELECT event_id, regexp_replace(regexp_replace(props, '"([a-z]+)": ([0-9]+)', '"' || event_type || '": ' || event_id, 'g'), '$', '') AS props,
       CASE WHEN event_id % 2 = 0 THEN 'a=<' || event_type || '>;c' ELSE 'x=<' || event_type || '>;c' END AS chosen FROM events
""")
def substitute_spans(s: SparkSession, d: str) -> DataFrame:
    """Groups within a repeated and within an alternative, which are replaced by their places."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    source = F.when(F.col("event_id") % 2 == 0, "a=1;b").otherwise("x=2;b")
    return _t(s, d, "events").select(
        "event_id", substitute(F.col("props"), '(?:"([a-z]+)": ([0-9]+))+', kind, number).alias("props"), substitute(source, "(?:a|x)=(?:([0-9])|[a-z]);(b)", F.concat(F.lit("<"), kind, F.lit(">")), F.lit("c")).alias("chosen")
    )


PORTABLE = [r"(\s+)", r"([a&&c]+)", r"\b(\w+)", r"(?i)(k+)", r"(?U)(a+)", r"(.+)", r"(?m)^(\w+)", r"(\w+)$", r"(\++|[0-9]+)", r"([[:punct:]]+)", r"([^[:alpha:]\s]+)", r"(\pL+)"]


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, '{p}', 1)) AS n{i}, md5(array_to_string(regexp_extract_all(text, '{p}', 1), '|')) AS h{i}" for i, p in enumerate(PORTABLE)) + " FROM documents")
def pattern_portable(s: SparkSession, d: str) -> DataFrame:
    found = [matches(F.col("text"), compile_pattern(p), 1) for p in PORTABLE]
    return _t(s, d, "documents").select("doc_id", *(x for i, f in enumerate(found) for x in (V.length(f, "array<string>").alias(f"n{i}"), F.md5(F.array_join(f, "|").cast("binary")).alias(f"h{i}"))))


@query("SELECT page_id, url, unnest(regexp_extract_all(html, '<title>([A-Za-z]+)', 1)) AS title FROM pages")
def extract_strict_mode(s: SparkSession, d: str) -> DataFrame:
    work = _t(s, d, "pages").withColumn("status", F.lit("FINISHED"))
    return extract_strict(work, {"title": "<title>([A-Za-z]+)"}, "page_id", ["url"], "html").drop("match_ix")


@query("SELECT 'urls' AS output, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM pages UNION ALL SELECT 'props', count(*), CAST(2 AS BIGINT) FROM events")
def extract_summary(s: SparkSession, d: str) -> DataFrame:
    return summary({"urls": extract(_t(s, d, "pages"), {}, ["page_id", "url"], "html"), "props": extract_props(s, d)})


@query(r"""
WITH m AS (SELECT page_id, url, regexp_extract_all(html, '<p>([A-Za-z]+)', 1) AS a, regexp_extract_all(html, '<title>([A-Za-z]+)', 1) AS t FROM pages),
n AS (SELECT *, unnest(range(1, greatest(len(a), len(t)) + 1)) AS i FROM m)
SELECT page_id, CAST(i - 1 AS INTEGER) AS match_ix, t[i] AS title, url, a[i] AS first_word FROM n
""")
def analyse_columns(s: SparkSession, d: str) -> DataFrame:
    """Columns by name, of helper patterns and values; a helper that no column names isn't run."""
    helpers = [("first_word", "<p>([[:alpha:]]+)"), ("title", "<title>([[:alpha:]]+)"), ("link", 'href="([^"]+)"')]
    return analyse(_t(s, d, "pages"), helpers, ["title", "url", "first_word"], ["url"], "page_id", "html")


# Sources and sinks -----------------------------------------------------------------------------------------------


def _folder(s: SparkSession) -> str:
    """A new folder that driver and tasks share; one of this machine's only where they are one process."""
    return f"{shared_folder(s)}/{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name || chr(10) || '\"x\"' AS c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_custkey % 2 = 0 AS even FROM customer")
def csv_inferred(s: SparkSession, d: str) -> DataFrame:
    named = _t(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"x"')).alias("c_name"), "c_nationkey", "c_acctbal", (F.col("c_custkey") % 2 == 0).alias("even"))
    path = _folder(s)
    named.repartitionByRange("c_custkey").write.option("escape", '"').csv(path, header=True)
    return read_csv(s, path)


@query("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders")
def csv_parts(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s)
    write_csv_parts(_t(s, d, "orders").select("o_totalprice", "o_orderkey"), path, ["o_totalprice", "o_orderkey"])
    return Grid.ordered(read_csv(s, path), "o_totalprice", "o_orderkey").positioned().select("pos", "o_orderkey", "o_totalprice")


def _supplier_runs(s: SparkSession, d: str) -> str:
    """A folder with a run per supplier, each with one file of two lines, written from a template by substitution."""
    path = _folder(s)
    rows = _t(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), substitute(F.lit("key: #\nnation: #"), "key: (#)\nnation: (#)", F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("text"))
    write_texts(rows, path, "run_id", "text")
    return path


@query("SELECT s_suppkey, 0 AS file_ix, s_nationkey::BIGINT AS nation FROM supplier")
def files_by_pattern(s: SparkSession, d: str) -> DataFrame:
    """Runs of one small file each, written first."""
    found = run_files(s, _supplier_runs(s, d), r"^part-.*\.txt$")
    return extract(found, {"s_suppkey": r"key: %d", "nation": r"nation: %d"}, ["file_ix"]).drop("match_ix")


@query("SELECT DISTINCT s_nationkey::BIGINT AS nation, 'n' || s_nationkey AS run_id FROM supplier")
def files_exact(s: SparkSession, d: str) -> DataFrame:
    """One file of a known name in every run; there are as many runs as nations, so a loop writes them."""
    path = _folder(s)
    runs = _t(s, d, "supplier").select("s_nationkey").distinct()
    for r in runs.collect():
        place = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/n{r.s_nationkey}/logs/job.out")
        out = place.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray(f"nation: {r.s_nationkey}", "utf-8"))
        out.close()
    found = exact_files(s, path, runs.select(F.concat(F.lit("n"), "s_nationkey").alias("run_id")), "logs/job.out")
    return extract(found, {"nation": "nation: %d"}, ["run_id"]).drop("match_ix")


@query("SELECT event_type AS step, max(event_id) AS last, count(*) AS n, CAST(sum(event_id % 10) AS DOUBLE) AS duration FROM events GROUP BY event_type")
def status_files(s: SparkSession, d: str) -> DataFrame:
    """Records of all events, written as JSON and read back."""
    path = _folder(s)
    rows = _t(s, d, "events").select(F.lit("FINISHED").alias("status"), F.col("event_type").alias("step"), F.col("event_id").alias("row"), (F.col("event_id") % 10).cast("double").alias("duration"))
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return status.read_records(s, path).groupBy("step").agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("duration").alias("duration"))


@query("SELECT r_name AS run_id, 's' AS step, n_nationkey::BIGINT AS row, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
def manifest_files(s: SparkSession, d: str) -> DataFrame:
    """A manifest per region with a workpackage per nation, written as JSON and read back."""
    path = _folder(s)
    work = F.struct(F.lit("s").alias("step"), F.col("n_nationkey").alias("row"), F.create_map(F.lit("name"), F.col("n_name")).alias("values"))
    runs = _t(s, d, "nation").join(_t(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("run_id")).agg(F.collect_list(work).alias("work"))
    write_texts(runs.select("run_id", F.to_json(F.struct("*")).alias("text")), path, "run_id", "text")
    return status.read_manifest(s, path).select("run_id", "step", "row", F.col("values.name").alias("name"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CAST(n_regionkey = 1 AS BIGINT) AS first FROM nation")
def sqlite_export(s: SparkSession, d: str) -> DataFrame:
    path = tempfile.mkdtemp() + "/results.db"  # the driver's own file, by definition
    write_sqlite({"nation": _t(s, d, "nation").select("n_nationkey", "n_name", (F.col("n_regionkey") == 1).alias("first"))}, path)
    with sqlite3.connect(path) as db:
        return s.createDataFrame(db.execute("SELECT * FROM nation").fetchall(), "n_nationkey long, n_name string, first long")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CAST(2 AS BIGINT) AS version FROM nation")
def published_tables(s: SparkSession, d: str) -> DataFrame:
    """Two tables published at once, twice; the second table of a third attempt fails, which leaves the second version."""
    path, nation = _folder(s), _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")
    publish({"nation": nation.limit(1), "region": _t(s, d, "region")}, path)
    version = publish({"nation": nation, "region": _t(s, d, "region")}, path)
    broken = _t(s, d, "region").where(F.raise_error(F.lit("broken")).cast("boolean"))
    try:
        publish({"nation": nation.limit(2), "region": broken}, path)
    except Exception as error:  # the failure is the case
        if "broken" not in str(error):
            raise
    return published(s, path)["nation"].withColumn("version", F.lit(version).cast("long"))


@query("SELECT n_name, r_name, CAST(n_nationkey * 5 + r_regionkey AS BIGINT) AS pos FROM nation CROSS JOIN region")
def rows_round_trip(s: SparkSession, d: str) -> DataFrame:
    """A small grid's row dictionaries, made a grid again: one source, so that a projection keeps all rows."""
    grid = _nation(s, d).project("n_name").product(_region(s, d).project("r_name"))
    return Grid.from_rows(s, grid.rows()).project("n_name", "r_name").positioned()


@query("SELECT p_partkey, p_brand || ';' || p_type AS label, p_size::BIGINT AS p_size FROM part")
def csv_sniffed(s: SparkSession, d: str) -> DataFrame:
    """Files without a telling name, by tabs since no comma is in the first line; semicolons separate nothing."""
    path = _folder(s)
    named = _t(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit(";"), "p_type").alias("label"), "p_size")
    named.write.option("sep", "\t").csv(path, header=True)
    return read_csv(s, path)


@query("""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id::BIGINT AS user_id, event_type AS kind, event_id % 2 = 0 AS even,
       CASE WHEN event_id % 4 = 0 THEN event_id ELSE event_id + 0.5 END::DOUBLE AS at, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE user_id::VARCHAR END AS tag
FROM events
""")
def table_rows(s: SparkSession, d: str) -> DataFrame:
    """A row dictionary per event, as a map of texts, made a grid whose types come from all rows."""
    e, user = F.col("event_id"), F.col("user_id").cast("string")
    texts = {
        "user_id": user,
        "kind": F.col("event_type"),
        "even": F.when(e % 2 == 0, "true").otherwise("false"),
        "at": F.when(e % 4 == 0, e.cast("string")).otherwise(F.concat(e.cast("string"), F.lit(".5"))),
        "tag": F.when(e % 3 == 0, "x").otherwise(user),
    }
    held = _t(s, d, "events").select("event_id", F.create_map(*(x for k, c in texts.items() for x in (F.lit(k), c))).alias("row"))
    rows = Grid.ordered(held.select("event_id"), "event_id").positioned().join(held, "event_id")
    return worktypes.grid_of_maps(rows, "pos", "row").positioned()


def _value_work(s: SparkSession, d: str) -> DataFrame:
    """Workpackages with a map of values as texts, whose kinds depend on the step."""
    e, t = F.col("event_id"), F.col("event_type")
    text = e.cast("string")
    mixed = F.when(t == "click", text).when(t == "error", F.when(e % 2 == 0, text).otherwise(F.concat(text, F.lit(".5")))).when(t == "login", F.when(e % 3 == 0, "true").otherwise("false")).otherwise(F.concat(F.lit("v"), text))
    values = F.when(t == "click", F.create_map(F.lit("a"), mixed)).otherwise(F.create_map(F.lit("a"), mixed, F.lit("b"), F.when(e % 5 == 0, "x").otherwise("7")))
    return _t(s, d, "events").select(t.alias("step"), e.alias("row"), values.alias("values"))


@query("""
SELECT event_type AS step, 'a' AS key, CASE event_type WHEN 'click' THEN 'bigint' WHEN 'error' THEN 'double' WHEN 'login' THEN 'boolean' ELSE 'string' END AS kind, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'b', 'string', count(*) FROM events WHERE event_type <> 'click' GROUP BY event_type
""")
def work_value_kinds(s: SparkSession, d: str) -> DataFrame:
    return worktypes.value_kinds(_value_work(s, d))


@query("""
SELECT event_type AS step, event_id AS row, CASE event_type WHEN 'click' THEN 'bigint' WHEN 'error' THEN 'double' WHEN 'login' THEN 'boolean' ELSE 'string' END AS kind,
       CASE WHEN event_type = 'click' THEN event_id::DOUBLE WHEN event_type = 'error' THEN event_id + 0.5 * (event_id % 2) WHEN event_type = 'login' THEN (event_id % 3 = 0)::INT ELSE -1 END::DOUBLE AS a,
       CASE WHEN event_type = 'click' THEN NULL WHEN event_id % 5 = 0 THEN 'x' ELSE '7' END AS b FROM events
""")
def work_values_typed(s: SparkSession, d: str) -> DataFrame:
    """A typed table per step, laid below each other by what all have."""
    tables = worktypes.typed_steps(_value_work(s, d), ["row"])
    number = lambda c, kind: c.cast("double") if kind != "string" else F.lit(-1.0)
    parts = []
    for step, df in tables.items():
        kind = dict(df.dtypes)["a"]
        b = F.col("b") if "b" in df.columns else F.lit(None).cast("string")
        parts.append(df.select(F.lit(step).alias("step"), "row", F.lit(kind).alias("kind"), number(F.col("a"), kind).alias("a"), b.alias("b")))
    return reduce(DataFrame.unionByName, parts)


@query("""
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FINISHED' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'NOTSTARTED' ELSE 'FINISHED' END AS s0,
                  CASE WHEN event_id % 3 = 0 THEN 'FINISHED' ELSE 'NOTSTARTED' END AS s1 FROM events),
b AS (SELECT *, CASE WHEN s1 = 'NOTSTARTED' AND s0 = 'ERROR' THEN 'BLOCKED' ELSE s1 END AS t1 FROM e)
SELECT 's0' AS step, event_id AS row, s0 AS status, s0 = 'NOTSTARTED' AS ready FROM b
UNION ALL SELECT 's1', event_id, t1, t1 = 'NOTSTARTED' AND s0 = 'FINISHED' FROM b
UNION ALL SELECT 's2', event_id, CASE WHEN t1 = 'BLOCKED' THEN 'BLOCKED' ELSE 'NOTSTARTED' END, t1 = 'FINISHED' FROM b
""")
def work_blocked(s: SparkSession, d: str) -> DataFrame:
    """A chain of three steps with a row per event: what failed blocks what comes from it, what is done makes it ready."""
    events = Grid.scan(_t(s, d, "events").select("event_id"), "event_id")
    plan = workplan.build([Step("s0", (Import("e", events),)), Step("s1", (), ("s0",)), Step("s2", (), ("s1",))])
    e = F.col("event_id")
    first = F.when(e % 4 == 1, "ERROR").when(e % 4 == 2, "NOTSTARTED").otherwise("FINISHED")
    status_of = {"s0": first, "s1": F.when(e % 3 == 0, "FINISHED").otherwise("NOTSTARTED"), "s2": F.lit("NOTSTARTED")}
    records = reduce(DataFrame.unionByName, (_t(s, d, "events").select(F.lit(step).alias("step"), e.alias("row"), c.alias("status")) for step, c in status_of.items()))
    return frontier.resolved(records, frontier.edges(plan))


@query(None)
def sample_replaced(s: SparkSession, d: str) -> DataFrame:
    """As many draws with replacement as rows, each numbered."""
    return _orders(s, d, "o_orderstatus").sample(replace_rows=True, seed=Seeds(7)).positioned()


@query("SELECT 'one' AS benchmark, '3' AS n, r_name AS \"r.r_name\", CAST(r_regionkey AS BIGINT) AS row, 's' AS step FROM region UNION ALL SELECT 'two', NULL, n_name, CAST(n_nationkey AS BIGINT), 's' FROM nation")
def plan_parameters_bare(s: SparkSession, d: str) -> DataFrame:
    """Scalars go by their name alone; benchmarks are told apart."""
    n = workplan.as_grid(s, 3, "n")
    one = workplan.build([Step("s", (Import("n", n), Import("r", _region(s, d), ("r_name",))))])
    two = workplan.build([Step("s", (Import("r", _nation(s, d).project("n_name").rename(n_name="r_name")),))])
    return workplan.parameters_of({"one": one, "two": two})


# Workplans and status --------------------------------------------------------------------------------------------


def _grid(s: SparkSession, d: str) -> Grid:
    """regions x nations x two letters: three sources in one grid."""
    return _region(s, d).project("r_name").product(_nation(s, d).project("n_name")).product(Grid.table(s, k=["a", "b"]))


@query("SELECT r_name, n_name, CAST(r_regionkey * 25 + n_nationkey AS BIGINT) AS row FROM region CROSS JOIN nation")
def plan_expand(s: SparkSession, d: str) -> DataFrame:
    steps = [Step("s0", (Import("r", _region(s, d), ("r_name",)),)), Step("s1", (Import("n", _nation(s, d), ("n_name",)),), ("s0",))]
    return workplan.build(steps).states["s1"].select("r_name", "n_name", "row")


@query("SELECT r_name, n_name, CAST(r_regionkey * 25 + n_nationkey AS BIGINT) AS row, CAST(2 AS INTEGER) AS sources FROM region CROSS JOIN nation")
def plan_lineage(s: SparkSession, d: str) -> DataFrame:
    grid = _grid(s, d)
    steps = [Step("s0", (Import("g", grid, ("r_name",)),)), Step("s1", (Import("g", grid, ("n_name",)),), ("s0",))]
    plan = workplan.build(steps)
    return plan.states["s1"].join(workplan.drawn(plan, "s1", "g"), "row").select("r_name", "n_name", "row", F.col("positions").cast("int").alias("sources"))


@query("""
SELECT r_name, s.l_returnflag AS shown, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(1 AS BIGINT) AS least, CAST(1 AS BIGINT) AS most
FROM region CROSS JOIN lineitem s GROUP BY r_name, s.l_returnflag
""")
def plan_lineage_large(s: SparkSession, d: str) -> DataFrame:
    """A projection to five keys, each of which shares all rows of a table, and the rest imported again."""
    lines = _t(s, d, "lineitem")
    grid = _region(s, d).project("r_name").product(Grid.ordered(lines, *lines.columns))
    steps = [Step("s0", (Import("g", grid, ("r_name",)),)), Step("s1", (Import("g", grid, ("l_orderkey", "l_returnflag", "l_quantity")),), ("s0",))]
    plan = workplan.build(steps)
    rows = workplan.with_drawn(plan, "s1", "g")
    return rows.groupBy("r_name", F.col("l_returnflag").alias("shown")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"), F.min("positions").alias("least"), F.max("positions").alias("most")
    )


@query("SELECT r_name AS region, n_name, CAST(r_regionkey * 25 + n_nationkey AS BIGINT) AS row FROM region CROSS JOIN nation")
def plan_alias(s: SparkSession, d: str) -> DataFrame:
    grid = _grid(s, d)
    steps = [Step("s0", (Import("g", grid, ("r_name",), "region"),)), Step("s1", (Import("g", grid, ("n_name",)),), ("s0",))]
    return workplan.build(steps).states["s1"].select("region", "n_name", "row")


@query("SELECT r_name, n_name, k FROM region CROSS JOIN nation CROSS JOIN (SELECT unnest(['a', 'b']) AS k)")
def plan_overlap(s: SparkSession, d: str) -> DataFrame:
    """What a step inherits drops out of its import, which then counts as a projection of the rest."""
    grid = _grid(s, d)
    steps = [Step("s0", (Import("g", grid, ("r_name",)),)), Step("s1", (Import("g", grid),), ("s0",))]
    return workplan.build(steps).states["s1"].select("r_name", "n_name", "k")


@query("SELECT unnest(['r', 'rn']) AS step, unnest([5, 125])::BIGINT AS n, unnest(['both', 'both']) AS analysis")
def plan_selected(s: SparkSession, d: str) -> DataFrame:
    steps = [Step("n", (Import("n", _nation(s, d)),)), Step("r", (Import("r", _region(s, d)),)), Step("rn", (Import("n", _nation(s, d)),), ("r",))]
    plan = workplan.build(steps, {"both": "rn", "nations": "n"})
    chosen, analyses = workplan.selected(plan, ["both"])
    counts = [plan.states[n].agg(F.lit(n).alias("step"), F.count(F.lit(1)).alias("n"), F.lit(",".join(analyses)).alias("analysis")) for n in chosen]
    return counts[0].unionByName(counts[1])


@query("SELECT v.k AS letters, r_name FROM region, (SELECT unnest(['x', 'y']) AS k) v")
def plan_import_values(s: SparkSession, d: str) -> DataFrame:
    steps = [Step("s", (Import("letters", workplan.as_grid(s, ["x", "y"], "letters")), Import("r", _region(s, d), ("r_name",))))]
    return workplan.build(steps).states["s"].select("letters", "r_name")


@query("SELECT CAST(a.r_regionkey * 5 + b.r_regionkey AS BIGINT) AS row, a.r_regionkey, b.r_name FROM region a CROSS JOIN region b")
def plan_diamond(s: SparkSession, d: str) -> DataFrame:
    region = _region(s, d)
    parents = [Step("p1", (Import("r", region, ("r_regionkey",)),)), Step("p2", (Import("r", region, ("r_name",)),))]
    return workplan.build([*parents, Step("c", (), ("p1", "p2"))]).states["c"].select("row", "r_regionkey", "r_name")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def plan_diamond_reimport(s: SparkSession, d: str) -> DataFrame:
    nation = _nation(s, d)
    parents = [Step("p1", (Import("n", nation, ("n_nationkey",)),)), Step("p2", (Import("n", nation, ("n_name",)),))]
    return workplan.build([*parents, Step("c", (Import("n", nation, ("n_regionkey",)),), ("p1", "p2"))]).states["c"].select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_name FROM region WHERE r_regionkey < 2")
def plan_limit(s: SparkSession, d: str) -> DataFrame:
    grid = _grid(s, d)
    steps = [Step("s0", (Import("g", grid, ("r_name",)),)), Step("s1", (Import("g", grid, ("n_name",)),), ("s0",))]
    plan = workplan.build(steps)
    return workplan.limited_parents(plan, "s1", 27)["s0"].select("r_name")


@query("SELECT r_name AS \"g.r_name\", NULL AS \"g.n_name\", 's0' AS step FROM region UNION ALL SELECT r_name, n_name, 's1' FROM region CROSS JOIN nation")
def plan_parameters(s: SparkSession, d: str) -> DataFrame:
    grid = _grid(s, d)
    steps = [Step("s0", (Import("g", grid, ("r_name",)),)), Step("s1", (Import("g", grid, ("n_name",)),), ("s0",))]
    return workplan.parameters(workplan.build(steps)).drop("row")


@query("""
WITH r AS (SELECT event_type AS step, CASE event_id % 3 WHEN 0 THEN 'FINISHED' WHEN 1 THEN 'ERROR' ELSE 'BLOCKED' END AS status, event_id % 10 AS duration FROM events)
SELECT step, count(*) FILTER (status = 'FINISHED') AS finished, count(*) FILTER (status = 'ERROR') AS error, count(*) FILTER (status = 'BLOCKED') AS blocked,
       count(*) AS total, CAST(sum(duration) AS DOUBLE) AS duration FROM r GROUP BY ROLLUP (step)
""")
def status_pivot(s: SparkSession, d: str) -> DataFrame:
    third = F.col("event_id") % 3
    records = _t(s, d, "events").select(
        F.col("event_type").alias("step"), F.when(third == 0, "FINISHED").when(third == 1, "ERROR").otherwise("BLOCKED").alias("status"), (F.col("event_id") % 10).cast("double").alias("duration")
    )
    return status.pivot(records).select("step", "finished", "error", "blocked", "total", "duration")


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'INTERRUPTED' WHEN bool_or(event_id % 3 = 0) THEN 'ERROR' ELSE 'FINISHED' END AS status FROM events GROUP BY user_id")
def status_final_by(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "INTERRUPTED").when(F.col("event_id") % 6 == 3, "ERROR").when(F.col("event_id") % 6 == 0, "BLOCKED").otherwise("FINISHED")
    return status.final_status(_t(s, d, "events").select("user_id", kind.alias("status")), "user_id")


@query("SELECT 'ERROR' AS status")
def status_final(s: SparkSession, d: str) -> DataFrame:
    return status.final_status(_t(s, d, "events").select(F.when(F.col("event_id") == 3, "ERROR").otherwise("FINISHED").alias("status")))
