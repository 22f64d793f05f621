"""Delimited and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import translate
from ..functions.values import FLOAT, INT, GridError, check_names


def infer(raw: DataFrame) -> DataFrame:
    """Type all-text columns by their whole content, in one aggregate pass.

    A column is boolean if every cell is true or false in any case, else long, else finite double, else text; an empty
    cell or no rows at all make it text, and white space isn't trimmed.
    """
    def fits(c: str, shape: str, cast: str | None) -> F.Column:
        cell = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        ok = cell.rlike(shape)
        if cast:
            value = cell.try_cast(cast)
            ok = ok & value.isNotNull() & (F.lit(True) if cast == "bigint" else ~value.isin(float("inf"), float("-inf")))
        return F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False))

    kinds = {"boolean": (r"^(?i:true|false)\z", None), "bigint": (INT, "bigint"), "double": (FLOAT, "double")}
    verdict = raw.agg(*(fits(c, *shape).alias(f"{i}_{kind}") for i, c in enumerate(raw.columns) for kind, shape in kinds.items())).first()
    typed = []
    for i, c in enumerate(raw.columns):
        kind = next((k for k in kinds if verdict[f"{i}_{k}"]), "string")
        cell = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        typed.append((F.lower(cell) == "true" if kind == "boolean" else cell.cast(kind)).alias(c))
    return raw.select(*typed)


def delimiter(path: str, first: str | None) -> str:
    """By the ending `.tsv` or `.csv`; else a tab if the first line that isn't empty has one and no comma."""
    ending = path.rsplit("/", 1)[-1].lower()
    if ending.endswith((".tsv", ".csv")):
        return "\t" if ending.endswith(".tsv") else ","
    return "\t" if first is not None and "\t" in first and "," not in first else ","


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, whose cells must be names and differ.

    A row of another length is an error when rows are read. A light pass over the lines finds whether any ends inside
    quotes; only then a file is read by one task, as a whole, else many share it.
    """
    lines = spark.read.text(path)
    first = next((r[0] for r in lines.where("trim(value) <> ''").take(1)), None)
    if first is None:
        raise GridError("E106", "empty file")
    sep = delimiter(path, first)
    names = check_names([x.strip('"') for x in first.removeprefix("\ufeff").split(sep)])
    schema = ", ".join(f"`{n}` string" for n in names)
    whole = lines.select(F.coalesce(F.bool_and(F.regexp_count("value", F.lit('"')) % 2 == 0), F.lit(True))).first()[0]
    raw = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', schema=schema, mode="FAILFAST", enforceSchema=True, multiLine=not whole)
    return infer(raw)


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(rel_path, text) of all files under a folder, those whose relative path the pattern matches somewhere."""
    whole = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    # The path is a URI: percent signs encode, plus signs don't.
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(decoded, "^[a-z]+:/*", "/")
    base = root.split(":", 1)[-1].rstrip("/")
    rel = F.substring(path, len("/" + base.lstrip("/")) + 2, 1 << 30)
    found = whole.select(rel.alias("rel_path"), F.col("value").alias("text"))
    return found if pattern is None else found.where(F.col("rel_path").rlike(translate(pattern).regex))


def run_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(run_id, rel_path, text, file_ix) of the files below one folder a run whose path within it the pattern matches.

    `file_ix` counts a run's files in the order of their paths.
    """
    found = read_files(spark, root).withColumn("run_id", F.substring_index("rel_path", "/", 1))
    within = F.substring(F.col("rel_path"), F.length("run_id") + 2, F.lit(1 << 30))
    kept = found.select("run_id", within.alias("rel_path"), "text").where((F.col("rel_path") != "") & F.col("rel_path").rlike(translate(pattern).regex))
    return kept.withColumn("file_ix", F.row_number().over(Window.partitionBy("run_id").orderBy("rel_path")) - 1)


def exact_files(spark: SparkSession, root: str, runs: DataFrame, name: str) -> DataFrame:
    """(run_id, text) of one file in every run's folder; a run of `runs` without it is an error when the rows are read."""
    if name.startswith("/") or ".." in name.split("/"):
        raise GridError("E411", f"{name} leads out of the run's folder")
    found = read_files(spark, root).select(F.substring_index("rel_path", "/", 1).alias("__run"), F.col("rel_path"), "text")
    found = found.where(F.col("rel_path") == F.concat("__run", F.lit("/" + name)))
    joined = runs.select("run_id").join(found, F.col("run_id") == F.col("__run"), "left")
    # As a filter the guard survives column pruning.
    missing = F.raise_error(F.concat(F.lit(f"E411: no file {name} in run "), "run_id")).cast("boolean")
    return joined.where(F.when(F.col("__run").isNull(), missing).otherwise(F.lit(True))).select("run_id", "text")
