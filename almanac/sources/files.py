"""Files of other kinds: typed CSV, JSON pages, expression exports, document archives, strict JSON, sealed folders."""

from __future__ import annotations

import json
import math
import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.functions import dsl

MOST_BYTES, MOST_EXPRESSIONS = 2_000_000, 10_000


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV by a given schema, so that a float column comes back as the same float; a row that does not fit fails the query."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def json_pages(spark: SparkSession, path: str, record: str, key: list[str]) -> DataFrame:
    """The records (a DDL struct body) in body.result.data of saved responses, one JSON document per file; a response without a result has none. A repeated key fails the query."""
    from pyspark.sql import Window as W

    pages = spark.read.schema(f"body struct<result: struct<data: array<struct<{record}>>>>").option("multiLine", True).json(path)
    rows = pages.select(F.explode("body.result.data").alias("r")).select("r.*")
    n = F.count("*").over(W.partitionBy(*key))
    return rows.withColumn("_ok", F.when(n > 1, F.raise_error(F.lit("a record is repeated"))).otherwise(F.lit(True))).where("_ok").drop("_ok")


def records(fields: Column | str, values: Column | str) -> Column:
    """A map from field names to the values of the same places; of different lengths the query fails."""
    f, v = (F.col(c) if isinstance(c, str) else c for c in (fields, values))
    return F.when(F.size(f) == F.size(v), F.map_from_arrays(f, v)).otherwise(F.raise_error(F.lit("fields and values differ in number")))


def expressions(spark: SparkSession, path: str) -> DataFrame:
    """(expression) of an export: a CSV with a column `exprs`, or a JSON object with an array of that name. Files are at most 2 MB and 10,000 expressions."""
    size = spark.read.format("binaryFile").load(path).select("length").first()
    if size is None or size.length > MOST_BYTES:
        raise ValueError("an export is one file of 2 MB at most")
    if path.endswith(".json"):
        rows = spark.read.schema("exprs array<string>").option("multiLine", True).json(path).select(F.explode("exprs").alias("expression"))
    else:
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)
        if "exprs" not in raw.columns:
            raise ValueError("an export has a column exprs")
        rows = raw.select(F.col("exprs").alias("expression"))
    n, empty = rows.agg(F.count("*"), F.count_if(F.col("expression").isNull())).first()
    if empty or not 0 < n <= MOST_EXPRESSIONS:
        raise ValueError("an export has 1 to 10,000 expressions, none of them missing")
    return rows


def documents(spark: SparkSession, path: str, index: DataFrame, title: str, start, end, most: int) -> DataFrame:
    """The index rows (file, title, date) whose title matches and whose date is in the window, the first `most` by date and file, with the archived bytes and their sha256.

    A listed document that is not in the archive has null content.
    """
    wanted = index.where(F.col("title").rlike(title) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date", "file").limit(most)
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content", F.sha2("content", 256).alias("sha256"))
    return wanted.join(files, "file", "left")


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.option("header", header).option("sep", sep).csv(path)


def write_calendar(dates: DataFrame, path: str) -> None:
    """One date a line, in order."""
    dates.select(F.date_format("dt", "yyyy-MM-dd").alias("value")).distinct().orderBy("value").coalesce(1).write.text(path)


def write_instruments(intervals: DataFrame, path: str) -> None:
    """Instrument, first and last date, separated by tabs."""
    out = intervals.select("inst", F.date_format("start_dt", "yyyy-MM-dd").alias("s"), F.date_format("end_dt", "yyyy-MM-dd").alias("e")).orderBy("inst", "s")
    write_csv(out, path, "\t", header=False)


def strict_json(value) -> str:
    """JSON in which NaN and infinities are null."""

    def clean(x):
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)


def write_json(value, path: str) -> None:
    """strict_json in a file of the driver's, put in place whole: a reader sees the old file or the new one."""
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(strict_json(value) + "\n")
        os.replace(temporary, path)
    except BaseException:
        os.remove(temporary)
        raise


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one line of JSON: nulls are written, NaN and infinities become null."""
    tidy = [F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*tidy), {"ignoreNullFields": "false"}).alias("value"))


def sealed(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(file, sha256): the checksum of every file of a folder, computed where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/")
    name = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape(root) + "/", "")
    return files.select(name.alias("file"), F.sha2("content", 256).alias("sha256"))


def seal_violations(spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """(file, reason): files that a manifest (file, sha256) does not have, lacks, or has with another checksum."""
    now = sealed(spark, path, pattern).withColumnRenamed("sha256", "_now")
    both = manifest.join(now, "file", "full_outer")
    reason = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_now") != F.col("sha256"), "changed")
    return both.select("file", reason.alias("reason")).where("reason is not null")


#: Rolling functions of two export dialects and their names here; functions that mean the same there; the fields that exports have.
DIALECTS = {
    "alphaforge": {"ts_mean": "Mean", "ts_std": "Std", "ts_max": "Max", "ts_min": "Min", "ts_delta": "Delta"},
    "alphasage": {"TsMean": "Mean", "TsStd": "Std", "TsMax": "Max", "TsMin": "Min", "TsDelta": "Delta"},
}
SHARED = ("Abs", "Inv", "Add", "Sub", "Mul", "Div", "Ref")
EXPORTED = frozenset("open close high low volume vwap".split())


def translate(dialect: str, text: str) -> str:
    """An exported expression in the language of functions.dsl. $close is a field; Inv(x) is 1 / x.

    Names are put in our words, the text is parsed as our own language, and the tree is then held against what does
    not carry over: other fields, a change over no time, and functions over time (or Abs) of a constant. Functions that no table lists
    are refused, among them Log and the ranks, whose meaning differs.
    """
    if dialect not in DIALECTS or not isinstance(text, str) or not 0 < len(text) <= 4000:
        raise dsl.ExpressionError("unknown dialect or text")
    names = DIALECTS[dialect] | {name: name for name in SHARED}

    def ours(call: re.Match) -> str:
        if call[1] not in names:
            raise dsl.ExpressionError(f"no counterpart of {call[1]}")
        return "Div(1, " if call[1] == "Inv" else f"{names[call[1]]}("

    tree = dsl.parse(re.sub(r"([A-Za-z_]\w*)\s*\(", ours, re.sub(r"\$(?=[A-Za-z_])", "", text)))
    if not dsl.fields(tree) <= EXPORTED:
        raise dsl.ExpressionError("a field that exports do not have")
    for part in dsl.parts(tree):
        if (part[0] == "Abs" or part[0] in dsl.WINDOWED) and not dsl.fields(part[1]):
            raise dsl.ExpressionError(f"{part[0]} of a constant")
        if part[0] == "Delta" and part[2] == 0:
            raise dsl.ExpressionError("a change over no time means something else there")
    return dsl.render(tree)
