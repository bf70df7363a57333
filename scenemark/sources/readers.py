"""Readers; every schema is given, none is inferred."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scenemark import schemas
from scenemark.sources.splits import SPLIT, before_splits, json_records, placed_lines


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """SRC-1: one record per line; malformed lines become NULL rows (see read_jsonl_checked)."""
    return spark.read.schema(schema).json(path)


def read_jsonl_checked(spark: SparkSession, path: str | list[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1 / RES-3: (rows, rejects); a line that is no record of the schema is a reject
    (line, file).  Empty lines are skipped."""
    given = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = given.withColumn("_r", F.from_json("line", f"{schema}, _bad string", options))
    good = F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    return parsed.filter(good).select("_r.*").drop("_bad"), parsed.filter(~good).select("line", "file")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-2: one JSON array per file, of anything.  A file is one split: for large arrays of
    objects see ``read_json_records``."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def to_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def read_json_map(spark: SparkSession, path: str, value_schema: str, key: str = "key") -> DataFrame:
    """SRC-3: a JSON object keyed by id, one row per key.  A file is one split, see
    ``read_json_entries`` for large ones."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "v")).select(key, "v.*")


def _parsed(rows: DataFrame, text: str, schema: str, carry: list) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is a record of the schema, and (line, file) of the others."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    read = rows.withColumn("_r", F.from_json(text, f"{schema}, _bad string", options))
    good = F.col("whole") & F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    return read.filter(good).select(*carry, "_r.*").drop("_bad"), read.filter(~F.coalesce(good, F.lit(False))).select(F.col("text").alias("line"), "file")


def read_json_records(spark: SparkSession, path: str | list[str], schema: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-2 / RES-3: (rows, rejects) of JSON arrays of objects, read by as many tasks as the files
    have splits, however their lines are broken.  A reject is (line, file): an object that does
    not fit the schema, or what is left of a broken file.  ``order`` names a column for the
    record's number in its file."""
    carry = [F.col("record").alias(order)] if order else []
    return _parsed(json_records(spark, path, False), "text", schema, carry)


def read_json_entries(spark: SparkSession, path: str | list[str], schema: str, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """SRC-3 / RES-3: the same for JSON maps whose values are objects, with the key as a column."""
    entry = r'(?s)^("(?:[^"\\]|\\.)*")\s*:\s*(.*)$'
    found = json_records(spark, path, True)
    name = F.from_json(F.concat(F.lit('{"k":'), F.regexp_extract("text", entry, 1), F.lit("}")), "k string")["k"]
    parts = found.withColumn("_key", name).withColumn("_value", F.regexp_extract("text", entry, 2))
    return _parsed(parts.withColumn("whole", F.col("whole") & F.col("_key").isNotNull()), "_value", schema, [F.col("_key").alias(key)])


def read_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-4: jsonl or json by suffix."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".json"):
        return read_json_array(spark, path, schema)
    raise ValueError(f"unsupported file type: {path}")


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    """SRC-5: with a header line; quoted fields may hold quotes, and with ``multiline`` line
    breaks too, at the price of one task per file."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)


def read_csv_checked(spark: SparkSession, path: str | list[str], schema: str, multiline: bool = False, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """SRC-5 / SRC-6 / RES-3: (rows, rejects); a line with too few or too many fields, or with one
    that does not fit its type, is a reject (line, file).  All fields are parsed even where few
    are selected, so what is a reject does not depend on the query."""
    given = spark.read.schema(f"{schema}, _bad string").option("header", True).option("escape", '"').option("sep", sep).option("multiLine", multiline)
    read = given.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("columnPruning", False).csv(path)
    fields = [c for c in read.columns if c != "_bad"]
    # always true, but asks for every field
    lines = read.filter(F.hash(*fields) >= -(1 << 31)).select("*", F.col("_metadata.file_path").alias("_file"))
    return lines.filter("_bad IS NULL").drop("_bad", "_file"), lines.filter("_bad IS NOT NULL").select(F.col("_bad").alias("line"), F.col("_file").alias("file"))


def blank_none(col: str) -> Column:
    """NULL for the texts nan and none in any case."""
    return F.when(~F.lower(F.trim(F.col(col))).isin("nan", "none"), F.col(col))


def read_options_tsv(spark: SparkSession, path: str, schema: str, options: list[str]) -> DataFrame:
    """SRC-6: tab-separated; option texts nan/none become NULL."""
    df = spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)
    return _blanked(df, options)


def _blanked(df: DataFrame, options: list[str]) -> DataFrame:
    return df.select(*[blank_none(c).alias(c) if c in options else F.col(c) for c in df.columns])


def read_options_checked(spark: SparkSession, path: str | list[str], schema: str, options: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-6 / RES-3: (rows, rejects) of an options table, see ``read_csv_checked``."""
    rows, rejects = read_csv_checked(spark, path, schema, sep="\t")
    return _blanked(rows, options), rejects


def read_shards(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """SRC-7: shard outputs N_i.jsonl together, with the shard number."""
    df = spark.read.schema(schema).json(pattern)
    return df.withColumn("shard", F.regexp_extract(F.input_file_name(), r"\d+_(\d+)\.jsonl", 1).cast("int"))


def read_ordered(spark: SparkSession, paths: list[str], schema: str, start: int = 0) -> tuple[DataFrame, DataFrame]:
    """SRC-8: (rows, rejects) of several files of JSON lines in the order given, with one running
    ``id`` over their records in the order of the lines; no column has to tell the order.

    A path that is a folder counts its files in the order of their names.  Empty lines have no
    id, and neither have rejects (line, file)."""
    lines = [placed_lines(spark, p).withColumn("_part", F.lit(i)) for i, p in enumerate(paths)]
    every = functools.reduce(DataFrame.unionByName, lines).filter(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = every.withColumn("_r", F.from_json("value", f"{schema}, _bad string", options))
    good = F.col("_r").isNotNull() & F.col("_r._bad").isNull()
    rows = parsed.filter(good)
    offsets = before_splits(rows, F.lit(1), ["_part", "file"])
    at = F.row_number().over(Window.partitionBy("_part", *SPLIT).orderBy("mid"))
    numbered = rows.withColumn("_at", at).join(offsets, ["_part", *SPLIT])
    out = numbered.select("_r.*", (F.col("before") + F.col("_at") - 1 + start).cast("bigint").alias("id")).drop("_bad")
    return out, parsed.filter(~good).select(F.col("value").alias("line"), "file")


def read_predictions(spark: SparkSession, root: str, schema: str = schemas.PREDICTIONS) -> DataFrame:
    """SRC-9: root/model=…/perspective=… with partition pruning on both."""
    return spark.read.schema(schema).option("basePath", root).json(root)


def read_qa_parquet(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-10: (rows, rejects) of question/answers parquet files.  The first answer counts;
    image bytes are not read unless selected later; rows without question or answer are
    rejected."""
    df = spark.read.parquet(*paths)
    out = df.select("question", F.get("answers", F.lit(0)).alias("answer"))
    bad = F.col("question").isNull() | F.col("answer").isNull()
    return out.filter(~bad), out.filter(bad)
