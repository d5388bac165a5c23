"""Flat files: JSON with an explicit schema, delimited text, role maps, fingerprints; and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import safe_list

ROLE = "array<struct<name: string, on_type: boolean, on_subtype: boolean, is_target: boolean>>"
TYPOLOGY = f"full_name string, maintype_name string, subtype_name string, participant {ROLE}, filler {ROLE}"


def typology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TYPOLOGY).option("multiLine", True).json(path)


def role_map(spark: SparkSession, path: str) -> DataFrame:
    """(old_role, new_role) of a JSON object new role -> old roles."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("new_role", "old")).select(F.explode("old").alias("old_role"), "new_role")


def renamed_roles(df: DataFrame, roles: DataFrame, column: str) -> DataFrame:
    """df with roles renamed by (old_role, new_role); unknown ones stay."""
    return df.join(roles.withColumnRenamed("old_role", column), column, "left").withColumn(column, F.coalesce("new_role", column)).drop("new_role")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents by line, with the stem of their file as split."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:-\d+)?\.", 1)
    return spark.read.schema(schema).json(path).withColumn("split", name)


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: md5 over the ordered names and md5s of all files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.md5("path").alias("k"), F.md5(F.concat_ws("|", "path", F.md5("content"))).alias("h"))
    # A tree of hex digits: each fold puts together what differs in the next three, so that no task holds more than its share.
    for digits in (9, 6, 3, 0):
        files = files.groupBy(F.substring("k", 1, digits).alias("k2")).agg(folded("k", "h").alias("h")).select(F.col("k2").alias("k"), "h")
    return files.select(F.col("h").alias("fingerprint"))


def folded(key: str, value: str) -> Column:
    """md5 of a group's md5s in order of their keys."""
    return F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""))


def cached(spark: SparkSession, path: str, stage: str, key: str, make) -> DataFrame:
    """The table of that stage and key under path, made and written if it isn't there."""
    target = f"{path}/{stage}-{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, by: list[str] | None = None) -> None:
    """Blank for null; one folder for each value of `by`."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).csv(path, sep=sep, header=header, nullValue="", emptyValue="")


def write_json_lines(df: DataFrame, path: str, column: str, by: list[str] | None = None) -> None:
    """A column of JSON text, one document a line."""
    writer = df.select(F.col(column).alias("value"), *(by or [])).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).text(path)


def split_ids(df: DataFrame, split: str, key: str) -> DataFrame:
    """(split, key): the distinct ids of each split as rows, to be written by split as JSON lines."""
    return df.select(split, key).filter(F.col(key).isNotNull()).distinct()


def span_table(spark: SparkSession, path: str, columns: list[str], lists: list[str]) -> DataFrame:
    """A tab-separated table with a header, whose list columns hold lists as they are written in code; a bad list is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return delimited(spark, path, schema).withColumns({c: safe_list(F.col(c)) for c in lists})


def marked(text: str, part: str, start: str = r"\underline{", end: str = "}"):
    """A text with its first occurrence of a part marked up."""
    t, p = F.col(text), F.col(part)
    at = F.expr(f"locate({part}, {text})")
    return F.when(at > 0, F.concat(F.expr(f"left({text}, locate({part}, {text}) - 1)"), F.lit(start), p, F.lit(end), F.expr(f"substring({text}, locate({part}, {text}) + length({part}))"))).otherwise(t)
