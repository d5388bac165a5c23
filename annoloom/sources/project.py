"""An exported annotation project: its metadata, its documents and type system, and a cleaned copy of the metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xmi

METADATA = "name string, annotation_documents array<struct<name: string, user: string, state: string>>"
FORMATS = ("xmi", "zip", "from_documents")
COMPANIES = "security string, industry string, subindustry string, corpussymbol string, tickersymbol string, allinfo string"


@dataclass(frozen=True)
class Project:
    """metadata: name, annotation_documents; members: path, member, content; documents: as xmi.parse gives them."""

    path: str
    metadata: DataFrame
    members: DataFrame

    @property
    def documents(self) -> DataFrame:
        return xmi.parse(self.members)


def open_project(spark: SparkSession, path: str, kind: str = "xmi") -> Project:
    """The export under path: exportedproject*.json there, and the documents of its files and zips. An unknown kind is an error; no metadata file gives no rows."""
    if kind not in FORMATS:
        raise ValueError(f"no such kind of export: {kind}; there are {FORMATS}")
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "exportedproject*.json").load(path)
    parsed = texts.select(F.from_json(F.decode("content", "UTF-8"), METADATA).alias("x"))
    return Project(path, parsed.select("x.*"), xmi.read_files(spark, path))


def type_system(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of typesystem.xml in the first zip by name that has one; no row without any."""
    found = xmi.read_files(spark, path, "*typesystem.xml").filter(F.col("path").endswith(".zip"))
    return found.groupBy().agg(F.min_by(F.struct("path", "content"), F.col("path")).alias("x")).filter("x is not null").select("x.*")


def listed_documents(project: Project) -> DataFrame:
    """(title, annotator) of the documents the metadata lists."""
    return project.metadata.select(F.explode("annotation_documents").alias("d")).select(F.col("d.name").alias("title"), F.col("d.user").alias("annotator"))


def cleaned_metadata(project: Project, kept: DataFrame) -> DataFrame:
    """The metadata (name, annotation_documents) with only the kept documents (title, annotator), to be written to a new place."""
    rows = project.metadata.select("name", F.posexplode("annotation_documents").alias("place", "d"))
    chosen = rows.join(kept.select(F.col("title").alias("t"), F.col("annotator").alias("a")).distinct(), (F.col("d.name") == F.col("t")) & (F.col("d.user") == F.col("a")), "left_semi")
    return chosen.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda x: x["d"]).alias("annotation_documents"))


def members_of(members: DataFrame, annotator: str) -> DataFrame:
    """One annotator's files out of an export: (path, member, content)."""
    return members.filter(F.regexp_extract("member", r"([^/]*?)(?:\.[^.]*)?$", 1) == annotator)


def companies(spark: SparkSession, path: str) -> DataFrame:
    """The company table, tab-separated, with symbol, its key in lower case."""
    return spark.read.schema(COMPANIES).csv(path, sep="\t", header=True).withColumn("symbol", F.lower(F.trim("corpussymbol")))
