"""Readers of the corpus formats. Schemas are given, so that nothing is scanned twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = (
    "claim_id string, claim_type string, source_doi string, confidence string, verbatim_quote string, evidence_locator string, extracted_at string, view_paths map<string,array<string>>, data string"
)
SOURCE = "doi string, title string, authors array<string>, year int, venue string, citation_count int, abstract string"
NODE = "view_id string, path string, name string, level int, claim_count long, children array<string>"
EXTRACTION = "doi string, model string, extracted_at string, data struct<claims: array<struct<claim_type: string, content: string, confidence: string, quote: string>>>"


def json_files(spark: SparkSession, folder: str, schema: str, multi_line: bool = True) -> DataFrame:
    """A record per file, with the file's name; multi_line off reads JSON lines."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(folder).withColumn("_file", F.input_file_name())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are kept with null columns and their text in _bad."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Nodes with children from the paths of others, rather than from what a file says."""
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    kids = nodes.filter(F.col("path") != "").groupBy("view_id", parent.alias("path")).agg(F.array_sort(F.collect_set("path")).alias("children"))
    return nodes.drop("children").join(kids, ["view_id", "path"], "left")


def claim_id(doi, kind, content):
    """Sixteen hex digits of SHA-256 over doi:type:content."""
    return F.substring(F.sha2(F.concat_ws(":", doi, kind, content), 256), 1, 16)


def extractions(raw: DataFrame, metadata: DataFrame) -> DataFrame:
    """Claims of nested extraction results: exploded, with ids and the paper's metadata (doi, ...); papers without claims give none."""
    c = raw.select(F.lower("doi").alias("doi"), "model", F.explode("data.claims").alias("c"))
    flat = c.select("doi", "model", "c.claim_type", "c.content", "c.confidence", "c.quote")
    return flat.withColumn("claim_id", claim_id(F.col("doi"), F.col("claim_type"), F.col("content"))).join(metadata.withColumn("doi", F.lower("doi")), "doi", "left")
