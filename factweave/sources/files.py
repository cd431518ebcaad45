"""File sources and sinks: documents as bytes, facts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.dedupe import best_by
from factweave.schema import FACT


def content_id(content: str = "content"):
    """The first sixteen hex digits of the SHA-256 of a document's bytes."""
    return F.substring(F.sha2(F.col(content), 256), 1, 16)


def read_binaries(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, filename, content) of files; the same bytes under two names are one document, named by the first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    named = files.select(content_id().alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "path")
    first = named.groupBy("doc_id").agg(F.min(F.struct("filename", "path")).alias("f")).select("doc_id", "f.filename", "f.path")
    return first.join(files.select("path", "content"), "path").select("doc_id", "filename", "content")


def read_facts_json(spark: SparkSession, *paths: str) -> DataFrame:
    """Facts of JSON arrays or JSON lines in several files; of one fact_id the last file's last stays."""
    found = None
    for k, p in enumerate(paths):
        df = spark.read.schema(FACT).option("multiLine", "true").json(p).withColumn("__file", F.lit(k)).withColumn("__row", F.monotonically_increasing_id())
        found = df if found is None else found.unionByName(df)
    return best_by(found, ["fact_id"], "__file", "__row").drop("__file", "__row")


def write_facts_json(facts: DataFrame, path: str) -> None:
    facts.write.mode("overwrite").json(path)


def facts_per_document(facts: DataFrame) -> DataFrame:
    """(doc_id, stats): what a bulk load knows of each document, with nothing proposed and all kept."""
    return facts.groupBy("doc_id").agg(F.struct(F.lit(0).alias("proposed"), F.count(F.lit(1)).cast("int").alias("kept")).alias("stats"))


def accept_uploads(binaries: DataFrame, filings: DataFrame) -> DataFrame:
    """Uploads (doc_id, filename, content) to take in: PDF files that the store does not hold, under names without folders."""
    name = F.regexp_replace(F.regexp_replace("filename", r"^.*[/\\\\]", ""), r"[^\w.\- ]", "_")
    clean = binaries.withColumn("filename", name).where(F.lower("filename").endswith(".pdf"))
    return clean.join(filings.select("doc_id"), "doc_id", "left_anti")
