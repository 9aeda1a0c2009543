"""The driver's tables as the data model's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import simhash


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _files(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """A document is a text file of the supplier ``source``."""
    path = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return _files(
        table(spark, folder, "documents"), submission_id=F.col("source"), supplier=F.col("source"), zip_name=F.concat("source", F.lit(".zip")), path=path, name=path, kind=F.lit("text"),
        size=F.octet_length("text").cast("long"), sha256=F.sha2("text", 256), ord=F.col("doc_id"), attributes=F.create_map().cast("map<string,string>"), text=F.col("text"), doc_id=F.col("doc_id"), lang=F.col("lang"),
    )


def fingerprinted(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).withColumn("fingerprint", simhash("text"))


def attributed(spark: SparkSession, folder: str, prints: bool = False) -> DataFrame:
    """Documents as word, pdf and image files in turn, with attributes: the first line as author, the language as program, the label's quality as revision; if asked for with fingerprints. What comes of the text is taken before the join, so that texts needn't be shuffled."""
    files = (fingerprinted if prints else documents)(spark, folder).withColumn("author", F.split_part("text", F.lit("\n"), F.lit(1)))
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("label_id"), "quality")
    kind = F.element_at(F.array(*map(F.lit, ("word", "pdf", "image"))), (F.col("doc_id") % 3 + 1).cast("int"))
    program = F.when(F.col("kind") == "word", "application").when(F.col("kind") == "pdf", "producer").otherwise("software")
    joined = files.join(labels, F.col("doc_id") == F.col("label_id"), "left").withColumn("kind", kind)
    revision = F.when(F.col("kind") == "word", F.col("quality").cast("string"))
    return joined.withColumn("attributes", F.create_map(F.lit("author"), F.col("author"), program, F.col("lang"), F.lit("revision"), revision)).drop("label_id", "quality", "author")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page is a pdf of the supplier that its host is; title, language and links come from the markup."""
    path = F.concat(F.lit("page_"), F.col("page_id").cast("string"))
    html = F.col("html")
    return _files(
        table(spark, folder, "pages"), submission_id=F.parse_url("url", F.lit("HOST")), supplier=F.parse_url("url", F.lit("HOST")), zip_name=F.concat(F.parse_url("url", F.lit("HOST")), F.lit(".zip")), path=path, name=path, kind=F.lit("pdf"),
        size=F.octet_length("html").cast("long"), sha256=F.sha2("html", 256), ord=F.col("page_id"),
        attributes=F.create_map(F.lit("title"), F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("producer"), F.regexp_extract(html, '<html lang="([^"]*)"', 1)),
        lists=F.create_map(F.lit("externalLinks"), F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))), url=F.col("url"), html=html, page_id=F.col("page_id"),
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    """An event is a word file of the supplier that its user is, with a revision from its JSON."""
    path = F.concat(F.lit("event_"), F.col("event_id").cast("string"))
    return _files(
        table(spark, folder, "events"), submission_id=F.col("user_id").cast("string"), supplier=F.col("user_id").cast("string"), zip_name=F.col("user_id").cast("string"), path=path, name=path, kind=F.lit("word"),
        size=F.octet_length("props").cast("long"), sha256=F.sha2("props", 256), ord=F.col("event_id"), attributes=F.create_map(F.lit("revision"), F.get_json_object("props", "$.k")), event_type=F.col("event_type"),
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """A turn is a file of the submission that its conversation is."""
    path = F.concat(F.col("turn").cast("string"), F.lit("_"), "role", F.lit(".txt"))
    owner = F.col("conv_id").cast("string")
    return _files(table(spark, folder, "conversations"), submission_id=owner, supplier=owner, zip_name=F.concat(owner, F.lit(".zip")), path=path, name=path, kind=F.lit("text"), size=F.octet_length("text").cast("long"), sha256=F.sha2("text", 256), ord=F.col("conv_id") * 100000 + F.col("turn"))
