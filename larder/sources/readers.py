"""Sources: pages, books, labelled lines and plain lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators import books, corpus


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of a Parquet table of pages."""
    return spark.read.parquet(path).select("url", "html")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, authors, subjects, identifiers, content) of every .epub below a folder; the title is the file's name without one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)
    meta = files.select("path", "content", books.book_metadata("content").alias("m"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    return meta.select("path", F.coalesce("m.title", stem).alias("title"), "m.authors", "m.subjects", "m.identifiers", "content")


def read_book_lines(spark: SparkSession, path: str) -> DataFrame:
    """(book, pos, doc_path, text, links, images) of every book below a folder."""
    rows = read_books(spark, path).select(F.col("path").alias("book"), F.posexplode(books.book_lines("content")).alias("pos", "line"))
    return rows.select("book", "pos", "line.*")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text): whole files are read, as the number of a line depends on all before it."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, section, labels, problem) of JSON lines with comments and section headers."""
    return corpus.parse_corpus(_numbered(spark, path), ["file"])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
