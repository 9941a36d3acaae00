"""Sinks: parsed lines and labelled rows as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.corpus import corpus_row


def parsed_json(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep, value): {line, name, amounts, modifier} of (line, parsed), null modifiers written as null."""
    amounts = F.transform("parsed.amounts", lambda m: F.struct(m["unit"].alias("unit"), m["value"].alias("value"), m["upper_value"].alias("upper_value")))
    return rows.select(*keep, F.to_json(F.struct("line", F.col("parsed.name").alias("name"), amounts.alias("amounts"), F.col("parsed.modifier").alias("modifier")), {"ignoreNullFields": "false"}).alias("value"))


def write_parsed(rows: DataFrame, path: str) -> None:
    parsed_json(rows).write.text(path)


def corpus_rows(lines: DataFrame) -> DataFrame:
    """(line, json, refused) of (line), and what other columns there are."""
    return lines.select("*", corpus_row("line").alias("__r")).select(*lines.columns, "__r.json", "__r.refused")


def write_corpus(lines: DataFrame, path: str) -> None:
    """The labelled rows of the lines that make one."""
    corpus_rows(lines).where("json is not null").select(F.col("json").alias("value")).write.text(path)
