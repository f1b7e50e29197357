"""Delimited text: sniffed on its first line, read by Spark as a table of strings; text sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import csv_cell

#: Candidate delimiters; of equally frequent ones the last wins.
DELIMITERS = (",", "\t", "|", ";")


def sniff(first_line: str) -> str:
    """The delimiter that is most frequent in a table's first line."""
    counts = [first_line.count(d) for d in DELIMITERS]
    return DELIMITERS[max(i for i, n in enumerate(counts) if n == max(counts))]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as strings: byte order mark dropped, blank rows dropped, names trimmed.

    An unterminated quote fails, like any malformed row.
    """
    head = spark.read.text(path).limit(1).collect()
    if not head:
        raise ValueError("empty table")
    first = head[0][0].lstrip("﻿")
    rows = spark.read.csv(path, sep=sniff(first), quote='"', escape='"', header=True, multiLine=True, mode="FAILFAST", enforceSchema=False,
                          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\x00", emptyValue="")
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    some = F.lit(False)
    for c in rows.columns:
        some = some | (F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) != "")
    return rows.where(some)


def column(table: DataFrame, name: str) -> str:
    """A column by its exact name, else by its name in any case."""
    if name in table.columns:
        return name
    found = [c for c in table.columns if c.lower() == name.lower()]
    if not found:
        raise ValueError(f"no column {name!r}; there are {', '.join(table.columns)}")
    return found[0]


def records(text: str) -> list[tuple[int, list[str]]]:
    """A delimited text's records (line on which one begins, trimmed cells) without blank ones; the header is the first.

    Cells may be quoted, with doubled quotes and line breaks inside; a quote that isn't closed is an error.
    """
    text = text.removeprefix("\ufeff")
    out, at = [], 0
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text.split("\n", 1)[0]), strict=True)
    try:
        for cells in reader:
            if any(c.strip() for c in cells):
                out.append((at, [c.strip() for c in cells]))
            at = reader.line_num
    except csv.Error as e:
        raise ValueError(f"line {at + 1}: a quote is not closed or stands within a cell ({e})") from None
    return out


def parse_text(texts: DataFrame, text: str, names: Sequence[str]) -> DataFrame:
    """Tables held as texts in a column: one row a record, columns by name (absent ones null), and line_no.

    Each text is small (a request's or a recipe's); files are read by `read_table`. Null texts have no records.
    """
    def run(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            found = records(t)
            head = found[0][1] if found else []
            at = [head.index(n) if n in head else None for n in names]
            out.append([{"line_no": line, "cells": [None if i is None or i >= len(cells) else cells[i] for i in at]} for line, cells in found[1:]])
        return pd.Series(out, dtype=object)

    rows = F.pandas_udf(run, "array<struct<line_no:int,cells:array<string>>>")(F.col(text))
    found = texts.where(F.col(text).isNotNull()).select(*[c for c in texts.columns if c != text], F.explode(rows).alias("_r"))
    return found.select("*", "_r.line_no", *[F.col("_r.cells")[i].alias(n) for i, n in enumerate(names)]).drop("_r")


def csv_lines(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows as CSV lines under one column, named like the header."""
    return rows.select(F.concat_ws(",", *[F.coalesce(csv_cell(c.cast("string")), F.lit("")) for c in columns.values()]).alias(",".join(columns)))


def manifest(rows: DataFrame, name: str) -> DataFrame:
    """Manifest rows in order of name as JSON lines, hashes in lower case."""
    low = rows.withColumn("sha1", F.lower("sha1")) if "sha1" in rows.columns else rows
    return low.orderBy(name).select(F.to_json(F.struct(*low.columns)).alias("json"))


def wikitext(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One information template a row: (name, text)."""
    body = F.concat_ws("\n", *[F.concat(F.lit(f"|{f}="), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    return rows.select("name", F.concat(F.lit("{{Information\n"), body, F.lit("\n}}")).alias("text"))


def license_credit(rows: DataFrame) -> DataFrame:
    """Credit text and share-alike flag of licence records (source, license, url)."""
    credit = F.concat_ws(", ", "source", "license")
    return rows.select("*", credit.alias("credit"), F.coalesce(F.col("license").rlike(r"(?i)(\bSA\b|share-?alike|ODbL)"), F.lit(False)).alias("share_alike"))
