"""CSV for spreadsheets: byte-order mark, CRLF, and cells that can't be taken for formulas."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.text import csv_cell

# The columns of an export.
COLUMNS = ("item_uid", "filename", "local_date", "local_time", "width", "height", "size_bytes", "category", "reason", "proposed_by", "status", "deleted", "url")


def safe_cells(df: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The columns as safe text; absent ones are empty."""
    return df.select(*[(csv_cell(F.col(c)) if c in df.columns else F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """Written by the executors, in as many files as there are partitions."""
    safe_cells(df, columns).write.mode("overwrite").option("header", "true").option("lineSep", "\r\n").option("quoteAll", "true").csv(path)


def export_text(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> str:
    """One text with a byte-order mark, for a page of rows that a person asked for; streamed, a partition at a time."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    for r in safe_cells(rows, columns).toLocalIterator():
        writer.writerow(list(r))
    return "﻿" + out.getvalue()
