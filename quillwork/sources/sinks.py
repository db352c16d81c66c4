"""Sinks: write-once records, JSON lines, flat exports, appended sections, Markdown tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def content_path(folder: str, *parts: str) -> str:
    return f"{folder}/{hashlib.sha256('/'.join(parts).encode()).hexdigest()}"


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def flat_export(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays, maps and structs as JSON text."""
    nested = {f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")}
    flat = df.select(*[F.to_json(F.col(c)).alias(c) if c in nested else F.col(c) for c in df.columns])
    flat.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_section(df: DataFrame, path: str, section: str) -> None:
    """Add a section to an export laid out by section; a section that is there is never overwritten."""
    df.withColumn("section", F.lit(section)).write.mode("errorifexists").parquet(f"{path}/section={section}")


def markdown(df: DataFrame, caption: str, most: int = 1000) -> str:
    """A report table; df is small by construction, and more than most rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"**{caption}**", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
