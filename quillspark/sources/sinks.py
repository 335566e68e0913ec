"""Writers whose output is the same bytes every time."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ranked
from ..operators.storage import shared_folder
from . import ordered_csv


def numbered(df: DataFrame, prefix: str, order: list) -> DataFrame:
    """df with a leading column id such as REF-00000001 in the given total order."""
    placed = ranked(df, [c if isinstance(c, Column) else F.col(c) for c in order], "_place")
    return placed.select(F.format_string(f"{prefix}-%08d", "_place").alias("id"), *[c for c in df.columns if c != "id"])


def formatted(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles as text with so many digits, nulls as empty text."""
    def cell(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        if kind in ("double", "float"):
            x = F.when(x.isNotNull(), F.format_string(f"%.{digits}f", x.cast("double")))
        elif kind.startswith(("array", "map", "struct")):
            x = F.to_json(x)
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)

    return df.select(*[cell(c, kind) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, order: list | None = None, bom: bool = False, crlf: bool = False, refuse_empty: bool = False) -> int:
    """One CSV file on the driver's disk; returns the number of rows.

    All tasks write the parts (see ordered_csv); only their bytes are put together here, some at a time.
    """
    folder = f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    made = ordered_csv.write_parts(df, folder, order, bom=bom, crlf=crlf)
    try:
        if refuse_empty and not made["rows"]:
            raise ValueError("there is nothing to write")
        return ordered_csv.join_parts(folder, path)
    finally:
        files, at = ordered_csv.filesystem(folder)
        files.delete_dir(at)


def write_folder(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """All partitions in parallel, for results of any size."""
    df.write.mode("errorifexists").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def write_summary(tables: dict[str, DataFrame], path: str, limit: int = 10_000) -> None:
    """Small tables as one JSON file with sorted keys; a larger table is an error."""
    out = {}
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows")
        out[name] = sorted((r.asDict(recursive=True) for r in rows), key=lambda r: json.dumps(r, sort_keys=True, default=str))
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n", encoding="utf-8")


def text_report(tables: dict[str, DataFrame], rows: int = 20) -> str:
    """A plain-text report: each table under its name, its first rows aligned."""
    parts = []
    for name, df in tables.items():
        found = [[str(v) if v is not None else "" for v in r] for r in df.limit(rows + 1).collect()]
        widths = [max(map(len, col)) for col in zip(df.columns, *found[:rows], strict=True)]
        shown = ["  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [df.columns, *found[:rows]]]
        parts.append("\n".join([name, "=" * len(name), *shown, *(["..."] if len(found) > rows else [])]))
    return "\n\n".join(parts) + "\n"
