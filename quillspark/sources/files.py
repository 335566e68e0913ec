"""CSV of unknown dialect, star snapshots, notation catalogues, file digests."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .split_csv import read_csv  # noqa: F401 (readers are found here)

SNAPSHOT = "schema_version int, search array<struct<full_name:string,stars:long>>, lookups map<string,struct<full_name:string,stars:long>>"


def dialect(head: bytes) -> tuple[str, str]:
    """(encoding, separator) of a CSV by its first bytes: UTF-8 or else Windows-1252, and the separator that its first line has most."""
    try:
        first, encoding = head.decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError as e:
        # A character cut off at the very end is no sign of another encoding.
        if e.start >= len(head) - 3 and e.reason == "unexpected end of data":
            first, encoding = head[: e.start].decode("utf-8-sig"), "UTF-8"
        else:
            first, encoding = head.decode("cp1252", "replace"), "windows-1252"
    line = first.split("\n", 1)[0]
    return encoding, max(",;\t", key=line.count)


def read_snapshot(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """(search results in their order, looked-up repositories by stored name) of a frozen star snapshot.

    A snapshot of another version, or whose search results aren't in the order of their stars, is an error.
    """
    doc = spark.read.schema(SNAPSHOT).json(path, multiLine=True)
    found = doc.select("schema_version").first()
    if found is None or found[0] != version:
        raise ValueError(f"snapshot version {found and found[0]} is not {version}")
    ranked = doc.select(F.posexplode("search").alias("place", "r")).select((F.col("place") + 1).alias("rank"), "r.full_name", "r.stars")
    ordered = doc.select(F.forall(F.sequence(F.lit(1), F.size("search") - 1), lambda i: F.element_at("search", i)["stars"] >= F.element_at("search", i + 1)["stars"])).filter(F.size("search") > 1).first()
    if ordered is not None and not ordered[0]:
        raise ValueError("search results are not in the order of their stars")
    looked = doc.select(F.explode("lookups").alias("stored_name", "r")).select("stored_name", "r.full_name", "r.stars").filter("full_name IS NOT NULL")
    return ranked, looked


def read_catalogue(path: str) -> list[dict]:
    """A notation catalogue of YAML or JSON, in the form of operators.notations.CATALOGUE."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        rows = json.loads(text)
    else:
        import yaml

        rows = yaml.safe_load(text)
    rows = rows["notations"] if isinstance(rows, dict) else rows
    return [dict(row) for row in rows]


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 of files (below 2 GB each)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_facts(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file on the driver."""
    return Path(path).stat().st_size, file_sha256(path)


def read_lines_csv(path: str) -> list[dict]:
    """A small CSV as rows, on the driver, in whatever dialect."""
    raw = Path(path).read_bytes()
    encoding, sep = dialect(raw)
    return list(csv.DictReader(raw.decode("utf-8-sig" if encoding == "UTF-8" else "cp1252").splitlines(), delimiter=sep))
