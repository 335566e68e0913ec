"""Parser results that are kept by parser, version and content, so that a content is parsed once, whatever asks for it.

A store is a folder of epochs. An epoch's rows are written first, and count from the moment at which its
manifest, a single small file, is put in place by a rename; an epoch that was broken off has no manifest and is written
anew. Streams fill the same store: a batch's epoch is named after the query and the batch, so a batch that
is run again is found and left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.storage import small


class ResultStore:
    """Results of one parser in one version: a Parquet folder of key and result. kind: the type of a result as DDL."""

    def __init__(self, spark: SparkSession, path: str, parser: str, version: str, kind: str):
        if not parser or not version or "/" in parser + version:
            raise ValueError("parser and version must be names")
        self.spark, self.kind = spark, kind
        self.path = f"{path.rstrip('/')}/{parser}/{version}"

    # -- files, by Hadoop's own file systems, so that any folder that Spark can write serves

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def epochs(self) -> list[str]:
        """Names of the epochs that count."""
        fs, at = self._fs(f"{self.path}/manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))) if fs.exists(at) else []

    def _publish(self, epoch: str, facts: dict) -> None:
        fs, hidden = self._fs(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(facts).encode()))
        finally:
            out.close()
        _, final = self._fs(f"{self.path}/manifests/{epoch}")
        if fs.exists(final) or not fs.rename(hidden, final):
            fs.delete(hidden, False)
            raise FileExistsError(f"epoch {epoch} is there already")

    # -- rows

    def rows(self) -> DataFrame:
        """key, result of all epochs that count."""
        schema = f"key string, result {self.kind}"
        known = self.epochs()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{e}" for e in known]) if known else self.spark.createDataFrame([], schema)

    def missing(self, contents: DataFrame, key: str) -> DataFrame:
        """The rows of contents whose key the store doesn't have; not those without one.

        Keys are compared without the contents, which stay where they are unless the new keys are too many for a broadcast.
        """
        new = contents.select(key).filter(F.col(key).isNotNull()).distinct().join(self.rows().select(F.col("key").alias(key)), key, "left_anti")
        return contents.join(small(new), key, "left_semi")

    def fill(self, contents: DataFrame, parse: Callable[[DataFrame], DataFrame], key: str = "content_hash", epoch: str | None = None) -> int:
        """Parse what is new in contents and publish it as an epoch; returns the number of results that were added.

        parse takes rows of contents, and returns key (named as in contents) and result; of copies one result stays. An epoch that is there already
        is left as it is; without new contents none is made.
        """
        name = epoch or uuid.uuid4().hex
        if epoch and epoch in self.epochs():
            return 0
        at = f"{self.path}/rows/{name}"
        made = parse(self.missing(contents, key)).select(F.col(key).cast("string").alias("key"), "result").dropDuplicates(["key"])
        made.write.mode("overwrite").option("compression", "zstd").parquet(at)
        n = self.spark.read.schema(f"key string, result {self.kind}").parquet(at).count()
        if not n and epoch is None:
            fs, folder = self._fs(at)
            fs.delete(folder, True)
            return 0
        self._publish(name, {"rows": n})
        return n

    def results(self, contents: DataFrame, parse: Callable[[DataFrame], DataFrame], key: str = "content_hash", name: str = "parsed") -> DataFrame:
        """contents with their results in a column: null for rows with a null key; what the store lacks is parsed and kept first."""
        self.fill(contents, parse, key)
        return contents.join(self.rows().select(F.col("key").alias(key), F.col("result").alias(name)), key, "left")

    def take_in(self, stream: DataFrame, parse: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "content_hash"):
        """Fill the store from a stream until all that is there has been taken in; each batch is an epoch, and counts once."""
        query_name = checkpoint.rstrip("/").rpartition("/")[2]

        def batch(rows: DataFrame, number: int) -> None:
            self.fill(rows, parse, key, f"{query_name}-{number:09d}")

        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
