"""The CSV sink, the store of parser results, matching as a stream, and language models."""

from __future__ import annotations

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import language, relational
from quillspark.plans.corpus import parsed
from quillspark.sources import ordered_csv, results
from quillspark.streaming import matching


def _joined(path):
    return b"".join(open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".csv") and not n.startswith("."))


def test_csv_has_the_same_bytes_however_rows_are_dealt(spark, tmp_path):
    rows = [(k, random.Random(k).choice(["plain", 'quote " and, comma', "two\nlines", None, "é"]), k / 7) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    want = io.StringIO()
    out = csv.writer(want, lineterminator="\n")
    out.writerow(df.columns)
    out.writerows([["" if v is None else v for v in r] for r in rows])
    for n in (1, 16):
        made = ordered_csv.write_parts(df.repartition(n), str(tmp_path / f"out{n}"), ["k"])
        assert _joined(tmp_path / f"out{n}") == want.getvalue().encode() and made["rows"] == 500 and made["bytes"] == len(want.getvalue().encode())
        parts = made["parts"]
        assert [p["first_row"] for p in parts[1:]] == [sum(q["rows"] for q in parts[:k]) for k in range(1, len(parts))]
        assert [p["first_byte"] for p in parts[1:]] == [sum(q["bytes"] for q in parts[:k]) for k in range(1, len(parts))]
    assert ordered_csv.join_parts(str(tmp_path / "out16"), str(tmp_path / "one.csv")) == 500
    assert (tmp_path / "one.csv").read_bytes() == want.getvalue().encode()
    bom = ordered_csv.write_parts(df.limit(0), str(tmp_path / "empty"), bom=True, crlf=True)
    assert bom["rows"] == 0 and _joined(tmp_path / "empty") == "﻿k,s,x\r\n".encode()


def test_csv_that_fails_leaves_what_was_there(spark, tmp_path):
    df = spark.range(100)
    target = str(tmp_path / "t")
    ordered_csv.write_parts(df, target, ["id"])
    before = _joined(target)
    broken = df.withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")))
    for bad, options in ((broken, {"overwrite": True}), (df, {}), (df.limit(0), {"overwrite": True, "refuse_empty": True})):
        with pytest.raises(Exception, match="broken|exists|nothing"):
            ordered_csv.write_parts(bad, target, **options)
        assert sorted(os.listdir(tmp_path)) == ["t"] and _joined(target) == before
    ordered_csv.write_parts(df.limit(3), target, ["id"], overwrite=True)
    assert _joined(target) == b"id\n0\n1\n2\n" and sorted(os.listdir(tmp_path)) == ["t"]


def _store(spark, tmp_path, version="1"):
    return results.ResultStore(spark, f"file://{tmp_path}/store", "sizes", version, "struct<n:int>")


def test_results_are_made_once(spark, tmp_path):
    rows = [("a", "xx"), ("a", "xx"), ("b", "yyy"), (None, "z"), ("c", "")]
    df = spark.createDataFrame(rows, "content_hash string, content string")
    asked = spark.sparkContext.accumulator(0)

    def parse(new):
        def size(content):
            asked.add(1)
            return {"n": len(content)}

        return parsed(new, size, "struct<n:int>", "result", ["content_hash"])

    store = _store(spark, tmp_path)
    assert store.rows().count() == 0 and store.epochs() == []
    for _ in range(2):
        got = sorted((str(r["content_hash"]), r["parsed"] and r["parsed"]["n"]) for r in store.results(df, parse).collect())
        assert got == [("None", None), ("a", 2), ("a", 2), ("b", 3), ("c", 0)] and len(store.epochs()) == 1
    made = asked.value
    assert store.fill(df.union(spark.createDataFrame([("d", "w")], df.schema)), parse) == 1 and len(store.epochs()) == 2
    assert asked.value == made + 1
    assert _store(spark, tmp_path, "2").fill(df, parse) == 3  # another version knows nothing

    def broken(new):
        return parse(new).withColumn("result", F.when(F.col("content_hash") == "f", F.raise_error(F.lit("broken"))).otherwise(F.col("result")))

    more = spark.createDataFrame([("e", "1"), ("f", "2")], df.schema)
    for _ in range(2):
        with pytest.raises(Exception, match="broken"):
            store.fill(more, broken, epoch="named")
        assert len(store.epochs()) == 2 and store.rows().count() == 4
    assert store.fill(more, parse, epoch="named") == 2 and store.fill(more, parse, epoch="named") == 0
    assert sorted(r["key"] for r in store.rows().collect()) == ["a", "b", "c", "d", "e", "f"]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "content_hash string, content string"
    store = _store(spark, tmp_path)
    parse = lambda new: new.select("content_hash", F.struct(F.length("content").cast("int").alias("n")).alias("result"))
    for part in ([("a", "1"), ("b", "22")], [("b", "22"), ("c", "333")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        store.take_in(spark.readStream.schema(schema).parquet(source), parse, f"{tmp_path}/checkpoints/q")
    assert sorted((r["key"], r["result"]["n"]) for r in store.rows().collect()) == [("a", 1), ("b", 2), ("c", 3)]
    commits = tmp_path / "checkpoints" / "q" / "commits"
    for name in os.listdir(commits):  # as if the last batch had ended before its commit
        if name.lstrip(".").startswith("1"):
            os.unlink(commits / name)
    store.take_in(spark.readStream.schema(schema).parquet(source), parse, f"{tmp_path}/checkpoints/q")
    assert store.rows().count() == 3 and len(store.epochs()) == 2


@pytest.fixture
def rocks(spark):
    name, key = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, name)
    yield spark
    spark.conf.unset(key)


def test_fifo_stream_equals_the_batch(rocks, tmp_path):
    spark, rnd = rocks, random.Random(6)
    rows = sorted((1_700_000_000 + rnd.randint(0, 400), k, rnd.randint(0, 5), rnd.random() < 0.5) for k in range(300))
    schema = "ts timestamp, event long, user int, is_left boolean"
    events = spark.createDataFrame([(t, e, u, s) for t, e, u, s in rows], "s long, event long, user int, is_left boolean").select(F.timestamp_seconds("s").alias("ts"), "event", "user", "is_left")
    edges = [0, *[rows[len(rows) * k // 3][0] for k in (1, 2)], 2_000_000_000]
    for a, b in zip(edges, edges[1:], strict=False):
        events.filter((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = spark.createDataFrame([(-1, True), (-2, False)], "event long, is_left boolean").select(F.timestamp_seconds(F.lit(2_500_000_000) - F.col("event") * 86_400).alias("ts"), "event", F.lit(99).alias("user"), "is_left")
    for k in (-1, -2):
        last.filter(f"event = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = matching.fifo_matches(stream, "user", "ts", "event", F.col("is_left"))
    query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(str, ((r["key"], r["left_event"], r["right_event"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["key"] != 99)))
    side = lambda s: events.filter(F.col("is_left") == s).select("user", "event", "ts")
    batch = relational.fifo_match(side(True), side(False), ["user"], ["ts", "event"], ["ts", "event"]).select("user", "left_row.event", "right_row.event")
    assert got == sorted(map(str, map(tuple, batch.collect())))


def test_language_models(spark):
    texts = {"en": "the cat and the dog are in the house of the old man", "de": "die Katze und der Hund sind in dem Haus des alten Mannes", "fr": "le chat et le chien sont dans la maison du vieil homme"}
    df = spark.createDataFrame([(x, t) for x, t in texts.items() for _ in range(5)] + [(None, "x"), ("en", None)], "lang string, text string")
    new = spark.createDataFrame([(1, "the old house"), (2, "das alte Haus des Hundes"), (3, "la maison du chat"), (4, ""), (5, None), (6, "привет")], "id int, text string")
    for kind in language.KINDS:
        model = language.fit(df, kind, least=5)
        assert model.languages == ["de", "en", "fr"]
        got = {r["id"]: r for r in language.predict(new, ["id"], model).collect()}
        assert [got[k]["language"] for k in range(1, 7)] == ["en", "de", "fr", "und", "und", "und"]
        assert all(0 <= r["margin"] <= r["confidence"] <= 1 for r in got.values()) and got[4]["confidence"] == 0
    assert language.fit(df.limit(0), "words").languages == []
    assert [r["language"] for r in language.predict(new, ["id"], language.fit(df.limit(0), "words")).collect()] == ["und"] * 6
    first = spark.createDataFrame([("Ab c",)], "t string").select(language.features(F.col("t"), "characters"), language.features(F.col("t"), "words")).first()
    assert list(first) == [[" Ab", "Ab ", " c "], ["ab", "c"]]


def test_tokens_are_scored_once_and_nothing_is_exchanged(spark):
    import pyarrow as pa

    words = ["Straße,", "don't", "½x²y", "İstanbul", "a", "", "ΟΔΟΣ!", "x1y", "naïve mot", "漢字かな"]
    rows = [(k, " \t".join(words[(k * i) % len(words)] for i in range(k % 7)) if k % 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, text string")
    labelled = df.select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), "text")
    for kind in language.KINDS:
        model = language.fit(labelled, kind, least=1)
        features = df.select("id", F.explode(language.features(F.col("text"), kind)).alias("feature"))
        direct = labelled.filter("text IS NOT NULL").select(F.explode(language.features(F.col("text"), kind)).alias("feature")).distinct()
        assert {r[0] for r in model.table.select("feature").collect()} == {r[0] for r in direct.collect()}
        found = features.join(model.table, "feature").groupBy("id").agg(F.count("*"), *[F.sum(F.col("scores")[i]) for i in range(2)]).collect()
        want = {r[0]: list(r[1:]) for r in found}
        scorer = language._TokenScores(kind, 2, {r[0]: list(r[1]) for r in model.table.collect()})
        assert scorer.sums(pa.array([t for _, t in rows], pa.string())).to_pylist() == [want.get(k, [0, 0, 0]) for k, _ in rows]
        assert "Exchange" not in language.predict(df, ["id"], model)._jdf.queryExecution().executedPlan().toString()


def test_a_key_that_waits_has_one_state_and_one_timer():
    import pandas as pd
    from pyspark.sql import types as T

    calls, timers = [], set()

    class Value:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        def getValueState(self, name, schema):
            return value

        def registerTimer(self, at):
            calls.append("register")
            timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            timers.remove(at)

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    value, matcher = Value(), matching.FifoMatcher(T.StructField("key", T.IntegerType()), 10_000)
    matcher.init(Handle())
    give = lambda *rows: list(matcher.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["at", "event", "is_left"])]), Now(0)))
    for k in range(4):
        calls.clear()
        assert give((1_000_000 * (k + 1), k, True)) == [] and len(timers) == 1 and len(calls) <= 3
    for now in (1_500, 5_000):  # the first one rings before all that waits is final
        timers.clear()
        assert list(matcher.handleExpiredTimer((7,), Now(now), None)) == [] and len(timers) == 1
    assert timers == {11_001}
    give((4_500_000, 9, False))
    assert timers == {4_501}
    timers.clear()
    out = list(matcher.handleExpiredTimer((7,), Now(30_000), None))
    assert [tuple(r) for r in out[0].fillna(-1).itertuples(index=False)] == [(7, 0, 9), (7, 1, -1), (7, 2, -1), (7, 3, -1)]
    assert value.value is None and not timers
