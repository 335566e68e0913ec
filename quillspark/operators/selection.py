"""Exact quantiles by selection: no task holds, sorts or counts all values of a group.

One pass counts the values of each group in stretches (parts of powers of two). A rank lies in
one stretch, and only the values of such stretches are gathered, each with its
count. Those stretches are cut into equal cells; the values of the few cells that
hold a rank, a part of 2^-22 of their size, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .storage import small, written

#: Cells into which a stretch is cut.
CELLS = 1 << 16
#: Stretches that may come to the driver.
FEW = 10_000
#: Stretches of one power of two.
_PARTS = 64
#: The largest finite double; keys of infinite values and of NaN, which comes last; more than any exponent.
_LARGEST, _INFINITE, _NAN, _EXPONENTS = 1.7976931348623157e308, 1 << 38, 1 << 40, 1100


def stretch(value: Column) -> Column:
    """A whole number that never falls as value grows, and takes some 64 values for each power of two on either side of 0."""
    v = value.cast("double")
    size = F.abs(v)
    power = F.floor(F.log2(F.greatest(size, F.lit(5e-324))))
    part = F.floor((size / F.pow(F.lit(2.0), F.greatest(power, F.lit(-1022)).cast("double")) - 1) * _PARTS)
    key = (power + _EXPONENTS) * _PARTS + part
    return F.when(F.isnan(v), _NAN).when(size > _LARGEST, F.when(v > 0, _INFINITE).otherwise(-_INFINITE)).when(v == 0, 0).when(v > 0, key).when(v < 0, -key).cast("long")


def _picked(cells: DataFrame, within: list[str], at: str, wanted: Column) -> DataFrame:
    """The cells in which ranks lie, each with i (number of the quantile) and r (rank within the cell).

    cells: rows with n, sorted by at within the columns within; wanted: array of structs of i and r, ranks among the rows of within.
    """
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*within).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.filter(F.transform(wanted, lambda x: F.struct(x["i"].alias("i"), (x["r"] - F.col("_before")).alias("r"))), lambda x: (x["r"] > 0) & (x["r"] <= F.col("n")))
    return cells.withColumn("_before", before).withColumn("wanted", own).filter(F.size("wanted") > 0).drop("_before")


def _local(df: DataFrame) -> DataFrame:
    """df, as rows of the driver if they are few; else stored, and broadcast within the usual bound."""
    rows = df.limit(FEW + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= FEW else small(written(df, "stretches"))


def quantiles(rows: DataFrame, cells: DataFrame, ps: list[float]) -> DataFrame:
    """g, q (array of the nearest-rank quantiles of the order of ps).

    rows: g (any type that orders), s (the value's stretch), value; cells: g, s, n, low, high of their stretches.
    """
    whole = F.sum("n").over(Window.partitionBy("g"))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all"))).cast("long").alias("r")) for i, p in enumerate(ps)])
    picked = _picked(cells.filter("n > 0").withColumn("_all", whole).withColumn("wanted", ranks), ["g"], "s", F.col("wanted"))
    picked = _local(picked.select("g", "s", "low", "high", "wanted"))
    # Distinct values of the stretches that count, over all tasks; no value of another stretch is exchanged.
    hist = written(rows.join(picked.select("g", "s"), ["g", "s"], "left_semi").groupBy("g", "s", "value").agg(F.count("*").alias("n")), "stretch-values")
    share = (F.col("value") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")
    cut = hist.join(picked, ["g", "s"]).withColumn("c", F.when(F.col("low") < F.col("high"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")).drop("low", "high")
    counts = cut.groupBy("g", "s", "c").agg(F.sum("n").alias("n"), F.first("wanted").alias("wanted"))
    keys = ["g", "s", "c"]
    picked, hist = _picked(counts, ["g", "s"], "c", F.col("wanted")), cut.drop("wanted")
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    last = hist.join(picked.select(*keys, "wanted"), keys).withColumn("_upto", upto)
    own = F.filter("wanted", lambda x: (x["r"] > F.col("_upto") - F.col("n")) & (x["r"] <= F.col("_upto")))
    found = last.select("g", "value", F.explode(own).alias("w"))
    return found.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("w.i", "value"))), lambda x: x["value"]).alias("q"))


def described(df: DataFrame, cols: str | list[str], kind: str = "full", cast: str = "long", by: list[str] | None = None) -> DataFrame:
    """Measures (see stats.KINDS) of numeric columns, exact: by, then measure (the column's name, if cols is a list), then the measures.

    Nulls don't count. A group without values, and all of an empty table (without by), has a count of 0 and what the kind says
    of no rows. Null keys are groups of their own. Runs two jobs at the call: the counts of stretches, and the values of those that hold a rank.
    """
    spark, by = df.sparkSession, by or []
    many = [cols] if isinstance(cols, str) else cols
    names, empty, rounded = stats.KINDS[kind]
    names = names.split()
    pairs = F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).cast(cast).alias("v")) for c in many])
    rows = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.explode(pairs).alias("_p"))
    rows = rows.select(F.struct(F.col("_p.m").alias("m"), *[F.col(f"_b{i}") for i in range(len(by))]).alias("g"), F.col("_p.v").alias("value")).withColumn("s", stretch(F.col("value")))
    cells = rows.groupBy("g", "s").agg(F.count("value").alias("n"), F.sum("value").cast(cast).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if(F.col("value") == 0).alias("zero"))
    cells = written(cells, "stretch-counts")
    ps = [0.5 if x == "median" else int(x[1:]) / 100 for x in names if x == "median" or x[1:].isdigit()]
    whole = cells.groupBy("g").agg(F.sum("n").alias("count"), F.sum("total").cast(cast).alias("total"), F.min("low").alias("minimum"), F.max("high").alias("maximum"), F.sum("zero").alias("zero"))
    # Rows of one group each; a group of nulls only has no quantiles.
    found = whole.join(quantiles(rows.filter("value IS NOT NULL"), cells, ps), "g", "left")
    mean = F.try_divide(F.col("total").cast("double"), F.col("count"))
    made = {x: F.col(x) for x in ("count", "total", "minimum", "maximum", "zero")} | {"mean": F.bround(mean, 6) if rounded else mean}
    at = 0
    for x in names:
        if x not in made:
            made[x] = F.get("q", F.lit(at)).cast(cast)
            at += 1
    keys = [F.col(f"g._b{i}").alias(c) for i, c in enumerate(by)]
    out = found.select(F.col("g.m").alias("measure"), *keys, *[made[x].alias(x) for x in names])
    if not by:
        out = F.broadcast(spark.createDataFrame([(c,) for c in many], "measure string")).join(out, "measure", "left")
    zero = {"count": 0, "zero": 0} | ({x: empty for x in names} if empty is not None else {})
    out = out.select("measure", *by, *[F.coalesce(F.col(x), F.lit(zero[x]).cast(out.schema[x].dataType)).alias(x) if x in zero else F.col(x) for x in names])
    return out.drop("measure") if isinstance(cols, str) else out
