"""Parents beside children, odds with empty cells, sections by list items, the second rule for lines."""

import math

from pyspark.sql import functions as F

from quillspark.functions import stats
from quillspark.plans import analyses
from quillspark.plans.corpus import NOTES, bind


def test_sizes_of_parents_and_children(spark):
    rows = [(1, 2, 5, 5), (3, 2, 0, 1), (2, 2, 9, 1), (0, 4, 1, 1)]
    edges = spark.createDataFrame(rows, "child_lines long, parent_lines long, child_words long, parent_words long")
    got = {r.measure: (r.edges, r.child_lower, r.child_equal, r.child_higher, r.child_lower_share, r.child_equal_share, r.child_higher_share) for r in analyses.compared_sizes(edges, ["lines", "words"]).collect()}
    assert got == {"lines": (4, 2, 1, 1, 0.5, 0.25, 0.25), "words": (4, 1, 2, 1, 0.25, 0.5, 0.25)}
    none = analyses.compared_sizes(edges.limit(0), ["lines"]).collect()
    assert [(r.edges, r.child_lower, r.child_lower_share) for r in none] == [(0, 0, 0.0)]


def test_odds_with_empty_cells(spark):
    cells = spark.createDataFrame([(2, 1, 1, 3), (0, 1, 1, 3), (2, 0, 1, 3), (0, 0, 0, 0)], "a long, b long, c long, d long")
    got = [tuple(None if x is None else round(x, 6) for x in r) for r in cells.coalesce(1).select(*stats.odds_ratio(*map(F.col, "abcd"))).collect()]
    half = 1.96 * math.sqrt(1 / 2 + 1 + 1 + 1 / 3)
    assert got == [(6.0, round(math.exp(math.log(6) - half), 6), round(math.exp(math.log(6) + half), 6)), (0.0, None, None), (None, None, None), (None, None, None)]


def test_list_items_of_either_population(spark):
    rows = [("full", 0, 6), ("full", 2, 3), ("full", 5, 1), ("unique", 0, 3), ("unique", 2, 1)]
    items = spark.createDataFrame(rows, "population string, value long, sections long")
    got = {r.list_item_count: tuple(r)[1:] for r in analyses.list_item_distribution(items).collect()}
    assert got == {0: (6, 0.6, 0.0, 3, 0.75, 0.0), 2: (3, 0.3, 0.75, 1, 0.25, 1.0), 5: (1, 0.1, 0.25, 0, 0.0, 0.0)}
    assert analyses.list_item_distribution(items.limit(0)).collect() == []


def test_both_rules_write_the_same_files(spark, sf_dir):
    one, two = (bind(spark, sf_dir, *rule).files.select("id", "path", "content") for rule in ((), (NOTES,)))
    both = one.join(two.withColumnRenamed("content", "other"), ["id", "path"]).filter("size(split(content, '\\n')) = size(split(other, '\\n'))")
    assert both.count() == one.count() == two.count()
