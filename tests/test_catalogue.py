"""Every registered corpus query: equal to its SQL where it has some, and readable otherwise."""

import math
from decimal import Decimal

import pytest

import __spark_entry__ as entry
from quillspark.plans import catalogue
from quillspark.plans.corpus import _COPY_IDS, bind


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    found = duck.execute(catalogue.oracle_sql()[name])
    names, cols = [c[0] for c in found.description], sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert want, "no rows, nothing compared"
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    df = catalogue.queries()[name](spark, sf_dir)
    assert df.columns and df.count() > 0


def test_binding_keeps_every_document(spark, sf_dir):
    corpus = bind(spark, sf_dir)
    want = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    rows = {r.id: r.path for r in corpus.files.select("id", "path").collect()}
    assert {i for i in rows if i < _COPY_IDS} == want and {i - _COPY_IDS for i in rows if i >= _COPY_IDS} == {i for i in want if i % 10 == 6}
    aside = [i for i in want if (i // 20) % 40 % 7 == 5]
    assert aside and all("aside/" in rows[i] for i in aside)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
