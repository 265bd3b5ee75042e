"""Every core query against its SQL on the small tables."""

import datetime
import os

import duckdb
import pytest

from claimloom.operators import derived, reconcile, vocabulary
from claimloom.plans import catalogue, registry
from claimloom.streaming.incremental import ingest_stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        own = [d[0] for d in cur.description]
        assert sorted(own) == names
        want = sorted(tuple(plain(r[own.index(c)]) for c in names) for r in cur.fetchall())
        assert got == want


def test_blocking_keeps_apart_and_merges(spark):
    pct = ["revenue from services", "capital expenditure as percentage of revenue from services", "credit growth", "credit to agriculture growth", "ebitda", "ebitda margin"]
    items = spark.createDataFrame([(a, "percent", 1) for a in pct], "attribute_raw string, unit_family string, n long")
    assert len({r.canon for r in vocabulary.blocked(items).collect()}) == len(pct)
    items = spark.createDataFrame([("real gdp growth", "percent", 3), ("real gdp growth rate", "percent", 2), ("growth in real gdp", None, 1)], "attribute_raw string, unit_family string, n long")
    assert {r.canon for r in vocabulary.blocked(items).collect()} == {"real gdp growth"}


def test_edges_are_taken_in_once(spark):
    own = catalogue.edges(spark, SF)
    first = reconcile.new_relations(own, own.limit(0).select("fact_a", "fact_b", "type"))
    n = first.count()
    assert n and reconcile.new_relations(own, first.select("fact_a", "fact_b", "type")).count() == 0
    assert derived.derived(catalogue.claims(spark, SF)).groupBy("fact_a", "fact_b").count().where("count > 1").count() == 0


def test_stream_appends_each_content_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / f"cp{_}")).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [1, 2]
    assert os.path.isdir(tmp_path / "store")


def test_verbatim_compares_whole_items(spark, tmp_path):
    items = [(1, "one two three four five six seven eight nine"), (2, "Just Four words here"), (3, "single"), (4, ""), (5, None), (None, "alpha  beta gamma"), (6, "two words"), (7, "the a b c d e f g end")]
    docs = [(1, "x one two three four five six seven eight nine y"), (2, "one two three four five six and not the rest"), (3, "just four\nWORDS here"), (4, "a singleton of two words"), (None, "say alpha beta gammas"), (5, None), (5, "just four words hereafter"), (8, "bathe a b c d e f g ended")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fold = lambda x: " ".join((x or "").lower().split())
    want = [(i, d) for i, q in items for d, t in docs if fold(q) and fold(q) in fold(t)]
    got = [tuple(r) for r in catalogue.verbatim(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (1, 2) not in got and len(want) == 7
