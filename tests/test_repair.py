from pyspark.sql import functions as F

from claimloom.functions import repair
from claimloom.operators import blocks


def test_repair():
    good = [{"a": 1}, {"b": "x]"}]
    for t in ('[{"a": 1}, {"b": "x]"}]', '```json\n[{"a": 1}, {"b": "x]"}]\n```', 'so: [{"a": 1}, {"b": "x]"},] done', '[{"a": 1}, {"b": "x]"}, {"c": "cut o'):
        assert repair.repaired(t) == good, t
    assert repair.repaired("nothing") is None and repair.repaired(None) is None
    assert repair.repaired('{"facts": [1,]}') == {"facts": [1]}


def test_parsed_and_exploded(spark):
    rows = [(1, '[{"a":1}]'), (2, 'x {"facts": [{"b":2},]}'), (3, "no"), (4, None)]
    df = repair.parsed(spark.createDataFrame(rows, "id long, answer string"))
    got = {r.id: r.f for r in df.select("id", repair.facts_in(F.col("json")).alias("f")).collect()}
    assert [len(x) if x else 0 for x in (got[1], got[2], got[3], got[4])] == [1, 1, 0, 0]


def test_packs_and_tables(spark):
    df = spark.createDataFrame([(["a" * 3000, "b" * 1500, "c" * 1000, "d" * 8000, "e"],)], "t array<string>")
    got = df.select(blocks.packs(F.col("t")).alias("p")).first().p
    assert [len(x) for x in got] == [4502, 1000, 8000, 1]
    rows = [(True, "Assets", []), (False, "Cash", [("FY23", "1"), ("FY24", "2")]), (False, None, [("FY23", "3")])]
    df = spark.createDataFrame([(rows, "Balance")], "rows array<struct<section: boolean, label: string, cells: array<struct<header: string, value: string>>>>, cap string")
    assert df.select(blocks.rendered(F.col("rows"), F.col("cap")).alias("t")).first().t == "Balance\n[Assets]\nCash: FY23=1; FY24=2\n(unlabelled row): FY23=3"
