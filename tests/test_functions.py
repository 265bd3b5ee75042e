import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from claimloom.functions import grounding, keys, periods, validation, values
from claimloom.operators import vocabulary
from claimloom.plans import golden
from claimloom.sources import ingest


def test_goldens(spark):
    df = spark.createDataFrame(golden.VALUES, "raw string, kind string, number double, unit string").withColumn("p", values.parse(F.col("raw")))
    for r in df.collect():
        assert (r.p.kind, r.p.unit) == (r.kind, r.unit) and r.p.number == (pytest.approx(r.number) if r.number is not None else None), r
    df = spark.createDataFrame(golden.PERIODS, "raw string, a string, b string, gran string").withColumn("p", periods.parse(F.col("raw")))
    for r in df.collect():
        assert (r.p and (str(r.p.start), str(r.p.end), r.p.gran)) == (r.a and (r.a, r.b, r.gran)), r


def test_agreement(spark):
    rows = [("₹75,000.00 million", "₹7,500 Cr", True), ("₹3,468 Cr", "₹3,500 Cr", True), ("₹2,000 Cr", "₹2,900 Cr", False), ("4.1 per cent", "4.8 per cent", False), ("96,301", "99,310", False)]
    df = spark.createDataFrame(rows, "x string, y string, want boolean").withColumn("a", values.parse(F.col("x"))).withColumn("b", values.parse(F.col("y")))
    for r in df.withColumn("why", values.agreement(F.col("a.number"), F.col("a.sig_figs"), F.col("b.number"), F.col("b.sig_figs"))).collect():
        assert (r.why is not None) == r.want, r
    fits = [("₹55 Cr", "€55 million", False), ("3.7%", "3.7 percentage points", False), ("8.8", "8.8 per cent", True)]
    df = spark.createDataFrame(fits, "x string, y string, want boolean").withColumn("a", values.parse(F.col("x"))).withColumn("b", values.parse(F.col("y")))
    for r in df.withColumn("ok", values.comparable(F.col("a.number"), F.col("a.unit_family"), F.col("b.number"), F.col("b.unit_family"))).collect():
        assert r.ok == r.want, r


def test_keys(spark):
    rows = [("Acme Limited", "acme"), ("Acme Ltd.", "acme"), ("The Total of It & Co", "it"), (None, "")]
    assert all(r.k == r.want for r in spark.createDataFrame(rows, "s string, want string").withColumn("k", keys.subject_key(F.col("s"))).collect())


def test_relations_of_periods(spark):
    rows = [("FY17", "Q3 FY17", "contains"), ("Q3 FY17", "FY17", "contained_by"), ("FY16", "FY17", "disjoint"), ("FY17", "CY2016", "overlaps"), ("FY17", "2016-17", "equal")]
    df = spark.createDataFrame(rows, "x string, y string, want string").withColumn("a", periods.parse(F.col("x"))).withColumn("b", periods.parse(F.col("y")))
    for r in df.withColumn("rel", periods.relation(F.col("a.start"), F.col("a.end"), F.col("b.start"), F.col("b.end"))).collect():
        assert r.rel == r.want, r


def test_kernels():
    assert grounding.lcs("kitten", "sitting") == 4 and grounding.distance("kitten", "sitting") == 3
    assert grounding.indel_ratio("abc", "abc") == 100 and grounding.partial_ratio("abc", "xxabcxx") == 100
    assert grounding.best_window("hello world", "say hallo world now")[0] == 4


def test_resolved_period(spark):
    rows = [("FY17", "x", "2016-04-01"), (None, "in CY2015 alone", "2015-01-01"), (None, "CY2015 and CY2016", None), ("", "", None)]
    df = spark.createDataFrame(rows, "p string, q string, want string")
    for r in df.withColumn("r", validation.resolved_period(F.col("p"), F.col("q"))).collect():
        assert (r.r and str(r.r.start)) == r.want, r


#: subject, attribute, value, quote, confidence, and the reason they are turned down for.
PAYLOADS = [
    ("Mill", "Output", "3.4 percent", "rose by 3.4 percent", "0.8", ""), ("Mill", "Output", "north=2; south=3; west=4", "q", "0.8", "value looks like a whole table row, not one cell"),
    ("Mill", "Output", "3.4 percent of", "q", "0.8", "value looks truncated mid-phrase"), (None, "Plans", "about to grow in", "q", None, "value looks truncated mid-phrase"), (" n/a ", "Output", "44", "came to 44", "7", ""),
    ("Mill", " none ", "44", "q", "x", "missing attribute"), ("Mill", "Output", None, "q", "0.5", "missing value"), ("Mill", "Output", "44", "  ", "0.5", "missing evidence quote"), ("Mill", "Ratio", "a=b", "a=b", "-3", ""),
]


def test_validation(spark):
    raw = spark.createDataFrame(PAYLOADS, "subject string, attribute string, value string, evidence_quote string, confidence string, want string")
    got = validation.validated(raw.withColumns({c: F.lit(None).cast("string") for c in ("value_kind", "period", "scope", "basis", "geography")})).collect()
    assert [r.reason for r in got] == [r.want for r in got]
    assert [r.confidence for r in got] == [0.8, 0.8, 0.8, 0.7, 1.0, 0.7, 0.5, 0.5, 0.0] and got[3].subject == got[4].subject == "(unspecified)"


def test_gates(spark):
    rows = [
        ("Output of the mill came to 612 tonnes", "612", "In all the output of the mill came to 612 tonnes, as planned.", "verbatim", ""),
        ("Output of the mill came to 612 tonnes", "77", "In all the output of the mill came to 612 tonnes, as planned.", "failed", "value digits '77' not present in the quoted evidence"),
        ("brief", "1", "nothing of it", "failed", "short quote not found verbatim"), ("yield(2): q1 07=9,301", "9,301", "Yield(2): Q1 07=9,301; Q1 08=9,410", "verbatim", ""),
        ("The yield fell to 38 bushels in the dry yaer", "38", "we know the yield fell to 38 bushels in the dry year and since", "fuzzy", ""), ("a sentence that was never written in any paper", "9", "Output of the mill came to 612 tonnes", "failed", "quote not found in the source text"),
        ("  ", "1", "text", "failed", "empty quote"), (None, None, None, "failed", "empty quote"),
    ]
    got = grounding.grounded(spark.createDataFrame(rows, "quote string, value string, source string, want string, why string")).collect()  # a column of its own name stays
    assert len(got) == len(rows) and all((r.status, r.reason) == (r.want, r.why) for r in got)


def test_token(spark):
    rows = [("  ﬁeld \u00a0 of\tﬂax ", "field of flax"), ("", ""), (None, None)]
    assert all(r.t == r.want for r in spark.createDataFrame(rows, "s string, want string").withColumn("t", grounding.token(F.col("s"))).collect())


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzzy_kernels_against_plain_tables():
    r = random.Random(8)
    for _ in range(120):
        source = "".join(r.choice("abc de") for _ in range(r.randint(1, 60)))
        n = r.randint(1, min(20, len(source)))
        at = r.randint(0, len(source) - n)
        quote = "".join(c if r.random() > 0.15 else r.choice("abcx") for c in source[at : at + n])
        like = lambda a, b: 100.0 * (1 - plain_distance(a, b) / max(len(a), len(b), 1))
        assert grounding.distance(quote, source) == plain_distance(quote, source) and grounding.lcs(quote, source) == plain_lcs(quote, source)
        ratios = [200.0 * plain_lcs(quote, p) / (len(quote) + len(p)) for i in range(1 - n, len(source)) if (p := source[max(i, 0) : i + n])]
        assert abs(grounding.partial_ratio(quote, source) - max(ratios)) < 1e-9
        stride, last, best = max(1, n // 8), len(source) - n, (-1, -1, 0.0)
        for i in range(0, last + 1, stride):
            if like(quote, source[i : i + n]) > best[2]:
                best = (i, i + n, like(quote, source[i : i + n]))
        for i in range(max(0, best[0] - stride), min(last + 1, best[0] + stride + 1)):
            if like(quote, source[i : i + n]) > best[2]:
                best = (i, i + n, like(quote, source[i : i + n]))
        assert grounding.best_window(quote, source) == best


def test_sort_ratio_against_a_plain_table():
    r = random.Random(9)
    for _ in range(200):
        a, b = (" ".join(r.choice(["oat", "rye", "wheat", "net", "sales"]) for _ in range(r.randint(0, 4))) for _ in range(2))
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        assert abs(vocabulary.sort_ratio(a, b) - (100.0 if not x + y else 200.0 * plain_lcs(x, y) / (len(x) + len(y)))) < 1e-9


def test_files_by_glob(spark, tmp_path):
    for name, data in (("a.bin", b"one"), ("b.bin", b""), ("c.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {(r.path.rsplit("/", 1)[-1], r.length, r.sha256) for r in ingest.files(spark, str(tmp_path / "*.bin")).collect()}
    assert got == {("a.bin", 3, hashlib.sha256(b"one").hexdigest())}  # Spark's reader leaves empty files out


def test_long_files_are_hashed_by_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "PIECE", 1000)
    noise = random.Random(7).randbytes(9000)
    contents = {"noise": noise, "ended": noise + b"\n", "lines": b"\n" * 5000, "one line": b"x" * 5000, "mark": ingest.BOM + noise, "mark, ended": ingest.BOM * 2 + noise + b"\n", "cr": b"a\r\nb\r" * 900,
                "no [a-c]{1,2}*?": noise[:3001], "mark and end": ingest.BOM + b"\n" * 2000, "packed.gz": gzip.compress(noise), "short": b"short\n"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    own = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in ingest.files(spark, str(tmp_path / "*")).collect()}
        (tmp_path / "packed.gz").unlink()
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # none of the others is read whole
        assert ingest.files(spark, str(tmp_path / "*")).count() == len(contents) - 1
        assert got["noise"][1] in {r.sha256 for r in ingest.files(spark, str(tmp_path / "*")).collect()}
    finally:
        for k in (*own, "spark.sql.sources.binaryFile.maxLength"):
            spark.conf.unset(k)
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
