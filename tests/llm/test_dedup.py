import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from claimloom.llm.dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[n], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(4)
    base = ["", "a b c", "héllo wörld", "x" * 200_000, "no break", "tab\tand\x0bmore"]
    rows = [(i, "".join(c + r.choice(["", "", " ", "\n"]) for c in r.choice(base[:3] + base[4:]))) for i in range(120)]
    return rows + [(200, base[3]), (201, base[3] + " "), (202, None), (None, "a b c"), (5, "a b c"), (5, "a b c"), (300, "alone"), (-(2**63), "low"), (2**63 - 1, "l ow")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "d") for i, t in rows], "doc_id long, text string, digest string").repartition(5)
    got = exact_dedup(df, salts=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert exact_dedup(df.limit(0)).count() == 0


def test_contents_of_one_digest_stay_apart(spark):
    rows = [(i, f"text {i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (lambda n: F.lit("same"), lambda n: F.right(n, F.lit(1)).isin("0", "1").cast("string")):
        got = exact_dedup(df, digest=digest).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(i, i % 4, 10) for i in range(40)]
