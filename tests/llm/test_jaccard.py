import random
import re

import numpy as np
from pyspark.sql import functions as F

from claimloom.llm.jaccard import DivideSkip, components, connected, jaccard_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    own = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in own}
    while True:
        old = dict(comp)
        for i, a in own:
            for j, b in own:
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == old:
            return {(i, max(len(s) for k, s in own if k == i), comp[i]) for i, _ in own}


def test_divide_skip():
    r = random.Random(3)
    for _ in range(150):
        index, sets = DivideSkip(heap_most=r.choice([0, 20_000])), []
        for n in range(r.randint(1, 40)):
            s = sorted({int(40 * r.random() ** 2) for _ in range(r.randint(1, 25))})
            index.add(n, s)
            sets.append(set(s))
        q = sorted({int(40 * r.random() ** 2) for _ in range(r.randint(1, 25))})
        need = r.randint(1, len(q))
        assert sorted(index.search(q, need)) == [(i, len(s & set(q))) for i, s in enumerate(sets) if len(s & set(q)) >= need]


def test_components_against_all_pairs():
    r = random.Random(5)
    for _ in range(60):
        sets = [np.array(sorted(r.sample(range(60), r.randint(1, 40))), np.uint64) for _ in range(5)]
        for _ in range(r.randint(1, 60)):
            s = set(sets[r.randrange(len(sets))].tolist())
            for _ in range(r.randint(0, 5)):
                s ^= {r.randrange(60)}
            if s:
                sets.append(np.array(sorted(s), np.uint64))
        docs = r.sample(range(1000), len(sets))
        comp = dict(zip(docs, docs, strict=True))
        while True:
            old = dict(comp)
            for i, a in zip(docs, sets, strict=True):
                for j, b in zip(docs, sets, strict=True):
                    o = len(np.intersect1d(a, b))
                    if 100 * o >= 80 * (len(a) + len(b) - o):
                        comp[i] = comp[j] = min(comp[i], comp[j])
            if comp == old:
                break
        found, leaders = components(docs, sets)
        assert found == [comp[i] for i in docs] and len({found[i] for i in leaders}) == len(set(found))


def test_connected(spark):
    r = random.Random(2)
    pairs = [tuple(sorted(r.sample(range(300), 2))) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 200)]
    comp = {x: x for p in pairs for x in p}
    while True:
        old = dict(comp)
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == old:
            break
    for hub in (256, 5):
        got = connected(spark.createDataFrame(pairs, "a long, b long").repartition(7), hub).collect()
        assert len(got) == len(comp) and {x.doc: x.cluster for x in got} == comp


def corpus():
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(80)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    bases = [text(r.choice([3, 5, 8, 30, 80, 200])) for _ in range(25)]
    for b in bases:
        for _ in range(r.randint(1, 12)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += passage
            rows.append(" ".join(w) if r.random() < 0.8 else "\n".join(w).upper())
    rows += [" ".join(text(40) + passage) for _ in range(30)]
    return rows + [None, "", " \t\n", "one", "One", "a b c d", "A  b\x0bc d", "é É", "É É", "a b c d e"]


def test_against_brute_force(spark):
    rows = list(enumerate(corpus()))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(5)
    assert {tuple(x) for x in jaccard_components(df).collect()} == brute(rows)
    assert {tuple(x) for x in jaccard_components(df, chunk=400, marked_most=0).collect()} == brute(rows)  # clusters in chunks, texts by join
    assert jaccard_components(df.limit(0)).count() == 0


def test_links_through_the_texts_of_one_id(spark):
    """Document 5 stands for two texts, each near another document's."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join([*a, "more"])), (4, " ".join([*b, "more"])), (7, " ".join(b)), (8, " ".join(a))]
    assert {tuple(x) for x in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_repeated_and_null_ids_and_long_texts(spark):
    a, b, c = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50)), " ".join(f"c{i % 977}x{i % 331}" for i in range(60_000))
    rows = [(1, a), (1, a), (2, b), (3, a), (3, b), (4, c), (5, c + " end"), (6, None), (9, "z"), (7, " ".join(f"y{i % 89}q{i % 97}" for i in range(3000))), (7, a), (7, None), (8, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(x) for x in jaccard_components(df).collect()} == brute(rows)
    got = {tuple(x) for x in jaccard_components(df.unionByName(df.where("doc_id = 9").withColumn("doc_id", F.lit(None).cast("long")))).collect()}
    assert (None, 1, 9) in got and (9, 1, 9) in got
