import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from claimloom.llm.langid import UND
from test_jaccard import brute as components
from test_pii import SHAPES, brute as pseudonym


def corpus(spark):
    r = random.Random(11)
    en, de = ["the", "house", "and", "with", "tree", "of", "water", "garden"], ["der", "hund", "und", "katze", "das", "wasser", "nicht", "auf"]
    rows = []
    for i in range(60):
        words = en if i % 2 else de
        base = [r.choice(words) + r.choice(["", "", "s", "n"]) for _ in range(40)]
        rows.append(" ".join(base))
        if i % 5 == 0:
            rows.append("\n".join(base) + "  ")
        if i % 7 == 0:
            rows.append(" ".join([*base[:-1], "other"]))
        if i % 9 == 0:
            rows.append(" ".join(r.choice(words) for _ in range(40)) + f" 27.65.93.{i} mail{i}@example.com")
    rows += [None, "", "12 34", "!!!"]
    return [(i, t, ("de" if "der" in (t or "") else "en"), "s", len(t or "")) for i, t in enumerate(rows)]


def test_stages_against_plain_versions(spark):
    rows = corpus(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    a = pipeline.language(spark, docs, "").collect()
    assert {x.doc_id for x in a} == {x[0] for x in rows if re.search(r"[^\W\d_]", x[1] or "")} and all(x.lang != UND for x in a)
    docs = spark.createDataFrame(a, docs.schema)
    b = pipeline.exact(spark, docs, "").collect()
    groups = defaultdict(list)
    for x in a:
        groups[re.sub(r"[\x20\x09-\x0D]", "", x.text)].append((-len(x.text), x.doc_id))
    assert {x.doc_id for x in b} == {min(g)[1] for g in groups.values()}
    docs = spark.createDataFrame(b, docs.schema)
    c = pipeline.near(spark, docs, "").collect()
    assert {x.doc_id for x in c} == {i for i, _, k in components([(x.doc_id, x.text) for x in b]) if i == k}
    assert len(c) < len(b) < len(a) < len(rows)
    docs = spark.createDataFrame(c, docs.schema)
    d = {x.doc_id: x for x in pipeline.private(spark, docs, "").collect()}
    shape = re.compile("|".join(SHAPES.values()), re.ASCII)
    for x in c:
        text = shape.sub(lambda m: pseudonym(m[0]), x.text)
        assert d[x.doc_id] == x.__class__(**{**x.asDict(), "text": text, "n_chars": len(text)})
    assert any(d[x.doc_id].text != x.text for x in c)
    docs = spark.createDataFrame(list(d.values()), docs.schema)
    ids = defaultdict(list)
    for x in pipeline.packed(spark, docs, "").collect():
        ids[x.doc_id].append((x.start, np.frombuffer(x.ids, "<u4").tolist()))
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert {k: sum((p for _, p in sorted(v)), []) for k, v in ids.items()} == {k: [*lib.encode(x.text).ids, 2] for k, x in d.items()}


def test_nulls_repeated_rows_and_clashing_names(spark):
    t = "the cat sat on the mat with a hat"
    rows = [(1, t, None, 5, "x"), (1, t, None, 5, "x"), (None, "le chat noir", "fr", None, None), (2, t + "!", "en", 1, "y"), (3, t, "en", 1, "z"), (4, None, "en", None, None)]
    names = "doc_id long, text string, lang string, n_chars long, lang_pred string"
    for stage, want in ((pipeline.language, [1, 1, 2, 3, None]), (pipeline.exact, [1, 1, 2, 4, None]), (pipeline.near, [1, 1, 2, 4, None]), (pipeline.private, [1, 1, 2, 3, 4, None])):
        docs = spark.createDataFrame(rows, names)
        if stage is pipeline.language:
            docs = docs.withColumnRenamed("lang_pred", "score2")
        for clash in ("norm", "digest", "keep_id", "component_id", "n", "part", "__x"):
            docs = docs.withColumn(clash, docs["n_chars"])
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert sorted((x.doc_id for x in out.collect()), key=str) == sorted(want, key=str), stage
        assert stage(spark, docs.limit(0), "").count() == 0
    assert pipeline.packed(spark, spark.createDataFrame(rows, names), "").where("start = 0").count() == 6


def test_run(spark, tmp_path):
    spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() >= 60 and [k for k, _ in pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]


def test_rows_of_null_or_shared_ids_are_decided_one_by_one(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (None, t + " end"), (None, "clean text alone"), (None, "clean text alone "), (None, "another clean one"), (7, u), (7, "unlike the other seven"), (3, u + " end"), (9, u), (9, "nine has more")]
    docs = spark.createDataFrame([(i, x, "k") for i, x in rows], "doc_id long, text string, __row string").repartition(3)
    got = lambda stage: sorted(((x.doc_id, x.text.strip()) for x in stage(spark, docs, "").collect()), key=str)
    clean = [(None, "another clean one"), (None, "clean text alone"), (1, t), (7, "unlike the other seven"), (9, "nine has more"), (3, u + " end")]
    assert got(pipeline.exact) == sorted([*clean, (None, t + " end"), (7, u)], key=str)
    assert got(pipeline.near) == sorted(clean, key=str)
    assert pipeline.near(spark, docs, "").columns == docs.columns


def test_intermediate_tables_go(spark, tmp_path):
    from claimloom.llm.common import made

    docs = spark.createDataFrame(corpus(spark), "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = made()
    out = pipeline.run(spark, str(tmp_path))
    left = [x for x in made() if x not in before]
    assert out.count() > 0 and len(left) == 1 and "stage-pii" in left[0]
