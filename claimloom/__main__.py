"""The engine from a shell: `python -m claimloom COMMAND --store FOLDER`.

A store is a folder of Parquet tables: documents (doc_id, title, publisher, published_on, text, sha256), blocks, facts, rejected, relations
and attributes. Every command reads them with the engine's operators and prints rows, or writes a table anew and then puts it in the old one's
place. A model is named as module:function.
"""

from __future__ import annotations

import argparse
import importlib
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import blocks, models, reads
from claimloom.operators.layout import located
from claimloom.plans import registry
from claimloom.sources import ingest, pages

DOCUMENTS = "doc_id long, title string, publisher string, published_on string, text string, sha256 string"
BLOCKS = "block_id long, doc_id long, page_no int, ordinal int, kind string, section string, text string, notes array<string>, skip string, sha256 string"
RELATIONS = "fact_a long, fact_b long, type string, discriminator string, confidence double, decided_by string, rule_label string, explanation string"
SCHEMAS = {
    "documents": DOCUMENTS, "blocks": BLOCKS, "relations": RELATIONS, "attributes": "canon string, unit_family string, aliases array<string>, n_facts long",
    "rejected": "id long, doc_id long, block_id long, payload_json string, reason string, detail string",
    "facts": "id long, doc_id long, block_id long, subject string, attribute string, value_kind string, value_num double, value_unit string, unit_family string, value_text string, value_raw string, sig_figs int, period_raw string, "
    "period_start date, period_end date, period_gran string, period_label string, scope string, basis string, geography string, claim_key string, evidence_quote string, evidence_page int, char_start int, char_end int, grounding string, "
    "grounding_score double, confidence double",
}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def read(self, name: str) -> DataFrame:
        fs, path = self._path(name)
        if not fs.exists(path):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        """df, which may read the old table, in its place."""
        cast = [F.col(c).cast(t).alias(c) for c, t in ((f.name, f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema)]
        new = f"{name}-{uuid.uuid4().hex}"
        df.select(*cast).write.parquet(f"{self.folder}/{new}")
        fs, path = self._path(name)
        fs.delete(path, True)
        fs.rename(self._path(new)[1], path)

    def append(self, name: str, df: DataFrame, key: str) -> int:
        """df after the rows there are, numbered on in `key`."""
        old = self.read(name)
        last = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
        before = old.count()
        numbered = df.withColumn(key, F.monotonically_increasing_id() + last + 1)
        self.write(name, old.unionByName(numbered.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) if c in numbered.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns])))
        return self.read(name).count() - before


def _model(name: str | None):
    if not name:
        return None
    module, _, function = name.partition(":")
    own = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(own)  # executors needn't have the module
    return getattr(own, function)


def take_in(store: Store, paths: list[str]) -> int:
    """Text files as documents, each content once, and their blocks."""
    spark = store.spark
    own = spark.read.format("binaryFile").load(paths).select(F.element_at(F.split("path", "/"), -1).alias("title"), F.decode("content", "UTF-8").alias("text"))
    fresh = ingest.new_documents(own.withColumn("doc_id", F.monotonically_increasing_id()), store.read("documents")).drop("doc_id")
    n = store.append("documents", fresh, "doc_id")
    known = store.read("blocks").select("doc_id").distinct()
    cut = blocks.document_blocks(store.read("documents").join(known, "doc_id", "left_anti"))
    cut = cut.withColumns({"page_no": F.lit(0), "kind": F.lit("paragraph"), "section": F.lit(""), "notes": F.array().cast("array<string>")})
    store.append("blocks", cut, "block_id")
    return n


def extract(store: Store, model, name: str) -> tuple[int, int]:
    tagged, _ = models.extracted(models.sent(store.read("blocks")), model, name)
    old = store.read("facts").withColumnsRenamed({"attribute": "attribute_raw"})
    facts = models.appended(models.accepted_facts(tagged), old).withColumnsRenamed({"attribute_raw": "attribute"}).withColumn("period_label", F.col("period_raw"))
    return store.append("facts", facts, "id"), store.append("rejected", models.rejected_facts(tagged), "id")


def link(store: Store, model=None) -> None:
    names, linked = models.consolidated(store.read("facts"), store.read("attributes"), model)
    facts = linked.withColumn("attribute", F.col("canon"))
    store.write("attributes", names)
    store.write("facts", facts)


def reconcile(store: Store, model=None) -> DataFrame:
    out, stats = models.reconciled(store.read("facts"), store.read("documents").drop("text", "sha256"), store.read("relations"), model)
    store.write("relations", store.read("relations").unionByName(out.select(*store.read("relations").columns)))
    return stats


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="claimloom")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        own = sub.add_parser(name)
        own.add_argument("--store", default="store")
        for flag, kind in options:
            own.add_argument(flag, **({"action": "store_true"} if kind is bool else {"type": kind}))

    sub.add_parser("queries")
    run = sub.add_parser("query")
    run.add_argument("name")
    run.add_argument("data")
    command("ingest")
    sub.choices["ingest"].add_argument("paths", nargs="+")
    command("docs")
    command("blocks", ("doc", int), ("--page", int), ("--extractable", bool))
    command("extract", ("--model", str))
    command("facts", ("-q", str), ("--doc", int))
    command("review")
    command("link", ("--model", str))
    command("reconcile", ("--model", str))
    command("relations", ("--type", str), ("-q", str), ("--cross-document", bool))
    command("schema")
    command("evidence", ("fact", int))
    a = p.parse_args(argv)
    if a.command == "queries":
        print("\n".join(registry.QUERIES))
        return
    spark = spark or SparkSession.builder.appName("claimloom").getOrCreate()
    show = lambda df, n=100: df.show(n, truncate=120)
    if a.command == "query":
        return show(registry.QUERIES[a.name](spark, a.data))
    s = Store(spark, a.store)
    docs = lambda: s.read("documents").select("doc_id", "title", "publisher", "published_on")
    if a.command == "ingest":
        print(take_in(s, a.paths), "new documents")
    elif a.command == "docs":
        show(reads.document_counts(reads.block_counts(docs(), s.read("blocks")), s.read("facts"), s.read("rejected")).orderBy("doc_id"))
    elif a.command == "blocks":
        show(reads.inspected(s.read("blocks"), a.doc, a.page, a.extractable))
    elif a.command == "extract":
        if not a.model:
            p.error("extract needs --model module:function")
        print("%d facts, %d turned down" % extract(s, _model(a.model), a.model))
    elif a.command == "facts":
        show(reads.facts_about(s.read("facts"), a.q or "", a.doc))
    elif a.command == "review":
        show(reads.rejection_summary(s.read("rejected")))
        show(reads.rejected_feed(s.read("rejected"), docs()))
        show(reads.review_feed(s.read("facts")))
    elif a.command == "link":
        link(s, _model(a.model))
    elif a.command == "reconcile":
        show(reconcile(s, _model(a.model)))
    elif a.command == "relations":
        show(s.read("relations").groupBy("type", "decided_by").count())
        show(reads.browsed(s.read("relations"), s.read("facts"), a.type and a.type.upper(), a.cross_document, a.q))
    elif a.command == "schema":
        show(s.read("attributes").orderBy(F.desc("n_facts"), "canon"))
    elif a.command == "evidence":
        fact = s.read("facts").where(F.col("id") == a.fact)
        box = F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")
        asked = fact.select(F.col("id").alias("fact_id"), "doc_id", F.col("evidence_page").alias("page_no"), F.col("evidence_quote").alias("quote"), F.col("value_raw").alias("value"), box.alias("block"))
        words = pages.text_words(s.read("documents").join(fact.select("doc_id"), "doc_id", "left_semi"))
        show(reads.evidence(a.fact, s.read("facts"), located(asked, words)))


if __name__ == "__main__":
    main()
