"""Queries by operator name, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import grounding, keys, periods, repair, validation, values
from claimloom.functions.binding import let
from claimloom.operators import blocks, derived, reads, reconcile, vocabulary
from claimloom.plans import golden
from claimloom.sources import ingest
from claimloom.sources.claims import CLAIMS, DOCUMENTS, claims, documents
from claimloom.sources.store import kept

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# What DuckDB computes the same things with.
def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _phrase(x: str, gone: list[str] = keys.FILLER) -> str:
    return f"array_to_string(list_filter(string_split_regex(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9 ]+', ' ', 'g'), ' +'), lambda w: w <> '' AND w NOT IN ({_list(gone)})), ' ')"


def _subject(x: str) -> str:
    return _phrase(x, keys.FILLER + keys.COMPANY)


KEYED = f"""
claims AS ({CLAIMS}),
docs AS ({DOCUMENTS}),
k AS (SELECT *, {_subject("subject")} AS ks, {_phrase("attribute")} AS ka, CASE WHEN period_start IS NOT NULL THEN concat(period_start::DATE, '/', period_end::DATE) ELSE '' END AS kp,
             {_phrase("scope")} AS kc, {_phrase("basis")} AS kb, coalesce(unit_family, '') AS ku FROM claims),
kk AS (SELECT *, concat(ks, '|', ka) AS loose_key, concat(ks, '|', ka, '|', kp, '|', kc, '|', kb, '|', ku) AS claim_key FROM k),
best AS (
  SELECT * FROM kk QUALIFY row_number() OVER (PARTITION BY doc_id, claim_key, lower(trim(value_raw))
    ORDER BY CASE grounding WHEN 'verbatim' THEN 2 WHEN 'fuzzy' THEN 1 ELSE 0 END DESC, least(length(evidence_quote), 400) DESC, confidence DESC, id) = 1),
pairs AS (
  SELECT a, b, row_number() OVER (PARTITION BY a.loose_key ORDER BY a.doc_id = b.doc_id, least(a.confidence, b.confidence) DESC, a.id, b.id) AS rank
  FROM best a JOIN best b ON a.loose_key = b.loose_key AND a.id < b.id QUALIFY rank <= 120),
p1 AS (
  SELECT *, least(a.confidence, b.confidence) AS sure,
    list_filter([CASE WHEN a.ks <> b.ks THEN 'subject' END, CASE WHEN a.ka <> b.ka THEN 'attribute' END, CASE WHEN a.kp <> b.kp THEN 'period' END,
                 CASE WHEN a.kc <> b.kc THEN 'scope' END, CASE WHEN a.kb <> b.kb THEN 'basis' END, CASE WHEN a.ku <> b.ku THEN 'unit' END], lambda x: x IS NOT NULL) AS diffs,
    greatest(2, least(CASE WHEN a.sig_figs > 0 THEN a.sig_figs ELSE 15 END, CASE WHEN b.sig_figs > 0 THEN b.sig_figs ELSE 15 END)) AS sig,
    a.value_num IS NOT NULL AND b.value_num IS NOT NULL AND (a.unit_family = b.unit_family OR (a.unit_family = 'number' AND b.unit_family IN ('percent', 'points'))
      OR (b.unit_family = 'number' AND a.unit_family IN ('percent', 'points'))) AS fit FROM pairs),
p2 AS (
  SELECT *, CASE WHEN abs(a.value_num) > 0 THEN power(10.0, floor(log10(abs(a.value_num))) - sig + 1) ELSE 1 END AS sta, CASE WHEN abs(b.value_num) > 0 THEN power(10.0, floor(log10(abs(b.value_num))) - sig + 1) ELSE 1 END AS stb FROM p1),
p3 AS (
  SELECT *, CASE WHEN NOT fit THEN NULL WHEN a.value_num = b.value_num THEN 'exact match'
    WHEN abs(a.value_num - b.value_num) / greatest(abs(a.value_num), abs(b.value_num)) <= 0.005 THEN 'within 0.5% relative tolerance'
    WHEN round_even(a.value_num / sta, 0) * sta = round_even(b.value_num / stb, 0) * stb THEN concat('agree at ', sig, ' significant figures (one source is rounded)') END AS why FROM p2),
p4 AS (
  SELECT *, CASE WHEN a.period_start IS NULL OR b.period_start IS NULL THEN 'period (one source does not state one)'
    WHEN a.period_start = b.period_start AND a.period_end = b.period_end THEN 'period'
    WHEN (a.period_start <= b.period_start AND a.period_end >= b.period_end) OR (b.period_start <= a.period_start AND b.period_end >= a.period_end) THEN 'period (one covers part of the other)'
    WHEN a.period_start <= b.period_end AND b.period_start <= a.period_end THEN 'period (overlapping but not identical)' ELSE 'period' END AS preason,
    CASE
      WHEN len(diffs) = 0 AND (a.value_num IS NULL OR b.value_num IS NULL) THEN CASE WHEN lower(trim(a.value_raw)) = lower(trim(b.value_raw)) THEN 1 ELSE 2 END
      WHEN len(diffs) = 0 AND NOT fit THEN 0 WHEN len(diffs) = 0 AND why IS NOT NULL THEN 3 WHEN len(diffs) = 0 THEN 4
      WHEN why IS NOT NULL AND diffs = ['period'] THEN 0 WHEN why IS NOT NULL THEN 5 WHEN len(diffs) = 1 AND sure < 0.5 THEN 0
      WHEN diffs = ['period'] THEN 6 WHEN len(diffs) = 1 AND diffs[1] IN ('scope', 'basis', 'unit') THEN 7 WHEN len(diffs) = 1 THEN 0
      WHEN fit AND a.doc_id <> b.doc_id AND sure >= 0.6 THEN 8 ELSE 0 END AS verdict FROM p3),
v AS (
  SELECT a, b, a.loose_key AS loose_key, rank, sure, CASE WHEN verdict IN (1, 3, 5) THEN 'CORROBORATES' WHEN verdict IN (6, 7) THEN 'RECONCILED_BY_CONTEXT' END AS label,
    CASE verdict WHEN 5 THEN array_to_string(diffs, ', ') WHEN 6 THEN preason WHEN 7 THEN diffs[1] WHEN 8 THEN array_to_string(diffs, ', ') ELSE '' END AS discriminator,
    (CASE verdict WHEN 1 THEN 0.9 WHEN 3 THEN 0.95 WHEN 5 THEN 0.75 WHEN 6 THEN 0.9 WHEN 7 THEN 0.85 ELSE 0.0 END)::DOUBLE AS confidence,
    CASE verdict WHEN 1 THEN 'identical claim, identical statement' WHEN 2 THEN 'identical claim, differing statements' WHEN 3 THEN concat('identical claim, values ', why)
      WHEN 4 THEN 'identical claim, values disagree' WHEN 5 THEN concat('values agree despite differing ', array_to_string(diffs, ', ')) WHEN 6 THEN 'single differing qualifier: period'
      WHEN 7 THEN concat('single differing qualifier: ', diffs[1]) WHEN 8 THEN 'several differing qualifiers' ELSE '' END AS rule,
    verdict IN (2, 4, 8) AS needs_model FROM p4),
rel AS (SELECT a.id AS fact_a, b.id AS fact_b, label AS type, discriminator, confidence, 'rule' AS decided_by, rule AS rule_label FROM v WHERE label IS NOT NULL)
"""


def keyed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.keyed(claims(spark, sf_dir))


def best_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.best_evidence(keyed_claims(spark, sf_dir))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.classified(reconcile.candidate_pairs(best_claims(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations that rules find, a table that a session writes once, as a store would hold them."""
    return kept(spark, "relations", sf_dir, lambda: reconcile.relations(verdicts(spark, sf_dir)))


# ---- scalars
def _rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    return spark.sql(f"SELECT * FROM {golden.sql(rows, names)}")


@query("N1_parse_value", f"SELECT raw, kind, number, unit FROM {golden.sql(golden.VALUES, ['raw', 'kind', 'number', 'unit'])}")
def parse_values(spark, sf_dir):
    p = values.parse(F.col("raw"))
    return _rows(spark, golden.VALUES, ["raw", "k", "n", "u"]).select("raw", p["kind"].alias("kind"), p["number"].alias("number"), p["unit"].alias("unit"))


@query("N1_parse_claims", f"WITH {KEYED} SELECT id, value_num AS number, CASE unit_family WHEN 'percent' THEN 'percent' ELSE 'money' END AS kind, unit_family, sig_figs::BIGINT AS sig_figs FROM claims")
def parse_claims(spark, sf_dir):
    p = values.parse(F.col("value_raw"))
    return claims(spark, sf_dir).select("id", p["number"].alias("number"), p["kind"].alias("kind"), p["unit_family"].alias("unit_family"), p["sig_figs"].cast("long").alias("sig_figs"))


@query("N2_sig_figs", f"WITH {KEYED} SELECT id, greatest(length(regexp_replace(regexp_replace(value_raw, '[^0-9]', '', 'g'), CASE WHEN contains(value_raw, '.') THEN '^0+' ELSE '^0+|0+$' END, '', 'g')), 1)::BIGINT AS sig FROM claims")
def sig_figs(spark, sf_dir):
    return claims(spark, sf_dir).select("id", values.sig_figs(F.regexp_extract("value_raw", r"([0-9.]+)", 1)).cast("long").alias("sig"))


@query("N3_currency", "SELECT raw, code FROM (VALUES ('₹5','INR'),('rs 5','INR'),('hours 5',NULL),('US$5','USD'),('5 eur','EUR'),('£9','GBP'),('neur 5',NULL),('$7','USD'),('usd7','USD')) AS t(raw, code)")
def currencies(spark, sf_dir):
    own = [(x,) for x in ("₹5", "rs 5", "hours 5", "US$5", "5 eur", "£9", "neur 5", "$7", "usd7")]
    return _rows(spark, own, ["raw"]).select("raw", values.currency(F.col("raw")).alias("code"))


@query("N4_scale", "SELECT * FROM (VALUES ('5 lakh', 1e5::DOUBLE), ('5 crore', 1e7::DOUBLE), ('5 bn', 1e9::DOUBLE), ('2 thousand crores', 1e10::DOUBLE), ('5', 1.0::DOUBLE)) AS t(raw, factor)")
def scales(spark, sf_dir):
    own = [(x,) for x in ("5 lakh", "5 crore", "5 bn", "2 thousand crores", "5")]
    return _rows(spark, own, ["raw"]).select("raw", values.scale(F.col("raw"), F.regexp_extract("raw", values.NUMBER, 2)).alias("factor"))


@query("N5_unit", "SELECT * FROM (VALUES (' tonnes a day', 'tons'), (' sq ft', 'sqft'), ('x', 'times'), (' new stores, net', 'new stores'), (' 7.', '')) AS t(tail, unit)")
def units(spark, sf_dir):
    own = [(x,) for x in (" tonnes a day", " sq ft", "x", " new stores, net", " 7.")]
    return _rows(spark, own, ["tail"]).select("tail", values.unit(F.col("tail")).alias("unit"))


PAIRED = "c AS (SELECT * FROM claims WHERE period_gran = 'year')"


def _neighbours(spark, sf_dir) -> DataFrame:
    """Claims of a subject and period, paired: an equi-join on both."""
    own = claims(spark, sf_dir).where("period_gran = 'year'").withColumn("who", keys.subject_key(F.col("subject")))
    side = lambda p: own.select("who", "period_start", F.struct("id", "value_num", "unit_family", "sig_figs").alias(p))
    return side("a").join(side("b"), ["who", "period_start"]).where("a.id < b.id")


@query("N6_comparable", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, a.unit_family = b.unit_family AS comparable FROM k a JOIN k b ON a.ks = b.ks AND a.period_start = b.period_start AND a.id < b.id WHERE a.period_gran = 'year' AND b.period_gran = 'year'")
def comparables(spark, sf_dir):
    c = values.comparable(F.col("a.value_num"), F.col("a.unit_family"), F.col("b.value_num"), F.col("b.unit_family"))
    return _neighbours(spark, sf_dir).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), c.alias("comparable"))


@query("N7_round_sig", f"WITH {KEYED} SELECT id, round_even(value_num / power(10.0, floor(log10(abs(value_num))) - 2), 0) AS mantissa FROM claims WHERE value_num <> 0")
def rounded(spark, sf_dir):
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.abs("value_num"))) - 2)
    return claims(spark, sf_dir).where("value_num <> 0").select("id", F.bround(values.round_sig(F.col("value_num"), F.lit(3)) / step, 0).alias("mantissa"))


@query("N8_values_agree", f"WITH {KEYED}, {PAIRED}, p AS (SELECT a, b, greatest(2, least(a.sig_figs, b.sig_figs)) AS sig FROM k a JOIN k b ON a.ks = b.ks AND a.period_start = b.period_start AND a.id < b.id WHERE a.period_gran = 'year' AND b.period_gran = 'year' AND a.unit_family = b.unit_family AND a.value_num <> 0 AND b.value_num <> 0), q AS (SELECT *, power(10.0, floor(log10(abs(a.value_num))) - sig + 1) AS x, power(10.0, floor(log10(abs(b.value_num))) - sig + 1) AS y FROM p) SELECT a.id AS a, b.id AS b, CASE WHEN a.value_num = b.value_num THEN 'exact match' WHEN abs(a.value_num - b.value_num) / greatest(abs(a.value_num), abs(b.value_num)) <= 0.005 THEN 'within 0.5% relative tolerance' WHEN round_even(a.value_num / x, 0) * x = round_even(b.value_num / y, 0) * y THEN concat('agree at ', sig, ' significant figures (one source is rounded)') END AS why FROM q")
def agreements(spark, sf_dir):
    own = _neighbours(spark, sf_dir).where("a.unit_family = b.unit_family and a.value_num <> 0 and b.value_num <> 0")
    why = values.agreement(F.col("a.value_num"), F.col("a.sig_figs"), F.col("b.value_num"), F.col("b.sig_figs"))
    return own.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), why.alias("why"))


@query("N9_parse_period", f"SELECT raw, p0 AS period_start, p1 AS period_end, gran FROM {golden.sql(golden.PERIODS, ['raw', 'p0', 'p1', 'gran'])}")
def parse_periods(spark, sf_dir):
    p = periods.parse(F.col("raw"))
    return _rows(spark, golden.PERIODS, ["raw", "a", "b", "c"]).select("raw", p["start"].cast("string").alias("period_start"), p["end"].cast("string").alias("period_end"), p["gran"].alias("gran"))


@query("N9_parse_labels", f"WITH {KEYED} SELECT DISTINCT period_label, period_start::DATE AS p0, period_end::DATE AS p1, period_gran AS gran FROM claims")
def parse_labels(spark, sf_dir):
    p = periods.parse(F.col("period_label"))
    return claims(spark, sf_dir).select("period_label").distinct().select("period_label", p["start"].alias("p0"), p["end"].alias("p1"), p["gran"].alias("gran"))


@query("N10_fiscal", "SELECT fy, q, count(*) AS n, min(o_orderdate::DATE) >= make_date(fy - CASE WHEN q = 4 THEN 0 ELSE 1 END, (q * 3) % 12 + 1, 1) AS within FROM (SELECT o_orderdate, (year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END)::INTEGER AS fy, ((month(o_orderdate) + 8) % 12 // 3 + 1)::INTEGER AS q FROM orders) GROUP BY fy, q")
def fiscal(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select("o_orderdate", periods.fiscal_year_of(F.col("o_orderdate")).alias("fy"), periods.fiscal_quarter(F.col("o_orderdate")).alias("q"))
    own = own.groupBy("fy", "q").agg(F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("d"))
    return own.select("fy", "q", "n", (F.col("d") >= periods.quarter_start(F.col("fy"), F.col("q"))).alias("within"))


YEAR = "concat(make_date({0} - 1, 4, 1), '/', make_date({0}, 3, 31))"
LAST = "year(period_end::DATE) + CASE WHEN month(period_end::DATE) >= 4 THEN 1 ELSE 0 END"


@query("N11_find_periods", f"WITH {KEYED}, f AS (SELECT *, ({LAST})::INTEGER AS fy FROM claims) SELECT id, concat(CASE WHEN period_gran = 'quarter' THEN concat(period_start::DATE, '/', period_end::DATE, ' ') ELSE '' END, {YEAR.format('fy')}, ' ', {YEAR.format('(fy - 1)')}) AS found FROM f")
def find_periods(spark, sf_dir):
    """Periods that a sentence about each claim names; of a fiscal year written as a pair the first year reads as one too."""
    text = F.concat(F.lit("In "), F.col("period_label"), F.lit(" it was "), F.col("value_raw"))
    found = F.transform(periods.find(text), lambda p: F.concat_ws("/", p["start"].cast("string"), p["end"].cast("string")))
    return claims(spark, sf_dir).select("id", F.array_join(found, " ").alias("found"))


RELATED = "CASE WHEN a.p0 = b.p0 AND a.p1 = b.p1 THEN 'equal' WHEN a.p0 <= b.p0 AND a.p1 >= b.p1 THEN 'contains' WHEN b.p0 <= a.p0 AND b.p1 >= a.p1 THEN 'contained_by' WHEN a.p0 <= b.p1 AND b.p0 <= a.p1 THEN 'overlaps' ELSE 'disjoint' END"


@query("N12_relation", f"WITH {KEYED}, d AS (SELECT DISTINCT period_label AS l, period_start::DATE AS p0, period_end::DATE AS p1, left(period_label, 1) = 'Q' AS q FROM claims) SELECT a.l AS a, b.l AS b, {RELATED} AS relation FROM d a JOIN d b ON year(a.p1) = year(b.p1)")
def relations_of_periods(spark, sf_dir):
    own = claims(spark, sf_dir).select(F.col("period_label").alias("l"), F.col("period_start").alias("p0"), F.col("period_end").alias("p1")).distinct()
    a, b = own.withColumn("y", F.year("p1")).alias("a"), own.withColumn("y", F.year("p1")).alias("b")
    rel = periods.relation(F.col("a.p0"), F.col("a.p1"), F.col("b.p0"), F.col("b.p1"))
    return a.join(b, F.col("a.y") == F.col("b.y")).select(F.col("a.l").alias("a"), F.col("b.l").alias("b"), rel.alias("relation"))


SAME = "a.subject = b.subject AND a.id < b.id"


@query("N13_same_period", f"WITH {KEYED}, c AS (SELECT id, subject, period_start AS p0, period_end AS p1 FROM claims) SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON {SAME} AND a.p0 = b.p0 AND a.p1 = b.p1 UNION ALL SELECT a.id, b.id FROM (SELECT * FROM c WHERE p0 IS NULL AND p1 IS NULL) a JOIN (SELECT * FROM c WHERE p0 IS NULL AND p1 IS NULL) b ON {SAME}")
def same_period(spark, sf_dir):
    own = claims(spark, sf_dir).select("id", "subject", "period_start", "period_end")
    a, b = own.alias("a"), own.alias("b")
    same = F.col("a.period_start").eqNullSafe(F.col("b.period_start")) & F.col("a.period_end").eqNullSafe(F.col("b.period_end"))
    return a.join(b, (F.col("a.subject") == F.col("b.subject")) & same & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("N14_phrase", f"SELECT p_partkey, {_phrase('p_name')} AS phrase, {_phrase('p_type')} AS kind FROM part")
def phrases(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", keys.phrase(F.col("p_name")).alias("phrase"), keys.phrase(F.col("p_type")).alias("kind"))


@query("N15_subject", f"WITH {KEYED} SELECT DISTINCT subject, ks AS subject_key FROM k")
def subjects(spark, sf_dir):
    return claims(spark, sf_dir).select("subject", keys.subject_key(F.col("subject")).alias("subject_key")).distinct()


@query("N16_claim_key", f"WITH {KEYED} SELECT id, claim_key FROM kk")
def claim_keys(spark, sf_dir):
    return keyed_claims(spark, sf_dir).select("id", "claim_key")


@query("N17_loose_key", f"WITH {KEYED} SELECT loose_key, count(*) AS n FROM kk GROUP BY loose_key")
def loose_keys(spark, sf_dir):
    return keyed_claims(spark, sf_dir).groupBy(keys.loose_key(F.col("subject"), F.col("attribute")).alias("loose_key")).agg(F.count(F.lit(1)).alias("n"))


@query("N18_diff", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, array_to_string(diffs, ',') AS diffs FROM p1")
def differences(spark, sf_dir):
    d = keys.differing(F.col("a.claim"), F.col("b.claim"))
    return reconcile.candidate_pairs(best_claims(spark, sf_dir)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.array_join(d, ",").alias("diffs"))


# ---- validation and grounding
WHITE = "[ \\t\\n\\x0B\\f\\r]"


def _clean(x: str, most: int) -> str:
    own = f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"
    return f"CASE WHEN lower({own}) NOT IN ({_list(validation.NOTHING)}) THEN substring({own}, 1, {most}) END"


CUT = f"regexp_replace(regexp_extract(lower(v), '(\\S+)\\s*$', 1), '[.,;:]+$', '') IN ({_list(validation.DANGLING)})"


@query("E6_validate", f"WITH c AS (SELECT doc_id, {_clean('source', 200)} AS s, {_clean('lang', 200)} AS a, {_clean('text', 300)} AS v, {_clean('text', 1200)} AS q, n_chars / 4000 AS c FROM documents) SELECT doc_id, coalesce(s, '(unspecified)') AS subject, lower(a) AS attribute, sha256(v) AS value, CASE WHEN a IS NULL THEN 'missing attribute' WHEN v IS NULL THEN 'missing value' WHEN q IS NULL THEN 'missing evidence quote' WHEN contains(v, '=') AND contains(v, ';') THEN 'value looks like a whole table row, not one cell' WHEN {CUT} THEN 'value looks truncated mid-phrase' ELSE '' END AS reason, least(greatest(coalesce(c, 0.7), 0), 1)::DOUBLE AS confidence FROM c")
def validate(spark, sf_dir):
    """Every document as a proposal: of its source, its language has its text as value and evidence."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subject"), F.col("lang").alias("attribute"), F.col("text").alias("value"), F.col("text").alias("evidence_quote"), (F.col("n_chars") / 4000).cast("string").alias("confidence"))
    raw = own.withColumns({c: F.lit(None).cast("string") for c in ("value_kind", "period", "scope", "basis", "geography")})
    return validation.validated(raw).select("doc_id", "subject", "attribute", F.sha2("value", 256).alias("value"), "reason", "confidence")


def _answered(spark, sf_dir, answer) -> DataFrame:
    """What a model might have said of each event's properties, and what can be read from it."""
    own = table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return repair.parsed(own)


@query("E9_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN json_extract_string(props, '$.k') END AS k FROM events")
def answers(spark, sf_dir):
    """Answers as they should be, in a fence, in a sentence with a comma too many, and of words alone."""
    p, way = F.col("props"), F.col("event_id") % 4
    said = F.when(way == 0, p).when(way == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(way == 2, F.concat(F.lit("It is ["), p, F.lit(",] as asked."))).otherwise("nothing to tell")
    return _answered(spark, sf_dir, said).select("event_id", F.coalesce(F.get_json_object("json", "$.k"), F.get_json_object("json", "$[0].k")).alias("k"))


@query("E10_salvage", "SELECT event_id, 2::BIGINT AS n, json_extract_string(props, '$.k') AS k FROM events")
def salvages(spark, sf_dir):
    """Arrays that end within their third object."""
    p = F.col("props")
    own = _answered(spark, sf_dir, F.concat(F.lit("["), p, F.lit(", "), p, F.lit(', {"k": [1, "two')))
    return own.select("event_id", F.size(repair.facts_in(F.col("json"))).cast("long").alias("n"), F.get_json_object("json", "$[1].k").alias("k"))


@query("E11_explode", "SELECT event_id, nth::BIGINT AS nth, json_extract_string(props, '$.k') AS k FROM (SELECT event_id, props, unnest(range(0, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END)) AS nth FROM events)")
def exploded(spark, sf_dir):
    """The facts of answers: lists of two, and objects with a list of one."""
    p = F.col("props")
    own = _answered(spark, sf_dir, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), p, F.lit(","), p, F.lit("]"))).otherwise(F.concat(F.lit('{"facts": ['), p, F.lit("]}"))))
    return own.select("event_id", F.posexplode(repair.facts_in(F.col("json"))).alias("nth", "fact")).select("event_id", F.col("nth").cast("long").alias("nth"), F.get_json_object("fact", "$.k").alias("k"))


@query("E3_clean", "SELECT event_id, CASE WHEN lower(trim(event_type)) NOT IN ('', 'null', 'none', 'n/a', 'unknown') THEN substring(trim(event_type), 1, 4) END AS kind FROM events")
def cleaned(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", validation.clean(F.col("event_type"), 4).alias("kind"))


@query("E4_rowdump", "SELECT event_id, contains(props, '=') AND contains(props, ';') AS dump FROM events")
def row_dumps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", validation.row_dump(F.col("props")).alias("dump"))


@query("E5_truncated", f"SELECT doc_id, regexp_replace(regexp_extract(lower(text), '(\\S+)\\s*$', 1), '[.,;:]+$', '') IN ({_list(validation.DANGLING)}) AS cut FROM documents")
def cut_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", validation.truncated(F.col("text")).alias("cut"))


FOLD = "lower(trim(regexp_replace(translate(replace(replace(coalesce({0}, ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '‐‑‒–—―−‘’‚“”„', '-------''''''\"\"\"'), '\\s+', ' ', 'g')))"


@query("G1_normalise", f"SELECT item_id, sha256({FOLD.format('text')}) AS folded FROM benchmark")
def fold(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(grounding.folded(F.col("text")), 256).alias("folded"))


@query("G2_verbatim", f"WITH d AS (SELECT doc_id, {FOLD.format('text')} AS t FROM documents), b AS (SELECT item_id, {FOLD.format('text')} AS q FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.q) WHERE b.q <> ''")
def verbatim(spark, sf_dir):
    """Documents that hold a whole benchmark item, both folded. Candidates are an equi-join on the item's words from the second on, six
    at most and never its last, which stand whole in any text that holds it; items of one or two words are looked for in every document."""
    fold = lambda c: grounding.folded(F.col(c), nfkc=False)
    docs = table(spark, sf_dir, "documents").select("doc_id", fold("text").alias("t"))
    items = table(spark, sf_dir, "benchmark").select("item_id", fold("text").alias("q")).where("q <> ''").withColumn("k", F.least(F.size(F.split("q", " ")) - 2, F.lit(6)))
    held = F.contains("t", "q")
    of = lambda w, k: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array())
    sizes = sorted(r.k for r in items.select("k").distinct().collect())
    out = docs.limit(0).crossJoin(items.limit(0))
    if sizes and sizes[0] < 1:
        out = out.unionByName(docs.join(items.where("k < 1"), held))
    if sizes := [k for k in sizes if k > 0]:
        grams = docs.select("doc_id", F.explode(let(F.split("t", " "), lambda w: F.array_distinct(F.flatten(F.array(*[of(w, k) for k in sizes]))))).alias("gram"))
        own = items.where("k > 0").select("item_id", F.array_join(F.slice(F.split("q", " "), F.lit(2), F.col("k")), " ").alias("gram"))
        near = grams.join(own, "gram").select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")).distinct()
        found = near.join(docs, F.col("d").eqNullSafe(F.col("doc_id"))).join(items.where("k > 0"), F.col("i").eqNullSafe(F.col("item_id")))
        out = out.unionByName(found.where(held).drop("d", "i"))
    return out.select("item_id", "doc_id")


@query("G6_value_in_span", f"WITH {KEYED}, n AS (SELECT id, lower(value_raw) AS v, lower(evidence_quote) AS q FROM claims), g AS (SELECT id, v, q, regexp_replace(v, '[^0-9]', '', 'g') AS d, regexp_replace(q, '[^0-9]', '', 'g') AS e FROM n) SELECT id, CASE WHEN contains(q, v) THEN '' WHEN contains(e, d) THEN '' ELSE concat('value digits ''', d, ''' not present in the quoted evidence') END AS reason FROM g")
def spans(spark, sf_dir):
    own = claims(spark, sf_dir)
    return own.select("id", grounding.value_in_span(grounding.folded(F.col("value_raw"), False), grounding.folded(F.col("evidence_quote"), False)).alias("reason"))


def _sourced(spark, sf_dir) -> DataFrame:
    """Claims as proposals: quote, value, and the text of their document that speaks of their subject. Shipped revenue is quoted with a
    word that isn't there."""
    own = claims(spark, sf_dir)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "evidence_quote"))), lambda x: x["evidence_quote"]), ". ")
    quote = F.when(F.col("basis").isNotNull(), F.concat(F.lit("shipped "), F.col("evidence_quote"))).otherwise(F.col("evidence_quote"))
    return own.join(own.groupBy("doc_id", "subject").agg(said.alias("source")), ["doc_id", "subject"]).select("id", "doc_id", "attribute", quote.alias("quote"), F.col("value_raw").alias("value"), "source")


GATE = "n AS (SELECT *, lower(value_raw) AS v, lower(evidence_quote) AS q FROM claims), g AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, regexp_replace(q, '[^0-9]', '', 'g') AS e FROM n), gated AS (SELECT id, doc_id, attribute, CASE WHEN basis IS NOT NULL THEN 'quote not found in the source text' WHEN contains(q, v) OR contains(e, d) THEN '' ELSE concat('value digits ''', d, ''' not present in the quoted evidence') END AS reason FROM g)"


@query("G7_ground", f"WITH {KEYED}, {GATE} SELECT id, CASE WHEN reason = '' THEN 'verbatim' ELSE 'failed' END AS status, reason FROM gated")
def ground(spark, sf_dir):
    """All claims through the gates, but for the fuzzy one."""
    return grounding.grounded(_sourced(spark, sf_dir), fuzzy=False).select("id", "status", "reason")


@query("G5_fuzzy")
def fuzzy(spark, sf_dir):
    """All claims, each quoted with two letters the wrong way round, against what its document says of the same measure and subject."""
    own = claims(spark, sf_dir)
    by = ["doc_id", "subject", "attribute"]
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "evidence_quote"))), lambda x: x["evidence_quote"]), ". ")
    own = own.join(own.groupBy(*by).agg(said.alias("source")), by)
    own = own.select("id", F.replace("evidence_quote", F.lit("period stood"), F.lit("peroid stood")).alias("quote"), F.col("value_raw").alias("value"), "source")
    return grounding.grounded(own.repartition(spark.sparkContext.defaultParallelism, "id")).select("id", "status", "reason")


# ---- blocks
LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"


@query("L2_running_lines", f"WITH l AS (SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS page_no, unnest({LINES}) AS text FROM documents), p AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM l GROUP BY doc_id HAVING count(DISTINCT page_no) >= 4), s AS (SELECT DISTINCT doc_id, page_no, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS shape FROM l) SELECT doc_id, shape, count(*) AS n_pages FROM s JOIN p USING (doc_id) WHERE length(shape) BETWEEN 3 AND 90 GROUP BY doc_id, shape, pages HAVING count(*) >= greatest(3, floor(pages * 0.35))")
def running(spark, sf_dir):
    """Each line of a document as a page of its own."""
    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")).alias("page_no", "text"))
    return blocks.running_lines(own.withColumn("margin", F.lit(True)))


@query("L4_numeric_token", "WITH w AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\s+')) AS w FROM documents), t AS (SELECT doc_id, regexp_replace(w, '[.,;]+$', '') AS w FROM w) SELECT doc_id, count(*) AS n FROM t WHERE NOT contains(w, '/') AND regexp_matches(w, '" + blocks.NUMERIC + "') GROUP BY doc_id")
def numeric_tokens(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("text rlike '[0-9]'").select("doc_id", F.explode(F.split("text", r"\s+")).alias("w"))
    return own.where(blocks.numeric_token(F.col("w"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


PRE = "CASE WHEN regexp_matches(lower(t), '" + blocks.BOILERPLATE + "') THEN 'boilerplate' WHEN length(t) < 25 THEN 'too short' WHEN NOT regexp_matches(t, '[0-9]') AND NOT regexp_matches(lower(t), '" + blocks.CUES + "') THEN 'no numeric or semantic content' ELSE '' END"


@query("L16_prefilter", f"SELECT doc_id, {PRE} AS skip FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def prefilters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", blocks.prefilter(F.col("text"), F.lit("paragraph")).alias("skip"))


PARAS = f"""RECURSIVE l AS (SELECT doc_id, unnest(range(1, len({LINES}) + 1)) AS i, unnest({LINES}) AS t FROM documents),
r AS (SELECT doc_id, i, 0 AS g, length(t) AS size FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.size >= {blocks.PACK_MOST} OR r.size + length(l.t) > {blocks.PACK} THEN r.g + 1 ELSE r.g END, CASE WHEN r.size >= {blocks.PACK_MOST} OR r.size + length(l.t) > {blocks.PACK} THEN length(l.t) ELSE r.size + length(l.t) END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
p AS (SELECT doc_id, g AS ordinal, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM r JOIN l USING (doc_id, i) GROUP BY doc_id, g)"""


@query("L17_pack", f"WITH {PARAS}, s AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM p) SELECT doc_id, ordinal, length(text)::INTEGER AS chars, {PRE} AS skip, sha256(concat('paragraph', chr(10), chr(10), text, chr(10))) AS sha256 FROM s")
def packed(spark, sf_dir):
    return blocks.document_blocks(table(spark, sf_dir, "documents")).select("doc_id", "ordinal", F.length("text").alias("chars"), "skip", "sha256")


@query("L21_block_sha", "SELECT doc_id, sha256(concat('paragraph', chr(10), source, chr(10), text, chr(10))) AS sha FROM documents")
def block_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", blocks.block_sha(F.lit("paragraph"), F.col("source"), F.col("text"), F.lit(None)).alias("sha"))


# ---- vocabulary
@query("V1_distinct", f"WITH {KEYED} SELECT attribute AS attribute_raw, unit_family, count(*) AS n, min(value_raw) AS example FROM claims GROUP BY attribute, unit_family")
def distinct_attributes(spark, sf_dir):
    return vocabulary.distinct_attributes(claims(spark, sf_dir))


@query("V3_blocking", f"WITH {KEYED} SELECT attribute AS attribute_raw, unit_family, CASE WHEN {_phrase('attribute')} = 'revenue' THEN 'revenue' ELSE attribute END AS canon, count(*) AS n FROM claims GROUP BY ALL")
def blocked(spark, sf_dir):
    return vocabulary.blocked(vocabulary.distinct_attributes(claims(spark, sf_dir)))


MAPPED = "m AS (SELECT attribute AS attribute_raw, unit_family, count(*) AS n, regexp_replace(ka, ' (share|growth)$', '') AS base FROM k GROUP BY ALL), un AS (SELECT base, unit_family, row_number() OVER (PARTITION BY base ORDER BY sum(n) DESC, unit_family) AS rn FROM m GROUP BY base, unit_family), vm AS (SELECT m.attribute_raw, m.unit_family, m.n, CASE WHEN rn = 1 THEN m.base ELSE concat(m.base, ' (', regexp_replace(m.unit_family, '^.*:', ''), ')') END AS canon FROM m JOIN un USING (base, unit_family))"


def _mapped(spark, sf_dir) -> DataFrame:
    own = vocabulary.distinct_attributes(claims(spark, sf_dir))
    return vocabulary.split_units(own.withColumn("canon", F.regexp_replace(keys.phrase(F.col("attribute_raw")), " (share|growth)$", "")))


@query("V7_unit_split", f"WITH {KEYED}, {MAPPED} SELECT attribute_raw, unit_family, n, canon FROM vm")
def unit_split(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query("V8_relink", f"WITH {KEYED}, {MAPPED} SELECT id, canon FROM claims c JOIN vm ON c.attribute = vm.attribute_raw AND c.unit_family = vm.unit_family")
def relink(spark, sf_dir):
    return vocabulary.relinked(claims(spark, sf_dir), _mapped(spark, sf_dir)).select("id", "canon")


@query("V9_rekey", f"WITH {KEYED}, {MAPPED} SELECT id, concat(ks, '|', {_phrase('canon')}, '|', kp, '|', kc, '|', kb, '|', ku) AS claim_key FROM k JOIN vm ON k.attribute = vm.attribute_raw AND k.unit_family = vm.unit_family")
def rekey(spark, sf_dir):
    return reconcile.keyed(vocabulary.relinked(claims(spark, sf_dir), _mapped(spark, sf_dir)), "canon").select("id", "claim_key")


@query("V10_schema", f"WITH {KEYED}, {MAPPED}, l AS (SELECT canon, c.unit_family, attribute FROM claims c JOIN vm ON c.attribute = vm.attribute_raw AND c.unit_family = vm.unit_family) SELECT canon, unit_family, count(*) AS n_facts, array_to_string(list_filter(list_sort(list(DISTINCT attribute)), lambda x: x <> canon), '; ') AS aliases FROM l GROUP BY canon, unit_family")
def vocabulary_schema(spark, sf_dir):
    return vocabulary.schema_of(vocabulary.relinked(claims(spark, sf_dir), _mapped(spark, sf_dir)))


# ---- reconciliation
@query("R1_fact_view", f"WITH {KEYED}, {MAPPED} SELECT id, coalesce(canon, attribute) AS attribute, title, publisher FROM claims c JOIN docs ON c.doc_id = docs.doc_id LEFT JOIN vm ON c.attribute = vm.attribute_raw AND c.unit_family = vm.unit_family")
def fact_view(spark, sf_dir):
    named = _mapped(spark, sf_dir).select(F.col("attribute_raw").alias("attribute"), "unit_family", "canon")
    return reconcile.fact_view(claims(spark, sf_dir), documents(spark), named).select("id", "attribute", "title", "publisher")


@query("R2_dedupe", f"WITH {KEYED} SELECT id, claim_key FROM best")
def dedupe(spark, sf_dir):
    return best_claims(spark, sf_dir).select("id", "claim_key")


@query("R3_cluster", f"WITH {KEYED} SELECT loose_key, count(*) AS n FROM best GROUP BY loose_key HAVING count(*) > 1")
def clusters(spark, sf_dir):
    return best_claims(spark, sf_dir).groupBy("loose_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("R4_pairs", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, rank FROM pairs")
def pairs(spark, sf_dir):
    return reconcile.candidate_pairs(best_claims(spark, sf_dir)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("rank").cast("long").alias("rank"))


ASKED = "asked AS (SELECT fact_b AS fact_a, fact_a AS fact_b FROM rel WHERE fact_a % 3 = 0)"


@query("R5_undecided", f"WITH {KEYED}, {ASKED} SELECT a.id AS a, b.id AS b FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM asked WHERE least(fact_a, fact_b) = p.a.id AND greatest(fact_a, fact_b) = p.b.id)")
def undecided(spark, sf_dir):
    asked = edges(spark, sf_dir).where("fact_a % 3 = 0").select(F.col("fact_b").alias("fact_a"), F.col("fact_a").alias("fact_b"), F.lit("llm").alias("decided_by"))
    return reconcile.undecided(reconcile.candidate_pairs(best_claims(spark, sf_dir)), asked).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("R6_classify", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, label, discriminator, confidence, rule, needs_model FROM v")
def classify(spark, sf_dir):
    return verdicts(spark, sf_dir).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "label", "discriminator", "confidence", "rule", "needs_model")


@query("R7_period_text", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, preason AS reason FROM p4")
def period_texts(spark, sf_dir):
    return reconcile.candidate_pairs(best_claims(spark, sf_dir)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), reconcile.period_reason().alias("reason"))


@query("R8_order", f"WITH {KEYED}, o AS (SELECT a.id AS x, b.id AS y, coalesce(da.published_on, '9999-99-99') AS dx, coalesce(db.published_on, '9999-99-99') AS dy FROM pairs p JOIN docs da ON p.a.doc_id = da.doc_id JOIN docs db ON p.b.doc_id = db.doc_id) SELECT CASE WHEN (dx, x) <= (dy, y) THEN x ELSE y END AS earlier, CASE WHEN (dx, x) <= (dy, y) THEN y ELSE x END AS later FROM o")
def ordered(spark, sf_dir):
    return reconcile.dated(reconcile.candidate_pairs(best_claims(spark, sf_dir)), documents(spark))


@query("R9_pending", f"WITH {KEYED} SELECT a.id AS a, b.id AS b, sure FROM v WHERE needs_model ORDER BY sure DESC, a.id, b.id LIMIT 250")
def pending(spark, sf_dir):
    return reconcile.pending(verdicts(spark, sf_dir)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "sure")


TALE = "CASE WHEN r.type = 'CORROBORATES' AND r.discriminator <> '' THEN concat(says, '. These differ by ', r.discriminator, ', but the values still agree.') WHEN r.type = 'CORROBORATES' THEN concat(says, ' for the same claim; the values agree.') ELSE concat(says, '. These are not the same claim: they differ by ', r.discriminator, CASE string_split(r.discriminator, ' ')[1] WHEN 'period' THEN concat(' — ', pa, ' against ', pb) WHEN 'basis' THEN concat(' — ', coalesce(ba, 'not stated'), ' against ', coalesce(bb, 'not stated')) WHEN 'scope' THEN ' — not stated against not stated' ELSE '' END, ', which accounts for the difference.') END"


@query("R12_narrate", f"WITH {KEYED}, r AS (SELECT rel.*, concat(coalesce(da.publisher, da.title), ' reports ', a.value_raw, ' and ', coalesce(db.publisher, db.title), ' reports ', b.value_raw) AS says, a.period_label AS pa, b.period_label AS pb, a.basis AS ba, b.basis AS bb FROM rel JOIN claims a ON a.id = fact_a JOIN claims b ON b.id = fact_b JOIN docs da ON da.doc_id = a.doc_id JOIN docs db ON db.doc_id = b.doc_id) SELECT fact_a, fact_b, type, {TALE} AS explanation FROM r")
def narrate(spark, sf_dir):
    return reconcile.narrated(edges(spark, sf_dir), claims(spark, sf_dir), documents(spark))


@query("S10_upsert", f"WITH {KEYED} SELECT fact_a, fact_b, type FROM rel WHERE fact_a % 2 = 1")
def upsert(spark, sf_dir):
    """Edges found again, some the other way round, against a store that has half of them."""
    own = edges(spark, sf_dir)
    turned = own.withColumns({"fact_a": F.col("fact_b"), "fact_b": F.col("fact_a")})
    return reconcile.new_relations(own.unionByName(turned), own.where("fact_a % 2 = 0").select("fact_a", "fact_b", "type")).select("fact_a", "fact_b", "type")


# ---- derived values
WORDS = f"list_filter(string_split(ka, ' '), lambda w: length(w) > 2 AND w NOT IN ({_list(derived.WEAK)}))"
PARTS = f"""x AS (SELECT *, {_phrase("subject")} AS who, {WORDS} AS words FROM k
  WHERE length(evidence_quote) >= 18 AND len(regexp_extract_all(value_raw, '-?\\(?[0-9][0-9,]*\\.?[0-9]*\\)?%?')) <= 1 AND ka NOT IN ({_list(derived.GENERIC)}) AND value_num IS NOT NULL),
t AS (SELECT * FROM x WHERE unit_family = 'percent'),
l AS (SELECT * FROM x WHERE value_num <> 0 AND unit_family LIKE 'currency:%'),
ratio AS (
  SELECT 'ratio' AS kind, t.id AS target, n.id AS part_a, d.id AS part_b, n.value_num / d.value_num * 100 AS computed, t.value_num AS stated,
         abs(n.value_num / d.value_num * 100 - t.value_num) / greatest(abs(t.value_num), 1e-9) AS error
  FROM t JOIN l n ON n.who = t.who AND n.kp = t.kp AND len(list_intersect(t.words, n.words)) > 0
  JOIN l d ON d.who = t.who AND d.kp = t.kp AND d.unit_family = n.unit_family AND d.id <> n.id
  WHERE len(list_intersect(string_split(t.ka, ' '), [{_list(derived.RATIO)}])) > 0
    AND abs(n.value_num / d.value_num * 100 - t.value_num) / greatest(abs(t.value_num), 1e-9) <= 0.06
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY error, n.id, d.id) = 1),
grown AS (
  SELECT 'growth' AS kind, t.id AS target, o.id AS part_a, n.id AS part_b, (n.value_num - o.value_num) / abs(o.value_num) * 100 AS computed, t.value_num AS stated,
         abs((n.value_num - o.value_num) / abs(o.value_num) * 100 - t.value_num) / greatest(abs(t.value_num), 1e-9) AS error
  FROM t JOIN l n ON n.who = t.who AND n.kp = t.kp AND len(list_intersect(t.words, n.words)) > 0
  JOIN l o ON o.who = n.who AND o.unit_family = n.unit_family AND o.period_end < n.period_start AND date_diff('day', o.period_end::DATE, n.period_start::DATE) <= 40
    AND len(list_intersect(n.words, o.words)) > 0
  WHERE abs((n.value_num - o.value_num) / abs(o.value_num) * 100 - t.value_num) / greatest(abs(t.value_num), 1e-9) <= 0.06
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY error, o.id, n.id) = 1)"""


@query("D1_ratio", f"WITH {KEYED}, {PARTS} SELECT target, part_a, part_b, round(computed, 4) AS computed FROM ratio")
def ratio_triples(spark, sf_dir):
    return derived.ratios(claims(spark, sf_dir)).select("target", "part_a", "part_b", F.round("computed", 4).alias("computed"))


@query("D2_growth", f"WITH {KEYED}, {PARTS} SELECT target, part_a, part_b, round(computed, 4) AS computed FROM grown")
def growth_triples(spark, sf_dir):
    return derived.growth(claims(spark, sf_dir)).select("target", "part_a", "part_b", F.round("computed", 4).alias("computed"))


@query("D8_union", f"WITH {KEYED}, {PARTS}, u AS (SELECT * FROM ratio UNION ALL SELECT * FROM grown), e AS (SELECT least(target, part_a) AS fact_a, greatest(target, part_a) AS fact_b, kind, greatest(0.6, 1 - 5 * error) AS c FROM u) SELECT fact_a, fact_b, kind, round(c, 6) AS confidence FROM e QUALIFY row_number() OVER (PARTITION BY fact_a, fact_b ORDER BY kind DESC, c DESC) = 1")
def derived_edges(spark, sf_dir):
    return derived.derived(claims(spark, sf_dir)).select("fact_a", "fact_b", "kind", F.round("confidence", 6).alias("confidence"))


# ---- reads
REJECTED = f"{GATE}, rejected AS (SELECT id, doc_id, 'ungrounded' AS reason, reason AS detail FROM gated WHERE reason <> '')"


def rejected(spark, sf_dir) -> DataFrame:
    """What the gates turn down of all claims, a table that a session writes once."""
    own = lambda: grounding.grounded(_sourced(spark, sf_dir), fuzzy=False).where("reason <> ''").select("id", "doc_id", F.lit("ungrounded").alias("reason"), F.col("reason").alias("detail"))
    return kept(spark, "rejected", sf_dir, own)


@query("Q1_documents", f"WITH {KEYED}, {REJECTED} SELECT doc_id::BIGINT AS doc_id, title, (SELECT count(*) FROM claims c WHERE c.doc_id = docs.doc_id) AS n_facts, (SELECT count(*) FROM rejected r WHERE r.doc_id = docs.doc_id) AS n_rejected FROM docs")
def document_list(spark, sf_dir):
    return reads.document_counts(documents(spark), claims(spark, sf_dir), rejected(spark, sf_dir)).select("doc_id", "title", "n_facts", "n_rejected")


@query("Q3_stats", f"WITH {KEYED} SELECT 'documents' AS name, count(*) AS n FROM docs UNION ALL SELECT 'facts', count(*) FROM claims UNION ALL SELECT concat('relations ', type), count(*) FROM rel GROUP BY type")
def statistics(spark, sf_dir):
    return reads.stats(documents(spark), claims(spark, sf_dir), edges(spark, sf_dir))


@query("Q4_fact_search", f"WITH {KEYED}, f AS (SELECT * FROM claims WHERE confidence >= 0.5 AND doc_id = 2 AND (subject ILIKE '%nation_1%' OR attribute ILIKE '%nation_1%' OR value_raw ILIKE '%nation_1%' OR evidence_quote ILIKE '%nation_1%')) SELECT id, subject, (SELECT count(*) FROM f) AS total FROM f ORDER BY id LIMIT 20 OFFSET 10")
def fact_search(spark, sf_dir):
    return reads.facts_found(claims(spark, sf_dir), q="Nation_1", doc_id=2, least=0.5, limit=20, offset=10).select("id", "subject", "total")


@query("Q5_neighbours", f"WITH {KEYED}, h AS (SELECT min(fact_a) AS id FROM rel) SELECT CASE WHEN fact_a = h.id THEN fact_b ELSE fact_a END AS other, type FROM rel, h WHERE fact_a = h.id OR fact_b = h.id")
def neighbour_edges(spark, sf_dir):
    own = edges(spark, sf_dir)
    return reads.neighbours(own.agg(F.min("fact_a")).first()[0], own).select("other", "type")


@query("Q6_relations", f"WITH {KEYED} SELECT fact_a, fact_b, type, a.value_raw AS value_a, b.value_raw AS value_b FROM rel JOIN claims a ON a.id = fact_a JOIN claims b ON b.id = fact_b WHERE a.doc_id <> b.doc_id ORDER BY rel.confidence DESC, fact_a, fact_b, type LIMIT 40 OFFSET 5")
def browse(spark, sf_dir):
    return reads.browsed(edges(spark, sf_dir), claims(spark, sf_dir), cross_document=True, limit=40, offset=5).select("fact_a", "fact_b", "type", "value_a", "value_b")


@query("Q7_relation_counts", f"WITH {KEYED} SELECT type, decided_by, count(*) AS n FROM rel GROUP BY type, decided_by")
def relation_counts(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("type", "decided_by").agg(F.count(F.lit(1)).alias("n"))


@query("Q10_rejections", f"WITH {KEYED}, {REJECTED} SELECT reason, CASE WHEN starts_with(trim(coalesce(detail, '')), 'value digits') THEN 'value not present in the quoted evidence' ELSE trim(coalesce(detail, '')) END AS detail, count(*) AS n FROM rejected GROUP BY ALL")
def rejections(spark, sf_dir):
    return reads.rejection_summary(rejected(spark, sf_dir))


@query("Q11_review", f"WITH {KEYED} SELECT id, confidence, grounding FROM claims WHERE confidence < 0.6 OR grounding = 'fuzzy' ORDER BY confidence, id LIMIT 60")
def review(spark, sf_dir):
    return reads.review_feed(claims(spark, sf_dir)).select("id", "confidence", "grounding")


# ---- sources and streams
@query("S2_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def hashes(spark, sf_dir):
    return ingest.hashed(table(spark, sf_dir, "documents")).select("doc_id", "sha256")


@query("S4_new_documents", "WITH d AS (SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents GROUP BY ALL) SELECT doc_id, sha256 FROM d WHERE sha256 NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE source = 'src0')")
def new_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ingest.new_documents(docs, ingest.hashed(docs.where("source = 'src0'"))).select("doc_id", "sha256")


@query("S11_cache_miss", "WITH b AS (SELECT doc_id, sha256(concat(sha256(coalesce(text, '')), '|1|m')) AS key, source FROM documents) SELECT doc_id, key FROM b WHERE key NOT IN (SELECT key FROM b WHERE source = 'src1')")
def misses(spark, sf_dir):
    own = ingest.hashed(table(spark, sf_dir, "documents"))
    cache = own.where("source = 'src1'").select(ingest.cache_key(F.col("sha256"), "m").alias("key"))
    return ingest.cache_misses(own, cache, "m").select("doc_id", "key")


@query("T1_token_window", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW), 4) AS spent FROM events")
def token_windows(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.col("value").alias("amount"))
    return blocks.token_window(own).select("event_id", F.round("spent", 4).alias("spent"))
