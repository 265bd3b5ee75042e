"""Claims derived from the warehouse tables, by SQL that any engine reads alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimloom.sources.store import kept

#: Sets of claims: a nation's revenue by fiscal year (C1, document 1) and quarter (C2), rounded (C3, document 2), as shipped (C4),
#: its growth (C5, document 3), its finished part as amount and share (C6), disagreeing figures (C7), and repeats of C1 (C8).
CLAIMS = """
WITH o AS (
  SELECT n_name, n_nationkey AS nk, o_orderkey, o_orderstatus, cast(o_totalprice AS decimal(18,2)) AS price, o_orderdate,
         cast(year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS int) AS fy,
         cast(floor(((month(o_orderdate) + 8) % 12) / 3) + 1 AS int) AS q
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
y AS (
  SELECT n_name, nk, fy, floor(cast(sum(price) AS double)) AS rev,
         floor(cast(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN price END), 0) AS double)) AS fin FROM o GROUP BY n_name, nk, fy),
z AS (SELECT n_name, nk, fy, q, floor(cast(sum(price) AS double)) AS rev FROM o GROUP BY n_name, nk, fy, q),
s AS (
  SELECT n_name, nk, fy, floor(cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS double)) AS rev
  FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY n_name, nk, fy),
g AS (
  SELECT b.n_name, b.nk, b.fy, floor((b.rev - a.rev) / a.rev * 1000 + 0.5) AS tenths
  FROM y a JOIN y b ON a.nk = b.nk AND b.fy = a.fy + 1 WHERE a.rev > 0),
u AS (
  SELECT 1 AS c, nk, fy, 0 AS q, 1 AS doc_id, n_name, 'Total revenue' AS attribute, rev AS num, 'USD' AS unit, '' AS basis FROM y
  UNION ALL SELECT 2, nk, fy, q, 1, n_name, 'revenue', rev, 'USD', '' FROM z
  UNION ALL SELECT 3, nk, fy, 0, 2, n_name, 'Revenue', floor(rev / power(10, length(cast(cast(rev AS bigint) AS string)) - 3) + 0.5) * power(10, length(cast(cast(rev AS bigint) AS string)) - 3), 'USD', '' FROM y
  UNION ALL SELECT 4, nk, fy, 0, 2, n_name, 'revenue', rev, 'USD', 'shipped' FROM s
  UNION ALL SELECT 5, nk, fy, 0, 3, n_name, 'revenue growth', tenths / 10, '%', '' FROM g
  UNION ALL SELECT 6, nk, fy, 0, 3, n_name, 'finished revenue', fin, 'USD', '' FROM y
  UNION ALL SELECT 7, nk, fy, 0, 3, n_name, 'finished revenue share', floor(fin / rev * 1000 + 0.5) / 10, '%', '' FROM y WHERE rev > 0
  UNION ALL SELECT 8, nk, fy, 0, 3, n_name, 'revenue', floor(rev * 1.03), 'USD', '' FROM y WHERE nk % 5 = 0
  UNION ALL SELECT 9, nk, fy, 0, 1, n_name, 'the revenue', rev, 'USD', '' FROM y)
SELECT cast(c * 10000000 + nk * 100000 + fy * 10 + q AS bigint) AS id, cast(doc_id AS bigint) AS doc_id,
       concat(n_name, CASE WHEN doc_id = 2 THEN ' Ltd.' ELSE ' Limited' END) AS subject, attribute,
       CASE WHEN unit = 'USD' THEN concat('US$ ', cast(cast(num AS bigint) AS string))
            ELSE concat(CASE WHEN num < 0 THEN '-' ELSE '' END, cast(cast(floor(abs(num * 10) / 10 + 0.000001) AS bigint) AS string), '.',
                        cast(cast(floor(abs(num * 10) + 0.5) AS bigint) % 10 AS string), '%') END AS value_raw,
       cast(num AS double) AS value_num, CASE WHEN unit = 'USD' THEN 'currency:USD' ELSE 'percent' END AS unit_family,
       cast(CASE WHEN unit = '%' THEN greatest(length(regexp_replace(cast(cast(floor(abs(num * 10) + 0.5) AS bigint) AS string), '^0+', '')), 1)
            ELSE greatest(length(regexp_replace(cast(cast(num AS bigint) AS string), '0+$', '')), 1) END AS int) AS sig_figs,
       CASE WHEN c = 2 THEN concat('Q', cast(q AS string), ' ') ELSE '' END || concat('FY', cast(fy - 1 AS string), '-', substring(cast(fy AS string), 3, 2)) AS period_label,
       CASE WHEN c = 2 THEN make_date(cast(fy - CASE WHEN q = 4 THEN 0 ELSE 1 END AS int), cast((q * 3) % 12 + 1 AS int), 1) ELSE make_date(fy - 1, 4, 1) END AS period_start,
       CASE WHEN c = 2 THEN last_day(make_date(cast(fy - CASE WHEN q >= 3 THEN 0 ELSE 1 END - CASE WHEN q = 3 THEN 1 ELSE 0 END AS int), cast((q * 3 + 2) % 12 + 1 AS int), 1)) ELSE make_date(fy, 3, 31) END AS period_end,
       CASE WHEN c = 2 THEN 'quarter' ELSE 'year' END AS period_gran,
       cast(NULL AS string) AS scope, CASE WHEN basis <> '' THEN basis END AS basis,
       concat(attribute, CASE WHEN c = 9 THEN ' as stated in full for the period stood at ' ELSE ' for the period stood at ' END, cast(cast(num AS bigint) AS string)) AS evidence_quote,
       CASE WHEN c = 9 AND nk % 2 = 0 THEN 'fuzzy' ELSE 'verbatim' END AS grounding,
       cast(CASE WHEN c = 4 AND nk % 7 = 0 THEN 0.4 WHEN c = 8 THEN 0.7 ELSE 0.9 END AS double) AS confidence
FROM u
"""
TABLES = ["orders", "customer", "nation", "lineitem"]
DOCUMENTS = "SELECT * FROM (VALUES (1, 'Filing', 'Registrar', '2003-05-01'), (2, 'Deck', 'Issuer', '2003-06-01'), (3, 'Survey', CAST(NULL AS string), CAST(NULL AS string))) AS t(doc_id, title, publisher, published_on)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of a data folder, a table that a session writes once. What is grouped are orders and line items, by nation and period,
    with partial sums before the shuffle."""

    def make() -> DataFrame:
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        return spark.sql(CLAIMS)

    return kept(spark, "claims", sf_dir, make)


def documents(spark: SparkSession) -> DataFrame:
    return spark.sql(DOCUMENTS).selectExpr("cast(doc_id AS bigint) doc_id", "title", "publisher", "published_on")
