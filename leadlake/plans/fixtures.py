"""Lead tables derived from the star schema, as the input of the registered queries.

One order is one lead, its region the tenant, its nation the source. The SQL text next to
each frame builds the same table for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.functions.numbers import round_to
from leadlake.operators.score import heuristic_scores
from leadlake.session import store

AS_OF = "2024-02-01 00:00:00"
PERIOD_SPLIT = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    # Whole hundredths: exact and order-free sums without wide decimals.
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return lines.groupBy("l_orderkey").agg(
        (F.sum(cents("l_quantity")) / 100.0).alias("time_on_site_seconds"),
        F.count("l_linenumber").cast("double").alias("total_visits"),
        round_to(F.sum(cents("l_discount")) / 100.0 / F.count(F.lit(1)) * 100.0, 6).alias("page_views_per_visit"),
    )


def leads(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    o = orders if orders is not None else table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    joined = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .join(line_features(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    key = F.col("o_orderkey")
    micros_back = F.pmod(key, F.lit(60)) * 86_400_000_000
    return joined.select(
        key.cast("string").alias("external_id"), key.alias("lead_key"),
        F.concat(F.col("n_name"), F.lit("-"), key.cast("string")).alias("lead_id"),
        F.col("r_name").alias("tenant_id"), F.col("n_name").alias("source_id"),
        F.col("c_name").alias("display_name"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Select")
         .otherwise(F.col("o_orderpriority")).alias("channel"),
        F.col("c_mktsegment").alias("industry"), F.col("n_name").alias("country"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Working Professional")
         .when(F.col("c_mktsegment") == "MACHINERY", "Student").otherwise("Unknown").alias("occupation"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "SMS Sent").otherwise("Email Opened").alias("last_activity"),
        F.when(F.pmod(key, F.lit(17)) == 0, " Yes ").when(F.pmod(key, F.lit(17)) < 9, "No").alias("do_not_contact"),
        "time_on_site_seconds", "total_visits", "page_views_per_visit",
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "P", 0).alias("converted"),
        F.col("o_totalprice").alias("deal_value"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.timestamp_micros(F.unix_micros(as_of()) - micros_back).alias("scored_at"),
    )


LEADS_SQL = f"""
line_features AS (
  SELECT l_orderkey,
         CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS time_on_site_seconds,
         CAST(COUNT(l_linenumber) AS DOUBLE) AS total_visits,
         floor(CAST(SUM(CAST(l_discount AS DECIMAL(12,2))) AS DOUBLE) / COUNT(*) * 100e0 * 1e6 + 0.500001e0) / 1e6 AS page_views_per_visit
  FROM lineitem GROUP BY l_orderkey),
leads AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderkey AS lead_key,
         n_name || '-' || CAST(o_orderkey AS VARCHAR) AS lead_id,
         r_name AS tenant_id, n_name AS source_id, c_name AS display_name,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Select' ELSE o_orderpriority END AS channel,
         c_mktsegment AS industry, n_name AS country,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Working Professional'
              WHEN 'MACHINERY' THEN 'Student' ELSE 'Unknown' END AS occupation,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'SMS Sent' ELSE 'Email Opened' END AS last_activity,
         CASE WHEN o_orderkey % 17 = 0 THEN ' Yes ' WHEN o_orderkey % 17 < 9 THEN 'No' END AS do_not_contact,
         time_on_site_seconds, total_visits, page_views_per_visit,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0 END AS converted,
         o_totalprice AS deal_value, o_orderdate AS created_at,
         TIMESTAMP '{AS_OF}' - to_days(CAST(o_orderkey % 60 AS INTEGER)) AS scored_at
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN line_features ON o_orderkey = l_orderkey)"""

HEURISTIC_SQL = """greatest(0e0, least(
    least(coalesce(time_on_site_seconds, 0e0) / 300e0, 1e0) * 0.5e0
  + least(coalesce(page_views_per_visit, 0e0) / 5e0, 1e0) * 0.25e0
  + least(coalesce(total_visits, 0e0) / 10e0, 1e0) * 0.25e0, 1e0))"""


def band_sql(p: str) -> str:
    return (f"CASE WHEN {p} >= 0.75e0 THEN 'hot' WHEN {p} >= 0.5e0 THEN 'warm' "
            f"WHEN {p} >= 0.25e0 THEN 'cool' ELSE 'cold' END")


def round_sql(c: str, digits: int) -> str:
    return f"(floor(({c}) * 1e{digits} + 0.500001e0) / 1e{digits})"


def scored(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    return heuristic_scores(leads(spark, sf_dir, orders))


SCORED_SQL = f"""{LEADS_SQL},
scored_raw AS (SELECT *, {HEURISTIC_SQL} AS probability FROM leads),
scored AS (SELECT *, {band_sql('probability')} AS band,
                  CASE WHEN probability >= 0.5e0 THEN 1 ELSE 0 END AS prediction FROM scored_raw)"""


def with_leads(body: str, extra: str = "") -> str:
    return f"WITH {LEADS_SQL}{',' + extra if extra else ''}\n{body}"


def with_scored(body: str, extra: str = "") -> str:
    return f"WITH {SCORED_SQL}{',' + extra if extra else ''}\n{body}"


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.select(
        F.col("r_name").alias("tenant_id"), F.when(F.col("r_name") == "ASIA", 1200).otherwise(F.lit(20) + F.col("r_regionkey") * 10).alias("daily_capacity"),
        (F.lit(500.0) + F.col("r_regionkey") * 500.0).alias("default_deal_value"))


TENANTS_SQL = """tenants AS (SELECT r_name AS tenant_id, CASE WHEN r_name = 'ASIA' THEN 1200 ELSE 20 + r_regionkey * 10 END AS daily_capacity,
  500e0 + r_regionkey * 500e0 AS default_deal_value FROM region)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources with their state; every third one takes scores back, every fourth is unconfirmed."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_name").alias("source_id"), (F.col("n_nationkey") % 3 == 0).alias("supports_writeback"),
        (F.col("n_nationkey") % 4 != 0).alias("mapping_confirmed"))


SOURCES_SQL = """sources AS (SELECT n_name AS source_id, n_nationkey % 3 = 0 AS supports_writeback,
  n_nationkey % 4 <> 0 AS mapping_confirmed FROM nation)"""


def model_versions(spark: SparkSession, sf_dir: str, leads_: DataFrame | None = None) -> DataFrame:
    """One model version per tenant and month of leads, plus one shared base model per month.

    EUROPE has no active version of its own, so it falls back to the base model.
    """
    month = F.date_trunc("month", "created_at")
    labelled = (leads(spark, sf_dir) if leads_ is None else leads_).where(F.col("converted").isNotNull())
    own = labelled.groupBy("tenant_id", month.alias("created_at")).agg(
        F.count(F.lit(1)).alias("training_rows"), F.sum("converted").alias("_pos"))
    base = own.groupBy("created_at").agg(
        F.sum("training_rows").alias("training_rows"), F.sum("_pos").alias("_pos")
    ).select(F.lit(None).cast("string").alias("tenant_id"), "created_at", "training_rows", "_pos")
    rate = F.col("_pos") / F.col("training_rows")
    made = own.unionByName(base).select(
        "tenant_id", F.date_format("created_at", "yyyyMMddHHmmss").alias("version"),
        F.when(F.col("training_rows") >= 5000, "continuous").when(F.col("training_rows") >= 500, "tenant")
         .otherwise("recalibrated").alias("tier"),
        rate.alias("conversion_rate"), (0.5 + rate * 0.4).alias("roc_auc"), "training_rows",
        (~F.coalesce(F.col("tenant_id") == "EUROPE", F.lit(False)) & (F.month("created_at") != 7)).alias("is_active"),
        "created_at",
    )
    return store(made)


MODELS_SQL = """own_models AS (
  SELECT tenant_id, date_trunc('month', created_at) AS created_at, COUNT(*) AS training_rows,
         CAST(SUM(converted) AS BIGINT) AS pos
  FROM leads WHERE converted IS NOT NULL GROUP BY 1, 2),
all_models AS (
  SELECT tenant_id, CAST(created_at AS TIMESTAMP) AS created_at, training_rows, pos FROM own_models
  UNION ALL
  SELECT NULL, CAST(created_at AS TIMESTAMP), CAST(SUM(training_rows) AS BIGINT), CAST(SUM(pos) AS BIGINT)
  FROM own_models GROUP BY 2),
models AS (
  SELECT tenant_id, strftime(created_at, '%Y%m%d%H%M%S') AS version,
         CASE WHEN training_rows >= 5000 THEN 'continuous' WHEN training_rows >= 500 THEN 'tenant'
              ELSE 'recalibrated' END AS tier,
         pos / training_rows AS conversion_rate, 0.5e0 + pos / training_rows * 0.4e0 AS roc_auc, training_rows,
         NOT coalesce(tenant_id = 'EUROPE', FALSE) AND month(created_at) <> 7 AS is_active, created_at
  FROM all_models)"""


def raw_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads under a foreign system's column names, every value as text."""
    l = leads(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    return l.select(
        "tenant_id", "source_id", F.concat(F.lit("C"), text("lead_key")).alias("Record ID"),
        F.col("display_name").alias("Contact Name"),
        text("time_on_site_seconds").alias("Time on Site"), text("total_visits").alias("Number of Sessions"),
        text("page_views_per_visit").alias("Pages Per Session"), F.col("channel").alias("Original Source"),
        F.col("country").alias("Country"), text("converted").alias("Is Converted"),
        text("deal_value").alias("Amount"), F.date_format("created_at", "yyyy-MM-dd").alias("Close Date"),
        F.concat(F.lit("w"), F.pmod(F.col("lead_key"), F.lit(97)).cast("string")).alias("internal_widget_ref"),
    )


RAW_COLUMNS = ["Record ID", "Contact Name", "Time on Site", "Number of Sessions", "Pages Per Session",
               "Original Source", "Country", "Is Converted", "Amount", "Close Date", "internal_widget_ref"]

RAW_MAPPING = {
    "Record ID": "external_id", "Contact Name": "display_name", "Time on Site": "time_on_site_seconds",
    "Number of Sessions": "total_visits", "Pages Per Session": "page_views_per_visit",
    "Original Source": "channel", "Country": "country", "Is Converted": "converted",
    "Amount": "deal_value", "Close Date": "converted_at",
}

RAW_SQL = """raw_crm AS (
  SELECT tenant_id, source_id, 'C' || CAST(lead_key AS VARCHAR) AS "Record ID", display_name AS "Contact Name",
         CAST(time_on_site_seconds AS VARCHAR) AS "Time on Site", CAST(total_visits AS VARCHAR) AS "Number of Sessions",
         CAST(page_views_per_visit AS VARCHAR) AS "Pages Per Session", channel AS "Original Source",
         country AS "Country", CAST(converted AS VARCHAR) AS "Is Converted", CAST(deal_value AS VARCHAR) AS "Amount",
         strftime(created_at, '%Y-%m-%d') AS "Close Date", 'w' || CAST(lead_key % 97 AS VARCHAR) AS internal_widget_ref
  FROM leads)"""


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled leads with planted leaks: a pure stage, a near copy of the label, and a rare
    flag whose support differs by tenant."""
    l = scored(spark, sf_dir).where(F.col("converted").isNotNull())
    return l.withColumns({
        "stage": F.when(F.col("converted") == 1, "won").otherwise("lost"),
        "score_copy": F.col("converted") + F.pmod(F.col("lead_key"), F.lit(100)) / 1000.0,
        "rare_flag": F.when((F.col("converted") == 1) & (F.pmod(F.col("lead_key"), F.lit(101)) == 0), "rare")
                      .otherwise(F.when(F.pmod(F.col("lead_key"), F.lit(2)) == 0, "even").otherwise("odd")),
        "last_touch": F.when((F.col("converted") == 0) & (F.pmod(F.col("lead_key"), F.lit(5)) == 0), "Bounced")
                       .otherwise(F.col("last_activity")),
    })


LEAKY_FEATURES = ["time_on_site_seconds", "total_visits", "page_views_per_visit", "channel", "industry",
                  "country", "stage", "score_copy", "rare_flag", "last_touch"]

LEAKY_SQL = """leaky AS (SELECT *, CASE WHEN converted = 1 THEN 'won' ELSE 'lost' END AS stage,
  converted + (lead_key % 100) / 1000e0 AS score_copy,
  CASE WHEN converted = 1 AND lead_key % 101 = 0 THEN 'rare' WHEN lead_key % 2 = 0 THEN 'even' ELSE 'odd' END AS rare_flag,
  CASE WHEN converted = 0 AND lead_key % 5 = 0 THEN 'Bounced' ELSE last_activity END AS last_touch
  FROM scored WHERE converted IS NOT NULL)"""


def periods(spark: SparkSession, sf_dir: str, shifted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reference, live) split by creation date; ``shifted`` moves visits and one tenant's channel."""
    l = leads(spark, sf_dir)
    split = F.to_timestamp(F.lit(PERIOD_SPLIT))
    reference, live = l.where(F.col("created_at") < split), l.where(F.col("created_at") >= split)
    if shifted:
        live = live.withColumns({
            "total_visits": F.col("total_visits") + 5.0,
            "channel": F.when(F.col("tenant_id") == "ASIA", F.lit("7-REFERRAL")).otherwise(F.col("channel")),
        })
    return reference, live


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lead scored by three model versions a week apart."""
    s = scored(spark, sf_dir)
    versions = F.array(*[
        F.struct(F.lit(f"v{i}").alias("model_version"), F.lit(scale).alias("_scale"), F.lit((i - 1) * 7).alias("_days"))
        for i, scale in ((1, 0.8), (2, 0.9), (3, 1.0))
    ])
    rows = s.select("tenant_id", "source_id", "lead_id", "lead_key", "external_id", "converted", "probability",
                    F.inline(versions))
    first = F.unix_micros(F.to_timestamp(F.lit("2024-01-08 00:00:00")))
    return rows.select(
        "tenant_id", "source_id", "lead_id", "lead_key", "external_id", "converted", "model_version",
        (F.col("probability") * F.col("_scale")).alias("probability"),
        F.timestamp_micros(first + F.col("_days") * 86_400_000_000 + F.pmod(F.col("lead_key"), F.lit(24)) * 3_600_000_000).alias("created_at"),
    )


LOG_SQL = """log AS (
  SELECT tenant_id, source_id, lead_id, lead_key, external_id, converted, v.model_version,
         probability * v.scale AS probability,
         TIMESTAMP '2024-01-08 00:00:00' + to_days(v.days) + to_hours(CAST(lead_key % 24 AS INTEGER)) AS created_at
  FROM scored CROSS JOIN (VALUES ('v1', 0.8e0, 0), ('v2', 0.9e0, 7), ('v3', 1e0, 14)) AS v(model_version, scale, days))"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome reports for open leads: by lead id, by external id, and for unknown leads."""
    l = leads(spark, sf_dir).where(F.col("converted").isNull())
    kind = F.pmod(F.col("lead_key"), F.lit(3))
    ref = F.when(kind == 0, F.col("lead_id")).when(kind == 1, F.col("external_id")).otherwise(
        F.concat(F.lit("gone-"), F.col("external_id")))
    return l.select(
        "tenant_id", ref.alias("lead_ref"), (F.pmod(F.col("lead_key"), F.lit(4)) == 0).alias("converted"),
        F.when(F.pmod(F.col("lead_key"), F.lit(5)) == 0, F.col("deal_value") * 2.0).alias("deal_value"),
        as_of().alias("recorded_at"))


OUTCOMES_SQL = f"""outcomes AS (
  SELECT tenant_id, CASE lead_key % 3 WHEN 0 THEN lead_id WHEN 1 THEN external_id ELSE 'gone-' || external_id END AS lead_ref,
         lead_key % 4 = 0 AS converted, CASE WHEN lead_key % 5 = 0 THEN deal_value * 2e0 END AS deal_value,
         TIMESTAMP '{AS_OF}' AS recorded_at
  FROM leads WHERE converted IS NULL)"""


def doc_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a binary quality label: a second, unbalanced target."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", "n_chars", "lang", "source").join(l.select("doc_id", "quality", "toxic"), "doc_id")
