"""Queries on cleaning, coercion, validation and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake import schema
from leadlake.functions import scoring as X
from leadlake.functions import text as TX
from leadlake.functions.numbers import round_to
from leadlake.operators import clean as C
from leadlake.plans import fixtures as FX
from leadlake.plans.fixtures import band_sql, round_sql, with_leads, with_scored
from leadlake.plans.registry import query
from leadlake.session import store

NUMBER_SQL = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
PLACEHOLDER_SQL = "('select','','none','n/a','na','null','unknown','-','--')"


def number_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), {NUMBER_SQL}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def placeholder_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {PLACEHOLDER_SQL} THEN {c} END"


@query("normalize_key", r"""
SELECT doc_id, md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS text_key,
       trim(regexp_replace(lower(source || '__' || lang), '[^\p{L}\p{N}]+', ' ', 'g')) AS source_key
FROM documents""")
def normalize_key(spark, sf):
    d = FX.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(TX.normalize_key(F.col("text"))).alias("text_key"),
                    TX.normalize_key(F.concat("source", F.lit("__"), "lang")).alias("source_key"))


@query("null_placeholders", with_leads(f"""
SELECT lead_key, {placeholder_sql('channel')} AS channel, {placeholder_sql('occupation')} AS occupation,
       {placeholder_sql('do_not_contact')} AS do_not_contact FROM leads"""))
def null_placeholders(spark, sf):
    return FX.leads(spark, sf).select(
        "lead_key", *[TX.null_placeholders(F.col(c)).alias(c) for c in ("channel", "occupation", "do_not_contact")])


@query("to_number", with_leads(f"""
SELECT "Record ID" AS record_id, {number_sql('"Amount"')} AS amount, {number_sql('"Time on Site"')} AS time_on_site,
       {number_sql('"Original Source"')} AS source_number, {number_sql('internal_widget_ref')} AS widget_number,
       {number_sql('"Close Date"')} AS date_number FROM raw_crm""", FX.RAW_SQL))
def to_number(spark, sf):
    r = FX.raw_crm(spark, sf)
    pick = {"amount": "Amount", "time_on_site": "Time on Site", "source_number": "Original Source",
            "widget_number": "internal_widget_ref", "date_number": "Close Date"}
    return r.select(F.col("`Record ID`").alias("record_id"),
                    *[TX.to_number(F.col(f"`{c}`")).alias(n) for n, c in pick.items()])


@query("coerce_float", """
SELECT event_id, CASE WHEN isnan(v) THEN NULL ELSE v END AS value
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'nan'::DOUBLE ELSE value END AS v FROM events)""")
def coerce_float(spark, sf):
    e = FX.table(spark, sf, "events")
    noisy = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", TX.to_number(noisy, "double").alias("value"))


_ANSWER = ("CASE WHEN event_type = 'purchase' THEN ' Won' WHEN event_type = 'signup' THEN 'yes' "
           "WHEN event_type = 'error' THEN 'LOST ' WHEN event_type = 'click' THEN 'n' ELSE 'maybe' END")
_BOOL_SQL = ("CASE WHEN lower(trim(a)) IN ('1','true','yes','won','converted','y') THEN TRUE "
             "WHEN lower(trim(a)) IN ('0','false','no','lost','n') THEN FALSE END")


@query("coerce_bool", f"SELECT event_id, {_BOOL_SQL} AS answer FROM (SELECT event_id, {_ANSWER} AS a FROM events)")
def coerce_bool(spark, sf):
    e = FX.table(spark, sf, "events")
    return e.select("event_id", TX.coerce_bool(F.expr(_ANSWER)).alias("answer"))


_LABEL = ("CASE WHEN event_type = 'purchase' THEN '1' WHEN event_type = 'signup' THEN 'Converted' "
          "WHEN event_type = 'error' THEN '0.0' WHEN event_type = 'click' THEN 'false' WHEN event_id % 3 = 0 THEN '99999999999' "
          "WHEN event_id % 3 = 1 THEN '2' ELSE '?' END")


@query("coerce_label", f"""
SELECT * FROM (SELECT event_id, CASE WHEN {number_sql('a')} = 0 THEN 0 WHEN {number_sql('a')} = 1 THEN 1 ELSE CAST({_BOOL_SQL} AS INTEGER) END AS label
FROM (SELECT event_id, {_LABEL} AS a FROM events)) WHERE label IS NOT NULL""")
def coerce_label(spark, sf):
    e = FX.table(spark, sf, "events").select("event_id", F.expr(_LABEL).alias("label"))
    return C.labelled_rows(e, "label")


@query("apply_mapping", with_leads(f"""
SELECT "Record ID" AS external_id, "Contact Name" AS display_name, "Time on Site" AS time_on_site_seconds,
  "Number of Sessions" AS total_visits, "Pages Per Session" AS page_views_per_visit, "Original Source" AS channel,
  "Country" AS country, "Is Converted" AS converted, "Amount" AS deal_value, "Close Date" AS converted_at
FROM raw_crm""", FX.RAW_SQL))
def apply_mapping(spark, sf):
    return C.apply_mapping(FX.raw_crm(spark, sf), FX.RAW_MAPPING)


def _clean_sql() -> str:
    have = {"channel", "industry", "country", "occupation", "last_activity", "do_not_contact"}
    columns = []
    for name in schema.FEATURES:
        if name in ("time_on_site_seconds", "total_visits", "page_views_per_visit"):
            columns.append(name)
        elif name in have:
            columns.append(f"{placeholder_sql(name)} AS {name}")
        else:
            kind = "DOUBLE" if name in schema.NUMERIC_FEATURES else "VARCHAR"
            columns.append(f"CAST(NULL AS {kind}) AS {name}")
    return ", ".join(columns)


CLEAN_SQL = f"clean AS (SELECT lead_key, tenant_id, converted, {_clean_sql()} FROM leads)"


@query("clean_frame", with_leads("SELECT * EXCLUDE (tenant_id, converted) FROM clean", CLEAN_SQL))
def clean_frame(spark, sf):
    return C.clean_frame(FX.leads(spark, sf), keep=["lead_key"])


_NUM = ["time_on_site_seconds", "total_visits", "page_views_per_visit"]
_CAT = ["channel", "industry", "country", "occupation", "last_activity", "do_not_contact"]


def _mode_cte() -> str:
    parts = [f"""SELECT tenant_id, '{c}' AS feature, {c} AS value, COUNT(*) AS n FROM clean
                 WHERE {c} IS NOT NULL GROUP BY 1, 3""" for c in _CAT]
    return f"""modes AS (SELECT tenant_id, feature, value AS mode FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, feature ORDER BY n DESC, value) AS i
      FROM ({' UNION ALL '.join(parts)})) WHERE i = 1)"""


_BASE_SQL = f"""{CLEAN_SQL}, {_mode_cte()},
base AS (SELECT tenant_id, {', '.join(f"coalesce(quantile_cont({c}, 0.5), 0e0) AS {c}" for c in _NUM)} FROM clean GROUP BY 1),
wide AS (SELECT tenant_id, {', '.join(f"max(CASE WHEN feature = '{c}' THEN mode END) AS {c}" for c in _CAT)} FROM modes GROUP BY 1),
baseline AS (SELECT base.*, {', '.join(f"coalesce(wide.{c}, 'Unknown') AS {c}" for c in _CAT)} FROM base LEFT JOIN wide USING (tenant_id))"""


@query("baseline_row", with_leads(
    f"SELECT tenant_id, {', '.join(round_sql(c, 6) + ' AS ' + c for c in _NUM)}, {', '.join(_CAT)} FROM baseline", _BASE_SQL))
def baseline_row(spark, sf):
    clean = C.clean_frame(FX.leads(spark, sf), keep=["tenant_id"])
    base = C.baseline_row(clean, ["tenant_id"], numeric=_NUM, categorical=_CAT)
    return base.select("tenant_id", *[round_to(F.col(c), 6).alias(c) for c in _NUM], *_CAT)


@query("impute_baseline", with_leads(
    f"""SELECT lead_key, {', '.join(f"{round_sql(f'coalesce(clean.{c}, baseline.{c}, 0e0)', 6)} AS {c}" for c in _NUM)},
    {', '.join(f"coalesce(CASE WHEN trim(clean.{c}) <> '' THEN clean.{c} END, baseline.{c}, 'Unknown') AS {c}" for c in _CAT)}
    FROM clean LEFT JOIN baseline USING (tenant_id)""", _BASE_SQL))
def impute_baseline(spark, sf):
    clean = C.clean_frame(FX.leads(spark, sf), keep=["tenant_id", "lead_key"])
    base = store(C.baseline_row(clean, ["tenant_id"], numeric=_NUM, categorical=_CAT))
    full = C.impute_baseline(clean, base, ["tenant_id"], numeric=_NUM, categorical=_CAT)
    return full.select("lead_key", *[round_to(F.col(c), 6).alias(c) for c in _NUM], *_CAT)


@query("strip_pii", with_leads("""
SELECT lead_key, channel, country, json_extract_string(p, '$.channel') AS payload_channel, FALSE AS payload_has_name
FROM (SELECT *, json_object('channel', channel) AS p FROM leads)"""))
def strip_pii(spark, sf):
    l = FX.leads(spark, sf).select("lead_key", "display_name", "channel", "country")
    l = l.withColumn("payload", F.create_map(F.lit("Display_Name"), F.col("display_name"), F.lit("channel"), F.col("channel")))
    out = C.strip_pii(l, "payload")
    assert "display_name" not in out.columns
    return out.select("lead_key", "channel", "country", F.col("payload")["channel"].alias("payload_channel"),
                      F.map_contains_key("payload", "Display_Name").alias("payload_has_name"))


@query("legacy_alias", """
SELECT user_id AS lead_key, CAST(coalesce(MAX(CASE WHEN event_type = 'view' THEN value END),
       SUM(CAST(CASE WHEN event_type = 'click' THEN value END AS DECIMAL(18,2)))) AS DOUBLE) AS time_on_site_seconds
FROM events GROUP BY 1""")
def legacy_alias(spark, sf):
    e = FX.table(spark, sf, "events")
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    old = e.groupBy(F.col("user_id").alias("lead_key")).agg(
        F.max(kind("view")).alias("time_on_site_seconds"),
        F.sum(kind("click").cast("decimal(18,2)")).cast("double").alias("total_time_spent_on_website"),
        F.max("props").alias("unknown_field"))
    return C.legacy_alias(old)


@query("validate_ranges", with_leads("""
SELECT lead_key, CASE WHEN deal_value - 100000e0 < 0 THEN 'deal_value must be >= 0' END AS deal_reason,
  CAST((CASE WHEN deal_value - 100000e0 < 0 THEN 1 ELSE 0 END) + (CASE WHEN total_visits - 2e0 < 0 THEN 1 ELSE 0 END) AS INTEGER) AS problems,
  NOT coalesce(deal_value - 100000e0 < 0, FALSE) AND NOT coalesce(total_visits - 2e0 < 0, FALSE) AS valid FROM leads"""))
def validate_ranges(spark, sf):
    shifted = FX.leads(spark, sf).select("lead_key", (F.col("deal_value") - 100000.0).alias("deal_value"),
                                         (F.col("total_visits") - 2.0).alias("total_visits"))
    checked = C.validate_ranges(shifted)
    deal = F.filter("reasons", lambda r: r.startswith("deal_value"))
    return checked.select("lead_key", F.get(deal, F.lit(0)).alias("deal_reason"), F.size("reasons").alias("problems"),
                          (F.size("reasons") == 0).alias("valid"))


@query("band", with_scored(f"SELECT lead_key, {band_sql('probability')} AS band FROM scored"))
def band(spark, sf):
    return FX.scored(spark, sf).select("lead_key", X.band(F.col("probability")).alias("band"))


@query("decide", with_scored("""SELECT lead_key, CASE WHEN probability >= 0.5e0 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN probability >= 0.5e0 THEN 'likely_to_convert' ELSE 'unlikely_to_convert' END AS label FROM scored"""))
def decide(spark, sf):
    p = F.col("probability")
    return FX.scored(spark, sf).select("lead_key", X.decide(p).alias("prediction"), X.decision_label(p).alias("label"))


@query("labelled", with_leads("SELECT lead_key, tenant_id, converted FROM leads WHERE converted IS NOT NULL"))
def labelled(spark, sf):
    from leadlake.operators.decide import labelled as op

    return op(FX.leads(spark, sf)).select("lead_key", "tenant_id", "converted")


@query("drop_known_leaky", with_leads("SELECT lead_key, total_visits FROM leads"))
def drop_known_leaky(spark, sf):
    l = FX.leads(spark, sf).select("lead_key", "total_visits", F.col("converted").alias("Tags"),
                                   F.col("converted").alias("Lead Quality"))
    return C.drop_known_leaky(l)


@query("sample_rows", with_leads(f"""
SELECT lead_key, source_id, display_name, converted FROM leads WHERE CAST('0x' || substr(md5('42:' || CAST(lead_key AS VARCHAR)), 1, 8) AS BIGINT) < {int(0.1 * (1 << 32))}"""))
def sample_rows(spark, sf):
    return C.sample_rows(FX.leads(spark, sf), 0.1, 42).select("lead_key", "source_id", "display_name", "converted")


@query("drop_index_column", with_leads("SELECT total_visits, converted FROM leads"))
def drop_index_column(spark, sf):
    return C.drop_index_column(FX.leads(spark, sf).select(
        F.col("lead_key").alias("Unnamed: 0"), "total_visits", "converted"))


@query("contact_suppression", with_leads(
    "SELECT lead_key, source_id FROM leads WHERE lower(trim(do_not_contact)) IN ('yes','true','1')"))
def contact_suppression(spark, sf):
    return C.contact_suppression(FX.leads(spark, sf)).select("lead_key", "source_id")


@query("sample_for_inspection")
def sample_for_inspection(spark, sf):
    return C.sample_for_inspection(FX.raw_crm(spark, sf), 300)


@query("category_options", with_leads(f"""
SELECT tenant_id, feature, value, n, CAST(i AS BIGINT) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tenant_id, feature ORDER BY n DESC, value) AS i FROM (
  {' UNION ALL '.join(f"SELECT tenant_id, '{c}' AS feature, {c} AS value, COUNT(*) AS n FROM clean WHERE {c} IS NOT NULL GROUP BY 1, 3" for c in _CAT)}))
WHERE i <= 3""", CLEAN_SQL))
def category_options(spark, sf):
    clean = C.clean_frame(FX.leads(spark, sf), keep=["tenant_id"])
    return C.category_options(clean, _CAT, 3, ["tenant_id"])


# ------------------------------------------------------------------ scalar rules


@query("heuristic_score", with_scored(f"SELECT lead_key, {round_sql('probability', 6)} AS probability FROM scored"))
def heuristic_score(spark, sf):
    return FX.leads(spark, sf).select("lead_key", round_to(X.heuristic_score(), 6).alias("probability"))


DAYS_SQL = f"greatest((epoch_us(TIMESTAMP '{FX.AS_OF}') - epoch_us({{0}})) / 86400e6, 0e0)"


@query("days_since", f"SELECT event_id, {round_sql(DAYS_SQL.format('ts'), 6)} AS days FROM events")
def days_since(spark, sf):
    e = FX.table(spark, sf, "events")
    return e.select("event_id", round_to(X.days_since(F.col("ts"), FX.as_of()), 6).alias("days"))


DECAY_SQL = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN 1e0 ELSE pow(0.5e0, {0} / 21e0) END"


@query("decay_factor", f"SELECT event_id, {round_sql(DECAY_SQL.format('d'), 6)} AS factor FROM (SELECT event_id, {DAYS_SQL.format('ts')} AS d FROM events)")
def decay_factor(spark, sf):
    e = FX.table(spark, sf, "events")
    return e.select("event_id", round_to(X.decay_factor(X.days_since(F.col("ts"), FX.as_of())), 6).alias("factor"))


ADJUSTED_CTE = f"""aged AS (SELECT *, {DAYS_SQL.format('scored_at')} AS days FROM scored),
factored AS (SELECT *, {DECAY_SQL.format('days')} AS factor FROM aged),
adjusted AS (SELECT *, CASE WHEN factor >= 1 THEN probability ELSE 0.38e0 + (probability - 0.38e0) * factor END AS p FROM factored)"""


def _adjusted(spark, sf):
    s = FX.scored(spark, sf)
    days = X.days_since(F.col("scored_at"), FX.as_of())
    return s.withColumn("p", X.apply_decay(F.col("probability"), days))


@query("apply_decay", with_scored(f"SELECT lead_key, {round_sql('p', 6)} AS adjusted FROM adjusted", ADJUSTED_CTE))
def apply_decay(spark, sf):
    return _adjusted(spark, sf).select("lead_key", round_to(F.col("p"), 6).alias("adjusted"))


@query("expected_value", with_scored(f"""
SELECT lead_key, {round_sql("p * CASE WHEN v > 0 THEN v ELSE 1000e0 END", 2)} AS expected_value
FROM (SELECT *, CASE WHEN channel = 'Select' THEN -1e0 WHEN channel = '5-LOW' THEN NULL ELSE deal_value END AS v FROM adjusted)""", ADJUSTED_CTE))
def expected_value(spark, sf):
    v = F.when(F.col("channel") == "Select", -1.0).when(F.col("channel") != "5-LOW", F.col("deal_value"))
    return _adjusted(spark, sf).select(
        "lead_key", round_to(X.expected_value(F.col("p"), v, F.lit(1000.0)), 2).alias("expected_value"))


@query("priority", with_scored(f"""
SELECT lead_key, {round_sql('p', 4)} AS by_probability,
  {round_sql("CASE WHEN p >= 0.5e0 THEN coalesce(nullif(v, 0e0), 1000e0) ELSE 0e0 END", 4)} AS by_value,
  {round_sql("p * CASE WHEN v > 0 THEN v ELSE 1000e0 END", 4)} AS by_expected_value
FROM (SELECT *, CASE WHEN channel = 'Select' THEN 0e0 WHEN channel = '5-LOW' THEN NULL ELSE deal_value END AS v FROM adjusted)""", ADJUSTED_CTE))
def priority(spark, sf):
    v = F.when(F.col("channel") == "Select", 0.0).when(F.col("channel") != "5-LOW", F.col("deal_value"))
    made = {f"by_{s}": round_to(X.priority(s, F.col("p"), v, F.lit(1000.0)), 4)
            for s in ("probability", "value", "expected_value")}
    return _adjusted(spark, sf).select("lead_key", *[c.alias(n) for n, c in made.items()])


TIER_SQL = "CASE WHEN {0} >= 5000 THEN 'continuous' WHEN {0} >= 500 THEN 'tenant' WHEN {0} >= 1 THEN 'recalibrated' ELSE 'generic' END"
PLAN_SQL = """CASE WHEN {0} >= 500 THEN 'train_tenant_model' WHEN {0} >= 1 THEN 'recalibrate' ELSE 'keep_base_model' END AS action,
  CAST({0} AS VARCHAR) || ' labelled lead(s); ' || CASE WHEN {0} >= 500 THEN 'a dedicated model will be trained.'
    WHEN {0} >= 1 THEN 'base model recalibrated to this pipeline.' ELSE 'the shared base model keeps scoring.' END AS detail,
  CAST(CASE WHEN {0} >= 5000 THEN NULL WHEN {0} >= 500 THEN 5000 WHEN {0} >= 1 THEN 500 ELSE 1 END AS BIGINT) AS next_tier_at"""
_SOURCE_COUNTS = "counted AS (SELECT source_id, channel, COUNT(converted) AS n FROM leads GROUP BY 1, 2)"


@query("tier", with_leads(f"SELECT source_id, channel, n, {TIER_SQL.format('n')} AS tier FROM counted", _SOURCE_COUNTS))
def tier(spark, sf):
    n = FX.leads(spark, sf).groupBy("source_id", "channel").agg(F.count("converted").alias("n"))
    return n.withColumn("tier", X.tier(F.col("n")))


@query("training_plan", with_leads(f"""
SELECT source_id, n, {TIER_SQL.format('n')} AS tier, {PLAN_SQL.format('n')}
FROM (SELECT source_id, CAST(SUM(n) AS BIGINT) AS n FROM counted GROUP BY 1)""", _SOURCE_COUNTS))
def training_plan(spark, sf):
    n = FX.leads(spark, sf).groupBy("source_id").agg(F.count("converted").alias("n"))
    return n.withColumns(X.training_plan(F.col("n")))


@query("next_best_action", with_scored("""
SELECT lead_key, split_part(rule, '/', 1) AS action, CASE rule
  WHEN 'no_outreach' THEN 'This lead has opted out of contact.'
  WHEN 'call_now/working' THEN 'High score and a working professional — call while intent is fresh.'
  WHEN 'call_now/sms' THEN 'Responded to SMS and scores well; a call is likely to connect.'
  WHEN 'personal_email' THEN 'Above threshold but no strong channel signal — start with email.'
  WHEN 'nurture_sequence' THEN 'Engaged with the site but scores low; nurture rather than call.'
  ELSE 'Not enough signal to justify a rep''s time yet.' END AS reason, 'rule' AS basis
FROM (SELECT lead_key, CASE WHEN lower(trim(do_not_contact)) IN ('yes','true','1') THEN 'no_outreach'
  WHEN probability >= 0.75e0 AND lower(occupation) LIKE '%working%' THEN 'call_now/working'
  WHEN probability >= 0.6e0 AND lower(last_activity) LIKE '%sms%' THEN 'call_now/sms'
  WHEN probability >= 0.5e0 THEN 'personal_email'
  WHEN coalesce(time_on_site_seconds, 0e0) > 300 THEN 'nurture_sequence' ELSE 'monitor' END AS rule FROM scored)"""))
def next_best_action(spark, sf):
    made = X.next_best_action(*[F.col(c) for c in (
        "probability", "do_not_contact", "occupation", "last_activity", "time_on_site_seconds")])
    return FX.scored(spark, sf).select("lead_key", *[c.alias(n) for n, c in made.items()])


@query("field_label", with_leads("""
SELECT feature, upper(left(f, 1)) || substr(f, 2) AS label, n FROM (
  SELECT feature, lower(replace(feature, '_', ' ')) AS f, n FROM (
    SELECT 'total_visits' AS feature, COUNT(total_visits) AS n FROM leads UNION ALL
    SELECT 'time_on_site_seconds', COUNT(time_on_site_seconds) FROM leads UNION ALL
    SELECT 'do_not_contact', COUNT(do_not_contact) FROM leads))"""))
def field_label(spark, sf):
    long = C.long_features(FX.leads(spark, sf), ["total_visits", "time_on_site_seconds", "do_not_contact"])
    return long.groupBy("feature").agg(F.count("value").alias("n")).select(
        "feature", TX.field_label(F.col("feature")).alias("label"), "n")


@query("version_stamp", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS version FROM events")
def version_stamp(spark, sf):
    return FX.table(spark, sf, "events").select("event_id", TX.version_stamp(F.col("ts").cast("timestamp")).alias("version"))


@query("what_if_verdict", with_scored("""
SELECT lead_key, CASE WHEN total_visits / 10e0 > probability THEN 'improves'
  WHEN total_visits / 10e0 < probability THEN 'worsens' ELSE 'no change' END AS verdict FROM scored"""))
def what_if_verdict(spark, sf):
    return FX.scored(spark, sf).select(
        "lead_key", X.what_if_verdict(F.col("probability"), F.col("total_visits") / 10.0).alias("verdict"))


@query("suspicious_name", """
SELECT DISTINCT source, lang, regexp_matches(lower(source || CASE lang WHEN 'en' THEN '_status' WHEN 'fr' THEN 'Rating' ELSE '_plain' END),
  'tag|status|stage|quality|grade|disposition|outcome|result|closed|won|lost|rating|score|profile') AS suspicious FROM documents""")
def suspicious_name(spark, sf):
    d = FX.table(spark, sf, "documents").select("source", "lang").distinct()
    name = F.concat("source", F.when(F.col("lang") == "en", "_status").when(F.col("lang") == "fr", "Rating").otherwise("_plain"))
    return d.select("source", "lang", TX.suspicious_name(name).alias("suspicious"))


@query("payload_access", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type, value * 2e0 AS doubled FROM events""")
def payload_access(spark, sf):
    e = FX.table(spark, sf, "events")
    nested = e.select(
        "event_id", F.from_json("props", "k int").alias("p"),
        F.to_json(F.struct(F.col("event_type").alias("channel"), F.col("value").alias("deal_value"))).alias("payload"))
    lead = nested.withColumn("lead", C.typed_payload(F.col("payload")))
    return lead.select("event_id", "p.k", F.col("lead.channel").alias("event_type"),
                       (F.col("lead.deal_value") * 2.0).alias("doubled"))
