"""Views of the supplied tables as forecasts, outcomes, ledgers and prices.

Every adapter is one projection of one table, so filters and column pruning
reach the Parquet scan. ``SQL`` holds the same adapters for an SQL engine and
``with_views`` assembles them into a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presage.functions.scalars import clamp
from presage.session import table


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per extracted claim; some have no date or no certainty."""
    k = F.col("k")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _k())
        .select(
            F.col("event_id").alias("claim_ix"),
            F.floor(F.col("event_id") / 40).cast("long").alias("market_id"),
            F.concat(F.lit("u"), (F.col("user_id") % 25).cast("string")).alias("source_id"),
            clamp((F.col("value") - 50) / 50, -1.0, 1.0).alias("stance"),
            F.when(k % 23 != 0, k / 100.0).alias("certainty"),
            F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10) / 10.0).alias("specificity"),
            F.when(k % 17 != 0, F.date_sub(F.to_date("ts"), k % 28)).alias("article_date"),
            F.element_at(F.create_map(*[F.lit(x) for x in (
                "purchase", "reported_fact", "signup", "cited_share", "view", "reporting", "click", "opinion", "error", None)]),
                F.col("event_type")).alias("evidence_class"),
            F.col("ts"), k.alias("k"), F.col("user_id"), F.col("event_type"), F.col("value"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per market with its outcome, outcome date and categories."""
    m = F.col("market_id")
    return (
        table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).cast("long").alias("market_id")).distinct()
        .select(
            m, (m % 3 != 0).alias("outcome"),
            F.date_add(F.to_date(F.lit("2024-01-12")), (m % 19).cast("int")).alias("outcome_date"),
            F.when(m % 4 == 0, F.array(F.lit("politics")))
            .when(m % 4 == 1, F.array(F.lit("politics"), F.lit("economy")))
            .when(m % 4 == 2, F.array(F.lit("economy"))).otherwise(F.array().cast("array<string>")).alias("category"),
        )
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sources with the parts of their lineage stratum."""
    u = F.col("u")
    return (
        table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("u")).distinct().filter(u != 7)
        .select(
            F.concat(F.lit("u"), u.cast("string")).alias("source_id"),
            F.concat(F.lit("Source "), u.cast("string")).alias("name"),
            F.when(u % 5 != 4, F.concat(F.lit("c"), (u % 5).cast("string"))).alias("country"),
            F.when(u % 2 == 0, F.lit("en")).otherwise(F.lit("de")).alias("language"),
        )
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price series, one per order priority."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date"))
        .agg(clamp(F.round(F.avg(F.col("o_totalprice").cast("decimal(18,4)")).cast("double") / 500000, 9), 0.01, 0.99).alias("probability"))
    )


def price_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw price points: several per series and day, ordered by ``tick``."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series_id"), F.col("o_orderkey").alias("tick"),
        F.to_date("o_orderdate").alias("date"), clamp(F.col("o_totalprice") / 500000, 0.01, 0.99).alias("probability"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of market snapshots in time order; some carry a model number."""
    k, e = _k(), F.col("event_id")
    m = (F.col("user_id") * 4 + e % 4)
    return table(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("ts"), m.alias("market_id"),
        F.concat(F.lit("ev"), F.floor(m / 3).cast("string")).alias("event_slug"),
        F.timestamp_seconds(F.lit(1706745600) - (m % 6) * 86400 * 3).alias("end_ts"),
        F.when(F.col("event_type") != "error", F.round(clamp(F.col("value") / 100, 0.01, 0.99), 4)).alias("market_yes"),
        F.when(k % 3 == 0, F.round(clamp(k / 100.0 + 0.005, 0.01, 0.99), 4)).alias("model_yes"),
        F.when((k % 3 != 0) & (k % 5 == 0), F.lit("insufficient_data")).alias("model_reason"),
        (F.col("ts") >= F.to_timestamp(F.lit("2024-01-20"))).alias("closed"),
        F.when((F.col("ts") >= F.to_timestamp(F.lit("2024-01-20"))) & (m % 7 != 0),
               F.when(m % 3 == 0, F.lit("YES")).otherwise(F.lit("NO"))).alias("resolved_outcome"),
        F.when((F.col("ts") >= F.to_timestamp(F.lit("2024-01-20"))) & (m % 7 == 0),
               F.when(m % 2 == 0, F.lit("MKT")).otherwise(F.lit("CANCEL"))).alias("resolution_raw"),
        (m % 5 != 0).alias("partition_market"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper trades: purchases before the close, priced at entry."""
    k, e = _k(), F.col("event_id")
    p = F.round(clamp(F.col("value") / 100, 0.05, 0.95), 4)
    side = F.when(k % 2 == 0, F.lit("YES")).otherwise(F.lit("NO"))
    entry = F.when(k % 2 == 0, p).otherwise(F.round(1 - p, 4))
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase").select(
        e.alias("trade_id"), F.col("ts"), (F.col("user_id") * 4 + e % 4).alias("market_id"), side.alias("side"),
        entry.alias("entry_price"), F.lit(100.0).alias("notional"), F.round(F.lit(100.0) / entry, 4).alias("shares"),
    )


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with direction, window and archetype."""
    q = F.col("pool_id")
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).cast("long").alias("pool_id")).distinct().select(
        q, F.when(q % 3 == 0, "arrival").when(q % 3 == 1, "survival").alias("claim_direction"),
        F.when(q % 11 != 0, F.date_add(F.to_date(F.lit("2024-01-08")), (q % 25).cast("int"))).alias("claim_deadline"),
        F.when(q % 13 != 0, F.date_add(F.to_date(F.lit("2023-12-20")), (q % 9).cast("int"))).alias("claim_created"),
        F.when(q % 5 == 0, "diffuse").when(q % 5 == 1, "scheduled").when(q % 5 == 2, "threshold").when(q % 5 == 3, "none").alias("claim_archetype"))


def pool_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article-level evidence rows of each question, claim columns attached."""
    k, e, u = F.col("k"), F.col("event_id"), F.col("user_id")
    actors = F.element_at(F.array(*[F.lit(x) for x in ("The US", "USA, Israel", "iran", "E.U.", "Great Britain", None)]), (u % 6 + 1).cast("int"))
    target = F.element_at(F.array(*[F.lit(x) for x in ("Iran", "the UN", "U.K.", None)]), (k % 4 + 1).cast("int"))
    pub = F.when(k % 17 != 0, F.date_sub(F.to_date("ts"), k % 28))
    rows = table(spark, sf_dir, "events").withColumn("k", _k()).select(
        F.floor(e / 40).cast("long").alias("pool_id"), e.alias("row_ix"),
        clamp((F.col("value") - 50) / 50, -1.0, 1.0).alias("stance"), (k / 100.0).alias("certainty"),
        ((u % 7 + 4) / 8.0).alias("credibility_weight"), ((e * 7) % 101 / 100.0).alias("relevance"),
        F.when(e % 11 != 0, F.element_at(F.create_map(*[F.lit(x) for x in (
            "purchase", 1.0, "signup", 1.5, "view", 0.6, "click", 0.25, "error", None)]), F.col("event_type"))).alias("evidence_weight"),
        pub.alias("published_date"),
        ((F.abs(clamp((F.col("value") - 50) / 50, -1.0, 1.0)) >= 0.9) & (k % 5 == 0)).alias("settled"),
        F.when(k % 3 != 0, F.date_sub(pub, k % 5 - 1)).alias("settlement_event_date"),
        F.when(k % 19 != 0, F.concat(F.lit("u"), (u % 25).cast("string"))).alias("source_id"),
        actors.alias("event_actors"), target.alias("event_target"), (e - e % 3).alias("cluster_id"),
        F.when((u % 25 != 7) & (u % 5 != 4) & (k % 19 != 0), F.concat(F.lit("c"), (u % 5).cast("string"), F.when(u % 2 == 0, ":en").otherwise(":de"))).alias("stratum"),
        k, F.col("user_id"), F.col("event_type"))
    return rows.join(pools(spark, sf_dir), "pool_id")


QUESTIONS = (
    "Will Arsenal beat Chelsea in the final?", "Will the Lakers win the title over Boston Celtics?", "Will Ukraine join NATO before 2027?",
    "Will inflation in Norway exceed 3.5% in May?", "Will Adams remain in office on June 1, 2024?", "Will the Ebola outbreak reach 10,000 cases?",
)
CLAIM_TEXTS = (
    "Chelsea will not lose the final", "a deal is inevitable after the vote", "the party rejects the offer", "Ukraine must join soon",
    "officials said talks continue", "the rate topped 3.5% in April", "Adams refuses to leave office", "the outbreak could reach Europe",
)
QUOTES = (
    "The index topped 3.5 percent on Tuesday", "Polymarket traders put the odds at 62%", "a few billion euros were lost", "Opta gives Arsenal a 71% chance",
    "hundreds of trucks crossed", "Will Arsenal beat Chelsea in the final?", "short one", "sources close to the talks expect a deal",
)
REFERENCES = ("today", "Yesterday.", "on Friday", "last Monday", "the coming Tuesday", "this Sunday", "next week", None)
ACTORS = ("Arsenal", "Chelsea", "the Lakers", "Boston Celtics", "Ukrainian army", "Norway", None)
TARGETS = ("Chelsea", "Arsenal", "Boston Celtics", "Lakers", "NATO", None)
URLS = ("https://t.me/channel/17", "https://news.example.com/opinion/2024/01/05/why", "https://www.daily.example.org/2024/jan/11/vote-result", "http://m.blog.example.net/a-b-c")


def _pick(values, index) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def rich_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with the optional fields that guards and audits read."""
    k, e, u = F.col("k"), F.col("event_id"), F.col("user_id")
    st = clamp((F.col("value") - 50) / 50, -1.0, 1.0)
    pub = F.when(k % 17 != 0, F.date_sub(F.to_date("ts"), k % 28))
    rows = table(spark, sf_dir, "events").withColumn("k", _k()).select(
        F.floor(e / 40).cast("long").alias("pool_id"), e.alias("claim_ix"), F.floor(e / 4).cast("long").alias("article_id"),
        st.alias("stance"), (k / 100.0).alias("certainty"), ((F.abs(st) >= 0.9) & (k % 2 == 0)).alias("settled"),
        pub.alias("article_date"), F.when(k % 5 != 0, F.date_add(F.to_date("ts"), (e % 13).cast("int") - 9 - k % 28)).alias("event_date"),
        _pick(REFERENCES, e).alias("event_date_reference"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("verified"),
        F.when(k % 4 == 3, None).otherwise(k % 4 != 1).alias("is_occurrence"),
        _pick(("announcement", "denial", "neither", None, None), e).alias("facet"),
        F.when(k % 6 != 0, clamp((F.col("value") - 40) / 40, -1.0, 1.0) * F.when(k % 2 == 0, 1).otherwise(-1)).alias("fact_signal"),
        F.when(e % 3 != 0, F.round("value", 1)).alias("quantity_value"), F.date_add(pub, (e % 5).cast("int") - 1).alias("quantity_as_of"),
        _pick(("%", "percent", "Basis points", "trucks"), e).alias("quantity_unit"), _pick(("=", ">", "<=", "<", ">="), k).alias("quantity_comparator"),
        _pick(CLAIM_TEXTS, e).alias("claim"), _pick(QUOTES, u).alias("quote"), _pick(ACTORS, e + u).alias("event_actors"),
        _pick(TARGETS, e + u).alias("event_target"), _pick(URLS, u).alias("url"),
        F.when(k % 9 != 0, (k - 50) / 50.0).alias("author_lean"), _pick(("cited_probability", "reporting", "opinion", "reported_fact", "cited_share", None), k).alias("evidence_class"),
        F.when(k % 7 < 5, _pick(("high", "medium", "low"), k)).alias("level"), F.when(k % 7 < 2, _pick(("negation", "quote_stack"), e)).alias("trap"),
        F.when(e % 3 != 0, (e % 10) / 10.0).alias("specificity"), (k % 6 == 0).alias("is_conditional"), _pick(("certain", "likely", "possible", "unlikely", "other"), e).alias("strength"),
        F.when(k % 12 == 0, 0.4).alias("stated_probability"), F.when(k % 8 == 0, k / 100.0).alias("quantitative_estimate"),
        _pick(("if talks collapse soon", "if the vote passes", None), e).alias("antecedent_text_en"), F.when(k % 10 != 0, k % 4 != 0).alias("antecedent_polarity"),
        F.concat(F.lit("u"), (u % 25).cast("string")).alias("source_id"), k, u)
    q = pools(spark, sf_dir).withColumns({
        "question": _pick(QUESTIONS, F.col("pool_id")), "bar_value": F.when(F.col("pool_id") % 6 == 3, 3.5).when(F.col("pool_id") % 6 == 1, 40.0),
        "bar_unit": F.when(F.col("pool_id") % 6 == 3, "pct").otherwise("basis point"), "bar_comparator": F.when(F.col("pool_id") % 6 == 3, ">").otherwise(">=")})
    return rows.join(q, "pool_id")


VOICES = ("The Ministry ", "the  ministry", "a spokesman", None, "officials", "")


def reported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool rows with the text they are clustered on and the voice they quote; some have neither."""
    k, e, u = F.col("k"), F.col("row_ix"), F.col("user_id")
    return pool_rows(spark, sf_dir).withColumns({
        "report_text": F.when(k % 13 != 0, F.concat(_pick(CLAIM_TEXTS, e), F.lit(" "), _pick(QUOTES, u))), "attributed_to": _pick(VOICES, k)})


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values, index: str) -> str:
    return f"{_sql_list(values)}[({index}) % {len(values)} + 1]"


SQL: dict[str, str] = {
    "rich_claims": f"""
      SELECT r.*, p.* EXCLUDE (pool_id), {_sql_pick(QUESTIONS, 'p.pool_id')} AS question,
             CASE p.pool_id % 6 WHEN 3 THEN 3.5::DOUBLE WHEN 1 THEN 40.0::DOUBLE END AS bar_value,
             CASE WHEN p.pool_id % 6 = 3 THEN 'pct' ELSE 'basis point' END AS bar_unit, CASE WHEN p.pool_id % 6 = 3 THEN '>' ELSE '>=' END AS bar_comparator
      FROM (
        SELECT e // 40 AS pool_id, e AS claim_ix, e // 4 AS article_id, st AS stance, k / 100.0::DOUBLE AS certainty, abs(st) >= 0.9 AND k % 2 = 0 AS settled,
          pub AS article_date, CASE WHEN k % 5 <> 0 THEN CAST(ts AS DATE) + CAST(e % 13 - 9 - k % 28 AS INTEGER) END AS event_date,
          {_sql_pick(REFERENCES, 'e')} AS event_date_reference, CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verified,
          CASE WHEN k % 4 <> 3 THEN k % 4 <> 1 END AS is_occurrence, {_sql_pick(("announcement", "denial", "neither", None, None), 'e')} AS facet,
          CASE WHEN k % 6 <> 0 THEN greatest(-1.0, least(1.0, (value - 40) / 40)) * CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END END AS fact_signal,
          CASE WHEN e % 3 <> 0 THEN round(value, 1) END AS quantity_value, pub + CAST(e % 5 - 1 AS INTEGER) AS quantity_as_of,
          {_sql_pick(("%", "percent", "Basis points", "trucks"), 'e')} AS quantity_unit, {_sql_pick(("=", ">", "<=", "<", ">="), 'k')} AS quantity_comparator,
          {_sql_pick(CLAIM_TEXTS, 'e')} AS claim, {_sql_pick(QUOTES, 'user_id')} AS quote, {_sql_pick(ACTORS, 'e + user_id')} AS event_actors,
          {_sql_pick(TARGETS, 'e + user_id')} AS event_target, {_sql_pick(URLS, 'user_id')} AS url,
          CASE WHEN k % 9 <> 0 THEN (k - 50) / 50.0::DOUBLE END AS author_lean,
          {_sql_pick(("cited_probability", "reporting", "opinion", "reported_fact", "cited_share", None), 'k')} AS evidence_class,
          CASE WHEN k % 7 < 5 THEN {_sql_pick(("high", "medium", "low"), 'k')} END AS level, CASE WHEN k % 7 < 2 THEN {_sql_pick(("negation", "quote_stack"), 'e')} END AS trap,
          CASE WHEN e % 3 <> 0 THEN (e % 10) / 10.0::DOUBLE END AS specificity, k % 6 = 0 AS is_conditional,
          {_sql_pick(("certain", "likely", "possible", "unlikely", "other"), 'e')} AS strength, CASE WHEN k % 12 = 0 THEN 0.4::DOUBLE END AS stated_probability,
          CASE WHEN k % 8 = 0 THEN k / 100.0::DOUBLE END AS quantitative_estimate, {_sql_pick(("if talks collapse soon", "if the vote passes", None), 'e')} AS antecedent_text_en,
          CASE WHEN k % 10 <> 0 THEN k % 4 <> 0 END AS antecedent_polarity, 'u' || (user_id % 25) AS source_id, k, user_id
        FROM (SELECT *, CASE WHEN k % 17 <> 0 THEN CAST(ts AS DATE) - (k % 28) END AS pub, greatest(-1.0, least(1.0, (value - 50) / 50)) AS st, event_id AS e
              FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))) r JOIN pools p USING (pool_id)""",
    "pools": """
      SELECT q AS pool_id, CASE q % 3 WHEN 0 THEN 'arrival' WHEN 1 THEN 'survival' END AS claim_direction,
             CASE WHEN q % 11 <> 0 THEN DATE '2024-01-08' + CAST(q % 25 AS INTEGER) END AS claim_deadline,
             CASE WHEN q % 13 <> 0 THEN DATE '2023-12-20' + CAST(q % 9 AS INTEGER) END AS claim_created,
             CASE q % 5 WHEN 0 THEN 'diffuse' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'threshold' WHEN 3 THEN 'none' END AS claim_archetype
      FROM (SELECT DISTINCT event_id // 40 AS q FROM events)""",
    "pool_rows": """
      SELECT r.*, p.* EXCLUDE (pool_id) FROM (
        SELECT event_id // 40 AS pool_id, event_id AS row_ix, greatest(-1.0, least(1.0, (value - 50) / 50)) AS stance,
               k / 100.0::DOUBLE AS certainty, (user_id % 7 + 4) / 8.0::DOUBLE AS credibility_weight, ((event_id * 7) % 101) / 100.0::DOUBLE AS relevance,
               CASE WHEN event_id % 11 <> 0 THEN CASE event_type WHEN 'purchase' THEN 1.0::DOUBLE WHEN 'signup' THEN 1.5::DOUBLE WHEN 'view' THEN 0.6::DOUBLE WHEN 'click' THEN 0.25::DOUBLE END END AS evidence_weight,
               pub AS published_date,
               abs(greatest(-1.0, least(1.0, (value - 50) / 50))) >= 0.9 AND k % 5 = 0 AS settled,
               CASE WHEN k % 3 <> 0 THEN pub - (k % 5 - 1) END AS settlement_event_date,
               CASE WHEN k % 19 <> 0 THEN 'u' || (user_id % 25) END AS source_id,
               ['The US', 'USA, Israel', 'iran', 'E.U.', 'Great Britain', NULL][user_id % 6 + 1] AS event_actors,
               ['Iran', 'the UN', 'U.K.', NULL][k % 4 + 1] AS event_target, event_id - event_id % 3 AS cluster_id,
               CASE WHEN user_id % 25 <> 7 AND user_id % 5 <> 4 AND k % 19 <> 0 THEN 'c' || (user_id % 5) || CASE WHEN user_id % 2 = 0 THEN ':en' ELSE ':de' END END AS stratum,
               k, user_id, event_type
        FROM (SELECT *, CASE WHEN k % 17 <> 0 THEN CAST(ts AS DATE) - (k % 28) END AS pub
              FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events))) r JOIN pools p USING (pool_id)""",
    "reported_rows": f"""
      SELECT *, CASE WHEN k % 13 <> 0 THEN {_sql_pick(CLAIM_TEXTS, 'row_ix')} || ' ' || {_sql_pick(QUOTES, 'user_id')} END AS report_text,
             {_sql_pick(VOICES, 'k')} AS attributed_to FROM pool_rows""",
    "claims": """
      SELECT event_id AS claim_ix, event_id // 40 AS market_id, 'u' || (user_id % 25) AS source_id,
             greatest(-1.0, least(1.0, (value - 50) / 50)) AS stance,
             CASE WHEN k % 23 <> 0 THEN k / 100.0::DOUBLE END AS certainty,
             CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0::DOUBLE END AS specificity,
             CASE WHEN k % 17 <> 0 THEN CAST(ts AS DATE) - (k % 28) END AS article_date,
             CASE event_type WHEN 'purchase' THEN 'reported_fact' WHEN 'signup' THEN 'cited_share'
                             WHEN 'view' THEN 'reporting' WHEN 'click' THEN 'opinion' END AS evidence_class,
             ts, k, user_id, event_type, value
      FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)""",
    "outcomes": """
      SELECT q AS market_id, q % 3 <> 0 AS outcome, DATE '2024-01-12' + CAST(q % 19 AS INTEGER) AS outcome_date,
             CASE q % 4 WHEN 0 THEN ['politics'] WHEN 1 THEN ['politics', 'economy']
                  WHEN 2 THEN ['economy'] ELSE [] END AS category
      FROM (SELECT DISTINCT event_id // 40 AS q FROM events)""",
    "registry": """
      SELECT 'u' || u AS source_id, 'Source ' || u AS name, CASE WHEN u % 5 <> 4 THEN 'c' || (u % 5) END AS country,
             CASE WHEN u % 2 = 0 THEN 'en' ELSE 'de' END AS language
      FROM (SELECT DISTINCT user_id % 25 AS u FROM events) WHERE u <> 7""",
    "prices": """
      SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS date,
             greatest(0.01, least(0.99, round(CAST(round(sum(CAST(o_totalprice AS DECIMAL(18,4)))::DOUBLE / count(*), 8) AS DOUBLE) / 500000, 9))) AS probability
      FROM orders GROUP BY 1, 2""",
    "price_ticks": """
      SELECT o_orderpriority AS series_id, o_orderkey AS tick, CAST(o_orderdate AS DATE) AS date,
             greatest(0.01, least(0.99, o_totalprice / 500000)) AS probability FROM orders""",
    "snapshots": """
      SELECT event_id AS seq, ts, m AS market_id, 'ev' || (m // 3) AS event_slug,
             make_timestamp((1706745600 - (m % 6) * 86400 * 3) * 1000000) AS end_ts,
             CASE WHEN event_type <> 'error' THEN round(greatest(0.01, least(0.99, value / 100)), 4) END AS market_yes,
             CASE WHEN k % 3 = 0 THEN round(greatest(0.01, least(0.99, k / 100.0::DOUBLE + 0.005::DOUBLE)), 4) END AS model_yes,
             CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'insufficient_data' END AS model_reason,
             ts >= TIMESTAMP '2024-01-20' AS closed,
             CASE WHEN ts >= TIMESTAMP '2024-01-20' AND m % 7 <> 0 THEN CASE WHEN m % 3 = 0 THEN 'YES' ELSE 'NO' END END AS resolved_outcome,
             CASE WHEN ts >= TIMESTAMP '2024-01-20' AND m % 7 = 0 THEN CASE WHEN m % 2 = 0 THEN 'MKT' ELSE 'CANCEL' END END AS resolution_raw,
             m % 5 <> 0 AS partition_market
      FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, user_id * 4 + event_id % 4 AS m FROM events)""",
    "trades": """
      SELECT event_id AS trade_id, ts, market_id, CASE WHEN k % 2 = 0 THEN 'YES' ELSE 'NO' END AS side, entry_price,
             100.0::DOUBLE AS notional, round(100.0::DOUBLE / entry_price, 4) AS shares
      FROM (SELECT *, CASE WHEN k % 2 = 0 THEN p ELSE round(1 - p, 4) END AS entry_price
            FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, user_id * 4 + event_id % 4 AS market_id,
                         round(greatest(0.05, least(0.95, value / 100)), 4) AS p
                  FROM events WHERE event_type = 'purchase'))""",
}


def with_views(names: str, body: str, extra: str = "") -> str:
    """``WITH`` clause over the named adapters, then further CTEs, then the query."""
    parts = [f"{n} AS ({SQL[n]})" for n in names.split()]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
