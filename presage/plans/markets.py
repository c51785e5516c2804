"""Forecasts against market prices, and reports over append-only ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.functions import scalars as S
from presage.operators import asof as AS, ledger as L
from presage.operators.skew import first_per
from presage.operators.guards import PERSONAL_QUESTION, admitted
from presage.plans.registry import Registry
from presage.session import rounded, table
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()
HORIZONS = (7, 14, 30, 60)


def priced_events(spark, sf):
    """Outcomes tied to a price series, with an outcome date inside its range."""
    m = F.col("market_id")
    series = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]), (m % 5 + 1).cast("int"))
    return fx.outcomes(spark, sf).select(m, "outcome", series.alias("series_id"),
                                         F.date_add(F.to_date(F.lit("1995-01-03")), ((m * 37) % 2500).cast("int")).alias("outcome_date"),
                                         (m % 6 == 0).alias("invert"))


def model_at(spark, sf):
    m, t = F.col("market_id"), F.col("t_days")
    return fx.outcomes(spark, sf).select(m).crossJoin(horizons(spark)).select(
        m, t, F.when((m + t) % 9 != 0, ((m * t * 7) % 97 + 1) / 100.0).alias("model_p"), (m % 10 == 0).alias("placeholder"))


def horizons(spark):
    return spark.createDataFrame([(t,) for t in HORIZONS], "t_days int")


def _r(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


DUEL_SQL = """
ev AS (SELECT market_id, outcome, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][market_id % 5 + 1] AS series_id,
              DATE '1995-01-03' + CAST((market_id * 37) % 2500 AS INTEGER) AS outcome_date, market_id % 6 = 0 AS invert FROM outcomes),
hz AS (SELECT unnest([7, 14, 30, 60])::INT AS t_days),
asked AS (SELECT *, outcome_date - t_days AS cutoff FROM ev, hz),
fst AS (SELECT series_id, min(date) AS d, arg_min(probability, date) AS p FROM prices GROUP BY 1),
mk AS (SELECT a.market_id, outcome, a.series_id, outcome_date, invert, t_days,
              round(CASE WHEN invert THEN 1 - coalesce(p.probability, fst.p) ELSE coalesce(p.probability, fst.p) END, 4) AS market_p,
              (outcome_date - coalesce(p.date, fst.d))::INT AS price_days, p.probability IS NULL AND fst.p IS NOT NULL AS after_cutoff
       FROM asked a ASOF LEFT JOIN prices p ON a.series_id = p.series_id AND a.cutoff >= p.date LEFT JOIN fst ON a.series_id = fst.series_id),
md AS (SELECT market_id, t_days, CASE WHEN (market_id + t_days) % 9 <> 0 THEN ((market_id * t_days * 7) % 97 + 1) / 100.0::DOUBLE END AS model_p,
              market_id % 10 = 0 AS placeholder FROM outcomes, hz),
duel AS (SELECT *, CASE WHEN ob < mb THEN 'model' WHEN mb < ob THEN 'market' WHEN mb = ob THEN 'tie' END AS winner
         FROM (SELECT mk.*, model_p, placeholder, round(pow(market_p - outcome::INT, 2), 4) AS mb, round(pow(model_p - outcome::INT, 2), 4) AS ob
               FROM mk LEFT JOIN md USING (market_id, t_days)))
"""


@Q.add("market_price_asof", with_views("outcomes prices", "SELECT * FROM mk", DUEL_SQL))
def market_price_asof(spark, sf):
    return AS.market_price_at(fx.prices(spark, sf), priced_events(spark, sf), horizons(spark))


def _duel(spark, sf):
    market = AS.market_price_at(fx.prices(spark, sf), priced_events(spark, sf), horizons(spark))
    return AS.duel_rows(market, model_at(spark, sf))


@Q.add("duel_rows", with_views("outcomes prices", """
SELECT market_id, t_days, market_p, round(model_p, 4) AS model_p, mb AS market_brier, ob AS model_brier, winner, placeholder FROM duel""", DUEL_SQL))
def duel_rows(spark, sf):
    return _duel(spark, sf).select("market_id", "t_days", "market_p", "model_p", "market_brier", "model_brier", "winner", "placeholder")


@Q.add("duel_sweep", with_views("outcomes prices", """
SELECT t_days, count(*) AS n_common, round(avg(ob), 10) AS model_brier, round(avg(mb), 10) AS market_brier,
       count(*) FILTER (WHERE winner = 'model') AS model_wins, count(*) FILTER (WHERE winner = 'market') AS market_wins
FROM duel WHERE market_id IN (SELECT market_id FROM duel WHERE market_p IS NOT NULL AND model_p IS NOT NULL GROUP BY 1 HAVING count(DISTINCT t_days) = 4)
GROUP BY 1""", DUEL_SQL))
def duel_sweep(spark, sf):
    return _r(AS.duel_sweep(_duel(spark, sf), len(HORIZONS)), "model_brier", "market_brier")


@Q.add("duel_coverage", with_views("outcomes prices", """
SELECT t_days, count(*) FILTER (WHERE market_p IS NOT NULL AND model_p IS NOT NULL AND NOT placeholder) AS n_both,
       count(*) FILTER (WHERE market_p IS NOT NULL AND (model_p IS NULL OR placeholder)) AS n_market_only,
       count(*) FILTER (WHERE market_p IS NULL) AS n_none FROM duel GROUP BY 1""", DUEL_SQL))
def duel_coverage(spark, sf):
    has, model = F.col("market_p").isNotNull(), F.col("model_p").isNotNull() & ~F.col("placeholder")
    return _duel(spark, sf).groupBy("t_days").agg(
        F.count_if(has & model).alias("n_both"), F.count_if(has & ~model).alias("n_market_only"), F.count_if(~has).alias("n_none"))


@Q.add("price_and_previous", with_views("outcomes prices", """
, pv AS (SELECT *, lag(probability) OVER (PARTITION BY series_id ORDER BY date) AS prev FROM prices)
SELECT a.market_id, a.series_id, a.outcome_date AS date, p.date AS price_date, p.probability AS price, p.prev AS prev_price
FROM ev a ASOF LEFT JOIN pv p ON a.series_id = p.series_id AND a.outcome_date >= p.date""", DUEL_SQL).replace("\n\n, pv", ",\npv"))
def price_and_previous(spark, sf):
    ev = priced_events(spark, sf).select("market_id", "series_id", F.col("outcome_date").alias("date"))
    return AS.asof(fx.prices(spark, sf), ev)


@Q.add("daily_last_price", with_views("price_ticks", """
SELECT series_id, date, arg_max(probability, tick) AS probability FROM price_ticks WHERE date <= DATE '1998-12-31' GROUP BY 1, 2"""))
def daily_last_price(spark, sf):
    return AS.last_per_day(fx.price_ticks(spark, sf), F.to_date(F.lit("1998-12-31")))


@Q.add("merged_price_history", with_views("price_ticks", """
SELECT series_id, date, coalesce(n.p, o.p) AS probability
FROM (SELECT series_id, date, arg_min(probability, tick) AS p FROM price_ticks WHERE date < DATE '1999-01-01' GROUP BY 1, 2) o
FULL JOIN (SELECT series_id, date, arg_min(probability, tick) AS p FROM price_ticks WHERE date >= DATE '1998-06-01' AND tick % 2 = 0 GROUP BY 1, 2) n
USING (series_id, date)"""))
def merged_price_history(spark, sf):
    t = fx.price_ticks(spark, sf)
    old = AS.first_per_day(t.filter(F.col("date") < F.lit("1999-01-01").cast("date")))
    new = AS.first_per_day(t.filter((F.col("date") >= F.lit("1998-06-01").cast("date")) & (F.col("tick") % 2 == 0)))
    return AS.merge_series(old, new)


@Q.add("evaluation_dates", with_views("prices", """
SELECT date, live FROM (SELECT *, row_number() OVER (ORDER BY date) - 1 AS ix FROM (
  SELECT date, live FROM (SELECT d.date, count(s.d) AS live FROM (SELECT DISTINCT date FROM prices) d LEFT JOIN
    (SELECT series_id, min(date) AS d FROM prices GROUP BY 1) s ON s.d <= d.date GROUP BY 1)
  WHERE live >= 0.9 * (SELECT count(DISTINCT series_id) FROM prices)))
WHERE ix >= 14 AND (ix - 14) % 14 = 0"""))
def evaluation_dates(spark, sf):
    return AS.thinned_dates(AS.coverage_dates(fx.prices(spark, sf), 0.9), 14)


@Q.add("series_as_maps", with_views("prices", """
SELECT series_id, count(*) AS points, min(date) AS first_date, max(date) AS last_date, round(sum(probability), 10) AS checksum FROM prices GROUP BY 1"""))
def series_as_maps(spark, sf):
    from presage.sources.readers import series_maps

    m = series_maps(fx.prices(spark, sf))
    keys = F.array_sort(F.map_keys("points"))
    return m.select("series_id", F.size("points").cast("long").alias("points"), keys[0].alias("first_date"), F.element_at(keys, -1).alias("last_date"),
                    rounded(F.aggregate(F.map_values("points"), F.lit(0.0), lambda a, x: a + x)).alias("checksum"))


LEDGER_SQL = """
lst AS (SELECT market_id, count(*) AS n_snapshots, count(*) FILTER (WHERE model_yes IS NOT NULL OR model_reason IS NOT NULL) AS calls, max(seq) AS s,
               max(seq) FILTER (WHERE model_yes IS NOT NULL) AS lm, min(seq) FILTER (WHERE model_yes IS NOT NULL) AS fm FROM snapshots GROUP BY 1),
rep AS (SELECT lst.*, l.event_slug, l.end_ts, l.closed, l.resolved_outcome, l.resolution_raw, l.market_yes, l.ts, l.partition_market FROM lst JOIN snapshots l ON l.seq = lst.s),
latest AS (SELECT rep.*, m.model_yes, m.market_yes AS market_at_model, m.ts AS model_ts, m.end_ts AS model_end_ts FROM rep LEFT JOIN snapshots m ON m.seq = lm),
firsts AS (SELECT rep.*, m.model_yes, m.market_yes AS market_at_model, m.ts AS model_ts, m.end_ts AS model_end_ts FROM rep LEFT JOIN snapshots m ON m.seq = fm)
"""


def scored_sql(src: str, excl: bool) -> str:
    why = ("CASE WHEN ok0 THEN CASE WHEN coalesce(epoch_us(model_end_ts) - epoch_us(model_ts) < 432000000000, true) THEN 'horizon' "
           "WHEN NOT market_at_model BETWEEN 0.1 AND 0.9 THEN 'band' END END") if excl else "NULL"
    return f"""
sc0 AS (SELECT *, {why} AS excluded FROM (SELECT *, coalesce(resolved_outcome IN ('YES', 'NO'), false) AND model_yes IS NOT NULL AND market_at_model IS NOT NULL AS ok0 FROM {src})),
sc AS (SELECT *, CASE WHEN ok THEN pow(model_yes - y, 2) END AS brier_model, CASE WHEN ok THEN pow(market_at_model - y, 2) END AS brier_market,
              CASE WHEN ok THEN -ln(greatest(0.0001, least(0.9999, CASE WHEN y = 1 THEN model_yes ELSE 1 - model_yes END))) END AS logloss_model,
              CASE WHEN ok THEN -ln(greatest(0.0001, least(0.9999, CASE WHEN y = 1 THEN market_at_model ELSE 1 - market_at_model END))) END AS logloss_market
       FROM (SELECT *, ok0 AND excluded IS NULL AS ok, (resolved_outcome = 'YES')::INT AS y FROM sc0))
"""


@Q.add("market_report", with_views("snapshots", """
SELECT market_id, n_snapshots, calls, event_slug, closed, resolved_outcome, resolution_raw, market_yes, model_yes, market_at_model,
       round(brier_model, 10) AS brier_model, round(brier_market, 10) AS brier_market FROM sc""", LEDGER_SQL + "," + scored_sql("latest", False)))
def market_report(spark, sf):
    s = L.score_markets(L.market_report(fx.snapshots(spark, sf)))
    return _r(s.select("market_id", "n_snapshots", "calls", "event_slug", "closed", "resolved_outcome", "resolution_raw", "market_yes", "model_yes",
                       "market_at_model", "brier_model", "brier_market"), "brier_model", "brier_market")


@Q.add("first_forecast_report", with_views("snapshots", """
SELECT market_id, model_yes, market_at_model, excluded, round(brier_model, 10) AS brier_model, round(logloss_market, 10) AS logloss_market FROM sc""",
                                           LEDGER_SQL + "," + scored_sql("firsts", True)))
def first_forecast_report(spark, sf):
    s = L.score_markets(L.market_report(fx.snapshots(spark, sf), "first"), L.exclusion())
    return _r(s.select("market_id", "model_yes", "market_at_model", "excluded", "brier_model", "logloss_market"), "brier_model", "logloss_market")


@Q.add("ledger_summary", with_views("snapshots", """
SELECT count(*) AS n_markets, count(model_yes) AS n_with_model, round(avg((model_yes IS NOT NULL)::INT), 10) AS coverage,
       count(*) FILTER (WHERE resolved_outcome IN ('YES', 'NO')) AS n_resolved, count(*) FILTER (WHERE resolution_raw IN ('MKT', 'CANCEL')) AS n_void,
       count(brier_model) AS n_scored, count(*) FILTER (WHERE excluded = 'horizon') AS n_excluded_horizon, count(*) FILTER (WHERE excluded = 'band') AS n_excluded_band,
       round(avg(brier_model), 10) AS brier_model, round(avg(brier_market), 10) AS brier_market, round(avg(logloss_model), 10) AS logloss_model,
       round(avg(logloss_market), 10) AS logloss_market, round(avg(brier_model - brier_market), 10) AS brier_diff, sum(calls)::BIGINT AS calls,
       CASE WHEN count(brier_model) < 150 THEN 'too early' WHEN avg(brier_model - brier_market) <= 0.01 THEN 'pass' ELSE 'not passing' END AS verdict
FROM sc""", LEDGER_SQL + "," + scored_sql("firsts", True)))
def ledger_summary(spark, sf):
    s = L.report_summary(L.score_markets(L.market_report(fx.snapshots(spark, sf), "first"), L.exclusion()))
    return _r(s, "coverage", "brier_model", "brier_market", "logloss_model", "logloss_market", "brier_diff")


POS_SQL = LEDGER_SQL + """,
pos AS (SELECT trade_id, market_id, side, shares, notional, status, price AS side_price, shares * price AS value, shares * price - notional AS pnl
  FROM (SELECT *, CASE WHEN status IN ('won', 'lost') THEN (status = 'won')::INT::DOUBLE WHEN status = 'open' THEN CASE WHEN side = 'YES' THEN market_yes ELSE 1 - market_yes END END AS price
    FROM (SELECT t.*, r.market_yes, CASE WHEN resolved_outcome = side THEN 'won' WHEN resolved_outcome IN ('YES', 'NO') THEN 'lost'
                 WHEN resolution_raw IN ('MKT', 'CANCEL') THEN 'void' ELSE 'open' END AS status
          FROM trades t LEFT JOIN rep r USING (market_id))))"""


@Q.add("positions", with_views("snapshots trades", """
SELECT trade_id, market_id, side, status, round(side_price, 10) AS side_price, round(value, 10) AS value, round(pnl, 10) AS pnl FROM pos""", POS_SQL))
def positions(spark, sf):
    p = L.positions(fx.trades(spark, sf), L.market_report(fx.snapshots(spark, sf)))
    return _r(p.select("trade_id", "market_id", "side", "status", "side_price", "value", "pnl"), "side_price", "value", "pnl")


@Q.add("profit_and_loss", with_views("snapshots trades", """
SELECT count(*) AS n_positions, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE status = 'won') AS n_won,
       count(*) FILTER (WHERE status = 'lost') AS n_lost, count(*) FILTER (WHERE status = 'void') AS n_void, round(sum(notional), 2) AS notional,
       round(coalesce(sum(pnl) FILTER (WHERE status = 'open'), 0), 4) AS unrealised,
       round(coalesce(sum(pnl) FILTER (WHERE status IN ('won', 'lost')), 0), 4) AS realised FROM pos""", POS_SQL))
def profit_and_loss(spark, sf):
    p = L.pnl_summary(L.positions(fx.trades(spark, sf), L.market_report(fx.snapshots(spark, sf))))
    return p.withColumns({"notional": F.round("notional", 2), "unrealised": F.round("unrealised", 4), "realised": F.round("realised", 4)})


@Q.add("coherent_prices", with_views("snapshots", """
SELECT market_id, event_slug, market_yes, model_yes, v AS coherent_yes, CASE WHEN v IS NOT NULL THEN CASE WHEN yes_ > 0 THEN 1.0::DOUBLE ELSE round(total, 4) END END AS coherent_sum,
       round(v - market_yes, 4) AS coherent_edge
FROM (SELECT *, CASE WHEN n >= 2 AND foreign_ = 0 AND openres = 0 AND nlive > 0 AND band THEN
               CASE WHEN yes_ > 0 THEN 0.0::DOUBLE WHEN nband > 0 AND nomodel = 0 AND total > 0 THEN round(model_yes / total, 4) END END AS v
  FROM (SELECT *, count(*) OVER e AS n, count(*) FILTER (WHERE NOT partition_market) OVER e AS foreign_,
               count(*) FILTER (WHERE closed AND resolved_outcome IS NULL) OVER e AS openres, count(*) FILTER (WHERE NOT closed) OVER e AS nlive,
               count(*) FILTER (WHERE closed AND resolved_outcome = 'YES') OVER e AS yes_, count(*) FILTER (WHERE band) OVER e AS nband,
               count(*) FILTER (WHERE band AND model_yes IS NULL) OVER e AS nomodel,
               sum(CASE WHEN band THEN model_yes WHEN NOT closed THEN market_yes ELSE 0 END) OVER e AS total
        FROM (SELECT *, NOT closed AND market_yes BETWEEN 0.02 AND 0.98 AS band FROM early WHERE market_yes IS NOT NULL) WINDOW e AS (PARTITION BY event_slug)))""",
    LEDGER_SQL.replace("FROM snapshots GROUP BY 1", "FROM snapshots WHERE ts < TIMESTAMP '2024-01-25' AND (NOT closed OR market_id % 4 = 0) GROUP BY 1") + ", early AS (SELECT * FROM latest)"))
def coherent_prices(spark, sf):
    snaps = fx.snapshots(spark, sf).filter((F.col("ts") < F.to_timestamp(F.lit("2024-01-25"))) & (~F.col("closed") | (F.col("market_id") % 4 == 0)))
    return L.coherent(L.market_report(snaps))


@Q.add("trade_decisions", with_views("snapshots", """
SELECT seq, market_id, CASE WHEN NOT market_yes BETWEEN 0.05 AND 0.95 THEN NULL WHEN round(model_yes - market_yes, 4) >= 0.1 THEN 'YES'
       WHEN round(model_yes - market_yes, 4) <= -0.1 THEN 'NO' END AS side, round(model_yes - market_yes, 4) AS edge
FROM snapshots WHERE model_yes IS NOT NULL AND market_yes IS NOT NULL AND NOT closed"""))
def trade_decisions(spark, sf):
    s = fx.snapshots(spark, sf).filter("model_yes is not null and market_yes is not null and not closed")
    return s.select("seq", "market_id", S.trade_side(F.col("model_yes"), F.col("market_yes")).alias("side"),
                    F.round(F.col("model_yes") - F.col("market_yes"), 4).alias("edge"))


@Q.add("first_open_trades", with_views("snapshots trades", """
SELECT market_id, min(seq) AS seq, arg_min(side, seq) AS side FROM (
  SELECT seq, market_id, CASE WHEN round(model_yes - market_yes, 4) >= 0.1 THEN 'YES' WHEN round(model_yes - market_yes, 4) <= -0.1 THEN 'NO' END AS side
  FROM snapshots WHERE model_yes IS NOT NULL AND market_yes BETWEEN 0.05 AND 0.95 AND NOT closed)
WHERE side IS NOT NULL AND market_id NOT IN (SELECT market_id FROM trades) GROUP BY 1"""))
def first_open_trades(spark, sf):
    return L.first_open_trade(trade_decisions(spark, sf).filter("side is not null").select("market_id", "seq", "side"), fx.trades(spark, sf))


ASK_SQL = """
asked AS (SELECT market_id, max(seq) AS ls, max(seq) FILTER (WHERE model_yes IS NOT NULL OR model_reason IS NOT NULL) AS la FROM snapshots GROUP BY 1),
st AS (SELECT asked.market_id, l.closed, l.market_yes, l.end_ts, a.ts AS asked_ts, a.model_yes AS asked_model
       FROM asked JOIN snapshots l ON l.seq = ls LEFT JOIN snapshots a ON a.seq = la)
"""


@Q.add("ask_again", with_views("snapshots", """
SELECT market_id, NOT closed AND coalesce(market_yes BETWEEN 0.02 AND 0.98, false) AND coalesce(TIMESTAMP '2024-01-19 12:00:00' - asked_ts >= INTERVAL 20 HOUR, true) AS ask,
       NOT closed AND coalesce(market_yes BETWEEN 0.02 AND 0.98, false) AND coalesce(end_ts - TIMESTAMP '2024-01-19 12:00:00' >= INTERVAL 5 DAY, true) AND asked_model IS NULL
         AND coalesce(TIMESTAMP '2024-01-19 12:00:00' - asked_ts >= INTERVAL 72 HOUR, true) AS ask_once
FROM st""", ASK_SQL.replace("FROM snapshots GROUP BY 1", "FROM snapshots WHERE ts < TIMESTAMP '2024-01-19 12:00:00' GROUP BY 1")))
def ask_again(spark, sf):
    now = "2024-01-19 12:00:00"
    last = L.last_asked(fx.snapshots(spark, sf).filter(F.col("ts") < F.to_timestamp(F.lit(now))))
    return last.select("market_id", L.wants_ask(last, now, 20).alias("ask"), L.wants_single_ask(now).alias("ask_once"))


@Q.add("run_call_cap", with_views("snapshots", """
SELECT run, seq, call_ix FROM (SELECT CAST(ts AS DATE) AS run, seq, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY seq) AS call_ix
  FROM snapshots WHERE model_yes IS NOT NULL OR model_reason IS NOT NULL) WHERE call_ix <= 12"""))
def run_call_cap(spark, sf):
    due = fx.snapshots(spark, sf).filter(L.asked(F.col("model_yes"), F.col("model_reason"))).select(F.to_date("ts").alias("run"), "seq")
    return L.per_run_cap(due, "run", "seq", 12)


@Q.add("ledger_append", """
WITH r AS (SELECT event_id AS seq, user_id AS prediction_id, round(value, 2) AS v FROM events)
SELECT prediction_id, arg_min(v, seq) AS v, min(seq) AS seq FROM r GROUP BY 1""")
def ledger_append(spark, sf):
    r = table(spark, sf, "events").select(F.col("user_id").alias("prediction_id"), F.round("value", 2).alias("v"), F.col("event_id").alias("seq"))
    # half of the keys are stored already and the whole log is offered again
    stored = first_per(r.filter(F.col("prediction_id") % 2 == 0), ["prediction_id"], F.col("seq"))
    return L.append_once(stored, r, "prediction_id", "seq")


@Q.add("ledger_retraction", """
WITH r AS (SELECT event_id AS seq, user_id AS prediction_id, event_type, value FROM events),
gone AS (SELECT prediction_id, max(seq) AS g FROM r WHERE event_type = 'error' GROUP BY 1)
SELECT prediction_id, seq FROM r LEFT JOIN gone USING (prediction_id) WHERE event_type <> 'error' AND (g IS NULL OR g < seq)""")
def ledger_retraction(spark, sf):
    r = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("prediction_id"), "event_type")
    return L.retract(r.filter("event_type <> 'error'"), r.filter("event_type = 'error'"), "prediction_id", "seq").select("prediction_id", "seq")


@Q.add("tag_upserts", """
SELECT prediction_id, array_to_string(tags, ',') AS tags FROM (
  SELECT prediction_id, arg_max(list_sort(list_distinct(list_filter(list_transform(string_split(raw, ','), lambda t: trim(t)), lambda t: t <> ''))), seq) AS tags
  FROM (SELECT event_id AS seq, user_id AS prediction_id, CASE WHEN event_type = 'error' THEN '' ELSE ' ' || event_type || ',' || (event_id % 3) || ' , ,' || event_type END AS raw FROM events) GROUP BY 1)
WHERE len(tags) > 0""")
def tag_upserts(spark, sf):
    raw = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(" "), "event_type", F.lit(","), (F.col("event_id") % 3).cast("string"), F.lit(" , ,"), "event_type"))
    log = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("prediction_id"), F.split(raw, ",").alias("tags"))
    return L.upsert_tags(log, "prediction_id", "seq").select("prediction_id", F.array_join("tags", ",").alias("tags"))


_PERSONAL = PERSONAL_QUESTION.replace("(?i)", "").replace("\\'", "''")


@Q.add("market_admission", rf"""
SELECT part_id, NOT closed AND price IS NOT NULL AND resolution IS NULL AND bettors >= 15 AND volume >= 500 AND NOT regexp_matches(q, '{_PERSONAL}', 'i') AND hours >= 120 AND hours <= 720 AS admitted
FROM (SELECT p_partkey AS part_id, CASE p_partkey % 7 WHEN 1 THEN 'Will my ' || p_name || ' arrive?' WHEN 2 THEN 'Daily ' || p_name || '?' ELSE 'Will the ' || p_name || ' rise?' END AS q, p_size AS bettors, p_retailprice AS volume,
  (p_partkey * 31) % 900 AS hours, p_partkey % 11 = 0 AS closed, CASE WHEN p_partkey % 13 <> 0 THEN 0.5 END AS price, CASE WHEN p_partkey % 17 = 0 THEN 'MKT' END AS resolution FROM part)""")
def market_admission(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    question = F.when(k % 7 == 1, F.concat(F.lit("Will my "), name, F.lit(" arrive?"))).when(k % 7 == 2, F.concat(F.lit("Daily "), name, F.lit("?"))).otherwise(
        F.concat(F.lit("Will the "), name, F.lit(" rise?")))
    return table(spark, sf, "part").select(k.alias("part_id"), admitted(
        F.col("p_size"), F.col("p_retailprice"), question, (k * 31) % 900, k % 11 == 0, F.when(k % 13 != 0, 0.5), F.when(k % 17 == 0, "MKT")).alias("admitted"))
