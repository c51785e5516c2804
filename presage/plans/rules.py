"""Work selection, staleness, malformed fields and text shaping, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from presage.operators import rules as R
from presage.plans.registry import Registry
from presage.session import rounded, table
from presage.sources import fixtures as fx
from presage.sources.fixtures import with_views

Q = Registry()
NOW = "2024-02-10 12:00:00"
_K = "(SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events)"


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@Q.add("cell_work", f"""
SELECT *, status NOT IN ('done', 'no_predictions') AND NOT (status = 'failed' AND failed >= 3) AS plain, status <> 'done' AND NOT (status = 'failed' AND failed >= 3) AS retry, status <> 'done' AS forced
FROM (SELECT user_id, event_type, arg_max(s, event_id) AS status, count(*) FILTER (WHERE s = 'failed') AS failed
  FROM (SELECT *, CASE WHEN k % 10 < 4 THEN 'done' WHEN k % 10 < 7 THEN 'no_predictions' ELSE 'failed' END AS s FROM {_K}) GROUP BY 1, 2)""")
def cell_work(spark, sf):
    """Latest state of every cell with its failures, and who would work on it."""
    m = F.col("k") % 10
    runs = _events(spark, sf).select("user_id", "event_type", "event_id", F.when(m < 4, "done").when(m < 7, "no_predictions").otherwise("failed").alias("s"))
    cells = runs.groupBy("user_id", "event_type").agg(F.max_by("s", "event_id").alias("status"), F.count_if(F.col("s") == "failed").alias("failed"))
    s, f = F.col("status"), F.col("failed")
    return cells.withColumns({"plain": R.cell_has_work(s, f), "retry": R.cell_has_work(s, f, retry_empty=True), "forced": R.cell_has_work(s, f, force=True)})


@Q.add("marker_states", f"""
SELECT event_id, coalesce(event_type IN ('view', 'click'), false) AS negative, k % 3 = 1 AND event_id % 2 = 1 AS current,
  CAST(date_trunc('second', ts) AS TIMESTAMP) + INTERVAL 30 DAY > TIMESTAMP '{NOW}' AND k % 30 = k % 28 AS empty, DATE '2024-01-15' + CAST(k % 28 AS INTEGER) + 7 <= TIMESTAMP '{NOW}' AS may_mark FROM {_K}""")
def marker_states(spark, sf):
    """Markers left by earlier passes: negative, current, empty and still fresh, and whether one may be written."""
    k, now = F.col("k"), F.to_timestamp(F.lit(NOW))
    status = F.when(F.col("event_type") == "view", "gate_rejected").when(F.col("event_type") == "click", "no_predictions").when(F.col("event_type") == "purchase", "done")
    day = lambda n: F.date_add(F.to_date(F.lit("2024-01-15")), n)
    return _events(spark, sf).select(
        "event_id", R.negative_marker(status).alias("negative"),
        R.marker_current(F.concat(F.lit("v"), (k % 3 + 4).cast("string")), F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")), "v5", "m1").alias("current"),
        R.marked_empty(F.date_trunc("second", "ts"), day(k % 30), day(k % 28), now).alias("empty"), R.may_mark_empty(day(k % 28), now).alias("may_mark"))


@Q.add("stale_forecasts", f"""
SELECT event_id, CASE WHEN k % 7 < 2 THEN true WHEN k % 7 = 2 THEN false ELSE TIMESTAMP '{NOW}' > date_trunc('second', ts) + INTERVAL 480 HOUR END AS needs FROM {_K}""")
def stale_forecasts(spark, sf):
    """Questions to ask again; times come as epoch seconds, as ISO text, broken, empty or not at all."""
    m = F.col("k") % 7
    sec = F.date_trunc("second", "ts")
    value = F.when(m == 0, F.lit("")).when(m == 2, F.lit("soon")).when((m == 3) | (m == 4), F.concat(F.unix_seconds(sec).cast("string"), F.lit(".0"))).when(
        m > 4, F.date_format(sec, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return _events(spark, sf).select("event_id", R.needs_forecast(value, F.to_timestamp(F.lit(NOW)), 480).alias("needs"))


@Q.add("premise_checks", with_views("pools pool_rows", """
SELECT row_ix, coalesce(claim_archetype IN ('scheduled', 'threshold'), false) OR coalesce(claim_deadline <= t, false) AS due,
  coalesce(coalesce(least(claim_deadline, t), t) - (published_date - (k * 5)::INT) > 180, false) AS stale,
  'TODAY: 2024-01-20 (the deadline ' || CASE WHEN claim_deadline < t THEN 'has already passed, ' || (t - claim_deadline) || ' day(s) ago' WHEN claim_deadline = t THEN 'is today'
    ELSE 'has NOT passed yet, ' || (claim_deadline - t) || ' day(s) remain' END || ')' AS fact,
  CASE WHEN k % 4 = 0 THEN 'absent' WHEN k % 4 = 1 THEN 'unparseable' WHEN settlement_event_date IS NULL THEN 'absent' ELSE 'parsed' END AS date_state
FROM (SELECT *, DATE '2024-01-20' AS t FROM pool_rows) WHERE claim_deadline IS NOT NULL
UNION ALL
SELECT row_ix, coalesce(claim_archetype IN ('scheduled', 'threshold'), false), coalesce(DATE '2024-01-20' - (published_date - (k * 5)::INT) > 180, false), NULL,
  CASE WHEN k % 4 = 0 THEN 'absent' WHEN k % 4 = 1 THEN 'unparseable' WHEN settlement_event_date IS NULL THEN 'absent' ELSE 'parsed' END FROM pool_rows WHERE claim_deadline IS NULL"""))
def premise_checks(spark, sf):
    """Which rows call for a premise check, whose results are too old, what is said about the deadline, and how their event date was given."""
    c, today, k = F.col, F.to_date(F.lit("2024-01-20")), F.col("k")
    given = F.when(k % 4 == 0, " ").when(k % 4 == 1, "last spring").otherwise(c("settlement_event_date").cast("string"))
    return fx.pool_rows(spark, sf).select(
        "row_ix", R.premise_due(c("claim_deadline"), c("claim_archetype"), today).alias("due"),
        R.stale_result(F.date_sub("published_date", k * 5), c("claim_deadline"), today).alias("stale"),
        R.days_to_deadline(c("claim_deadline"), today).alias("fact"), R.date_state(given).alias("date_state"))


_TAILS = ("", " at least 5 votes", " for $3", " by May 2024", " must pass", " will win", " mark it")


@Q.add("question_texts", rf"""
SELECT doc_id, regexp_matches(q, '{R.HARD_THRESHOLD}') AS hard, array_to_string(list_filter([CASE WHEN trim(q) = '' THEN 'empty_criteria' WHEN length(trim(q)) < 35 THEN 'short_criteria' END,
  CASE WHEN trim(q) <> '' AND NOT (contains(lower(q), 'must') OR contains(lower(q), 'will ') OR contains(lower(q), 'mark ')) THEN 'no_anchor_verb' END], lambda x: x IS NOT NULL), ',') AS issues
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, (doc_id % 40)::INT) ELSE '' END || {list(_TAILS)}[doc_id % {len(_TAILS)} + 1] AS q FROM documents)""")
def question_texts(spark, sf):
    """Resolution texts (whole documents, short openings, nothing, each with an ending): hard thresholds and faults."""
    k = F.col("doc_id")
    body = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.substr("text", F.lit(1), (k % 40).cast("int"))).otherwise("")
    q = F.concat(body, F.get(F.array(*[F.lit(t) for t in _TAILS]), (k % len(_TAILS)).cast("int")))
    d = table(spark, sf, "documents").select("doc_id", q.alias("q"))
    return d.select("doc_id", R.hard_threshold(F.col("q")).alias("hard"), F.array_join(R.criteria_issues(F.col("q")), ",").alias("issues"))


@Q.add("probability_fields", f"""
SELECT event_id, CASE k % 6 WHEN 1 THEN 'not_numeric' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'not_finite' WHEN 4 THEN 'out_of_range' END AS fault FROM {_K}""")
def probability_fields(spark, sf):
    """Stored probabilities in five shapes, good and bad."""
    m = F.col("k") % 6
    value = F.when(m == 1, "high").when(m == 2, "NaN").when(m == 3, "-Infinity").when(m == 4, F.concat(F.lit("1."), (F.col("k") + 1).cast("string"))).when(
        m == 5, F.concat(F.lit("0."), F.col("k").cast("string")))
    return _events(spark, sf).select("event_id", R.probability_fault(value).alias("fault"))


@Q.add("score_gate", with_views("pools rich_claims", """
SELECT article_id, max(specificity) AS best, coalesce(max(specificity) < 0.5, false) AS skip FROM rich_claims GROUP BY 1"""))
def score_gate(spark, sf):
    """Articles an extraction gate would skip by their best sentence score."""
    best = fx.rich_claims(spark, sf).groupBy("article_id").agg(F.max("specificity").alias("best"))
    return best.withColumn("skip", R.score_gate(F.col("best"), 0.5))


_SAYS = ("topped ", "failed to top, never passing ", "breached about $", "reached ", "did not, he said. It crossed ", "exceeding £")
_UNITS = ("", " thousand", "k", " million")


@Q.add("bound_comparators", f"""
SELECT event_id, CASE WHEN k % 4 <> 3 AND event_id % 6 IN (0, 2, 4, 5) AND NOT (k % 5 = 0) THEN '>' WHEN k % 4 = 3 THEN '<' ELSE '=' END AS comparator FROM {_K}""")
def bound_comparators(spark, sf):
    """Comparators after the verb of the quote is read; some quotes state another number."""
    e, k = F.col("event_id"), F.col("k")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    number = k * 1000 + 1000
    quote = F.concat(F.lit("The index "), pick(_SAYS, e % 6), F.format_number(number, 0), pick(_UNITS, k % 4), F.lit(" on Monday."))
    value = number * pick((1.0, 1e3, 1e3, 1e6), k % 4) + F.when(k % 5 == 0, 1.0).otherwise(0.0)
    stated = F.when(k % 4 == 3, "<").otherwise("=")
    return _events(spark, sf).select("event_id", R.comparator(stated, quote, value).alias("comparator"))


@Q.add("shaped_queries", """
SELECT p_partkey, array_to_string((list_distinct_in_order)[1:6], ' ') AS query FROM (
  SELECT p_partkey, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS list_distinct_in_order FROM (
    SELECT p_partkey, list_filter(list_concat(['us', 'senate', lower(p_type)], list_concat(string_split(lower(p_name), ' '), ['us', 'senate', ((p_partkey % 300) + 1) || 'k', lower(p_type), '2026'])),
      lambda w: length(w) >= 2) AS ws FROM part))""")
def shaped_queries(spark, sf):
    """Search texts for questions about parts."""
    q = F.concat(F.lit("Will the "), F.col("p_name"), F.lit(" (officially, so far) reach the USA Senate for $"), (F.col("p_partkey") % 300 + 1).cast("string"), F.lit(",000 within "),
                 F.col("p_type"), F.lit(" before 2026?"))
    q = F.regexp_replace(q, "^Will", "will")
    return table(spark, sf, "part").select("p_partkey", R.search_query(q).alias("query"))


@Q.add("answer_distributions", f"""
SELECT event_id, round(ex, 10) AS expected, round(ex / (1 - p0), 10) AS stance, round(p0, 10) AS p_none, v[list_position(p, list_max(p))] AS top
FROM (SELECT event_id, p, p[4] AS p0, [-1.0, -0.7, -0.3, 0.0, 0.3, 0.7, 1.0]::DOUBLE[] AS v, list_sum(list_transform(p, lambda x, i: x * ([-1.0, -0.7, -0.3, 0.0, 0.3, 0.7, 1.0]::DOUBLE[])[i])) AS ex
  FROM (SELECT event_id, list_transform(w, lambda x: x / list_sum(w)::DOUBLE) AS p FROM (SELECT event_id, list_transform(range(7), lambda i: (k * (i + 3) + event_id) % 11 + 1) AS w FROM {_K})))""")
def answer_distributions(spark, sf):
    """Expected stance, stance of the levels that take a side, and likeliest level."""
    w = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (F.col("k") * (i + 3) + F.col("event_id")) % 11 + 1)
    total = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = _events(spark, sf).select("event_id", w.alias("w")).select("event_id", F.transform("w", lambda x: x / total).alias("p")).withColumn("s", R.signal(F.col("p")))
    return rows.select("event_id", rounded(R.expected_value(F.col("p"))).alias("expected"), rounded(F.col("s.stance")).alias("stance"), rounded(F.col("s.p_none")).alias("p_none"),
                       R.top_level(F.col("p")).alias("top"))


@Q.add("decomposition_lines", r"""
SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 <> 0 THEN left(trim(regexp_replace('WHO: ' || coalesce(text, '') || ' | SCOPE: all', '\s+', ' ', 'g')), 400) END AS line
FROM conversations""")
def decomposition_lines(spark, sf):
    """The WHO ... SCOPE line found in replies that hold one around a turn's text."""
    reply = F.when((F.col("conv_id") + F.col("turn")) % 3 != 0, F.concat(F.lit("Sure.\nWHO: "), F.coalesce("text", F.lit("")), F.lit("\n| SCOPE: all\nDone."))).otherwise(F.lit("no line here"))
    return table(spark, sf, "conversations").select("conv_id", "turn", R.decomposition_line(reply).alias("line"))


@Q.add("cluster_texts", with_views("pools rich_claims", """
SELECT article_id, coalesce(string_agg(concat_ws(' ', nullif(claim, ''), nullif(quote, '')), ' ' ORDER BY claim_ix), 'article ' || article_id) AS text FROM rich_claims GROUP BY article_id"""))
def cluster_texts(spark, sf):
    """Text each article is clustered on; an article's claims are a short list."""
    a = fx.rich_claims(spark, sf).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("claim_ix", "claim", "quote"))).alias("claims"))
    return a.select("article_id", R.cluster_text(F.col("claims"), F.concat(F.lit("article "), F.col("article_id").cast("string"))).alias("text"))


@Q.add("article_dates", r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN DATE '2024-01-01' + CAST(page_id % 28 AS INTEGER) WHEN 1 THEN DATE '2024-03-10' - CAST(page_id % 9 AS INTEGER)
  WHEN 2 THEN DATE '2024-02-01' + CAST(page_id % 28 AS INTEGER) ELSE TRY_CAST(nullif(regexp_extract(html, '(?i)<time[^>]*datetime=["'']\s*((?:19|20)\d{2}-\d{2}-\d{2})', 1), '') AS DATE) END AS date FROM pages""")
def article_dates(spark, sf):
    """Date of each page: the provider's in several styles, else the address's, else the page's own."""
    k = F.col("page_id")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (k % 28).cast("int"))
    provider = F.when(k % 4 == 0, F.date_format(day, "MMM d, yyyy")).when(k % 4 == 1, F.concat((k % 9).cast("string"), F.lit(" days ago"))).when(k % 4 == 2, F.lit("recently"))
    url = F.when(k % 4 == 2, F.concat(F.lit("https://a.example.com/2024/feb/"), (k % 28 + 1).cast("string"), F.lit("/x"))).otherwise(F.lit("https://a.example.com/x"))
    return table(spark, sf, "pages").select("page_id", R.article_date(provider, url, F.col("html"), F.to_date(F.lit("2024-03-10"))).alias("date"))


@Q.add("stage_modes", """
SELECT user_id, event_type, CASE WHEN count(*) % 2 = 0 THEN 'OFF' WHEN max(event_id) % 2 = 0 THEN 'ENFORCE' ELSE 'SHADOW' END AS mode FROM events GROUP BY 1, 2""")
def stage_modes(spark, sf):
    """Mode of every stage by its two flags."""
    flags = table(spark, sf, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) % 2 == 1).alias("enabled"), (F.max("event_id") % 2 == 0).alias("enforce"))
    return flags.select("user_id", "event_type", R.stage_mode(F.col("enabled"), F.col("enforce")).alias("mode"))
