"""Row rules of collection and review: what to work on, what is stale, what is malformed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from presage.functions import web as W
from presage.functions.scalars import let

# Marker states, limits, patterns and stance levels.
NEGATIVE_MARKERS = ("gate_rejected", "no_predictions")
MAX_FAILED_ATTEMPTS = 3
EMPTY_MARKER_TTL_DAYS = 30
EMPTY_MARKER_GRACE_DAYS = 7
STALE_RESULT_DAYS = 180
SHORT_CRITERIA = 35
HARD_THRESHOLD = r"(?i)\d[\d,.]*\s*%|\bby\b.*\d{4}\b|\$\d|\bat least\b\s*\d|\bmore than\b\s*\d"
BOUND_VERB = r"(?:topp(?:ed|ing)|breach(?:ed|ing)|cross(?:ed|ing)|exceed(?:ed|ing)|surpass(?:ed|ing)|pass(?:ed|ing))"
BOUND_NUMBER = r"\s+(?:about\s+|around\s+|roughly\s+)?[$€£]?\s*(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|billion|trillion|k|m|bn|b)?\b"
BOUND_NEGATION = r"(?:\bnot\b|n't\b|\bnever\b|\bfail(?:ed|s)?\s+to\b|\bwithout\b|\bshort of\b)[^.;]{0,25}$"
SCALE = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12}
STANCE_VALUES = (-1.0, -0.7, -0.3, 0.0, 0.3, 0.7, 1.0)
QUERY_STOP_WORDS = (
    "a", "an", "the", "of", "or", "and", "to", "in", "on", "for", "by", "be", "will", "is",
    "are", "was", "were", "between", "with", "from", "at", "as", "that", "this", "it", "its",
    "they", "their", "than", "then", "officially", "official", "formally", "formal", "sign",
    "signed", "signs", "announce", "announced", "announces", "reach", "reached", "within",
    "before", "after", "during", "over", "about", "into", "per", "whether",
)
TOKEN_ALIASES = {"usa": "us", "u.s.a": "us", "u.s": "us"}
MAX_QUERY_TOKENS = 6
MAX_LINE_CHARS = 400


def negative_marker(status: Column) -> Column:
    return F.coalesce(status.isin(*NEGATIVE_MARKERS), F.lit(False))


def marker_current(version: Column, model: Column, now_version: str, now_model: str) -> Column:
    """A marker holds as long as prompt and model are those in use."""
    return version.eqNullSafe(F.lit(now_version)) & model.eqNullSafe(F.lit(now_model))


def cell_has_work(status: Column, failed_attempts: Column, force: bool = False, retry_empty: bool = False) -> Column:
    """Whether a cell is worked on: not done, not known empty unless asked for, not parked after three failures unless forced."""
    skip = status.isin(*(("done",) if force or retry_empty else ("done", "no_predictions")))
    parked = F.lit(False) if force else (status == "failed") & (failed_attempts >= MAX_FAILED_ATTEMPTS)
    return F.coalesce(~skip & ~parked, F.lit(True))


def marked_empty(checked_at: Column, marker_end: Column, window_end: Column, now: Column, ttl_days: int = EMPTY_MARKER_TTL_DAYS) -> Column:
    """A fresh empty marker for just this window; an unreadable one does not count."""
    fresh = now < checked_at + F.make_dt_interval(F.lit(ttl_days))
    return F.coalesce(fresh & (marker_end == window_end), F.lit(False))


def may_mark_empty(window_end: Column, now: Column) -> Column:
    """Only a window closed for a week is known to stay empty."""
    return F.date_add(window_end, EMPTY_MARKER_GRACE_DAYS).cast("timestamp") <= now


def forecast_time(value: Column) -> Column:
    """Epoch seconds or an ISO time in text; null when it is neither."""
    return F.coalesce(F.timestamp_micros((value.try_cast("double") * 1000000).cast("long")), F.try_to_timestamp(value))


def needs_forecast(value: Column, now: Column, stale_hours: int) -> Column:
    """No forecast yet or a stale one; one that cannot be dated is left alone."""
    known = F.nullif(value, F.lit(""))
    old = now > forecast_time(known) + F.make_dt_interval(F.lit(0), F.lit(stale_hours))
    return F.when(known.isNull(), True).otherwise(F.coalesce(old, F.lit(False)))


def iso_day(value: Column) -> Column:
    return F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd")


def date_state(value: Column) -> Column:
    """absent / unparseable / parsed."""
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", "absent").when(iso_day(value).isNotNull(), "parsed").otherwise("unparseable")


def stage_mode(enabled: Column, enforce: Column) -> Column:
    return F.when(F.coalesce(enabled, F.lit(False)), F.when(F.coalesce(enforce, F.lit(False)), "ENFORCE").otherwise("SHADOW")).otherwise("OFF")


def premise_due(deadline: Column, archetype: Column, today: Column) -> Column:
    """Whether the premise of a question is worth checking."""
    return F.coalesce(archetype.isin("scheduled", "threshold"), F.lit(False)) | F.coalesce(deadline <= today, F.lit(False))


def stale_result(published: Column, deadline: Column, today: Column) -> Column:
    """Published over half a year before the deadline, or before today if that is earlier."""
    return F.coalesce(F.datediff(F.least(deadline, today), published) > STALE_RESULT_DAYS, F.lit(False))


def days_to_deadline(deadline: Column, today: Column) -> Column:
    """Sentence that states whether the deadline has passed; null without one."""
    left = F.datediff(deadline, today)
    said = F.when(left < 0, F.concat(F.lit("has already passed, "), (-left).cast("string"), F.lit(" day(s) ago"))).when(left == 0, F.lit("is today")).otherwise(
        F.concat(F.lit("has NOT passed yet, "), left.cast("string"), F.lit(" day(s) remain")))
    return F.concat(F.lit("TODAY: "), today.cast("string"), F.lit(" (the deadline "), said, F.lit(")"))


def hard_threshold(text: Column) -> Column:
    return text.rlike(HARD_THRESHOLD)


def criteria_issues(criteria: Column) -> Column:
    """Faults of a resolution text, as a list."""
    text = F.trim(F.coalesce(criteria, F.lit("")))
    low = F.lower(text)
    anchored = F.contains(low, F.lit("must")) | F.contains(low, F.lit("will ")) | F.contains(low, F.lit("mark "))
    return F.array_compact(F.array(F.when(text == "", "empty_criteria").when(F.length(text) < SHORT_CRITERIA, "short_criteria"),
                                   F.when((text != "") & ~anchored, "no_anchor_verb")))


def probability_fault(value: Column) -> Column:
    """Why a stored probability is unusable; null if it is fine or absent."""
    x = value.try_cast("double")
    wild = F.isnan(x) | x.isin(float("inf"), float("-inf"))
    return F.when(value.isNotNull(), F.when(x.isNull(), "not_numeric").when(wild, "not_finite").when(~x.between(0.0, 1.0), "out_of_range"))


def score_gate(best: Column, threshold: float) -> Column:
    """Whether an article would be skipped; without a score it is not."""
    return F.coalesce(best < threshold, F.lit(False))


def asserts_lower_bound(quote: Column, value: Column) -> Column:
    """Whether a verb of passing a bound stands right before this number, not negated.

    Each verb with its number is judged by the words in front of it."""
    found = f"(?i){BOUND_VERB}{BOUND_NUMBER}"
    scale = F.create_map(*[F.lit(x) for pair in SCALE.items() for x in pair])
    marked = F.regexp_replace(F.translate(quote, "\x01", " "), found, "\x01$0")
    near = lambda n: F.abs(n - value) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(value))

    def asserted(pieces: Column) -> Column:
        def says(piece: Column, i: Column) -> Column:
            number = F.replace(F.regexp_extract(piece, found, 1), F.lit(",")).cast("double")
            unit = F.coalesce(F.try_element_at(scale, F.lower(F.regexp_extract(piece, found, 2))), F.lit(1.0))
            before = F.array_join(F.slice(pieces, F.lit(1), i + 1), "")
            return near(number * unit) & ~F.regexp_like(before, F.lit(f"(?i){BOUND_NEGATION}"))

        return F.exists(F.transform(F.slice(pieces, 2, F.size(pieces)), says), lambda x: x)

    return F.coalesce(let(F.split(marked, "\x01"), asserted), F.lit(False))


def comparator(stated: Column, quote: Column, value: Column) -> Column:
    return F.when((stated == "=") & asserts_lower_bound(quote, value), ">").otherwise(stated)


def search_query(text: Column) -> Column:
    """Short search text: compact amounts, capitalised words first, at most six words."""
    compact = F.regexp_replace(text, r"(?<!\d,)(?<!\d)([1-9]\d{0,2}),000(?!,\d{3})", " $1k ")
    plain = F.regexp_replace(compact, r"(?<=\d),(?=\d{3})", "")
    clean = F.regexp_replace(F.regexp_replace(plain, r"\([^)]*\)", " "), r"[^A-Za-z0-9\s.]", " ")
    alias = F.create_map(*[F.lit(x) for pair in TOKEN_ALIASES.items() for x in pair])
    stop = F.array(*[F.lit(w) for w in QUERY_STOP_WORDS])

    def norm(w: Column) -> Column:
        return let(F.rtrim(F.lower(w), F.lit(".")), lambda x: F.coalesce(F.try_element_at(alias, x), x))

    def shape(ws: Column) -> Column:
        ordered = F.concat(F.transform(F.filter(ws, lambda w: w.rlike("^[A-Z]")), norm), F.transform(ws, norm))
        return F.slice(F.array_distinct(F.filter(ordered, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))), 1, MAX_QUERY_TOKENS)

    return F.array_join(let(F.filter(F.split(clean, r"\s+"), lambda w: w != ""), shape), " ")


def expected_value(probabilities: Column) -> Column:
    """Mean stance of a distribution over the stance levels (array, one entry per level)."""
    values = F.array(*[F.lit(v) for v in STANCE_VALUES])
    return F.aggregate(F.zip_with(probabilities, values, lambda p, v: p * v), F.lit(0.0), lambda a, x: a + x)


def signal(probabilities: Column) -> Column:
    """Mean stance of the levels that take a side, and the weight of the one that takes none."""
    none = F.get(probabilities, F.lit(STANCE_VALUES.index(0.0)))
    rest = 1.0 - none
    return F.struct(F.when(rest > 1e-9, expected_value(probabilities) / rest).otherwise(0.0).alias("stance"), none.alias("p_none"))


def top_level(probabilities: Column) -> Column:
    """The likeliest level, the first at a tie."""
    values = F.array(*[F.lit(v) for v in STANCE_VALUES])
    return F.get(values, (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def decomposition_line(reply: Column) -> Column:
    """The WHO ... SCOPE line of a reply in one line; null without one."""
    line = F.trim(F.regexp_replace(F.regexp_extract(reply, r"(?s)WHO:.*?SCOPE:[^\n]*", 0), r"\s+", " "))
    return F.nullif(F.substring(line, 1, MAX_LINE_CHARS), F.lit(""))


def cluster_text(claims: Column, title: Column) -> Column:
    """Text a row is clustered on: its claims and quotes in order, else its title.

    ``claims``: array of structs with claim and quote."""
    parts = F.flatten(F.transform(claims, lambda c: F.filter(F.array(c["claim"], c["quote"]), lambda x: F.coalesce(x, F.lit("")) != "")))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, F.array_join(parts, " ")).otherwise(title)


def article_date(provider: Column, url: Column, html: Column, now: Column) -> Column:
    """The provider's date if it can be read, else the address's, else the page's; never today's."""
    return F.coalesce(W.published_date(provider, now), W.url_date(url), W.html_date(html))
