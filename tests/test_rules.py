"""Text, page, date and row rules on small cases worked out by hand."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from presage.functions import text as X, web as W
from presage.operators import reports as RP, rules as R
from presage.plans import streams


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in rows.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_match_key_removes_marks_and_folds(spark):
    got = column(spark, ["Straße", "בן־גוריון", "Ad‘hoc – x", None, ""], X.match_key)
    assert got == ["strasse", "בנגוריונ", "adhoc x", "", ""]


def test_alias_vowel_letters_are_optional_once(spark):
    rows = spark.createDataFrame([("שימריז", "שמריז", True), ("שייימריז", "שמריז", False), ("ולשמריז", "שמריז", True), ("אז", "יואז", False), ("the u.s.a x", "u.s", True),
                                  ("uxs", "u.s", False), ("élan", "lan", False), ("ab", "ab", False)], "t string, a string, want boolean")
    for r in rows.select("*", X.contains_alias(F.col("t"), F.col("a")).alias("got")).collect():
        assert r.got == r.want, (r.t, r.a)


def test_page_text_selectors(spark):
    long = "word " * 80
    pages = [f"<html><head><title>T</title></head><body><nav>menu</nav><div class='x article-body'><div>{long}</div>tail</div><p>junk</p></body></html>",
             f"<article>short</article><div class=\"my-story-box\">{long}</div>", "<p>a</p><script>var x='<b>';</script><!-- c --><p>b &amp; c<br>d</p>", None, "", "<div class=content>" + "<b>x</b>" * 3]
    got = column(spark, pages, W.page_text)
    assert got[0] == long.strip() + " tail" and got[1] == long.strip() and got[2] == "a b & c d" and got[3] is None and got[4] == "" and got[5] == "x x x"


def test_html_date_places(spark):
    pages = ['<meta content="2024-01-02T08:00" property="article:published_time">', "<meta name='pubdate' content=' 2024-01-03'>", '<meta name="pubdate" content="soon"><time class="a" datetime="2024-01-04">',
             '<script type="application/ld+json">[{"a": {"datePublished": "2020-01-01"}}, {"dateCreated": "2024-01-05T00:00Z"}]</script>', '<script type="application/ld+json">{"uploadDate": "2024-01-06"}</script>', "", None]
    assert column(spark, pages, W.html_date) == [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 6)] + [None, None]


def test_sentences_and_quotes(spark):
    text = "Mr. Smith met Sen.\nTom Leek on Sept. 23 at the house. It cost No. 5 more than it was.  Short. “Quoted words” are here again!"
    assert column(spark, [text, "", None], W.sentences) == [
        ["Mr. Smith met Sen. Tom Leek on Sept. 23 at the house.", "It cost No. 5 more than it was.", '"Quoted words" are here again!'], [], None]
    quotes = ["the house. It cost", "„Quoted words”", "not there", "…", text[:45] + " … " + text[-45:], "Short."]
    rows = spark.createDataFrame([(i, text, q) for i, q in enumerate(quotes)], "i int, t string, q string")
    assert [r.y for r in rows.select("i", W.quote_sentences(F.col("t"), F.col("q")).alias("y")).orderBy("i").collect()] == [[0, 1], [2], None, None, [0, 1, 2], []]


def test_bound_verbs(spark):
    cases = [("Prices topped 90,000 yuan", 90000.0, ">"), ("It failed to top, never passing 5 million", 5e6, "="), ("reached 7", 7.0, "="), ("crossed about $1.5bn today", 1.5e9, ">"), ("It did not. Later exceeding 3", 3.0, ">"),
             ("not topping or breaching 5,000", 5e3, "="), ("never passing 4, it later topped a record, breached 4", 4.0, ">"), ("topped 3 and not exceeding 4", 3.0, ">"), ("topped 3 and not exceeding 4", 4.0, "="), ("", 1.0, "="), (None, 1.0, "=")]
    rows = spark.createDataFrame(cases, "q string, v double, want string")
    for r in rows.select("*", R.comparator(F.lit("="), F.col("q"), F.col("v")).alias("got")).collect():
        assert r.got == r.want, r.q


def test_search_query(spark):
    got = column(spark, ["Will Bitcoin reach $200,000 in the USA (officially)?", "paid 1,200,000 and 5,500 by x", ""], R.search_query)
    assert got == ["bitcoin us 200k", "paid 1200000 5500", ""]


def test_spread_places_round_half_to_even(spark):
    for n in (0, 1, 3, 4, 10, 14, 101):
        for k in (1, 3, 4, 7):
            want = list(range(n)) if n <= k else [n // 2] if k == 1 else sorted({round(i * (n - 1) / (k - 1)) for i in range(k)})
            if n:
                assert spark.range(1).select(RP.spread_places(F.lit(n).cast("long"), k).alias("p")).first().p == want


def test_season_is_the_latest_running_one(spark):
    d = dt.date
    rows = [("aib-1", "x", d(2024, 1, 1), d(2024, 6, 1), None), ("aib-2", "x", d(2024, 2, 1), None, d(2024, 3, 1)), ("cup", "FutureEval", d(2024, 1, 20), None, None), ("", "aib", d(2024, 2, 2), None, None),
            ("aib-9", None, d(2025, 1, 1), None, None)]
    t = spark.createDataFrame(rows, "slug string, name string, start date, forecasting_end date, close_date date")
    assert [r.slug for r in RP.season(t, F.lit(d(2024, 4, 1))).collect()] == ["cup"]
    assert RP.season(t.limit(0), F.lit(d(2024, 4, 1))).count() == 0


def test_stream_decisions_follow_the_order_of_snapshots(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.market_id, r.seq): (r.ask, r.trade) for r in streams.stream_market_decisions(spark, sf).collect()}
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values("event_id")
    state, want = {}, {}
    for r in e.itertuples():
        k, m = int(r.props.split(":")[1].strip(" }")), r.user_id * 4 + r.event_id % 4
        asked, opened = state.get(m, (None, False))
        price = None if r.event_type == "error" else round(min(max(r.value / 100, 0.01), 0.99), 4)
        usable = r.ts < pd.Timestamp("2024-01-20") and price is not None
        ask = bool(usable and 0.02 <= price <= 0.98 and (asked is None or (r.ts - asked).total_seconds() >= 72000))
        trade = None
        if usable and not opened and k % 3 == 0 and 0.05 <= price <= 0.95:
            edge = round(k / 100 - price, 4)
            trade = "YES" if edge >= 0.1 else "NO" if edge <= -0.1 else None
        state[m] = (r.ts if ask else asked, opened or trade is not None)
        want[(m, r.event_id)] = (ask, trade)
    assert got == want
