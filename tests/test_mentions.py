"""Date mentions in every script, by hand."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from presage.functions.mentions import date_mentions

PUB = date(2024, 1, 17)  # a Wednesday


def day(n):
    d = str(PUB + timedelta(days=n))
    return d, d


CASES = [
    ("On May 5 he may 5 times.", {("2023-05-05",) * 2, ("2024-05-05",) * 2}),
    ("he may 5 times and 10 dec of it", set()),
    ("May 5, 2000 soldiers", {("2023-05-05",) * 2, ("2024-05-05",) * 2}),
    ("5 марта 2023", {("2023-03-05",) * 2, ("2023-03-01", "2023-03-31")}),
    ("3 בינואר 2024", {("2024-01-03",) * 2}),
    ("12 كانون الثاني 2024", {("2024-01-12",) * 2, ("2024-01-01", "2024-01-31")}),
    ("сегодня", {day(0)}), ("אתמול", {day(-1)}), ("ומחר", {day(1)}), ("غدا", {day(1)}),
    ("morgen kommt er", {day(1)}), ("heute Morgen", {day(0)}),
    ("в пятницу", {day(-5), day(2)}), ("ברביעי", {day(0)}), ("ביום שני", {day(-2), day(5)}), ("פעם שני", set()), ("بالجمعة الجمعة", {day(-5), day(2)}),
    ("last Wednesday", {day(0), day(-7)}), ("on Wednesday", {day(0)}), ("Friday's vote", {day(-5), day(2)}),
    ("на прошлой неделе", {("2024-01-08", "2024-01-14")}), ("בשבוע הבא", {("2024-01-22", "2024-01-28")}), ("هذا الأسبوع", {("2024-01-15", "2024-01-21")}),
    ("late March 2024", {("2024-03-01", "2024-03-31")}), ("in October", {("2023-10-01", "2023-10-31"), ("2024-10-01", "2024-10-31")}),
    ("by the end of 2024", {("2024-12-01", "2024-12-31")}), ("it may be", set()), (None, set()),
]


def test_every_script(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, t string").withColumn("pub", F.lit(PUB))
    got = {}
    for r in date_mentions(rows, "id", "t", "pub").collect():
        got.setdefault(r.id, set()).add((str(r.start), str(r.end)))
    wrong = {t: (got.get(i, set()), want) for i, (t, want) in enumerate(CASES) if got.get(i, set()) != want}
    assert not wrong


def test_no_publication_day(spark):
    rows = spark.createDataFrame([(1, "today", None)], "id int, t string, pub date")
    assert date_mentions(rows, "id", "t", "pub").count() == 0


def test_costly_patterns_only_where_a_plain_test_allows_them(spark):
    """What the plain tests turn down holds no date; case forms, day endings and joined words pass."""
    from presage.functions.mentions import may_hold

    texts = {"grammar and calamar seemed mayor": set(), "on 3may": {"_month"}, "5stmay": {"_month"}, "MARſ": {"_month"}, "MÄRZ 3": {"_month"}, "Auguſt 5, 2023": {"_month"}, "FRİDAY": {"_day"},
             "last WEEK": {"_week"}, "end of 2024": {"_year"}, "5 מאי": {"_east", "_month", "_week", "_year"}, "": set()}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tests = may_hold(F.col("t"))
    for r in rows.select("t", *[c.alias(n) for n, c in tests.items()]).collect():
        assert {n for n in tests if r[n]} == texts[r.t], r
