"""Dates a text mentions, as intervals relative to its publication day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presage.functions.scalars import literal_map

# Month, weekday and day words; "_" joins a name of two words.
MONTH_NAMES = (
    "january jan januar janvier enero январь января ינואר يناير كانون_الثاني",
    "february feb februar février febrero февраль февраля פברואר فبراير شباط",
    "march mar märz mars marzo март марта מרץ مارس آذار",
    "april apr avril abril апрель апреля אפריל أبريل نيسان",
    "may mai mayo май мая מאי مايو أيار",
    "june jun juni juin junio июнь июня יוני يونيو حزيران",
    "july jul juli juillet julio июль июля יולי يوليو تموز",
    "august aug août agosto август августа אוגוסט أغسطس آب",
    "september sep sept septembre septiembre сентябрь сентября ספטמבר سبتمبر أيلول",
    "october oct oktober octobre octubre октябрь октября אוקטובר أكتوبر تشرين_الأول",
    "november nov novembre noviembre ноябрь ноября נובמבר نوفمبر تشرين_الثاني",
    "december dec dez dezember décembre diciembre декабрь декабря דצמבר ديسمبر كانون_الأول")
MONTHS_IN_LOWER_CASE_ARE_WORDS = ("may", "mar", "jan", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec")
WEEKDAY_NAMES = (
    "monday montag lundi lunes понедельник שני الاثنين الإثنين",
    "tuesday dienstag mardi martes вторник שלישי الثلاثاء",
    "wednesday mittwoch mercredi miércoles среда среду רביעי الأربعاء الاربعاء",
    "thursday donnerstag jeudi jueves четверг חמישי الخميس",
    "friday freitag vendredi viernes пятница пятницу שישי الجمعة",
    "saturday samstag samedi sábado суббота субботу שבת السبت",
    "sunday sonntag dimanche domingo воскресенье ראשון الأحد الاحد")
WEEKDAYS_AFTER_DAY = ("שני", "ראשון", "שבת")
DAY_WORDS = {
    "today": 0, "tonight": 0, "heute": 0, "aujourd'hui": 0, "hoy": 0, "сегодня": 0, "היום": 0, "הלילה": 0, "اليوم": 0,
    "yesterday": -1, "gestern": -1, "ayer": -1, "вчера": -1, "אתמול": -1, "أمس": -1, "امس": -1, "البارحة": -1,
    "tomorrow": 1, "morgen": 1, "demain": 1, "mañana": 1, "завтра": 1, "מחר": 1, "غدا": 1, "غداً": 1}
HEBREW_PREFIXES = "ובלכהמש"
WEEK_PATTERNS = (
    (-1, r"\blast week\b|\bletzte[rn]? woche\b|на прошлой неделе|בשבוע שעבר|השבוע שעבר|الأسبوع الماضي"),
    (0, r"\bthis week\b|\bdiese[rn]? woche\b|на этой неделе|השבוע(?! הבא| שעבר)|هذا الأسبوع"),
    (1, r"\bnext week\b|\bnächste[rn]? woche\b|на следующей неделе|בשבוע הבא|الأسبوع (?:المقبل|القادم)"))
LAST_CUE = r"\b(?:last|previous|prior|letzte[nrms]?|dernier|dernière|pasad[oa]|прошл\w+|предыдущ\w+)\b|שעבר|הקודם|الماضي|السابق"
MONTH_PART = r"(?:(?:end|beginning|start|early|late|mid)[- ](?:of )?)?"
YEAR_END = r"\b(?:end|close) of (20\d\d)\b|סוף (20\d\d)|конц[ае] (20\d\d)"

MONTH_WORDS = {n.replace("_", " "): i for i, names in reversed(list(enumerate(MONTH_NAMES, 1))) for n in names.split()}
WEEKDAY_WORDS = {n: i for i, names in enumerate(WEEKDAY_NAMES) for n in names.split()}


def _any(words) -> str:
    return "|".join(sorted((w.replace(" ", "\\s+") for w in words), key=lambda w: (-len(w), w)))


#: One-letter forms that case-blind patterns take for a letter of the names, and that letter.
ODD_FORMS = ("ſıİᲀᲁᲂᲃᲄᲅᲆ", "siiвдосттъ")
EASTERN = "[\u0400-\u06ff]"


def _latin(words) -> str:
    """A word in Latin letters as a whole word of a lower-case text; a day's ending may stand before it."""
    each = _any(w for w in words if w[0] < "\u0400")
    return rf"(?<![a-z])(?=[{''.join(sorted({w[0] for w in words if w[0] < chr(0x400)}))}])(?:{each})(?![a-z])|\d(?:st|nd|rd|th)(?:{each})(?![a-z])"


def may_hold(text: Column) -> dict[str, Column]:
    """Plain tests of a text; each kind of date needs one of them, and costs far more than the test."""
    low = F.lower(F.translate(text, *ODD_FORMS))
    east = F.regexp_like(low, F.lit(EASTERN))
    return {"_east": east, "_month": east | F.regexp_like(low, F.lit(_latin(MONTH_WORDS))), "_day": F.regexp_like(low, F.lit(_latin([*DAY_WORDS, *WEEKDAY_WORDS]))),
            "_week": east | low.contains("week") | low.contains("woche"), "_year": east | low.contains(" of 20")}


def date_mentions(rows: DataFrame, key: str, text: str, published: str) -> DataFrame:
    """Distinct (start, end) per text, of dates within ten years of publication.

    A day without year, or before a number that is no year, counts in the years
    within 366 days of publication; a weekday is the previous and the coming
    one, and the day a week before where it is that day and a word like "last"
    is near. Months, weeks and year ends are ranges. Lower-case "may" and its
    like are words, as is capital "Morgen". Hebrew words may carry up to two
    prefix letters; three weekdays that are also other words need "day" before
    them. A null text or publication day has no mentions.
    """
    pub, names = F.col(published), _any(MONTH_WORDS)
    no_word, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    month_first = rf"(?iu){no_word}({names}){end}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?(?!\d)"
    day_first = rf"(?iu)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th|\.|-?ה?ב?)?\s*(?:of\s+|de\s+|ב-?|ב)?({names}){end}(?:,?\s+(\d{{4}}))?"
    iso, numeric = r"(?<!\d)(20\d\d)-(\d\d)-(\d\d)(?!\d)", r"(?<![\d.])(\d{1,2})[./](\d{1,2})[./](20\d\d|\d\d)(?![\d.])"
    month_only = rf"(?iu){no_word}({MONTH_PART})({names}){end}\.?(?:\s+(20\d\d))?(?!\.?\s*\d)"
    word = lambda words, before="": rf"(?iu)(?<![\p{{L}}\p{{N}}_'׳״-]){before}({_any(words)})(?:'s)?(?![\p{{L}}\p{{N}}_'׳״-])"
    hebrew = lambda words: [w for w in words if "א" <= w[0] <= "ת"]
    other = lambda words: [w for w in words if not "א" <= w[0] <= "ת"]
    prefix = f"[{HEBREW_PREFIXES}]{{0,2}}"
    free = [w for w in hebrew(WEEKDAY_WORDS) if w not in WEEKDAYS_AFTER_DAY]
    east, day_or_east, always = F.col("_east"), F.col("_day") | F.col("_east"), F.lit(True)
    kinds = [("md", month_first, F.col("_month")), ("dm", day_first, F.col("_month")), ("iso", iso, always), ("num", numeric, always), ("month", month_only, F.col("_month")), ("year", f"(?iu){YEAR_END}", F.col("_year")),
             ("day", word(other(DAY_WORDS)), day_or_east), ("day", word(hebrew(DAY_WORDS), prefix), east), ("wd", word(other(WEEKDAY_WORDS)), day_or_east), ("wd", word(free, prefix), east),
             ("wd", rf"(?<=ביום\s{{1,3}})({_any(WEEKDAYS_AFTER_DAY)}){end}", east), ("wd", rf"{no_word}ב(שבת){end}", east), *[(f"week{k}", f"(?iu){p}", F.col("_week")) for k, p in WEEK_PATTERNS]]
    found = lambda pat, may: F.when(may, F.regexp_extract_all("t", F.lit(pat), F.lit(0))).when(F.col("t").isNotNull(), F.array().cast("array<string>"))
    tag = lambda kind, pat, may: F.transform(found(pat, may), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("m")))
    tested = rows.filter(pub.isNotNull()).select(key, pub.alias("pub"), F.col(text).alias("t"), *[test.alias(name) for name, test in may_hold(F.col(text)).items()])
    hits = tested.select(key, "pub", "t", F.explode(F.concat(*[tag(*k) for k in kinds])).alias("f")).select(key, "pub", "t", "f.kind", "f.m")
    g = lambda pat, i: F.regexp_extract("m", pat, i)
    look = lambda table, x: F.try_element_at(literal_map(table), F.regexp_replace(F.lower(x), r"\s+", " "))
    ymd = lambda y, mo, d: F.try_to_date(F.format_string("%04d-%02d-%02d", y, mo, d), "yyyy-MM-dd")
    num = lambda x: x.try_cast("int")
    is_md = F.col("kind") == "md"
    name = F.when(is_md, g(month_first, 1)).otherwise(g(day_first, 2))
    mon, day = look(MONTH_WORDS, name), F.when(is_md, num(g(month_first, 2))).otherwise(num(g(day_first, 1)))
    year = F.when(is_md, num(g(month_first, 3))).otherwise(num(g(day_first, 3)))
    near_year = lambda d: d.isNotNull() & (F.abs(F.datediff(d, F.col("pub"))) < 3660)
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    point = lambda d: F.filter(F.array(span(d, d)), lambda x: near_year(x["start"]))
    years = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around_pub = F.filter(F.transform(F.transform(years, lambda k: ymd(F.year("pub") + k, mon, day)), lambda d: span(d, d)), lambda x: F.abs(F.datediff(x["start"], F.col("pub"))) <= 366)
    dated = ymd(year, mon, day)
    short = num(g(numeric, 3))
    only = look(MONTH_WORDS, g(month_only, 2))
    whole = lambda y: F.transform(F.array(ymd(y, only, F.lit(1))), lambda d: span(d, F.last_day(d)))
    months = F.filter(F.flatten(F.transform(years, lambda k: whole(F.year("pub") + k))),
                      lambda x: (x["end"] >= F.date_sub("pub", 366)) & (x["start"] <= F.date_add("pub", 366)))
    stated, part = num(g(month_only, 3)), g(month_only, 1)
    lone = F.lower(g(month_only, 2)).isin(*MONTHS_IN_LOWER_CASE_ARE_WORDS, "mai") & stated.isNull() & (part == "") & (F.lower(F.substring(g(month_only, 2), 1, 1)) == F.substring(g(month_only, 2), 1, 1))
    end_year = num(F.regexp_extract("m", r"(20\d\d)", 1))
    bare = F.regexp_replace(F.lower("m"), "'s$", "")
    base = lambda table: F.coalesce(look(table, bare), look(table, F.substring(bare, 2, 99)), look(table, F.substring(bare, 3, 99)))
    target = base(WEEKDAY_WORDS)
    back = F.pmod(F.weekday("pub") - target, F.lit(7))
    near_cue = F.exists(F.regexp_extract_all("t", F.concat(F.lit(r"(?s).{0,16}\Q"), F.col("m"), F.lit(r"\E.{0,16}")), F.lit(0)), lambda x: F.regexp_like(x, F.lit(f"(?iu){LAST_CUE}")))
    day_of = lambda n: span(F.date_add("pub", n), F.date_add("pub", n))
    weekdays = F.concat(F.array(day_of(-back), day_of(F.pmod(target - F.weekday("pub"), F.lit(7)))), F.when((back == 0) & near_cue, F.array(day_of(F.lit(-7)))).otherwise(F.array().cast("array<struct<start:date,end:date>>")))
    monday = F.date_sub("pub", F.weekday("pub"))
    week = lambda k: F.array(span(F.date_add(monday, 7 * k), F.date_add(monday, 7 * k + 6)))
    none = F.array().cast("array<struct<start:date,end:date>>")
    days = (F.when(F.col("kind").isin("md", "dm"), F.when(name.isin(*MONTHS_IN_LOWER_CASE_ARE_WORDS), none).when(year.isNotNull() & near_year(dated), point(dated)).otherwise(around_pub))
            .when(F.col("kind") == "iso", point(F.try_to_date("m", "yyyy-MM-dd")))
            .when(F.col("kind") == "num", point(ymd(F.when(short < 100, short + 2000).otherwise(short), num(g(numeric, 2)), num(g(numeric, 1)))))
            .when(F.col("kind") == "month", F.when(lone, none).when(stated.isNotNull(), F.filter(whole(stated), lambda x: near_year(x["start"]))).otherwise(months))
            .when(F.col("kind") == "year", F.filter(F.array(span(ymd(end_year, F.lit(12), F.lit(1)), ymd(end_year, F.lit(12), F.lit(31)))), lambda x: near_year(x["start"])))
            .when(F.col("kind") == "day", F.when(F.col("m").startswith("Morgen") | F.col("m").startswith("MORGEN"), none).otherwise(F.array(day_of(base(DAY_WORDS)))))
            .when(F.col("kind") == "wd", weekdays))
    for k, _ in WEEK_PATTERNS:
        days = days.when(F.col("kind") == f"week{k}", week(k))
    return hits.select(key, F.explode(days).alias("d")).select(key, "d.start", "d.end").filter("start is not null").distinct()
