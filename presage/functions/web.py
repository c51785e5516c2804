"""URLs, publication dates, page text, sentences and search terms as columns."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from presage.functions.scalars import let, literal_map

# Month names, host and path lists, abbreviations.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
EVERGREEN = ("wikipedia.org", "britannica.com", "cfr.org", "encyclopedia.com", "history.com", "investopedia.com")
BAD_PATHS = ("/authors/", "/author/", "/topics/", "/tag/", "/category/", "/section/", "/search/", "/video/")
SHORT_FORM_HOSTS = ("t.me", "israelnationalnews.com")
NO_ARTICLE_PAGE_HOSTS = ("t.me",)
NOISY_SUBDOMAINS = ("feeds", "rss", "m", "amp", "www")
UNIT_DAYS = {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30, "year": 365}
COMMON_NAMES = ("Israel", "Israeli", "Iran", "Iranian", "Gaza", "West", "Bank", "United", "States", "America", "American", "European", "Middle", "East")
DATE_META = (
    ("property", "article:published_time"), ("name", "article:published_time"), ("property", "og:article:published_time"),
    ("name", "datePublished"), ("itemprop", "datePublished"), ("name", "pubdate"), ("name", "publishdate"), ("name", "DC.date.issued"),
    ("property", "article:modified_time"),
)
JSON_LD_DATES = ("datePublished", "dateCreated", "uploadDate")
BOILERPLATE_TAGS = ("script", "style", "nav", "footer", "header", "aside", "iframe", "figure")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CONTENT_SELECTORS = (
    "article", "main", ".article-body", ".article-content", ".post-content", '[class*="article"]', '[class*="story"]', '[class*="content"]',
)
MIN_BODY_CHARS = 300
STUB_TITLES = (
    "bloomberg mercury", "bloomberg data", "watch russia invades ukraine", "this week in crypto", "bloomberg podcasts", "bloomberg quicktake", "bloomberg live")
SENTENCE_END = r"(?<=[.!?׃۔؟])\s+"
DOUBLE_QUOTES = "“”„«»״″"
SINGLE_QUOTES = "‘’׳′"
QUOTE_TRIM = ' ….,;:"\'–—-'
ABBR_MONTH = r"(?:^|[\s(\"'])(?:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec)\.$"
ABBR_TITLE = r"(?:^|[\s(\"'])(?:Mr|Mrs|Ms|Dr|Prof|Sen|Rep|Gov|Gen|Lt|Col|Sgt|Capt|Maj|Adm|Rev|St|Mt|Hon|Pres|Sec)\.$"
ABBR_INITIAL = r"(?:^|\s)[A-Z]\.$"
ABBR_INLINE = r"(?i)(?:^|[\s(\"'])(?:vs|No|Nos|Inc|Ltd|Co|Corp|Jr|Sr|approx|est)\.$"
ABBR_CHARS = 8  # the longest abbreviation with its full stop and the character before it
ABBR_ANY = r"(?:^|[\s(\"'])[A-Za-z]{1,6}\.$"
SLUG_SMALL_WORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with")


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1)), "^www\\.", "")


def clean_source(domain: Column) -> Column:
    return F.regexp_replace(domain, "^(?:(?:" + "|".join(NOISY_SUBDOMAINS) + ")\\.)+", "")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def url_date(url: Column) -> Column:
    """Date in the path, month as number or name; null when it is no date."""
    pat = "(?i)[/_-](\\d{4})[/_-](\\d{1,2}|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[/_-](\\d{1,2})(?:[/_\\-.]|$)"
    part = lambda i: F.regexp_extract(url, pat, i)
    month = F.coalesce(F.try_element_at(literal_map(MONTHS), F.lower(part(2))).cast("string"), part(2))
    year = part(1).try_cast("int")
    return F.when(year.between(2000, 2100), _date(part(1), month, part(3)))


def published_date(value: Column, now: Column) -> Column:
    """ISO, month-name, unambiguous numeric and "n units ago" forms; else null."""
    t = F.trim(F.regexp_replace(value, "[\\u200b-\\u200f\\u202a-\\u202e\\u2066-\\u2069\\ufeff]", ""))
    g = lambda pat, i: F.regexp_extract(t, pat, i)
    iso = "^((?:19|20)\\d{2})-(\\d{1,2})-(\\d{1,2})"
    mfirst = "(?i)^([a-z]{3,9})\\.?\\s+(\\d{1,2})(?:st|nd|rd|th)?\\s*,?\\s+((?:19|20)\\d{2})$"
    dfirst = "(?i)^(\\d{1,2})(?:st|nd|rd|th)?\\s+([a-z]{3,9})\\.?\\s*,?\\s+((?:19|20)\\d{2})$"
    num = "^(\\d{1,2})[/.-](\\d{1,2})[/.-]((?:19|20)\\d{2})$"
    ago = "(?i)^(\\d+)\\s+(minute|hour|day|week|month|year)s?\\s+ago$"
    month = lambda name: F.try_element_at(literal_map(MONTHS), F.lower(F.substring(name, 1, 3))).cast("string")
    a, b = g(num, 1).try_cast("int"), g(num, 2).try_cast("int")
    numeric = F.when((a > 12) & (b <= 12), _date(g(num, 3), g(num, 2), g(num, 1))).when((b > 12) & (a <= 12), _date(g(num, 3), g(num, 1), g(num, 2)))
    days = g(ago, 1).try_cast("int") * F.try_element_at(literal_map(UNIT_DAYS), F.lower(g(ago, 2)))
    return (F.when(t.rlike(iso), _date(g(iso, 1), g(iso, 2), g(iso, 3))).when(t.rlike(mfirst), _date(g(mfirst, 3), month(g(mfirst, 1)), g(mfirst, 2)))
            .when(t.rlike(dfirst), _date(g(dfirst, 3), month(g(dfirst, 2)), g(dfirst, 1))).when(t.rlike(num), numeric).when(t.rlike(ago), F.date_sub(now, days)))


def html_date(html: Column) -> Column:
    """First ISO date of the publication meta tags in their order, else of the first
    dated <time>, else of a JSON-LD block; attributes may stand in any order."""
    iso = lambda x: F.try_to_date(F.substring(F.trim(x), 1, 10), "yyyy-MM-dd")
    quoted = lambda tag, pattern: F.nullif(F.regexp_extract(tag, pattern, 1), F.lit(""))
    value = lambda tag, name: F.coalesce(quoted(tag, rf"(?i)\s{name}\s*=\s*\"([^\"]*)\""), quoted(tag, rf"(?i)\s{name}\s*=\s*'([^']*)'"))

    def from_meta(tags: Column) -> Column:
        first = lambda attr, name: F.get(F.filter(tags, lambda t: value(t, attr) == name), F.lit(0))
        return F.coalesce(*[iso(value(first(attr, name), "content")) for attr, name in DATE_META])

    meta = let(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), from_meta)
    time = iso(value(F.regexp_extract(html, r"(?is)<time\b[^>]*\sdatetime\s*=[^>]*>", 0), "datetime"))
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*\stype\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script"), F.lit(1))
    entries = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(b, "array<struct<" + ", ".join(f"{k}: string" for k in JSON_LD_DATES) + ">>"), F.array())))
    dated = F.flatten(F.transform(entries, lambda e: F.array(*[iso(e[k]) for k in JSON_LD_DATES])))
    return F.coalesce(meta, time, F.get(F.filter(dated, lambda d: d.isNotNull()), F.lit(0)))


class _Body(HTMLParser):
    """Text nodes of a page outside boilerplate, and of the first element of each content selector."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, list[int]]] = []
        self.hidden = 0
        self.page: list[str] = []
        self.found: dict[int, list[str]] = {}
        self.live: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in BOILERPLATE_TAGS:
            self.hidden += 1
        elif tag in VOID_TAGS:
            return
        classes = dict(attrs).get("class") or ""
        started = [] if self.hidden else [i for i, rule in enumerate(CONTENT_SELECTORS) if i not in self.found and _selects(rule, tag, classes)]
        for i in started:
            self.found[i] = []
        self.live += started
        self.open.append((tag, started))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, started = self.open.pop()
            self.hidden -= name in BOILERPLATE_TAGS
            self.live = [i for i in self.live if i not in started]
            if name == tag:
                break

    def handle_data(self, data):
        text = data.strip()
        if text and not self.hidden:
            self.page.append(text)
            for i in self.live:
                self.found[i].append(text)


def _selects(rule: str, tag: str, classes: str) -> bool:
    if rule.startswith("[class*="):
        return rule[9:-2] in classes
    return rule[1:] in classes.split() if rule.startswith(".") else rule == tag


@F.arrow_udf(T.StringType())
def page_text(html: pa.Array) -> pa.Array:
    """Visible text without boilerplate: that of the first selector whose first
    element has more than 300 characters, else of the whole page; null stays null.

    One page at a time becomes a Python string, never a whole batch."""
    def one(page: str | None) -> str | None:
        if page is None:
            return None
        body = _Body()
        body.feed(page)
        body.close()
        texts = (" ".join(body.found[i]) for i in sorted(body.found))
        return next((t for t in texts if len(t) > MIN_BODY_CHARS), " ".join(body.page))

    # a run of pages at a time, so that texts do not wait as Python strings either
    runs = [pa.array((one(x.as_py()) for x in html[i:i + 256]), pa.string()) for i in range(0, len(html), 256)]
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(runs) if runs else pa.array([], pa.string())


def is_redirector(url: Column) -> Column:
    h, p = host(url), url_path(url)
    return (h == "news.google.com") | (h.isin("google.com", "bing.com", "duckduckgo.com") & p.rlike("^/(?:url|goto|search|ck/|l/)"))


def is_evergreen(url: Column) -> Column:
    return host(url).rlike("(?:" + "|".join(d.replace(".", "\\.") for d in EVERGREEN) + ")$")


def is_stub(text: Column) -> Column:
    """A known paywall or redirect page, by its first 120 characters."""
    return F.lower(F.substring(text, 1, 120)).rlike("|".join(STUB_TITLES))


def is_liveblog(url: Column) -> Column:
    return F.coalesce(F.lower(url).contains("liveblog"), F.lit(False))


def bare_domain(name: str) -> str:
    """Host of a configured outlet address, without scheme, www and path."""
    return name.strip().lower().removeprefix("https://").removeprefix("http://").removeprefix("www.").split("/")[0]


def is_short_form(url: Column) -> Column:
    """Posts and tickers that are terse by design."""
    return host(url).isin(*SHORT_FORM_HOSTS)


def has_no_page(url: Column) -> Column:
    """Whether no article page stands behind the address."""
    return host(url).isin(*NO_ARTICLE_PAGE_HOSTS)


def is_candidate(url: Column, domain: Column, expected: Column) -> Column:
    near = F.abs(F.datediff(url_date(url), expected)) <= 30
    return F.contains(url, domain) & ~url.rlike("|".join(BAD_PATHS)) & F.coalesce(near, F.lit(True))


def slug_title(url: Column) -> Column:
    """Title words from the last path segment."""
    last = F.regexp_replace(F.element_at(F.split(F.rtrim(url_path(url), F.lit("/")), "/"), -1), "^\\d+-", "")
    ws = F.filter(F.split(F.translate(last, "-_", "  "), " +"), lambda w: w != "")
    small = F.array(*[F.lit(w) for w in SLUG_SMALL_WORDS])
    cap = lambda w: F.when(F.array_contains(small, F.lower(w)), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(ws, cap), " ")


def title_slug(title: Column) -> Column:
    t = F.regexp_replace(F.lower(title), "[^a-z0-9\\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(t), "\\s+", "-"), "-+", "-")


def query_terms(text: Column, cap: int = 8) -> Column:
    """Capitalised phrases, then uncommon capitalised words, at most ``cap``."""
    clean = F.regexp_replace(F.regexp_replace(text, "\\b(?:site|after|before|domain):\\S+", ""), "\\b(?:OR|AND|NOT)\\b", " ")
    phrases = F.regexp_extract_all(clean, F.lit("\\b([A-Z][a-z]{1,}(?:\\s+[A-Z][a-z]{1,})+)\\b"), F.lit(1))
    singles = F.array_except(F.regexp_extract_all(clean, F.lit("\\b([A-Z][a-z]{3,})\\b"), F.lit(1)), F.array(*[F.lit(w) for w in COMMON_NAMES]))
    return F.slice(F.array_distinct(F.concat(phrases, singles)), 1, cap)


def script_of(text: Column) -> Column:
    """he / ar / cyr when such letters lead and make a fifth; latin; or other."""
    count = lambda cls: F.regexp_count(text, F.lit(cls))
    total, ascii_ = count("\\p{L}"), count("[A-Za-z]")
    alt = F.array(F.struct(count("[\\p{L}&&[\\u0590-\\u05ff]]").alias("n"), F.lit(3).alias("o"), F.lit("he").alias("k")),
                  F.struct(count("[\\p{L}&&[\\u0600-\\u06ff]]").alias("n"), F.lit(2).alias("o"), F.lit("ar").alias("k")),
                  F.struct(count("[\\p{L}&&[\\u0400-\\u04ff]]").alias("n"), F.lit(1).alias("o"), F.lit("cyr").alias("k")))
    return let(F.struct(F.array_max(alt).alias("b"), total.alias("t"), ascii_.alias("a")), lambda x: F.when(x["t"] == 0, "other").when(
        (x["b"]["n"] > x["a"]) & (x["b"]["n"] / x["t"] >= 0.2), x["b"]["k"]).when(x["a"] / x["t"] >= 0.5, "latin").otherwise("other"))


def flat_text(text: Column) -> Column:
    """Quotes in one form, white space as single spaces."""
    plain = F.translate(F.translate(text, DOUBLE_QUOTES, "\"" * len(DOUBLE_QUOTES)), SINGLE_QUOTES, "'" * len(SINGLE_QUOTES))
    return F.trim(F.regexp_replace(plain, "\\s+", " "))


def _glued(flat: Column) -> Column:
    """The flattened text with a \x01 in place of the space between two sentences.

    Whether two pieces join shows at their common edge, so one pass over
    neighbours is enough. A line break is white space like any other. Patterns
    see the last characters of a piece only, not all of it."""
    def joins(prev: Column, nxt: Column) -> Column:
        return let(F.substring(prev, -ABBR_CHARS, ABBR_CHARS), lambda end: F.when(end.rlike(ABBR_ANY), edge(end, nxt)).otherwise(False))

    def edge(prev: Column, nxt: Column) -> Column:
        return F.when(prev.rlike(ABBR_MONTH), nxt.rlike("^\\d")).when(prev.rlike(ABBR_TITLE) | prev.rlike(ABBR_INITIAL), nxt.rlike("^\\p{Lu}")).otherwise(
            prev.rlike(ABBR_INLINE) & nxt.rlike("^[\\p{Ll}\\d]"))

    def glue(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda s, i: F.concat(F.when(i == 0, "").when(joins(F.get(pieces, i - 1), s), " ").otherwise("\x01"), s)), "")

    return let(F.split(flat, SENTENCE_END), glue)


def _long(sentence: Column, min_chars: int) -> Column:
    return F.length(F.trim(sentence)) >= min_chars


def sentences(text: Column, min_chars: int = 16) -> Column:
    """Sentences of the flattened text, in order, cut after closing marks and joined
    again where an abbreviation ends a piece; those under ``min_chars`` are left out."""
    return F.filter(F.split(_glued(flat_text(text)), "\x01"), lambda s: _long(s, min_chars))


def quote_sentences(text: Column, quote: Column, min_chars: int = 16) -> Column:
    """Numbers (from 0) of the sentences a quote touches; null if it is not in the text.

    Any script and length; of a quote over 80 characters the middle may be
    missing when both its ends of 40 characters stand in order."""
    def locate(x: Column) -> Column:
        t, q = x["t"], x["q"]
        whole, head = F.instr(t, q), F.instr(t, F.substring(q, 1, 40))
        tail = F.instr(F.substr(t, head + 40), F.substr(q, F.length(q) - 39))
        elided = (F.length(q) > 80) & (head > 0) & (tail > 0)
        span = F.when(q == "", None).when(whole > 0, F.struct(whole.alias("a"), (whole + F.length(q) - 1).alias("b"))).when(
            elided, F.struct(head.alias("a"), (head + 39 + tail + 39).alias("b")))
        return let(F.struct(span.alias("at"), _glued(t).alias("g")), touched)

    def touched(x: Column) -> Column:
        number = lambda at: F.size(F.split(F.substr(x["g"], F.lit(1), at), "\x01")) - 1
        kept = F.filter(F.transform(F.split(x["g"], "\x01"), lambda s, i: F.when(_long(s, min_chars), i)), lambda i: i.isNotNull())
        ends = F.struct(number(x["at"]["a"]).alias("a"), number(x["at"]["b"]).alias("b"), kept.alias("k"))
        hits = let(ends, lambda e: F.filter(F.transform(e["k"], lambda o, j: F.when(o.between(e["a"], e["b"]), j)), lambda j: j.isNotNull()))
        return F.when(x["at"].isNotNull(), hits)

    trimmed = F.trim(flat_text(quote), F.lit(QUOTE_TRIM))
    return let(F.struct(flat_text(text).alias("t"), trimmed.alias("q")), locate)


def cap_words(text: Column, n: int) -> Column:
    """Cut before ``n`` characters at the last space; empty becomes null."""
    t = F.nullif(F.trim(text), F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""))
