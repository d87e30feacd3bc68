"""URL functions as native column expressions.

A URL is split by one pattern, `scheme://authority/path?query#fragment`; strings of another form have empty parts.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Query parameters that only track visits.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_cid", "mc_eid", "ref",
    "affiliate", "partner", "source", "medium", "campaign", "content",
)
# Beginnings of session parameters.
SESSION = ("session", "sess", "sid", "jsessionid", "phpsessid", "aspsessionid", "cfid", "cftoken")
# File endings of resources.
RESOURCES = (
    "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "woff", "woff2", "ttf", "eot", "pdf", "doc", "docx", "xls", "xlsx", "zip", "tar", "gz", "rar",
    "mp3", "mp4", "wav", "avi", "mov",
)
# Where sites keep their terms of service.
TERMS_PATHS = ("/terms", "/terms-of-service", "/tos", "/legal/terms", "/terms-and-conditions", "/terms-of-use")

# One-segment addresses that are no sections of a news site.
NO_SECTIONS = (
    "video", "videos", "live", "watch", "listen", "account", "login", "signup", "subscribe", "search", "about", "contact", "privacy", "terms", "jobs", "careers",
    "press", "newsletters", "weather",
)

Rules = list[tuple[str, str]]  # (label, pattern), the first that matches decides

# Page types by parts of the address.
PAGE_TYPES: Rules = [
    ("article", "/article|/post|/blog|/news"), ("product", "/product|/item|/shop"), ("listing", "/category|/tag|/archive"),
    ("homepage", r"[.](com|org|net|io)/*$"),
]
SITEMAP_TYPES: Rules = [
    ("article", "/article|/post|/blog|/news"), ("listing", "/category|/tag|/archive"), ("product", "/product|/item|/shop"),
    ("homepage", r"/$|^[^/]*(/[^/]*){0,3}$"),
]
NEWS_TYPES: Rules = [
    ("politics", "/politics|/political"), ("business", "/business|/economy|/finance|/markets"), ("technology", "/tech|/technology|/science"),
    ("world", "/world|/international|/global"), ("entertainment", "/entertainment|/celebrity|/culture"), ("health", "/health|/medical"),
    ("opinion", "/opinion|/editorial|/commentary"), ("breaking", "/breaking|/latest|/trending"), ("article", "/article/|/story/|/news/|/post/"),
    ("category", "/category/|/section/|/topic/"), ("archive", "/archive|/search"),
]
SPORTS_TYPES: Rules = [
    ("article", "(/nfl/|/football/|/nba/|/basketball/).*(/story/|/news/)|(/story/|/news/).*(/nfl/|/football/|/nba/|/basketball/)|/(nfl|football|nba|basketball)/(story|news)/|/(story|news)/(nfl|football|nba|basketball)/"),
    ("category", "/nfl/|/football/|/nba/|/basketball/"), ("scores", "/scores|/scoreboard"), ("standings", "/standings"), ("schedule", "/schedule"),
    ("player", "/player/|/players/"), ("team", "/team/|/teams/"), ("article", "/story/|/news/|/article/"),
]

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, group), F.lit(""))


def domain(url: Column) -> Column:
    """Lower-case authority, with port and user if any."""
    return F.lower(part(url, 2))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def path(url: Column) -> Column:
    """The path without the parameters of its last segment; '/' if empty."""
    p = F.regexp_replace(part(url, 3), ";[^/]*$", "")
    return F.when(p == "", "/").otherwise(p)


def base_domain(url: Column) -> Column:
    """The last two labels of the domain."""
    return F.substring_index(domain(url), ".", -2)


def same_domain(a: Column, b: Column, subdomains: bool = False) -> Column:
    return (base_domain(a) == base_domain(b)) if subdomains else (domain(a) == domain(b))


def is_valid(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (part(url, 2) != "")


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _private4(text: Column) -> Column:
    """Whether a text is a private, loopback, link-local or reserved IPv4 address; null if it is none."""

    def reserved(octets: Column) -> Column:
        a, b, c = octets[0], octets[1], octets[2]
        return F.when(~F.exists(octets, lambda o: o > 255), (
            a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
            | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
        ))

    numbers = lambda t: F.when(t.rlike(r"^\d{1,3}([.]\d{1,3}){3}$"), F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)"), 1), lambda o: o.cast("int")))
    return _let(text, lambda t: _let(numbers(t), reserved))


def _dotted(text: Column) -> Column:
    """An IPv4 address at the end of a text as two groups of hexadecimal digits; null if it has a number over 255."""

    def groups(octets: Column) -> Column:
        pair = lambda i: F.lower(F.lpad(F.hex(octets[i] * 256 + octets[i + 1]), 4, "0"))
        return F.when(~F.exists(octets, lambda o: o > 255), F.concat(pair(0), F.lit(":"), pair(2)))

    four = F.regexp_extract(text, r":(\d{1,3}[.]\d{1,3}[.]\d{1,3}[.]\d{1,3})$", 1)
    done = _let(F.transform(F.split(four, "[.]"), lambda o: o.try_cast("int")), groups)
    return F.when(text.rlike(r":\d{1,3}([.]\d{1,3}){3}$"), F.concat(F.regexp_replace(text, "[0-9.]+$", ""), done)).otherwise(text)


def _digits(text: Column) -> Column:
    groups = lambda t: F.filter(F.split(t, ":"), lambda g: g != "")

    def filled(sides: Column) -> Column:
        missing = 8 - F.size(sides["left"]) - F.size(sides["right"])
        return F.when(missing >= 1, F.concat(sides["left"], F.array_repeat(F.lit("0"), missing), sides["right"]))

    sides = F.struct(groups(F.substring_index(text, "::", 1)).alias("left"), groups(F.substring_index(text, "::", -1)).alias("right"))
    whole = text.rlike("^[0-9a-f]{1,4}(:[0-9a-f]{1,4}){7}$")
    short = text.rlike("^([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?::([0-9a-f]{1,4}(:[0-9a-f]{1,4})*)?$")
    all_ = F.when(whole, F.split(text, ":")).when(short, _let(sides, filled))
    return F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), "")


def ipv6(host: Column) -> Column:
    """The 32 hexadecimal digits of a bracketed IPv6 address, with or without port, zone and `::`, or an IPv4 address at its
    end; null for anything else."""
    text = F.regexp_replace(F.regexp_extract(F.lower(host), r"(?:^|@)\[([^\]]*)\](?::\d*)?$", 1), "%.*$", "")
    return F.when(F.contains(host, F.lit("[")), _let(text, lambda t: _let(_dotted(t), _digits)))


def _private6(digits: Column) -> Column:
    """Whether an address is private or reserved: all but global unicast (2000::/3), multicast and site-local ones, and of global
    unicast what is set aside for protocols, documentation and 6to4. A mapped IPv4 address counts as that."""
    at = lambda p: digits.startswith(p)
    # Ranges inside 2001::/23 that are global after all.
    open_ = digits.isin("20010001" + "0" * 23 + "1", "20010001" + "0" * 23 + "2") | at("20010003") | at("200100040112") | at("2001002") | at("2001003")
    set_aside = ((at("20010") & F.substring(digits, 6, 1).isin("0", "1")) & ~open_) | at("20010db8") | at("2002") | at("3fff0")
    octet = lambda i: F.conv(F.substring(digits, i, 2), 16, 10)
    mapped = F.concat_ws(".", *[octet(i) for i in (25, 27, 29, 31)])
    elsewhere = ~F.substring(digits, 1, 1).isin("2", "3") & ~at("ff") & ~F.substring(digits, 1, 3).between("fec", "fef")
    return F.when(at("0" * 20 + "ffff"), _private4(mapped)).otherwise(set_aside | elsewhere)


def is_private(url: Column) -> Column:
    """A private, loopback, link-local or reserved IPv4 or bracketed IPv6 address, or a local name; of other hosts the port is
    cut at the first colon."""

    def private(name: Column) -> Column:
        host = F.substring_index(name, ":", 1)
        return (host == "localhost") | F.coalesce(_private4(host), _let(ipv6(name), _private6), F.lit(False))

    return _let(domain(url), private)


def depth(url: Column) -> Column:
    """Segments of the path that aren't empty."""
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def pattern(url: Column) -> Column:
    """The path with numbers, UUIDs and hyphenated words replaced by placeholders; digits come first, also for years."""
    def place(s: Column) -> Column:
        return (
            F.when(s.rlike("^[0-9]+$"), "{id}")
            .when(F.lower(s).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "{uuid}")
            .when(s.rlike(r"(?U)^[\w-]+$") & s.contains("-"), "{slug}").otherwise(s)
        )
    return F.array_join(F.transform(F.split(path(url), "/"), place), "/")


def normalize(url: Column, *, strip_tracking: bool = True, strip_session: bool = True, sort_params: bool = True, lowercase_domain: bool = True,
              remove_trailing_slash: bool = False, remove_default_port: bool = True, remove_fragment: bool = True) -> Column:
    """Canonical form for deduplication. Parameters are decoded, filtered by their decoded names and encoded again, as forms
    are; values of one parameter stay together in their order."""
    host = F.lower(part(url, 2)) if lowercase_domain else part(url, 2)
    if remove_default_port:
        host = F.when(scheme(url) == "http", F.regexp_replace(host, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    p = F.regexp_replace(path(url), "/+", "/")
    if remove_trailing_slash:
        p = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    given = F.filter(F.split(part(url, 4), "&"), lambda x: x != "")
    params = F.transform(given, lambda x: F.struct(unescape(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"), unescape(F.regexp_extract(x, "^[^=]*=?(.*)$", 1)).alias("v")))
    if strip_tracking:
        params = F.filter(params, lambda x: ~F.lower(x["k"]).isin(*TRACKING))
    if strip_session:
        params = F.filter(params, lambda x: ~F.lower(x["k"]).rlike(f"^({'|'.join(SESSION)})"))
    keyed = F.transform(params, lambda x, i: F.struct(x["k"].alias("k"), i.alias("i"), F.concat(escape(x["k"]), F.lit("="), escape(x["v"])).alias("x")))
    if sort_params:
        keyed = F.array_sort(keyed)
    else:
        first = F.transform(keyed, lambda e: F.struct(F.array_position(F.transform(keyed, lambda o: o["k"]), e["k"]).alias("f"), e["i"].alias("i"), e["x"].alias("x")))
        keyed = F.array_sort(first)
    query = F.array_join(F.transform(keyed, lambda e: e["x"]), "&")
    out = F.concat(scheme(url), F.lit("://"), host, p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return out if remove_fragment else F.concat(out, F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))


def unescape(text: Column) -> Column:
    """A form value decoded: + is a blank, %xx a byte of UTF-8; a % that no two digits follow stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def escape(text: Column) -> Column:
    """A text as a form value: letters, digits and _.-~ stay, a blank is +, other bytes of UTF-8 are %xx."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def matches(url: Column, patterns: list[str]) -> Column:
    """Whether the path matches one of the patterns: * within a segment, ** across segments, {name} for a segment."""
    out = F.lit(False)
    for p in patterns:
        r = re.sub(r"\{[^}]+\}", "[^/]+", p.replace("**", "\0").replace("*", "[^/]+").replace("\0", ".*"))
        try:
            re.compile(r)
        except re.error:
            continue
        out = out | path(url).rlike(f"^{r}$")
    return out


def is_resource(url: Column) -> Column:
    return F.lower(path(url)).rlike(rf"[.]({'|'.join(RESOURCES)})$")


def classify(url: Column, rules: Rules, default: str) -> Column:
    """The label of the first rule whose pattern occurs in the lower-case address."""
    out = F.lit(default)
    for label, p in reversed(rules):
        out = F.when(F.lower(url).rlike(p), label).otherwise(out)
    return out


def file_name(url: Column) -> Column:
    """The last path segment with _ for all but letters and digits, cut to 50 characters, and 12 digits of the address's hash."""
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    last = F.when(last == "", "index").otherwise(last)
    return F.concat(F.substring(F.regexp_replace(last, r"[^\p{L}\p{N}]", "_"), 1, 50), F.lit("_"), F.substring(F.md5(url), 1, 12))


def terms_urls(url: Column) -> Column:
    """Candidate addresses of a site's terms of service."""
    return F.transform(F.array(*[F.lit(p) for p in TERMS_PATHS]), lambda p: F.concat(scheme(url), F.lit("://"), part(url, 2), p))


def resolve(base: Column, relative: Column) -> Column:
    """The absolute address of a link on a page by the standard rules, Arrow-batched; null where either is null or no address."""

    def join(bases: pd.Series, links: pd.Series) -> pd.Series:
        out = []
        for b, r in zip(bases, links, strict=True):
            try:
                out.append(None if b is None or r is None else urljoin(b, r))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(join, "string")(base, relative)


def same_category(rows: DataFrame, column: str, names: dict[str, str], to: str = "category") -> DataFrame:
    """`rows` whose `column` is a key of the dictionary `names`, with its general name as `to`; others are left out. Keys are
    case-sensitive. The dictionary is a literal map in the plan: no join, and no more rows than it has keys."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return rows.withColumn(to, F.element_at(table, F.col(column))).where(F.col(to).isNotNull())


def is_news_category(url: Column) -> Column:
    """An address of a site's section: one segment of at most twenty letters that isn't a service page."""
    p = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    return p.rlike("^[A-Za-z]{1,20}$") & ~p.isin(*NO_SECTIONS)


def is_article(url: Column) -> Column:
    """An address like an article's: a date, five digits or two hyphens, in two segments or more, and no page of a list."""
    p = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    marked = p.rlike(r"[0-9]{4}/[0-9]{2}/[0-9]{2}") | p.rlike("[0-9]{5,}") | (hyphens(url) >= 2)
    return marked & p.contains("/") & ~part(url, 3).rlike("/page/[0-9]+/?$")


def hyphens(url: Column) -> Column:
    p = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    return F.length(p) - F.length(F.replace(p, F.lit("-"), F.lit("")))
