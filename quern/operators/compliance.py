"""Robots rules, authorization, terms of service, rendering needs and the fetch gate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions import url as U

RULE = "array<struct<group_no:int,agents:array<string>,crawl_delay:double,request_rate:string,line_no:int,pattern:string,allow:boolean>>"


def parse_robots(text: str | None, status: int = 200) -> tuple[list[dict], list[str]]:
    """Rules in file order, and sitemaps. 404 allows all; 401, 403 and 500 or more disallow all; other codes use the body."""
    if status == 404:
        return [], []
    if status in (401, 403) or status >= 500:
        return [{"group_no": 0, "agents": ["*"], "crawl_delay": None, "request_rate": None, "line_no": 0, "pattern": "/", "allow": False}], []
    groups: list[dict] = []
    sitemaps: list[str] = []
    for number, line in enumerate((text or "").splitlines(), 1):
        name, colon, value = line.split("#", 1)[0].strip().partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            sitemaps.append(value)
        elif name == "user-agent":
            if not groups or groups[-1]["rules"]:
                groups.append({"agents": [], "rules": [], "delay": None, "rate": None})
            groups[-1]["agents"].append(value.lower())
        elif groups and name in ("allow", "disallow"):
            if value:
                groups[-1]["rules"].append((number, value, name == "allow"))
        elif groups and name == "crawl-delay":
            try:
                groups[-1]["delay"] = float(value)
            except ValueError:
                pass
        elif groups and name == "request-rate":
            groups[-1]["rate"] = value
    rows = []
    for g, group in enumerate(groups):
        for number, pattern, allow in group["rules"] or [(0, None, None)]:
            rows.append({"group_no": g, "agents": group["agents"], "crawl_delay": group["delay"], "request_rate": group["rate"], "line_no": number, "pattern": pattern, "allow": allow})
    return rows, sitemaps


def robots(files: DataFrame) -> DataFrame:
    """`files` (domain, content, status) parsed: domain, rules, sitemaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parsed = [parse_robots(c, int(s)) for c, s in zip(b["content"], b["status"], strict=True)]
            yield pd.DataFrame({"domain": b["domain"], "rules": [p[0] for p in parsed], "sitemaps": [p[1] for p in parsed]})

    return files.select("domain", "content", "status").mapInPandas(run, f"domain string, rules {RULE}, sitemaps array<string>")


def agent_rules(parsed: DataFrame, agent: str) -> DataFrame:
    """The rules of the group for `agent`: the first whose name equals or begins it, else the last `*` group; with its delay."""
    a = agent.lower()
    rule = parsed.select("domain", F.explode("rules").alias("r")).select("domain", "r.*")
    own = F.exists("agents", lambda x: (x != "*") & F.lit(a).startswith(x))
    star = F.array_contains("agents", "*")
    pick = rule.groupBy("domain").agg(F.min(F.when(own, F.col("group_no"))).alias("own"), F.max(F.when(star, F.col("group_no"))).alias("star"))
    pick = pick.select("domain", F.coalesce("own", "star").alias("group_no"))
    return rule.join(pick, ["domain", "group_no"]).select("domain", "line_no", "pattern", "allow", "crawl_delay")


def rule_regex(pattern: Column) -> Column:
    """A robots pattern as a regular expression: * is any run, a last $ ends the path, else a prefix."""
    ended = pattern.endswith("$")
    body = F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(body, r"\*", ".*"), F.when(ended, "$").otherwise(""))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (key, domain, path) with `allowed`: the longest matching rule decides, ties by line; none allows.

    The rules of a domain are one array in the order in which they decide, and each url takes the first that matches: one
    join, unique per domain, and no row per rule.
    """
    named = rules.where("pattern is not null").select("domain", F.struct((-F.length("pattern")).alias("n"), "line_no", rule_regex(F.col("pattern")).alias("regex"), "allow").alias("r"))
    ordered = named.groupBy("domain").agg(F.array_sort(F.collect_list("r")).alias("rules"))  # bounded by a robots file
    hit = F.filter("rules", lambda r: F.regexp_like(F.col("path"), r["regex"]))
    verdict = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["allow"])
    return urls.join(ordered, "domain", "left").withColumn("allowed", F.coalesce(verdict, F.lit(True))).drop("rules")


# Prohibitions and concerns in terms of service.
PROHIBITIONS = [
    ("prohibit.*scraping", "scraping_prohibited"), ("prohibit.*crawling", "crawling_prohibited"), ("prohibit.*automated.*access", "automated_access_prohibited"),
    ("no.*robots", "robots_prohibited"), ("no.*spiders", "spiders_prohibited"), ("must.*not.*scrape", "scraping_prohibited"), ("shall.*not.*harvest", "harvesting_prohibited"),
]
CONCERNS = [("api.*only|only.*api|must.*use.*api", "api_required"), ("rate.*limit|request.*limit", "rate_limits_mentioned")]


def terms(text: Column) -> tuple[Column, Column, Column]:
    """(restrictions, concerns, recommendation) of terms of service; a pattern stays within a line."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda rules: F.filter(F.array(*[F.when(low.rlike(p), name) for p, name in rules]), lambda x: x.isNotNull())
    return found(PROHIBITIONS), found(CONCERNS), F.when(F.size(found(PROHIBITIONS)) > 0, "block").otherwise("proceed_with_caution")


def blocked_domain(urls: DataFrame, blocklist: DataFrame) -> DataFrame:
    """`urls` (key, domain) with `blocked`: the domain or one of its parents of two labels or more is listed."""
    labels = F.split(F.col("domain"), "[.]")
    n = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    hit = urls.select("key", F.explode(suffix).alias("s")).join(blocklist.select(F.lower(F.trim("domain")).alias("s")), "s", "left_semi").select("key").distinct()
    return urls.join(hit.withColumn("blocked", F.lit(True)), "key", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def record_notices(blocklist: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocklist with the sites of cease-and-desist `notices` (domain, received, reference), and a record of the latest
    notice of each site: domain, authorized, basis, received, notes."""
    given = notices.withColumn("domain", F.lower("domain"))
    last = given.groupBy("domain").agg(F.max_by(F.struct("received", "reference"), "received").alias("n"))
    notes = F.when(F.col("n.reference") != "", F.concat(F.lit("Reference: "), F.col("n.reference"))).otherwise("")
    records = last.select("domain", F.lit(False).alias("authorized"), F.lit("cease_desist").alias("basis"), F.col("n.received").alias("received"), notes.alias("notes"))
    return blocklist.select(F.lower(F.trim("domain")).alias("domain")).union(records.select("domain")).distinct(), records


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """A list of domains from text files: one a line, in any case; blank lines and those that start with # don't count."""
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("domain")).where((F.col("domain") != "") & ~F.col("domain").startswith("#"))


def authorization(blocked: Column, listed: Column, auth: Column, robots_ok: Column, notice: Column, restrictive: Column) -> Column:
    """The basis of the decision, in fixed order; authorized are explicit_permission and public_access."""
    return (
        F.when(blocked, "blocklist").when(listed, "explicit_permission").when(auth, "authentication_required").when(~robots_ok, "robots_txt")
        .when(notice, "cease_desist").when(restrictive, "terms_of_service").otherwise("public_access")
    )


def gate(private: Column, basis: Column, robots_ok: Column) -> Column:
    """The status of a fetch before it is made: authorization sees robots first, so `blocked_robots` is left to allowed domains."""
    return F.when(private | ~basis.isin("explicit_permission", "public_access"), "blocked_legal").when(~robots_ok, "blocked_robots").otherwise("success")


# Signs of pages that scripts build.
FRAMEWORKS = [
    'id="root"', 'id="app"', "data-reactroot", "__NEXT_DATA__", 'id="__nuxt"', "data-v-", "ng-app", "ng-view", "_nghost", "svelte-",
    "window.__INITIAL_STATE__", "window.__PRELOADED_STATE__", "application/json",
]
# Bodies that are empty until scripts run.
MINIMAL = ["<body></body>", "<body>\n</body>", '<div id="root"></div>', '<div id="app"></div>']
# What pages tell readers without scripts.
NOSCRIPT = "enable javascript|javascript required|javascript is required"


def visible_text(html: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", ""), "(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " "))


def needs_scripts(html: Column) -> Column:
    """Why a page needs rendering, or null."""
    low = F.lower(html)
    out = F.lit(None).cast("string")
    noscript = F.array_join(F.regexp_extract_all(html, F.lit("(?is)<noscript[^>]*>(.*?)</noscript>"), 1), " ")
    out = F.when(F.lower(noscript).rlike(NOSCRIPT), "noscript").otherwise(out)
    out = F.when((F.regexp_count(low, F.lit("<script")) >= 5) & (F.length(visible_text(html)) < 500), "script_heavy").otherwise(out)
    for label, signs in (("minimal", MINIMAL), ("framework", FRAMEWORKS)):
        out = F.when(low.rlike("|".join(re.escape(s.lower()) for s in signs)), label).otherwise(out)
    return out


def route(url: Column, status: Column, html: Column, never: str, always: str) -> Column:
    """Where a hybrid fetcher gets a page from: plain or rendered."""
    return F.when(url.rlike(never), "http").when(url.rlike(always), "render").when(status != 200, "http").when(needs_scripts(html).isNotNull(), "render").otherwise("http")


def latest_valid(rows: DataFrame, key: str, at: str, now: Column, seconds: int) -> DataFrame:
    """The latest row of each key that is not older than `seconds`: a cache with expiry."""
    first = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("_n", F.row_number().over(first)).where((F.col("_n") == 1) & (F.col(at) + F.expr(f"interval {seconds} seconds") > now)).drop("_n")
