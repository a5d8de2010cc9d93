"""User-agent features and an ordered rule table for browser, system and device families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import contains_any, entropy, words

# Automation tokens looked for in user agents.
BOT_TOKENS = [
    "bot", "crawler", "spider", "scraper", "curl", "wget", "python", "java", "scrapy", "requests",
]

# Browser rules in order of priority: (family, pattern whose first group is the version).
BROWSERS = [
    ("Googlebot", r"Googlebot/([0-9.]+)"),
    ("bingbot", r"bingbot/([0-9.]+)"),
    ("Python Requests", r"python-requests/([0-9.]+)"),
    ("curl", r"curl/?([0-9.]*)"),
    ("Edge", r"Edg(?:e|A|iOS)?/([0-9.]+)"),
    ("Opera", r"OPR/([0-9.]+)"),
    ("Samsung Internet", r"SamsungBrowser/([0-9.]+)"),
    ("Firefox", r"(?:Firefox|FxiOS)/([0-9.]+)"),
    ("Chrome Mobile iOS", r"CriOS/([0-9.]+)"),
    ("Chrome Mobile", r"Android.*Chrome/([0-9.]+)"),
    ("Chrome", r"Chrome/([0-9.]+)"),
    ("Mobile Safari", r"(?:iPhone|iPad|iPod).*Version/([0-9.]+).*Safari"),
    ("Safari", r"Version/([0-9.]+).*Safari"),
    ("IE", r"(?:MSIE |Trident/.*rv:)([0-9.]+)"),
]
# System rules in order of priority.
SYSTEMS = [
    ("Windows", r"Windows NT ([0-9.]+)"),
    ("iOS", r"(?:iPhone|iPad|iPod).* OS ([0-9_]+)"),
    ("Mac OS X", r"Mac OS X ([0-9_.]+)"),
    ("Android", r"Android ([0-9.]+)"),
    ("Chrome OS", r"CrOS \S+ ([0-9.]+)"),
    ("Linux", r"(?i)linux()"),
]
# Device rules in order of priority: (family, brand, pattern).
DEVICES = [
    ("Spider", "Spider", r"(?i)bot|crawler|spider"),
    ("iPad", "Apple", r"iPad"),
    ("iPhone", "Apple", r"iPhone"),
    ("Mac", "Apple", r"Macintosh"),
    ("Samsung", "Samsung", r"SM-|SAMSUNG"),
    ("Generic Smartphone", "Generic", r"Android.*Mobile"),
    ("Generic Tablet", "Generic", r"Android"),
]


def version_match(browser: Column, major: Column) -> Column:
    """0 when a chrome version lies outside 70–130, else 1."""
    return F.when((browser == "chrome") & ((major < 70) | (major > 130)), 0).otherwise(1)


def _first(rules: list[tuple], agent: Column, value) -> Column:
    """Value of the first rule whose pattern (last item) occurs in the agent."""
    chain = None
    for rule in rules:
        hit = agent.rlike(rule[-1])
        chain = F.when(hit, value(rule)) if chain is None else chain.when(hit, value(rule))
    return chain


def parse(agent: Column) -> dict[str, Column]:
    """Browser, system and device of a user agent: a documented subset of a full parser.

    Families outside the rule tables read 'Other'; null or empty agents give null and false.
    """
    known = agent.isNotNull() & (agent != "")
    extract = lambda rule: F.nullif(F.regexp_extract(agent, rule[-1], 1), F.lit(""))
    family = lambda rules: F.when(
        known, F.coalesce(_first(rules, agent, lambda r: F.lit(r[0])), F.lit("Other"))
    )
    dotted = lambda c: F.rtrim(F.replace(c, F.lit("_"), F.lit(".")))
    bot = known & agent.rlike(r"(?i)bot|crawler|spider")
    tablet = known & agent.rlike(r"iPad|Android(?!.*Mobile)|Tablet")
    phone = known & agent.rlike(r"iPhone|iPod|Android.*Mobile|Windows Phone")
    desktop = known & agent.rlike(r"Windows NT|Macintosh|X11|CrOS") & ~tablet & ~phone
    false_if_null = lambda c: F.coalesce(c, F.lit(False))
    return {
        "ua_browser_family": family(BROWSERS),
        "ua_browser_version": F.when(known, _first(BROWSERS, agent, extract)),
        "ua_os_family": family(SYSTEMS),
        "ua_os_version": F.when(known, dotted(_first(SYSTEMS, agent, extract))),
        "ua_device_family": family(DEVICES),
        "ua_device_brand": F.when(known, _first(DEVICES, agent, lambda r: F.lit(r[1]))),
        "ua_is_mobile": false_if_null(phone),
        "ua_is_tablet": false_if_null(tablet),
        "ua_is_pc": false_if_null(desktop),
        "ua_is_bot": false_if_null(bot),
    }


def add_agent(df: DataFrame) -> DataFrame:
    """Length, words, version consistency, automation tokens, entropy and suspicion."""
    agent = F.col("userAgent")
    length = F.coalesce(F.length(agent), F.lit(0))
    count = words(agent)
    return df.withColumns(
        {
            "ua_length": length,
            "ua_word_count": count,
            "browser_version_match": version_match(F.col("browser"), F.col("browserMajorVersion")),
            "ua_bot_indicators": contains_any(agent, BOT_TOKENS),
            "ua_entropy": entropy(agent),
            "ua_has_version": F.coalesce(agent.rlike(r"[0-9]+\.[0-9]+"), F.lit(False)).cast("int"),
            "ua_suspicious": ((length < 10) | (length > 500) | (count < 2)).cast("int"),
        }
    )


def add_parsed_agent(df: DataFrame) -> DataFrame:
    return df.withColumns(parse(F.col("userAgent")))
