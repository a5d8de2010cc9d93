"""Text features: entropy, keywords, referrers, JSON fields."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Referrer domains by kind.
SOCIAL = [
    "facebook.com",
    "twitter.com",
    "instagram.com",
    "linkedin.com",
    "tiktok.com",
    "youtube.com",
    "pinterest.com",
]
SEARCH = ["google.com", "bing.com", "yahoo.com", "duckduckgo.com"]
AD_NETWORKS = ["taboola.com", "outbrain.com", "googleadservices.com"]
# Brand names and purchase-intent words looked for in keywords.
BRANDS = ["samsung", "apple", "microsoft", "google", "amazon"]
COMMERCIAL = ["buy", "price", "deal", "discount", "sale", "cheap", "best"]


@F.pandas_udf(T.DoubleType())
def entropy(text: pd.Series) -> pd.Series:
    """Shannon entropy in bits of the characters of the whole text; null or empty → 0.

    Built-in functions need one scan of the text per distinct character and measured 20 times
    slower; here the characters of many distinct texts of an Arrow batch are counted at once.
    """
    places, texts = pd.factorize(text)
    # a null text has place -1, the last slot
    return pd.Series(np.append(_bits([t or "" for t in texts]), 0.0)[places])


def _bits(texts: list[str], limit: int = 1 << 20) -> np.ndarray:
    """Entropy of each text; about `limit` characters at a time."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.zeros(len(texts))
    start = 0
    while start < len(texts):
        room = np.searchsorted(np.cumsum(sizes[start:]), limit, "right")
        stop = start + max(1, int(room))
        codes = np.frombuffer("".join(texts[start:stop]).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(stop - start), sizes[start:stop])
        pairs, counts = np.unique(owner << 21 | codes, return_counts=True)
        total = np.maximum(sizes[start:stop], 1)
        known = np.bincount(pairs >> 21, weights=counts * np.log2(counts), minlength=stop - start)
        out[start:stop] = np.maximum(np.log2(total) - known / total, 0.0)
        start = stop
    return out


def words(text: Column) -> Column:
    """Number of whitespace-separated words; null or blank → 0."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"\s+"))).otherwise(F.lit(0))


def contains_any(text: Column, tokens: list[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(tokens)), F.lit(False)).cast("int")


def domain(url: Column) -> Column:
    """Network location of a URL in lower case without 'www.'; null or empty → unknown."""
    place = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.when(url.isNull() | (url == ""), "unknown").otherwise(F.regexp_replace(place, r"^www\.", ""))


def add_context(df: DataFrame) -> DataFrame:
    """Referrer, keyword and device-browser features."""
    keyword = F.col("keyword")
    df = df.withColumn("referrer_domain", domain(F.col("referrer")))
    place = F.col("referrer_domain")
    return df.withColumns(
        {
            "referrer_is_social": place.isin(SOCIAL).cast("int"),
            "referrer_is_search": place.isin(SEARCH).cast("int"),
            "referrer_is_ad_network": place.isin(AD_NETWORKS).cast("int"),
            "keyword_length": F.coalesce(F.length(keyword), F.lit(0)),
            "keyword_word_count": words(keyword),
            "keyword_has_brand": contains_any(keyword, BRANDS),
            "keyword_commercial_intent": contains_any(keyword, COMMERCIAL),
            "device_browser_combo": F.concat_ws(
                "_", F.coalesce(F.col("device"), F.lit("nan")), F.coalesce(F.col("browser"), F.lit("nan"))
            ),
        }
    )


_NAMED = T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())])
PLATFORM = T.StructType(
    [
        T.StructField("cpu", T.StructType([T.StructField("architecture", T.StringType())])),
        T.StructField("engine", _NAMED),
        T.StructField("os", _NAMED),
    ]
)
LOCATION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ["cityName", "countryCode", "timezone", "timezoneOffset"]]
)


def add_platform(df: DataFrame) -> DataFrame:
    """Processor, engine and operating system from the platform JSON; bad JSON → null."""
    parsed = F.from_json(F.col("platform"), PLATFORM)
    return (
        df.withColumn("_platform", parsed)
        .withColumns(
            {
                "cpu_architecture": F.col("_platform.cpu.architecture"),
                "engine_name": F.col("_platform.engine.name"),
                "engine_version": F.col("_platform.engine.version"),
                "os_name": F.col("_platform.os.name"),
                "os_version": F.col("_platform.os.version"),
            }
        )
        .drop("_platform")
    )


def add_location(df: DataFrame) -> DataFrame:
    """City, country code, time zone and offset from the location JSON; bad JSON → null."""
    parsed = F.from_json(F.col("location"), LOCATION)
    return (
        df.withColumn("_location", parsed)
        .withColumns(
            {
                "city_name": F.col("_location.cityName"),
                "country_code": F.col("_location.countryCode"),
                "timezone": F.col("_location.timezone"),
                "timezone_offset": F.col("_location.timezoneOffset").try_cast("smallint"),
            }
        )
        .drop("_location")
    )
