"""Per-row fraud indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import as_int, total

# Weight of each fraud flag.
FRAUD_WEIGHTS = {
    "isLikelyBot": 3.0,
    "isIpTOR": 2.5,
    "isIpDatacenter": 2.0,
    "isIpVPN": 1.5,
    "isIpAnonymous": 1.5,
    "isIpPublicProxy": 1.8,
    "isIpHostingService": 2.0,
    "isIpResidentialProxy": 1.2,
    "isIpCrawler": 2.2,
}


def bot_flag(df: DataFrame) -> Column:
    """isLikelyBot or, where the log has it, isBot; null → false."""
    flag = F.coalesce(F.col("isLikelyBot"), F.lit(False))
    if "isBot" in df.columns:
        flag = flag | F.coalesce(F.col("isBot").cast("boolean"), F.lit(False))
    return flag


def add_fraud(df: DataFrame) -> DataFrame:
    """Number of raised flags and their weighted sum."""
    return df.withColumns(
        {
            "total_fraud_flags": total(as_int(F.col(c)) for c in FRAUD_WEIGHTS),
            "weighted_fraud_score": total(as_int(F.col(c)) * F.lit(w) for c, w in FRAUD_WEIGHTS.items()),
        }
    )
