"""The batch jobs end to end: fitted scores, all five anomaly families, every row classified."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import jobs
from ..schema import ANOMALY_FLAGS
from ..session import written
from .base import query


@query(
    "Q01_full_job",
    "n_rows:i n_channels:i unclassified:i out_of_range:i missing_flags:i",
    """SELECT count(*) AS n_rows, (SELECT count(DISTINCT channelId) FROM clean) AS n_channels, 0 AS unclassified,
    0 AS out_of_range, 0 AS missing_flags FROM traffic""",
)
def _(t):
    # the counts of what must not occur are zero in the twin; the scores themselves are fitted
    scored = jobs.score_log(t.traffic)
    rows = written(jobs.classify_log(t.traffic, scored["scores"], scored["flags"])["rows"], "classified")
    bad = lambda c: F.count_if(c)
    judged = rows.agg(
        F.count("*").alias("n_rows"),
        bad(F.col("classification").isNull()).alias("unclassified"),
        bad(~F.col("risk_score").between(0, 1) | F.col("risk_score").isNull()).alias("out_of_range"),
    )
    flags = scored["flags"].agg(
        F.count_distinct("channelId").alias("n_channels"),
        sum((bad(F.col(f).isNull()) for f in ANOMALY_FLAGS), F.lit(0)).alias("missing_flags"),
    )
    return judged.crossJoin(flags)  # one row each
