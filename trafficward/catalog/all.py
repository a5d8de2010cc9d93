"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import (  # noqa: F401
    anomaly_queries,
    channel_queries,
    entity_queries,
    job_queries,
    log_queries,
    report_queries,
    similarity_queries,
    stream_queries,
)
from .base import REGISTRY

__all__ = ["REGISTRY"]
