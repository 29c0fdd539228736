"""Requests to stored events in one plan: the same function serves a batch job and every micro-batch of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.enrich.network import bot_reasons, mark_bots, with_network
from tidemark.enrich.payload import drop_repeated_ids, geo_fallback, track_events
from tidemark.enrich.web import with_referrer
from tidemark.functions.lineage import cut
from tidemark.operators.sessions import TIMEOUT_SECONDS, sessionize


def enriched(accepted: DataFrame, networks: DataFrame, referrers: DataFrame, networks6: DataFrame | None = None) -> DataFrame:
    """Accepted events with location, referrer class and bot marks, each id once."""
    placed = geo_fallback(with_network(accepted, networks, "ip", networks6))
    known = with_referrer(placed, referrers)
    # Crawlers were refused before, so the address is what is left to tell.
    reasons = bot_reasons(F.lit(False), F.col("geo_asn"))
    marked = known.withColumn("properties", mark_bots(F.col("properties"), reasons))
    latitude, longitude = F.col("geo_latitude").alias("latitude"), F.col("geo_longitude").alias("longitude")
    return drop_repeated_ids(marked.select(*[c for c in marked.columns if not c.startswith("geo_")], latitude, longitude))


def assembled(raw: DataFrame, networks: DataFrame, referrers: DataFrame, networks6: DataFrame | None = None, salt: str = "",
              timeout: int = TIMEOUT_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Events with session ids, ready for :func:`tidemark.sources.tables.write_events`, and the refused rows with their status."""
    parsed = cut(track_events(raw, salt))  # parsed once, read by both results
    events = enriched(parsed.where(F.col("status") == "accepted").drop("status"), networks, referrers, networks6)
    refused = parsed.where(~F.col("status").isin("accepted", "crawler_accepted")).select("status", "name", "created_at")
    return sessionize(cut(events), timeout), refused
