"""Address and agent records for a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.enrich.network import is_datacenter, with_network
from tidemark.enrich.agents import with_agent
from tidemark.enrich.web import is_crawler


def lookup(requests: DataFrame, networks: DataFrame, ip: str = "ip", agent: str = "user_agent", networks6: DataFrame | None = None) -> DataFrame:
    """Location, provider, and device of each (address, agent) row."""
    out = with_agent(requests, agent, name="_agent").select(*requests.columns, "_agent.*", is_crawler(F.col(agent)).alias("is_crawler"))
    return with_network(out, networks, ip, networks6).withColumn("is_datacenter", is_datacenter(F.col("geo_asn")))
