"""User journeys and event flows.

A session's journey is its page sequence with consecutive repeats collapsed, cut to a number of steps
and before the first page seen twice. Such a prefix holds each page once, in order of first visit; it ends
at the first event that returns to a page after a later page was opened. First visits are a minimum per
(session, page), so they are combined before the shuffle, and at most ``steps + 1`` of them per session go on.
No list of a session's events is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut
from tidemark.functions.numbers import round_to
from tidemark.functions.timeutil import Period
from tidemark.operators.traffic import top_k
from tidemark.schema import SHOP

SESSION = [*SHOP, "session_id"]

# Node colours by entry page.
COLOURS = ("#3b82f6", "#10b981", "#f59e0b", "#ef4444", "#8b5cf6", "#ec4899", "#06b6d4", "#84cc16", "#f97316", "#6366f1")


def distinct_prefix(ev: DataFrame, item: str, steps: int, backwards: bool = False) -> DataFrame:
    """(session, position, item): the collapsed, repeat-free start of each session's item sequence, or
    of its reverse."""
    seen = ev.select(*SESSION, F.col(item).alias("item"), F.struct("created_at", "id").alias("at"))
    extreme, order = (F.max, F.desc("first")) if backwards else (F.min, F.asc("first"))
    w = Window.partitionBy(*SESSION).orderBy(order)
    firsts = seen.groupBy(*SESSION, "item").agg(extreme("at").alias("first")).withColumn("position", F.row_number().over(w))
    firsts = firsts.where(F.col("position") <= steps + 1).withColumn("next", F.lead("first").over(w))
    # A return: an event on an item after the following item was first seen.
    returns = seen.join(firsts.where(F.col("next").isNotNull()).select(*SESSION, "item", "next"), [*SESSION, "item"])
    late = F.col("at") < F.col("next") if backwards else F.col("at") > F.col("next")
    cutoff = returns.where(late).groupBy(*SESSION).agg(extreme("at").alias("cutoff"))
    kept = firsts.where(F.col("position") <= steps).join(cutoff, SESSION, "left")
    inside = F.col("first") > F.col("cutoff") if backwards else F.col("first") < F.col("cutoff")
    return kept.where(F.col("cutoff").isNull() | inside).select(*SESSION, "position", "item")


def _hops(prefix: DataFrame) -> DataFrame:
    """Prefixes of at least two items as (session, position, source, target, entry)."""
    w = Window.partitionBy(*SESSION).orderBy("position")
    hop = prefix.select("*", F.lead("item").over(w).alias("target"), F.first("item").over(w).alias("entry"))
    return hop.where(F.col("target").isNotNull()).withColumnRenamed("item", "source")


def journey_paths(ev: DataFrame, period: Period, steps: int = 5) -> DataFrame:
    """Page prefixes of every session."""
    rows = ev.where(period.current(F.col("created_at")) & (F.col("path") != ""))
    return distinct_prefix(rows, "path", steps)


def journey_transitions(prefix: DataFrame, entries: int = 3) -> tuple[DataFrame, DataFrame]:
    """Top entry pages per shop and the page changes per step of sessions entering there. Sessions with a single page are left out."""
    hops = cut(_hops(prefix))  # a few rows per session, read twice
    starts = hops.where(F.col("position") == 1).groupBy(*SHOP, "entry").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy(*SHOP).orderBy(F.desc("count"), "entry"))
    top = starts.withColumn("rank", rank).where(F.col("rank") <= entries)
    moves = hops.join(top.select(*SHOP, "entry"), [*SHOP, "entry"], "left_semi")
    moves = moves.groupBy(*SHOP, "source", "target", F.col("position").alias("step")).agg(F.count(F.lit(1)).alias("value"))
    return top, moves


def journey_graph(prefix: DataFrame, steps: int = 5, entries: int = 3, fanout: int = 3) -> tuple[DataFrame, DataFrame]:
    """Sankey nodes and links per shop.

    From the top entry pages, each active node follows its ``fanout`` most frequent changes to the next step.
    Links below 0.25 % of the entry sessions (at least 1) are dropped and nodes without a link go with them.
    Nodes take the colour of their strongest incoming link. The loop runs over steps; each round is a join of
    small aggregates, written out so that the next one does not recompute it.
    """
    top, moves = journey_transitions(prefix, entries)
    top = cut(top)
    best = cut(top_k(moves, [*SHOP, "step", "source"], [F.desc("value"), F.col("target")], fanout))
    colours = F.array(*[F.lit(c) for c in COLOURS])
    active = top.select(*SHOP, F.col("entry").alias("source"), F.get(colours, F.col("rank") - 1).alias("colour"))
    links = None
    for step in range(1, steps):
        found = cut(best.where(F.col("step") == step).join(active, [*SHOP, "source"]))
        links = found if links is None else links.unionByName(found)
        colour = F.max_by("colour", F.struct("value", "source")).alias("colour")
        active = found.groupBy(*SHOP, "target").agg(colour).withColumnRenamed("target", "source")
    total = top.groupBy(*SHOP).agg(F.sum("count").alias("total"))
    links = links.join(total, SHOP)
    enough = F.greatest(F.lit(1), F.ceil(F.col("total") * 0.0025))
    kept = links.where(F.col("value") >= enough)

    def node(path, step):
        return F.concat(path, F.lit("::step"), step.cast("string"))

    out_links = kept.select(*SHOP, node(F.col("source"), F.col("step")).alias("source"), node(F.col("target"), F.col("step") + 1).alias("target"), "value")
    # Every node with its raw and kept inflow; entries bring their session count.
    inflow = links.groupBy(*SHOP, F.col("target").alias("path"), (F.col("step") + 1).alias("step")).agg(
        F.sum("value").alias("raw"), F.sum(F.when(F.col("value") >= enough, F.col("value"))).alias("kept"),
        F.max_by("colour", F.struct("value", "source")).alias("colour"))
    entry = top.select(*SHOP, F.col("entry").alias("path"), F.lit(1).alias("step"), F.col("count").alias("raw"), F.lit(None).cast("bigint").alias("kept"),
                       F.get(colours, F.col("rank") - 1).alias("colour"))
    outflow = kept.select(*SHOP, F.col("source").alias("path"), "step").distinct()
    nodes = inflow.unionByName(entry).join(outflow.withColumn("_out", F.lit(True)), [*SHOP, "path", "step"], "left")
    nodes = nodes.where(F.col("_out") | F.col("kept").isNotNull()).join(total, SHOP)
    value = F.coalesce("kept", "raw")
    return nodes.select(*SHOP, node(F.col("path"), F.col("step")).alias("id"), F.col("path").alias("label"), F.col("step").cast("int").alias("step"), "colour",
                        value.alias("value"), round_to(value / F.col("total") * 100, 2).alias("percentage")), out_links


def event_flow(ev: DataFrame, period: Period, mode: str = "after", start: str | None = None, end: str | None = None,
               steps: int = 5, include: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Repeat-free event-name prefixes per session: from the first ``start`` onwards, backwards from the last
    ``end``, or between the first ``start`` and the first ``end`` after it."""
    rows = ev.where(period.current(F.col("created_at")))
    at = F.struct("created_at", "id")
    wanted = F.lit(True) if include is None else F.col("name").isin(*include, *[n for n in (start, end) if n])
    body = rows.where(wanted & ~F.col("name").isin(*exclude)) if exclude else rows.where(wanted)
    if mode == "before":
        anchor = rows.where(F.col("name") == end).groupBy(*SESSION).agg(F.max(at).alias("anchor"))
        return distinct_prefix(body.join(anchor, SESSION).where(at <= F.col("anchor")), "name", steps, backwards=True)
    anchor = rows.where(F.col("name") == start).groupBy(*SESSION).agg(F.min(at).alias("anchor"))
    body = body.join(anchor, SESSION).where(at >= F.col("anchor"))
    if mode == "between":
        stop = (rows.where(F.col("name") == end).join(anchor, SESSION).where(at > F.col("anchor"))
                .groupBy(*SESSION).agg(F.min(at).alias("stop")))
        body = body.join(stop, SESSION).where(at <= F.col("stop"))
    return distinct_prefix(body, "name", steps)


def flow_links(prefix: DataFrame) -> DataFrame:
    """Counts of each change per step."""
    return _hops(prefix).groupBy(*SHOP, "source", "target", F.col("position").alias("step")).agg(F.count(F.lit(1)).alias("value"))
