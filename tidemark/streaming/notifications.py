"""Notification rules on a stream: event rules row by row, funnel rules by an automaton per device."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.timeutil import from_micros, micros
from tidemark.operators.summaries import event_notifications
from tidemark.schema import DEVICE
from tidemark.streaming.stateful import _timed, in_order, use_rocksdb


class FunnelRules(StatefulProcessor):
    """For every rule the newest start of a chain that has reached each step, as in the batch funnel: it is all a later event
    needs. A completed chain is reported once, and its start is forgotten in every step. A timer removes the state when no
    chain can be in time any more."""

    def __init__(self, rules: list[dict]):
        self.rules, self.longest = rules, max(r["window"] for r in rules) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chains = handle.getMapState("chains", "rule string", "starts array<bigint>")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {}
        for rule in self.rules:
            found = self.chains.getValue((rule["id"],))
            known[rule["id"]] = list(found[0]) if found else [None] * len(rule["steps"])
        last = None
        for block in in_order(rows, ["at", "id", "name"]):
            out = []
            for at, id_, name in block:
                last = at
                for rule in self.rules:
                    starts, steps, width = known[rule["id"]], rule["steps"], rule["window"] * 1_000_000
                    if name not in steps:
                        continue
                    before = list(starts)
                    for k, step in enumerate(steps):
                        start = at if k == 0 else before[k - 1]
                        if name == step and start is not None and at - start <= width:
                            starts[k] = start if starts[k] is None else max(starts[k], start)
                    done = starts[-1]
                    if done is not None:
                        out.append((*key, rule["id"], id_, done, at))
                        known[rule["id"]] = [None if s is None or s <= done else s for s in starts]
            yield pd.DataFrame(out, columns=[*DEVICE, "rule_id", "id", "began", "at"])
        for rule, starts in known.items():
            self.chains.updateValue((rule,), (starts,))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        until = max((last + self.longest) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(until)
        self.timer.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.chains.clear()
        self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def funnel_notifications(ev: DataFrame, rules: list[dict], delay: str = "10 minutes") -> DataFrame:
    """One row per completed chain of a rule {id, steps, window in seconds}: the completing event, and when the chain began.
    A rule of one step reports every such event."""
    use_rocksdb(ev)
    names = sorted({step for rule in rules for step in rule["steps"]})
    types = {f.name: f.dataType.simpleString() for f in ev.schema}
    out = ", ".join(f"{c} {types[c]}" for c in DEVICE) + f", rule_id string, id {types['id']}, began bigint, at bigint"
    rows = _timed(ev.where(F.col("name").isin(*names)), delay).select(*DEVICE, "id", "name", "event_time", micros(F.col("created_at")).alias("at"))
    found = rows.groupBy(*DEVICE).transformWithStateInPandas(FunnelRules(rules), out, "append", "EventTime")
    return found.select(*DEVICE, "rule_id", "id", from_micros(F.col("began")).alias("began_at"), from_micros(F.col("at")).alias("completed_at"))


def notifications(ev: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that satisfy an event rule, as they arrive."""
    return event_notifications(ev, rules)
