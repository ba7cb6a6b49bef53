"""Runs followed as a stream: each run's state and report, failures as rows, and a timer for every item that is under way."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: planned is given with PLAN; an item is begun by START and ended by OK or FAIL.
EVENT = "run_id string, kind string, item string, planned long, error string, at timestamp"
REPORT = "run_id string, status string, item string, planned long, ok long, failed long, stalled long, open long, note string"


class RunReports(StatefulProcessor):
    """Counts and open items of one run.

    A report follows every micro-batch with events of the run, and rows for
    failures and for items that were not ended in time.  An item that ends after
    it was given up counts as what it became.  An item's first end stands.
    """

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "planned long, ok long, failed long, stalled long")
        self.open = handle.getMapState("open", "item string", "due long")
        self.ended = handle.getMapState("ended", "item string", "how string")
        self.handle = handle

    def _counts(self) -> dict:
        got = self.counts.get() if self.counts.exists() else None
        return dict(zip(("planned", "ok", "failed", "stalled"), got)) if got else {"planned": 0, "ok": 0, "failed": 0, "stalled": 0}

    def _report(self, run: str, c: dict, rows: list) -> pd.DataFrame:
        still = sum(1 for _ in self.open.keys()) if self.open.exists() else 0
        done = c["ok"] + c["failed"] + c["stalled"]
        status = "IN_PROGRESS" if not c["planned"] or done < c["planned"] else "COMPLETE" if not c["failed"] + c["stalled"] else "COMPLETE_WITH_FAILURES"
        self.counts.update(tuple(c.values()))
        told = [(run, kind, item, None, None, None, None, None, note) for kind, item, note in rows]
        return pd.DataFrame([*told, (run, status, None, *c.values(), still, None)], columns=[x.split()[0] for x in REPORT.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, out = self._counts(), []
        events = pd.concat(list(rows)).sort_values(["at", "kind", "item"], na_position="first")
        # Each call of the state is a round trip: a run without any is not asked, and items that begin and end here are only written once.
        asked = {name: state.exists() for name, state in (("open", self.open), ("ended", self.ended))}
        begun, ends = {}, {}
        for e in events.itertuples():
            if e.kind == "PLAN":
                c["planned"] = max(c["planned"], int(e.planned))
            elif e.kind == "START":
                if e.item not in begun and e.item not in ends and not self._in("open", e.item, asked) and not self._in("ended", e.item, asked):
                    begun[e.item] = int(e.at.timestamp() * 1000) + self.patience
            elif e.kind in ("OK", "FAIL"):
                was = ends.get(e.item) or (self.ended.getValue((e.item,))[0] if self._in("ended", e.item, asked) else None)
                if was in ("OK", "FAIL"):
                    continue
                if was == "STALLED":
                    c["stalled"] -= 1
                c["ok" if e.kind == "OK" else "failed"] += 1
                ends[e.item] = e.kind
                if begun.pop(e.item, None) is None and self._in("open", e.item, asked):
                    self.open.removeKey((e.item,))
                if e.kind == "FAIL":
                    out.append(("FAILED", e.item, e.error))
        for item, how in ends.items():
            self.ended.updateValue((item,), (how,))
        for item, due in begun.items():
            self.open.updateValue((item,), (due,))
            self.handle.registerTimer(due)
        yield self._report(key[0], c, out)

    def _in(self, name: str, item: str, asked: dict) -> bool:
        return asked[name] and getattr(self, name).containsKey((item,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c, now = self._counts(), expiredTimerInfo.getExpiryTimeInMs()
        late = sorted(item[0] for item, due in list(self.open.iterator()) if due[0] <= now)
        for item in late:
            self.open.removeKey((item,))
            self.ended.updateValue((item,), ("STALLED",))
            c["stalled"] += 1
        if late:
            yield self._report(key[0], c, [("STALLED", item, "not ended in time") for item in late])

    def close(self) -> None:
        pass


def run_reports(events: DataFrame, patience: str = "10 minutes") -> DataFrame:
    """REPORT rows of a stream of EVENT: failures and stalled items as they are known, and each run's counts after every batch it is in.

    Stalled is what has not ended `patience` after its start, by the watermark
    (0 seconds behind the latest event).  Needs the RocksDB state store.
    """
    ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    return events.withWatermark("at", "0 seconds").groupBy("run_id").transformWithStateInPandas(RunReports(ms), outputStructType=REPORT, outputMode="Append", timeMode="EventTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
