"""The progress of runs, told from their events as these arrive, and runs that fall silent.

Events wait in the state of their run until the watermark has passed them, so they
are numbered by their own time in whatever order they come.  A run that says
nothing for a while and isn't finished gets one row of its own, by a timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..types import RUN_FAILED

#: Fixed: the kinds of events that change what is told; others are numbered only.
START, VERDICT, END = "start", "verdict", "end"
TOLD = "run_id string, number long, ms long, kind string, claim_id long, completed long, remaining long"
_STATE = "held string"
_EMPTY = {"total": 0, "done": 0, "number": 0, "last": 0, "over": False, "waiting": []}


def progress(events: DataFrame, late: str = "5 minutes", silence_minutes: int = 30) -> DataFrame:
    """(run_id, number, at, kind, claim_id, completed, remaining) for the events (run_id, event_id, at, kind, claim_id, total) of a stream.

    ``total`` of a start event is the number of claims of its run; ``remaining``
    are those without a verdict.  An event that comes twice counts once while the
    watermark holds it, and one that comes after the watermark not at all.  A run
    whose last event is ``silence_minutes`` old, by the watermark, without an end
    gets a row of kind RUN_FAILED and is forgotten, as one is that has ended; a
    later event of it begins anew.
    """
    silence = silence_minutes * 60_000

    def told(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {**_EMPTY, "waiting": []}
        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    claim = None if pd.isna(row.claim_id) else int(row.claim_id)
                    total = None if pd.isna(row.total) else int(row.total)
                    held["waiting"].append([int(row.ms), row.event_id, row.kind, claim, total])
        held["waiting"].sort(key=lambda e: (e[0], e[1]))
        rows = []
        while held["waiting"] and held["waiting"][0][0] < passed:
            at, _, kind, claim, total = held["waiting"].pop(0)
            held["number"] += 1
            held["last"] = max(held["last"], at)
            held["done"] += kind == VERDICT
            held["over"] |= kind == END
            if kind == START:
                held["total"] = total or 0
            rows.append((key[0], held["number"], at, kind, claim, held["done"], max(0, held["total"] - held["done"])))
        quiet = held["last"] + silence if held["last"] else None
        if not held["waiting"] and held["last"] and not held["over"] and quiet < passed:
            held["number"] += 1
            rows.append((key[0], held["number"], quiet, RUN_FAILED, None, held["done"], max(0, held["total"] - held["done"])))
            held["over"] = True
        if held["over"] and not held["waiting"]:
            if state.exists:
                state.remove()
        else:
            state.update((json.dumps(held),))
            due = min(x for x in (held["waiting"][0][0] if held["waiting"] else None, quiet if not held["over"] else None) if x is not None)
            state.setTimeoutTimestamp(max(due, passed + 1))
        out = pd.DataFrame(rows, columns=["run_id", "number", "ms", "kind", "claim_id", "completed", "remaining"])
        yield out.astype({"claim_id": "Int64"})

    seen = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "event_id"])
    each = seen.select("run_id", "event_id", "at", F.unix_millis("at").alias("ms"), "kind", "claim_id", "total")
    rows = each.groupBy("run_id").applyInPandasWithState(told, TOLD, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return rows.select("run_id", "number", F.timestamp_millis("ms").alias("at"), "kind", "claim_id", "completed", "remaining")
