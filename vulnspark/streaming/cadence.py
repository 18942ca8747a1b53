"""Contact rhythm of hosts and acknowledgement of folds as stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vulnspark.params import DAY, Params

#: Contacts a host's state keeps: ten gaps.
CONTACTS = 11
EVENT = "hostname string, event string, last_contact_at bigint, n_gaps int, median_gap bigint, p95_gap bigint, learned int"
STATE = "times array<bigint>, told string"


def rhythm(times: list[int]) -> tuple[int, int | None, int | None, int]:
    """Number of gaps, median, longest, and whether there are enough to judge by."""
    gaps = sorted(b - a for a, b in zip(times, times[1:], strict=False))
    if not gaps:
        return 0, None, None, 0
    return len(gaps), gaps[(len(gaps) - 1) // 2], gaps[-1], int(len(gaps) >= 3)


def contact_stream(contacts: DataFrame, late: str = "0 seconds", p: Params = Params()) -> DataFrame:
    """One row for every host a batch heard of, one when a host falls silent, one when it is retired.

    ``contacts`` streams hostname and scanned_at. A host is silent when it has been quiet for twice its longest
    gap and no less than the floor, and retired at the retirement age or four times that gap; both are event-time
    timers, so they fire once the watermark has passed them, whether or not the host is heard of again. State is
    a host's last contacts; a retired host leaves none.
    """
    def limit(longest: int, told: str) -> int:
        return max(2 * longest, p.late_floor) if told == "" else max(p.host_retire_days * DAY, 4 * longest)

    def on_time(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, told = (list(state.get[0]), state.get[1]) if state.exists else ([], "")
        if state.hasTimedOut:
            told = "silent" if told == "" else "retired"
            event = told
        else:
            heard = {int(t) for batch in batches for t in batch["scanned_at"]}
            new = max(heard) > max(times, default=-1)
            times, told, event = sorted({*times, *heard})[-CONTACTS:], "" if new else told, "contact"
        n, median, longest, learned = rhythm(times)
        if told == "retired":
            state.remove()
        else:
            state.update((times, told))
            if learned:
                due = (times[-1] + limit(longest, told) + 1) * 1000
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"hostname": [key[0]], "event": [event], "last_contact_at": [times[-1]], "n_gaps": [n], "median_gap": pd.array([median], "Int64"),
                            "p95_gap": pd.array([longest], "Int64"), "learned": [learned]})

    rows = contacts.select("hostname", "scanned_at", F.timestamp_seconds("scanned_at").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("hostname").applyInPandasWithState(on_time, EVENT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


PENDING = ("pending array<struct<run:bigint,n:bigint,at:bigint>>, folds array<struct<run:bigint,n:bigint,at:bigint>>, "
           "told array<struct<run:bigint,n:bigint,at:bigint>>")


def fold_acknowledgements(receipts: DataFrame, folds: DataFrame, late: str = "1 hour", p: Params = Params()) -> DataFrame:
    """hostname, match_run, findings_produced and whether a fold of the run arrived within the window, once for each receipt.

    ``receipts`` streams hostname, match_run, findings_produced and ingested_at, ``folds`` hostname, state_run,
    rows_at_run and folded_pass_at, in seconds; either may come first. Both are one keyed stream, whose state holds
    the receipts, folds and answers of a host's last window. A receipt of no findings needs no fold. An event-time
    timer ends the wait: the receipt then leaves as not folded.
    """
    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, seen, told = ([tuple(r) for r in part] for part in state.get) if state.exists else ([], [], [])
        pending, seen, told, out = list(pending), list(seen), list(told), []
        if not state.hasTimedOut:
            for batch in batches:
                for kind, *row in batch[["kind", "run", "n", "at"]].itertuples(index=False):
                    (pending if kind == "receipt" else seen).append(tuple(int(v) for v in row))
        now = state.getCurrentWatermarkMs() // 1000
        known = {run for run, _, _ in told}
        waiting = []
        for run, n, at in sorted(set(pending)):
            if run in known:
                continue
            proof = n == 0 or any(abs(r - run) < p.run_tolerance and rows >= n and at <= t <= at + p.ack_window for r, rows, t in seen)
            if proof or at + p.ack_window < now:
                known.add(run)
                told.append((run, n, at))
                out.append((key[0], run, n, proof))
            else:
                waiting.append((run, n, at))
        recent = [[r for r in part if r[2] + 2 * p.ack_window >= now] for part in (sorted(set(seen)), told)]
        due = [at + p.ack_window + 1 for _, _, at in waiting] + [at + 2 * p.ack_window + 1 for part in recent for _, _, at in part]
        if due:
            state.update((waiting, *recent))
            state.setTimeoutTimestamp(max(min(due) * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["hostname", "match_run", "findings_produced", "folded"])

    sent = receipts.select("hostname", F.lit("receipt").alias("kind"), F.col("match_run").alias("run"), F.col("findings_produced").alias("n"), F.col("ingested_at").alias("at"))
    done = folds.select("hostname", F.lit("fold").alias("kind"), F.col("state_run").alias("run"), F.col("rows_at_run").alias("n"), F.col("folded_pass_at").alias("at"))
    rows = sent.unionByName(done).withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", late)
    return rows.groupBy("hostname").applyInPandasWithState(
        one, "hostname string, match_run bigint, findings_produced bigint, folded boolean", PENDING, "append", GroupStateTimeout.EventTimeTimeout)
