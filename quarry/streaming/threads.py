"""Threads of chat channels as a stream, by the rules of operators.threads.build_threads.

State is kept for each channel.  A message waits until the watermark has passed it, so messages are taken in the order of
time whatever the order of files.  It can be replied to, or be named as a thread's root, for ``reply_minutes`` after it or after
the last message that leads to it; what nobody leads to in that time is a loose message and goes by time gaps.  Thus a channel's state is what is
still open to replies, however long the stream runs.

Equal to the batch where edges lead back to earlier messages within that time and indexes rise with time; an edge that leads
further back, or forward, leads nowhere.  Rows later than the watermark are dropped, as in any stream.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.threads import GAP_MINUTES, MAX_HOPS, MAX_MESSAGES

REPLY_MINUTES = 24 * 60
_COLUMNS = ("index", "messageIndex", "threadRootMessageIndex", "repliesToEventIndex")


def empty() -> dict:
    """waiting: messages (millis, *_COLUMNS); open: by index (until, path, members, root, message); names: index by message; run: the last loose message's millis, its thread and count."""
    return {"waiting": [], "open": {}, "names": {}, "run": None}


def _join(state: dict, root: int, index: int, out: list) -> None:
    """The row of a member, and before the first one that of its root."""
    head = state["open"][root]
    for i in ([root] if not head["members"] else []) + ([index] if index != root else []):
        head["members"] += 1
        if head["members"] <= MAX_MESSAGES:
            out.append((root, i))


def _place(state: dict, message: tuple, reply_millis: int, out: list) -> None:
    at, index, name, thread, reply = message
    nodes, names = state["open"], state["names"]
    if index in nodes:
        return
    node = nodes[index] = {"at": at, "until": at + reply_millis, "path": [index], "members": 0, "root": None, "name": name}
    if name is not None:
        names[name] = max(index, names.get(name, index))
    live = lambda i: i in nodes and nodes[i]["until"] >= at
    if thread is not None:
        target = names.get(thread)
        path = [target] if target is not None and live(target) else []
        node["path"] = path or [index]
    else:
        path = nodes[reply]["path"] if reply is not None and live(reply) else []
        node["path"] = ([index] + [i for i in path if i != index])[: MAX_HOPS + 1]
    for i in [*path, *([reply] if path and thread is None else [])]:
        nodes[i]["until"] = max(nodes[i]["until"], at + reply_millis)
    if path:
        node["root"] = path[-1]
        _join(state, path[-1], index, out)


def advance(state: dict, mark: int, reply_millis: int) -> list[tuple[int, int]]:
    """(thread, index) of what is settled once all messages before ``mark`` (millis) are there; changes ``state``."""
    out: list[tuple[int, int]] = []
    ready = sorted((m for m in state["waiting"] if m[0] < mark), key=lambda m: m[:2])
    state["waiting"] = [m for m in state["waiting"] if m[0] >= mark]
    for m in ready:
        _place(state, tuple(m), reply_millis, out)
    past = sorted((n["at"], i) for i, n in state["open"].items() if n["until"] < mark)
    for at, i in past:
        node = state["open"].pop(i)
        if node["name"] is not None and state["names"].get(node["name"]) == i:
            del state["names"][node["name"]]
        if node["root"] is None and not node["members"]:
            run = state["run"]
            state["run"] = [at, i, 1] if run is None or at - run[0] > GAP_MINUTES * 60_000 else [at, run[1], run[2] + 1]
            if state["run"][2] <= MAX_MESSAGES:
                out.append((state["run"][1], i))
    return out


def due(state: dict) -> int | None:
    """The millis that the watermark must pass before the state changes again."""
    times = [m[0] for m in state["waiting"]] + [n["until"] for n in state["open"].values()]
    return min(times, default=None)


def thread_stream(events: DataFrame, ts: str, channel: str, late: str = "1 hour", reply_minutes: int = REPLY_MINUTES) -> DataFrame:
    """(channel, thread, index) of a stream of cleaned events; append mode.

    events: the columns of _COLUMNS (index unique in its channel), a time ``ts`` and a ``channel``.  A message that comes twice counts once as long as it is open; one without
    time or index is left out.
    """

    def step(key, batches, group):
        state = json.loads(group.get[0]) if group.exists else empty()
        state["open"] = {int(i): n for i, n in state["open"].items()}
        state["names"] = {int(i): n for i, n in state["names"].items()}
        if not group.hasTimedOut:
            for b in batches:
                whole = [[None if pd.isna(v) else int(v) for v in b[c].tolist()] for c in ("__at", *_COLUMNS)]
                state["waiting"] += zip(*whole, strict=True)
        mark = group.getCurrentWatermarkMs()
        out = advance(state, mark, reply_minutes * 60_000)
        wait = due(state)
        if wait is None and (state["run"] is None or state["run"][0] + GAP_MINUTES * 60_000 < mark):
            group.remove()
        else:
            group.update((json.dumps(state),))
            group.setTimeoutTimestamp(max(mark + 1, state["run"][0] + GAP_MINUTES * 60_000 if wait is None else wait))
        yield pd.DataFrame({"channel": [key[0]] * len(out), "thread": [t for t, _ in out], "index": [i for _, i in out]})

    rows = events.where(F.col(ts).isNotNull() & F.col("index").isNotNull()).withWatermark(ts, late).select(
        F.col(channel).cast("string").alias("channel"), ts, F.unix_millis(ts).alias("__at"), *[F.col(c).cast("string") for c in _COLUMNS]
    )
    return rows.groupBy("channel").applyInPandasWithState(step, "channel string, thread long, index long", "kept string", "append", "EventTimeTimeout")
