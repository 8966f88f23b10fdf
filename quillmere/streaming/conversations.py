"""Short-term memory of sessions as a stream: the batch fold, fed turn by turn."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmere.config import Lexicon, ShortTerm
from quillmere.operators import lexicon as lx
from quillmere.operators.memory import Turn, Window_, add_turn, turn_of

OUTPUT = "session string, turn int, compressed array<int>, n_active int, summary string"


def session_memory(turns: DataFrame, lexicon: DataFrame, s: ShortTerm | None = None, c: Lexicon | None = None, late: str = "7 days", at: str = "received_at", idle_hours: int = 24 * 30) -> DataFrame:
    """The memory after each turn of a stream of turns (session, turn, role, text).

    A turn that was seen before, or that comes after a later one of its session, is passed over:
    memory moves forward only. State is the window and the summary, as JSON, for each session; it
    is dropped when event time is idle_hours beyond its last turn, and a session that goes on later
    starts anew.
    """
    s, c = s or ShortTerm(), c or Lexicon()
    shared = turns.sparkSession.sparkContext.broadcast(lx.matcher(lexicon, c))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, w = -1, Window_()
        if state.exists:
            saved = json.loads(state.get[0])
            last, w = saved["last"], Window_([Turn(*t) for t in saved["active"]], saved["summary"], saved["compressed"])
        rows = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"], strict=True):
            if turn <= last:
                continue
            last, text = int(turn), text or ""
            found = shared.value.find(text)
            gone = add_turn(w, turn_of(last, (role or "").lower(), text, found, c), s)
            out.append((key[0], last, gone, len(w.active), w.summary))
        state.update((json.dumps({"last": last, "active": w.active, "summary": w.summary, "compressed": w.compressed}),))
        newest = max((int(t.timestamp() * 1000) for t in rows[at].dropna()), default=0)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_hours * 3_600_000)
        yield pd.DataFrame(out, columns=["session", "turn", "compressed", "n_active", "summary"])

    timely = turns.where("session is not null and turn is not null").withWatermark(at, late).select("session", F.col("turn").cast("int").alias("turn"), "role", "text", at)
    return timely.groupBy("session").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def entity_counts(turns: DataFrame, window: str = "1 hour", late: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Terms by kind in windows of event time: window_start, type, n; late turns beyond the watermark fall out."""
    words = turns.withWatermark(at, late).select(at, F.explode("entities").alias("type", "terms"))
    return words.groupBy(F.window(at, window).alias("w"), "type").agg(F.sum(F.size("terms")).alias("n")).select(F.col("w.start").alias("window_start"), "type", "n")
