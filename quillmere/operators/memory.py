"""Memory of conversations: a sliding window with a rolling summary, and long-term facts.

Both are folds over the turns of a session in order. A session's rows are sorted within one
partition and stream through the fold, which holds only its state; the session itself, however
long, is never gathered.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.config import Lexicon, LongTerm, ShortTerm
from quillmere.functions.text import python_tokens
from quillmere.operators import lexicon as lx
from quillmere.operators import nli
from quillmere.operators.embedding import Encoder, create_encoder

SENTENCE = re.compile(r"[^。！？；!?;\n]*[。！？；!?;\n]|[^。！？；!?;\n]+$")


def latest_turns(turns: DataFrame) -> DataFrame:
    """One row for each session and turn, the one received last."""
    order = Window.partitionBy("session", "turn").orderBy(F.desc_nulls_last("received_at"), F.coalesce("text", F.lit("")), F.coalesce("role", F.lit("")))
    return turns.where("session is not null and turn is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r").withColumn("role", F.lower("role"))


def fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], list[tuple]]) -> DataFrame:
    """Runs step over the rows of each key in order; step changes the state and gives output rows."""
    columns = [f.split()[0] for f in schema.split(", ")]  # types are written without blanks after commas

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_dict("records"):
                if state is None or row[key] != now:
                    now, state = row[key], start()
                out += step(state, row)
            yield pd.DataFrame(out, columns=columns)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


# ---------------------------------------------------------------- short-term memory
def effective_importance(base: str = "base_importance", turn: str = "turn", session: str = "session", decay: float = 0.82) -> Column:
    """Importance that fades with the turns that followed."""
    return F.round(F.coalesce(F.col(base), F.lit(0.0)) * F.pow(F.lit(decay), F.max(turn).over(Window.partitionBy(session)) - F.col(turn)), 6)


class Turn(NamedTuple):
    number: int
    role: str
    text: str
    importance: float
    tokens: int
    has_terms: bool

    def faded(self, now: int, decay: float) -> float:
        return self.importance * decay ** (now - self.number)

    def piece(self) -> str:
        """What a summary keeps of a turn: its first sentences, two if it names known terms."""
        parts = [p for m in SENTENCE.finditer(self.text) if (p := m[0].strip())][: 2 if self.has_terms else 1]
        return f"[{'患' if self.role == 'user' else '医'}]{''.join(parts)[:120]}"


@dataclass
class Window_:
    """The active turns and the summary of those that left."""

    active: list[Turn] = field(default_factory=list)
    summary: str = ""
    compressed: int = 0

    @property
    def tokens(self) -> int:
        return sum(t.tokens for t in self.active)

    def leave(self, gone: list[Turn], limit: int) -> None:
        """Turns go into the summary, which keeps its newest pieces within a number of tokens."""
        pieces = " ".join(filter(None, (self.summary, *(t.piece() for t in gone)))).strip().split(" ")
        fits = bisect_right(list(accumulate(map(python_tokens, reversed(pieces)))), limit)
        self.summary = " ".join(pieces[len(pieces) - fits :])
        self.compressed += len(gone)


def add_turn(w: Window_, turn: Turn, s: ShortTerm) -> list[int]:
    """Adds a turn; gives the numbers of those that leave for it: all beyond the window, the most
    important first, then the least important ones until the token budget holds, never the newest."""
    turns = [*w.active, turn]
    weight = lambda t: t.faded(turn.number, s.decay)
    beyond = turns[: max(0, len(turns) - s.window_turns)]
    within = turns[len(beyond) :]
    weakest = sorted(within[:-1], key=weight)
    excess = sum(t.tokens for t in within) - s.max_window_tokens
    # Of the turns by rising weight as few as bring the sum down to the budget.
    freed = list(accumulate((t.tokens for t in weakest), initial=0))
    out = weakest[: bisect_left(freed, excess)] if excess > 0 else []
    w.active = [t for t in within if t not in out]
    if beyond or out:
        w.leave(sorted(beyond, key=weight, reverse=True) + out, s.summary_max_tokens)
    return [t.number for t in (*beyond, *out)]


def context(w: Window_) -> str:
    """Summary and window as text."""
    names = {"user": "患者", "assistant": "医师"}
    lines = [f"{names.get(t.role, '系统')}: {t.text}" for t in w.active]
    return "\n\n".join(([f"【历史摘要】{w.summary}"] if w.summary else []) + (["\n".join(["【近期对话】", *lines])] if lines else []))


def turn_of(number: int, role: str | None, text: str, found: list, c: Lexicon) -> Turn:
    return Turn(number, role or "", text, lx.python_importance(found, c), python_tokens(text), bool(found))


REPLAY = "session string, turn int, compressed array<int>, n_active int, active_tokens int, n_compressed int, summary string, context string"


def replay(turns: DataFrame, lexicon: DataFrame, s: ShortTerm | None = None, c: Lexicon | None = None) -> DataFrame:
    """The short-term memory after each turn of each session. Null texts count as empty turns;
    re-sent turns count once."""
    s, c = s or ShortTerm(), c or Lexicon()
    shared = turns.sparkSession.sparkContext.broadcast(lx.matcher(lexicon, c))

    def step(w: Window_, row: dict) -> list[tuple]:
        text = row["text"] or ""
        found = shared.value.find(text)
        gone = add_turn(w, turn_of(int(row["turn"]), row["role"], text, found, c), s)
        return [(row["session"], int(row["turn"]), gone, len(w.active), w.tokens, w.compressed, w.summary, context(w))]

    return fold(latest_turns(turns).select("session", "turn", "role", "text"), "session", ["turn"], REPLAY, Window_, step)


def window_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """Turns with whether they are among the last n of their session."""
    place = Window.partitionBy("session").orderBy(F.desc("turn"))
    return latest_turns(turns).withColumn("active", F.row_number().over(place) <= n)


def recent_entities(turns: DataFrame, last_n: int = 3, role: str | None = None) -> DataFrame:
    """session, type, terms: distinct terms of the last n turns of a role, or the last 2n of all, first seen first."""
    t = latest_turns(turns)
    t = t.where(F.col("role") == role) if role else t
    place = Window.partitionBy("session").orderBy(F.desc("turn"))
    near = t.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= (last_n if role else 2 * last_n)).where("entities is not null")
    words = near.select("session", "turn", F.explode("entities").alias("type", "terms")).select("session", "turn", "type", F.posexplode("terms").alias("at", "term"))
    first = words.groupBy("session", "type", "term").agg(F.min(F.struct("turn", "at")).alias("_f"))
    return first.groupBy("session", "type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "term"))), lambda x: x["term"]).alias("terms"))


# ---------------------------------------------------------------- long-term memory
RECORD = "struct<id:string,content:string,importance:double,status:string,hits:int,source:string,conflicts:string,embedding:array<float>>"
WRITES = f"key string, seq long, action string, record_id string, importance double, similarity double, reason string, n_active int, changed array<{RECORD}>"


class Facts:
    """The records of one key. Active ones are rows of one matrix; what is superseded leaves it.

    A key holds no two records that are nearly equal, as these are merged: its state grows with
    the different facts told under it, about two kilobytes each, not with what is told.
    """

    def __init__(self, dim: int):
        self.records: list[dict] = []
        self.matrix = np.zeros((16, dim))

    def __len__(self) -> int:
        return len(self.records)

    def put(self, k: int, record: dict, vector: np.ndarray) -> None:
        if k == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[k] = vector
        self.records[k : k + 1] = [record]

    def drop(self, k: int) -> dict:
        n = len(self)
        self.matrix[k : n - 1] = self.matrix[k + 1 : n]
        return self.records.pop(k)

    def nearest(self, vector: np.ndarray, count: int) -> list[tuple[float, int]]:
        """Similarity and place of the nearest records, the earlier of equals first."""
        like = self.matrix[: len(self)] @ vector
        few = np.argpartition(-like, count - 1)[:count] if len(like) > count else np.arange(len(like))
        # All that are as near as the last of these take part in the order.
        few = np.flatnonzero(like >= like[few].min()) if len(few) else few
        return [(float(like[k]), int(k)) for k in sorted(few, key=lambda k: (-like[k], k))][:count]

    def shown(self, k: int) -> dict:
        return {**self.records[k], "embedding": self.matrix[k].astype(np.float32)}


def _noted(record: dict, why: str, how: str) -> None:
    record["conflicts"] = json.dumps([*json.loads(record["conflicts"] or "[]"), {"reason": why, "resolution": how}], ensure_ascii=False)


def write_fact(facts: Facts, key: str, seq: int, content: str, source: str, weight: float, vector: np.ndarray, judge: nli.Judge, p: LongTerm) -> tuple:
    """One write: rejected, merged into a near copy, decided against a contradicting fact, or
    inserted. Gives the action and the records that it changed, as they are now."""
    told = lambda action, record=None, like=None, why=None, changed=(): (
        key, seq, action, record and record["id"], weight if content else 0.0, None if like is None else round(like, 4), why, len(facts), list(changed),
    )
    if not content or weight < p.write_importance:
        return told("rejected_low_importance", why=None if content else "empty_content")
    near = facts.nearest(vector, p.neighbours)
    best = near[0][0] if near else None
    if near and best >= p.merge_similarity:
        k = near[0][1]
        old = facts.records[k]
        facts.put(k, {**old, "hits": old["hits"] + 1, "importance": max(old["importance"], weight), "content": max(old["content"], content, key=len)}, vector)
        return told("merged", old, best, changed=[facts.shown(k)])
    new = {"id": "mem_" + hashlib.md5(f"{key}\x1f{content}\x1f{seq}".encode()).hexdigest()[:10], "content": content, "importance": weight, "status": "active", "hits": 0, "source": source, "conflicts": "[]"}
    verdicts = ((like, k, *judge.judge(facts.records[k]["content"], content)) for like, k in near if like >= p.candidate_similarity)
    against = next(((like, k, why) for like, k, label, _, why in verdicts if label == "contradiction"), None)
    if against is None:
        facts.put(len(facts), new, vector)
        return told("inserted", new, best, changed=[facts.shown(len(facts) - 1)])
    like, k, why = against
    old = facts.records[k]
    if p.policy == "newer_wins" or (p.policy == "importance_wins" and weight >= old["importance"]):
        _noted(old, why, "superseded_by_new"), _noted(new, why, "supersedes_old")
        gone = {**facts.shown(k), "status": "superseded"}
        facts.drop(k)
        facts.put(len(facts), new, vector)
        return told("conflict_superseded", new, like, why, [gone, facts.shown(len(facts) - 1)])
    _noted(old, why, "kept_old")
    return told("conflict_rejected", old, like, why, [facts.shown(k)])


def write_all(facts: DataFrame, lexicon: DataFrame, p: LongTerm | None = None, c: Lexicon | None = None, encoder: Encoder | None = None, known: DataFrame | None = None) -> DataFrame:
    """The action of each write (key, seq, content, source), in order of seq within its key, and
    the records it changed.

    known: records of an earlier time (key and the fields of a record); the writes of a key go on
    from its active ones. Null contents are rejected like empty ones.
    """
    p, c = p or LongTerm(), c or Lexicon()
    e = create_encoder(encoder)
    shared = facts.sparkSession.sparkContext.broadcast(lx.matcher(lexicon, c))
    judges: dict[int, nli.Judge] = {}

    def step(state: Facts, row: dict) -> list[tuple]:
        if (old := row["record"]) is not None:
            vector = np.asarray(old["embedding"], np.float64)
            state.put(len(state), {k: old[k] for k in ("id", "content", "importance", "status", "hits", "source", "conflicts")}, vector)
            return []
        judge = judges.setdefault(0, nli.Judge(shared.value))
        text = (row["content"] or "").strip()
        weight = lx.python_importance(shared.value.find(text), c)
        return [write_fact(state, row["key"], int(row["seq"]), text, row["source"] or "", weight, e.encode([text])[0], judge, p)]

    given = facts.where("key is not null and seq is not null").select(F.col("key").cast("string").alias("key"), F.lit(1).alias("later"), F.col("seq").cast("long").alias("seq"), "content", "source", F.lit(None).cast(RECORD).alias("record"))
    if known is not None:
        fields = [f.split(":")[0] for f in RECORD[len("struct<") : -1].replace("array<float>", "array").split(",")]
        fit = known.where((F.col("status") == "active") & (F.size("embedding") == e.dim)).select("key", F.struct(*fields).cast(RECORD).alias("record"))
        fit = fit.join(given.select("key").distinct(), "key", "left_semi")
        given = given.unionByName(fit.select("key", F.lit(0).alias("later"), F.lit(0).cast("long").alias("seq"), F.col("record.id").alias("content"), F.lit("").alias("source"), "record"))
    return fold(given, "key", ["later", "seq", "content"], WRITES, lambda: Facts(e.dim), step)


def records_of(writes: DataFrame) -> DataFrame:
    """The records that writes left behind, each in its last state: key, fields of a record, seq."""
    each = writes.select("key", "seq", F.explode("changed").alias("r")).select("key", "seq", "r.*")
    last = Window.partitionBy("key", "id").orderBy(F.desc("seq"))
    return each.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def recall_of_key(queries: DataFrame, records: DataFrame, k: int = 3) -> DataFrame:
    """query_id, id, content, score, rank: of the active records of a query's own key the most
    similar, weighted by importance. queries: query_id, key, embedding."""
    asked = queries.where("query_id is not null and key is not null").select("query_id", "key", F.col("embedding").alias("_q"))
    mine = records.where("status = 'active'").select("key", "id", "content", "importance", F.col("embedding").alias("_r"))
    product = F.aggregate(F.zip_with("_q", "_r", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = asked.join(mine, "key").where(F.size("_q") == F.size("_r")).withColumn("score", F.round(F.greatest(product, F.lit(0.0)) * (0.75 + 0.25 * F.coalesce("importance", F.lit(0.0))), 4))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "content", "score", "rank")


def latest_records(memories: DataFrame) -> DataFrame:
    """One row for each memory, the last updated."""
    order = Window.partitionBy("id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("hits"), "content")
    return memories.where("id is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def recall(queries: DataFrame, memories: DataFrame, now: str, k: int = 3, block: int = 5000) -> DataFrame:
    """query_id, id, score, rank: similarity, weighted by importance and by how recent a memory is.

    queries: query_id, embedding. memories: id, embedding, importance, updated_at, status; only
    active ones with a vector of the queries' size take part. now is a timestamp, so that the
    result is the same whenever it is computed. A null importance counts as 0.
    """
    spark = memories.sparkSession
    fit = memories.where("status = 'active' and embedding is not null").withColumn("_ok", F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))).where("_ok")
    days = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))) / F.lit(86400e6)
    weight = (0.75 + 0.25 * F.coalesce("importance", F.lit(0.0))) * (0.85 + 0.15 * F.coalesce(1 / (1 + days / 7), F.lit(0.0)))
    ready = fit.select("id", "embedding", weight.alias("weight"))
    qtype = dict(queries.dtypes)["query_id"]
    given = queries.where("query_id is not null and embedding is not null").select("query_id", "embedding").dropDuplicates(["query_id"])
    out = None
    for start in range(0, given.count(), block):
        part = given.orderBy("query_id").offset(start).limit(block).toPandas()
        dim = int(part["embedding"].map(len).mode()[0])
        part = part[part["embedding"].map(len) == dim]
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(), np.stack(part["embedding"].to_numpy()).astype(np.float64)))

        def search(batches: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                batch = batch[batch["embedding"].map(len) == dim]
                if not len(batch):
                    continue
                x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                scores = np.round(np.maximum(matrix @ x.T, 0.0) * batch["weight"].to_numpy(), 4)
                n = min(k, len(batch))
                for q, line in zip(ids, scores, strict=True):
                    at = np.flatnonzero(line >= np.partition(line, len(line) - n)[len(line) - n])
                    yield pd.DataFrame({"query_id": [q] * len(at), "id": batch["id"].to_numpy()[at], "score": line[at]})

        found = ready.mapInPandas(search, f"query_id {qtype}, id string, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"query_id {qtype}, id string, score double, rank int")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def context_lines(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """query_id, block: the recalled memories of each query as text."""
    j = hits.join(memories.select("id", "content", "importance", "hits"), "id")
    line = F.format_string("- %s（重要度%.2f，命中%d次）", "content", F.coalesce("importance", F.lit(0.0)), F.coalesce("hits", F.lit(0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"])
    return j.groupBy("query_id").agg(F.concat(F.lit("【长期记忆】\n"), F.array_join(lines, "\n")).alias("block"))


def candidates(messages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """key, seq, content, source: sentences of user messages worth keeping (with a known term), at most four a message."""
    from quillmere.functions import text as tx

    parts = latest_turns(messages).where("role = 'user' and text is not null").select("session", "turn", F.posexplode(tx.split_sentences("text")).alias("at", "content")).withColumn("_e", lx.entities(lexicon, "content")).where(F.size("_e") > 0)
    place = Window.partitionBy("session", "turn").orderBy("at")
    return parts.withColumn("_r", F.row_number().over(place)).where("_r <= 4").select(F.col("session").alias("key"), (F.col("turn") * 4 + F.col("_r") - 1).cast("long").alias("seq"), "content", F.concat_ws("#", "session", "turn").alias("source"))
