"""One object for the whole: build an index from documents, load it, search, answer, remember."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.config import Config
from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx
from quillmere.operators import agent, chunking, memory, ocr, retrieval, store
from quillmere.operators.embedding import Encoder, create_encoder, encode
from quillmere.operators.index import TermIndex
from quillmere.operators.lexicon import unique_terms
from quillmere.session import cut, share
from quillmere.sources import sinks

#: Longest texts that are taken as a message or a query, and the most results of a search.
MESSAGE, QUERY, RESULTS = 2000, 500, 30
#: What is stored of a turn.
TURN = ("session", "turn", "role", "text", "entities", "received_at")


class Engine:
    """Tables of one index: chunks (with vectors), lexicon, memories, turns."""

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None, encoder: Encoder | None = None):
        share(spark)
        self.spark, self.folder, self.config = spark, folder, config or Config()
        self.encoder = create_encoder(encoder, self.config.retrieval.embedding_dim)

    def build(self, documents: DataFrame, lexicon: DataFrame) -> DataFrame:
        """Cleans, chunks, encodes and stores; gives the manifest. Stored tables of an earlier build are replaced."""
        terms = unique_terms(lexicon)
        sinks.write(terms, self.folder, "lexicon")
        cleaned = ocr.clean(documents.where("text is not null"), "text", terms)
        made = chunking.chunk(cleaned.select("doc_id", "title", F.col("clean_text").alias("text"), "source_type", "source_path", "meta"), self.config.chunking)
        sinks.write(encode(made, "text", self.encoder), self.folder, "chunks")
        sinks.write(documents.select("doc_id", "title", "text", "source_type", "source_path", "meta"), self.folder, "documents")
        TermIndex.build(self.chunks, self.lexicon if self.config.retrieval.whole_terms else None).save(self.folder)
        found = store.manifest(self.chunks)
        sinks.write(found, self.folder, "manifest")
        sinks.write(store.counts(self.chunks), self.folder, "counts")
        return found

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks")

    @property
    def lexicon(self) -> DataFrame:
        return self._table("lexicon")

    @property
    def index(self) -> TermIndex:
        return TermIndex.load(self.spark, self.folder)

    def _stored(self, name: str) -> DataFrame | None:
        """A table that may not have been written yet."""
        try:
            return self._table(name)
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return None

    @property
    def memories(self) -> DataFrame | None:
        """Records of long-term memory by key, of all sessions so far."""
        return self._stored("memories")

    def session(self, session: str) -> DataFrame | None:
        """The stored turns of a session in order, or None where nothing is stored."""
        told = self._stored("turns")
        return None if told is None else told.where(F.col("session") == session).orderBy("turn")

    def _asked(self, texts: list[str] | DataFrame, longest: int) -> DataFrame:
        if isinstance(texts, DataFrame):
            return texts
        for t in texts:
            if not 1 <= len(t) <= longest:
                raise ValueError(f"a text must have 1 to {longest} characters")
        return self.spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "query_id string, text string")

    def search(self, queries: list[str] | DataFrame, mode: str = "full", top: int | None = None) -> DataFrame:
        if top is not None and not 0 <= top <= RESULTS:
            raise ValueError(f"top must be 0 to {RESULTS}")
        return retrieval.retrieve(self._asked(queries, QUERY), self.chunks, self.lexicon, mode, top, self.config, self.encoder, self.index)

    def answer(self, questions: list[str] | DataFrame, mode: str = "react", recent: DataFrame | None = None) -> DataFrame:
        if mode not in ("react", "static"):
            raise ValueError("mode must be react or static")
        return agent.answer(self._asked(questions, MESSAGE), self.chunks, self.lexicon, self.config, mode, recent, self.encoder, self.index)

    def chat(self, turns: DataFrame, mode: str = "react") -> DataFrame:
        """Answers the last user turn of each session, with terms of its earlier turns, stored or
        given, and with what is remembered of it (memories); then stores the turns, the answer as
        a turn of the assistant, and the facts worth keeping of both."""
        given = memory.latest_turns(turns.select(*TURN))
        before = self._stored("turns")
        told = given if before is None else store.upsert(before.select(*TURN).join(given.select("session").distinct(), "session", "left_semi"), given, ["session", "turn"], "received_at")
        last = given.where("role = 'user' and text is not null").groupBy("session").agg(F.max(F.struct("turn", "text")).alias("m"))
        asked = cut(last.select(F.col("session").alias("query_id"), F.col("m.text").alias("text"), F.col("m.turn").alias("turn")))
        of = lambda role, n: memory.recent_entities(told, n, role).groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("type", "terms"))).alias(role))
        recent = of("assistant", 1).join(of("user", 2), "session", "full").withColumnRenamed("session", "query_id")
        done = self.answer(asked.select("query_id", "text"), mode, recent)
        if (known := self.memories) is not None:
            queries = encode(asked, "text", self.encoder, is_query=True).select("query_id", F.col("query_id").alias("key"), "embedding")
            hits = memory.recall_of_key(queries, known, self.config.long_term.recall_top_k)
            done = done.join(hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("memories")), "query_id", "left")
        else:
            done = done.withColumn("memories", F.lit(None).cast("array<string>"))
        done = cut(done.withColumn("memories", F.coalesce("memories", F.array().cast("array<string>"))))
        replies = done.join(asked.select("query_id", "turn"), "query_id").withColumn("_e", lx.entities(self.lexicon, "answer")).select(
            F.col("query_id").alias("session"), (F.col("turn") + 1).cast("int").alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"),
            lx.by_type(F.col("_e")).alias("entities"), F.lit(None).cast("timestamp").alias("received_at"),
        )
        facts = done.where("not refused and size(claims) > 0").join(asked.select("query_id", "turn"), "query_id").select(
            F.col("query_id").alias("key"), (F.col("turn").cast("long") * 8 + 4).alias("seq"), F.col("claims")[0].alias("content"), F.concat_ws("#", "query_id", F.col("turn") + 1).alias("source")
        )
        self.remember(given.select(*TURN).unionByName(replies), facts)
        return done

    def remember(self, turns: DataFrame, facts: DataFrame | None = None) -> str:
        """Stores turns over those of the same session and number, and writes the facts of user
        turns, and those given, to long-term memory: its records, and a log of what was done."""
        own = memory.candidates(turns, self.lexicon).withColumn("seq", F.floor(F.col("seq") / 4) * 8 + F.col("seq") % 4)
        own = own if facts is None else own.unionByName(facts)
        done = cut(memory.write_all(own, self.lexicon, self.config.long_term, self.config.lexicon, self.encoder, self.memories))
        sinks.upsert_table(memory.latest_turns(turns.select(*TURN)), self.folder, "turns", ["session", "turn"], "received_at")
        sinks.write(done.drop("changed"), self.folder, "memory_writes", "append")
        return sinks.upsert_table(memory.records_of(done), self.folder, "memories", ["key", "id"], "seq")

    def reset_session(self, session: str) -> str:
        return sinks.delete_rows(self.spark.createDataFrame([(session,)], "session string"), self.folder, "turns", "session")

    def health(self) -> dict[str, int | str]:
        return {"status": "ok", "chunks": self.chunks.count(), "terms": self.lexicon.count(), "tokens": self.chunks.agg(F.sum(tx.count_tokens("text"))).first()[0] or 0}
