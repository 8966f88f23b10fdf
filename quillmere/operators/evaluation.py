"""Measures of retrieval and of answers, and the building of evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.operators import lexicon as lx
from quillmere.operators import nli


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 5, 10, 30), strict_top1: bool = False) -> DataFrame:
    """One row for each query of qrels: recall_k, precision_k, hit_k, mrr, top1, context_precision, context_recall.

    ranked: query_id, rank, chunk_id. qrels: query_id, chunk_id. Only queries with a gold chunk
    are measured. Precision divides by k however few were found. top1 is null for a query
    without results (0 where strict), as it is left out of means then.
    """
    gold = qrels.where("chunk_id is not null").select("query_id", "chunk_id").distinct()
    n_gold = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    flagged = ranked.select("query_id", "rank", "chunk_id").join(gold.withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = flagged.withColumn("so_far", F.sum("hit").over(upto))
    sums = [F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"_n{k}") for k in ks]
    per = flagged.groupBy("query_id").agg(
        *sums, F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("_first"), F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("_one"),
        F.avg(F.when(F.col("hit") == 1, F.col("so_far") / F.col("rank"))).alias("_cp"), F.sum("hit").alias("_hits"),
    )
    j = n_gold.join(per, "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns: list[Column] = [F.col("query_id")]
    for k in ks:
        columns += [(zero(f"_n{k}") / F.col("n_gold")).alias(f"recall_{k}"), (zero(f"_n{k}") / F.lit(float(k))).alias(f"precision_{k}"), (zero(f"_n{k}") > 0).cast("int").alias(f"hit_{k}")]
    one = F.col("_one").cast("double")
    columns += [F.coalesce(1.0 / F.col("_first"), F.lit(0.0)).alias("mrr"), (F.coalesce(one, F.lit(0.0)) if strict_top1 else one).alias("top1"), F.coalesce("_cp", F.lit(0.0)).alias("context_precision"), (zero("_hits") / F.col("n_gold")).alias("context_recall")]
    return j.select(*columns)


def mean_metrics(per_query: DataFrame, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Means of all measures, nulls left out, overall or by columns, with the number of queries."""
    measures = [c for c, t in per_query.dtypes if c not in {"query_id", *(by or [])} and t in ("double", "int", "bigint", "float")]
    return per_query.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[F.round(F.avg(c), digits).alias(c) for c in measures])


def latency(df: DataFrame, value: str, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """p50, p95, p99 (interpolated), mean and max."""
    p = lambda q: F.round(F.percentile(value, q), digits)
    return df.groupBy(*(by or [])).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg(value), digits).alias("mean"), F.round(F.max(value), digits).alias("max"))


def faithfulness(answers: DataFrame, lexicon: DataFrame, overlap: float = 0.30) -> DataFrame:
    """query_id, n_claims, n_supported, faithfulness of answers (query_id, answer, context).

    A claim is supported if enough of its pairs and all of its terms stand in the context and
    the two don't contradict each other. Without a claim a blank answer has 1, another one 0.
    """
    parts = answers.select("query_id", "answer", "context", F.explode_outer(tx.claims("answer")).alias("claim"))
    judged = nli.judge_pairs(parts, lexicon, "context", "claim").withColumn("_e", lx.entity_texts(lx.entities(lexicon, "claim")))
    supported = (tx.coverage(tx.bigrams("claim"), tx.bigrams("context")) >= overlap) & F.forall("_e", lambda e: F.contains(F.col("context"), e)) & (F.col("label") != "contradiction")
    per = judged.groupBy("query_id").agg(F.count("claim").alias("n_claims"), F.count_if(F.coalesce(supported, F.lit(False))).alias("n_supported"), F.max(tx.strip(F.col("answer"))).alias("_a"))
    return per.select("query_id", "n_claims", "n_supported", F.when(F.col("n_claims") > 0, F.round(F.col("n_supported") / F.col("n_claims"), 4)).when(F.coalesce(F.col("_a"), F.lit("")) == "", 1.0).otherwise(0.0).alias("faithfulness"))


def relevancy(question: str, answer: str, entities: str) -> Column:
    """Share of a question's tokens (times .6) and terms (times .4) that an answer holds; 0 for a blank one."""
    words = F.array_distinct(F.filter(tx.tokens(question), lambda t: F.length(t) >= 2))
    tokens = tx.coverage(words, tx.tokens(answer))
    terms = F.when(F.size(entities) > 0, F.size(F.filter(entities, lambda e: F.contains(F.col(answer), e))) / F.size(entities)).otherwise(tokens)
    return F.when(tx.strip(F.col(answer)) == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.6 * tokens + 0.4 * terms), 4))


def answer_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates over evaluated answers (item_type, refused, gold_hit, faithfulness, context_precision,
    context_recall, relevancy, rounds_used, confidence): refusals where they are right and where not,
    confident answers without a gold chunk, and means."""
    can, answered = F.col("item_type") != "unanswerable", (F.col("item_type") != "unanswerable") & ~F.col("refused")
    share = lambda what, of: F.round(F.try_divide(F.count_if(what & of), F.count_if(of)), 4)
    mean = lambda c, of: F.round(F.avg(F.when(of, F.col(c))), 4)
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_items"), mean("faithfulness", answered).alias("faithfulness"), mean("context_precision", can).alias("context_precision"), mean("context_recall", can).alias("context_recall"), mean("relevancy", answered).alias("answer_relevancy"),
        share(F.col("refused"), ~can).alias("refusal_accuracy"), share(F.col("refused"), can).alias("over_refusal"), share(~F.coalesce("gold_hit", F.lit(True)), answered).alias("false_confidence"),
        F.round(F.avg("rounds_used"), 2).alias("avg_rounds"), F.round(F.avg("confidence"), 4).alias("avg_confidence"),
    )


def records(chunks: DataFrame) -> DataFrame:
    """Chunks with the entry they belong to: record_key, book, term, source_type, chunk_id, seq, text.

    An entry is a title path of a document, or a whole question record. Entries may be of any
    size, so their chunks stay rows; what holds for an entry comes from its first chunk.
    """
    qa = F.col("source_type") == "qa"
    path = F.coalesce("title_path", F.array().cast("array<string>"))
    keyed = chunks.withColumn("_p", path).withColumn("record_key", F.when(qa, F.col("doc_id")).otherwise(F.concat_ws("|", "doc_id", F.array_join(path, ">"))))
    first = keyed.groupBy("record_key").agg(F.min(F.struct("seq", "chunk_id", F.col("_p").alias("path"), "source_type", "doc_id", F.col("meta")["doc_title"].alias("title"))).alias("_f"))
    p, is_qa = F.col("_f.path"), F.col("_f.source_type") == "qa"
    head = F.coalesce(F.try_element_at(p, F.lit(1)), F.lit(""))
    named = first.select("record_key", F.when(is_qa, "医案问答").otherwise(head).alias("book"), F.when(is_qa, F.coalesce("_f.title", "_f.doc_id")).when(F.size(p) >= 2, F.try_element_at(p, F.lit(-1))).otherwise(head).alias("term"))
    return keyed.select("record_key", "source_type", "chunk_id", "seq", "text").join(named, "record_key")


# Question templates of entries, by the kind of term, with the field they ask for.
TEMPLATES = [("herb", "{}的性味归经是什么？", "性味"), ("herb", "{}怎么炮制？", "炮制"), ("formula", "{}由哪些药组成？", "组成"), ("formula", "{}主治什么？", "主治"), ("disease", "{}的病因病机是什么？", "病机"), ("pattern", "{}有哪些主要表现？", "表现"), ("symptom", "{}怎么调理？", "调理")]


def build_items(entries: DataFrame, lexicon: DataFrame, seed: int = 42) -> DataFrame:
    """Evaluation items from entries as rows of gold: record_key, question, item_type, chunk_id.

    The first known term of an entry is asked for with a template that the entry can answer,
    drawn by hash. If just one chunk holds the field asked for, it alone is gold, else all are.
    """
    spark = entries.sparkSession
    templates = spark.createDataFrame([(k, t, f, n) for n, (k, t, f) in enumerate(TEMPLATES)], "type string, template string, field string, number int")
    found = entries.withColumn("_e", lx.entities(lexicon, "text")).where(F.size("_e") > 0)
    terms = found.groupBy("record_key").agg(F.min(F.struct("seq", "chunk_id", F.col("_e")[0].alias("e"))).alias("_f")).select("record_key", F.col("_f.e.text").alias("entity"), F.col("_f.e.type").alias("type"))
    fields = F.broadcast(spark.createDataFrame([(f,) for f in sorted({f for _, _, f in TEMPLATES})], "field string"))
    holds = entries.join(fields, F.contains(entries["text"], F.col("field"))).groupBy("record_key", "field").agg(F.count("*").alias("n_holding"))
    joined = terms.join(F.broadcast(templates), "type").join(holds, ["record_key", "field"], "left")
    pick = Window.partitionBy("record_key").orderBy(F.desc(F.col("n_holding").isNotNull()), F.md5(F.concat_ws("#", F.lit(str(seed)), "record_key", "number")))
    one = joined.withColumn("_r", F.row_number().over(pick)).where("_r = 1")
    asked = one.select("record_key", F.replace("template", F.lit("{}"), F.col("entity")).alias("question"), F.col("type").alias("item_type"), "field", "n_holding")
    gold = entries.select("record_key", "chunk_id", "text").join(asked, "record_key")
    return gold.where((F.coalesce("n_holding", F.lit(0)) != 1) | F.contains("text", F.col("field"))).select("record_key", "question", "item_type", "chunk_id")


# Questions of further kinds, with what is put into them.
FURTHER = {"classic": "“{}”一语出自哪部书？", "case": "{}的医案用了什么方药？", "diagnosis": "出现{}与{}，应辨为什么证？", "multi_hop": "{}中的{}起什么作用？"}


def further_items(entries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """More evaluation items as rows of gold (record_key, question, item_type, chunk_id).

    qa: a question record is asked for by its own title. classic and case: an entry of that
    source by its term. diagnosis: the chunks that name a pattern and two symptoms or more.
    multi_hop: chunks that name a formula and a herb, with the chunks of entries about the herb.
    Each entry is asked once of each kind, by its first chunk that serves.
    """
    found = entries.withColumn("_e", lx.entities(lexicon, "text"))
    named = lambda kind: F.array_distinct(F.transform(F.filter("_e", lambda e: e["type"] == kind), lambda e: e["text"]))
    found = found.select("record_key", "term", "source_type", "chunk_id", "seq", *[named(k).alias(k) for k in ("formula", "herb", "pattern", "symptom")])
    first = Window.partitionBy("record_key").orderBy("seq", "chunk_id")
    say = lambda kind, *what: F.format_string(FURTHER[kind].replace("{}", "%s"), *what)
    once = lambda df: df.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    own = lambda kind, question: once(found.where(F.col("source_type") == kind)).select("record_key", question.alias("question"), F.lit(kind).alias("item_type"), "chunk_id")
    told = once(found.where((F.size("pattern") > 0) & (F.size("symptom") > 1)))
    diagnosis = told.select("record_key", say("diagnosis", F.col("symptom")[0], F.col("symptom")[1]).alias("question"), F.lit("diagnosis").alias("item_type"), "chunk_id")
    hop = once(found.where((F.size("formula") > 0) & (F.size("herb") > 0))).select("record_key", say("multi_hop", F.col("formula")[0], F.col("herb")[0]).alias("question"), F.lit("multi_hop").alias("item_type"), "chunk_id", F.col("herb")[0].alias("_h"))
    about = entries.select(F.col("term").alias("_h"), F.col("chunk_id").alias("_c"))
    more = hop.join(about, "_h").select("record_key", "question", "item_type", F.col("_c").alias("chunk_id"))
    return own("qa", F.col("term")).unionByName(own("classic", say("classic", F.col("term")))).unionByName(own("case", say("case", F.col("term")))).unionByName(diagnosis).unionByName(hop.drop("_h")).unionByName(more).distinct()


def least_covered(questions: DataFrame, chunks: DataFrame, n: int, text: str = "question") -> DataFrame:
    """The n questions whose pairs of characters occur least in the corpus: the question and its overlap."""
    asked = questions.select("qid", F.explode(tx.bigrams(text)).alias("pair"))
    known = chunks.select(F.explode(tx.bigrams("text")).alias("pair")).distinct().withColumn("in_corpus", F.lit(1))
    share = asked.join(known, "pair", "left").groupBy("qid").agg(F.round(F.count("in_corpus") / F.count("*"), 4).alias("overlap"))
    return share.orderBy("overlap", "qid").limit(n)


def term_recall(truth: Column, text: Column, terms: Column) -> Column:
    """Share of the terms of a true text that another text has."""
    real = F.filter(terms, lambda t: F.contains(truth, t))
    return F.size(F.filter(real, lambda t: F.contains(text, t))) / F.greatest(F.size(real), F.lit(1))
