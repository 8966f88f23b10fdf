"""Documents from files: Markdown, text, textbook JSON, question records, PDF; and stored tables.

Every reader gives doc_id, title, text, source_type, source_path, meta (a map of strings).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as tx

DOCUMENT = ["doc_id", "title", "text", "source_type", "source_path", "meta"]
TEXTBOOK = "book string, source_type string, chapters array<struct<title:string,records:array<struct<term:string,fields:map<string,string>>>>>"
QA = "id string, question string, answer string, label string, related_diseases string, score int"
EVAL = "qid string, question string, gold_chunk_ids array<string>, item_type string, reference_answer string, meta map<string,string>"


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _path(path: Column) -> Column:
    """The path itself, as a local path is written without its scheme."""
    return F.url_decode(F.regexp_replace(F.replace(path, F.lit("+"), F.lit("%2B")), r"^file:/{1,3}(?=/|\w)", "/"))


def doc_id(path: Column) -> Column:
    """File name and the head of the path's MD5."""
    return F.concat(_stem(path), F.lit("_"), F.substring(F.md5(path), 1, 6))


def inferred_type(path: Column, pdf: bool = False) -> Column:
    """What a folder says about a file: scanned, a case, or a classic."""
    parts = F.split(path, "/")
    if pdf:
        return F.when(F.array_contains(parts, "pdf") | F.array_contains(parts, "ocr"), "ocr_scan").otherwise("pdf")
    return F.when(F.array_contains(parts, "ocr"), "ocr_scan").when(F.array_contains(parts, "cases"), "case").otherwise("classic")


def _glob(names: str) -> dict[str, str]:
    return {"recursiveFileLookup": "true", "pathGlobFilter": names}


def _kept(df: DataFrame) -> DataFrame:
    """Without helper files: names that start with an underscore, and the ground truth of simulated noise."""
    name = F.regexp_extract("source_path", r"([^/]+)$", 1)
    return df.where(~name.startswith("_") & (name != "ground_truth.json"))


def _whole(spark: SparkSession, folder: str, names: str, source_type: str | None, meta: dict[str, str] | None) -> DataFrame:
    raw = spark.read.options(**_glob(names)).text(folder, wholetext=True).select(F.col("value").alias("text"), _path(F.col("_metadata.file_path")).alias("source_path"))
    extra = F.create_map(*[F.lit(x) for pair in (meta or {}).items() for x in pair]).cast("map<string,string>") if meta else F.create_map().cast("map<string,string>")
    kind = F.lit(source_type) if source_type else inferred_type(F.col("source_path"))
    return _kept(raw).select(doc_id(F.col("source_path")).alias("doc_id"), _stem(F.col("source_path")).alias("title"), "text", kind.alias("source_type"), "source_path", extra.alias("meta"))


def markdown(spark: SparkSession, folder: str, source_type: str | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """One document for each file; its title is the first line that starts with one hash and a space."""
    docs = _whole(spark, folder, "*.{md,markdown,MD}", source_type, meta)
    named = F.trim(F.regexp_extract("text", r"(?m)^# (.*)$", 1))
    return docs.withColumn("title", F.when(F.col("text").rlike(r"(?m)^# "), named).otherwise(F.col("title")))


def text_files(spark: SparkSession, folder: str, source_type: str | None = "classic", meta: dict[str, str] | None = None) -> DataFrame:
    return _whole(spark, folder, "*.{txt,TXT}", source_type, meta)


def textbooks(spark: SparkSession, folder: str) -> DataFrame:
    """Books of chapters of entries with fields, flattened into text with headings."""
    raw = spark.read.options(**_glob("*.{json,JSON}")).option("multiLine", "true").schema(TEXTBOOK).json(folder).select("*", _path(F.col("_metadata.file_path")).alias("source_path"))
    raw = _kept(raw).where("chapters is not null or book is not null")
    fields = lambda r: F.transform(F.map_entries(r["fields"]), lambda e: F.concat(F.lit("【"), e["key"], F.lit("】"), F.coalesce(e["value"], F.lit("None"))))
    entry = lambda r: F.concat(F.array(F.concat(F.lit("### "), F.coalesce(r["term"], F.lit("未命名条目"))), F.lit("")), F.coalesce(fields(r), F.array().cast("array<string>")), F.array(F.lit("")))
    chapter = lambda c: F.concat(F.array(F.concat(F.lit("## "), F.coalesce(c["title"], F.lit("未分章"))), F.lit("")), F.flatten(F.transform(F.coalesce(c["records"], F.array()), entry)))
    chapters = F.coalesce("chapters", F.array())
    book = F.coalesce("book", _stem(F.col("source_path")))
    lines = F.concat(F.array(F.concat(F.lit("# "), book), F.lit("")), F.flatten(F.transform(chapters, chapter)))
    n_records = F.aggregate(chapters, F.lit(0), lambda a, c: a + F.coalesce(F.size(c["records"]), F.lit(0)))
    meta = F.create_map(F.lit("n_chapters"), F.size(chapters).cast("string"), F.lit("n_records"), n_records.cast("string"))
    return raw.select(doc_id(F.col("source_path")).alias("doc_id"), book.alias("title"), F.array_join(lines, "\n").alias("text"), F.coalesce("source_type", F.lit("textbook")).alias("source_type"), "source_path", meta.alias("meta"))


def textbook_terms(spark: SparkSession, folder: str, kinds: dict[str, str]) -> DataFrame:
    """term, type of all entries, by the kind a book stands for."""
    raw = spark.read.options(**_glob("*.json")).option("multiLine", "true").schema(TEXTBOOK).json(folder)
    kind = F.coalesce(F.create_map(*[F.lit(x) for pair in (kinds or {"": "other"}).items() for x in pair])[F.col("book")], F.lit("other"))
    return raw.select(kind.alias("type"), F.explode("chapters").alias("c")).select("type", F.explode("c.records").alias("r")).select(F.trim("r.term").alias("term"), "type").where("term is not null")


def questions_to_documents(rows: DataFrame, source_path: str | None = None) -> DataFrame:
    """Question records (id, question, answer, label, related_diseases, score) as documents.
    Records without an id, a question or an answer are left out: line numbers mean nothing on a cluster."""
    q, a = tx.strip(F.col("question")), tx.strip(F.col("answer"))
    title = F.concat(F.substring(q, 1, 24), F.when(F.length(q) > 24, "…").otherwise(""))
    meta = F.map_from_arrays(F.array(*map(F.lit, ["label", "related_diseases", "score", "question", "answer"])), F.array(F.coalesce("label", F.lit("")), F.coalesce("related_diseases", F.lit("")), F.coalesce(F.col("score").cast("string"), F.lit("0")), q, a))
    return rows.where("id is not null and question is not null and answer is not null").select(
        F.concat(F.lit("qa_"), F.col("id").cast("string")).alias("doc_id"), title.alias("title"), F.concat(F.lit("# 医案问答："), title, F.lit("\n\n【患者问】"), q, F.lit("\n\n【医师答】"), a, F.lit("\n")).alias("text"),
        F.lit("qa").alias("source_type"), F.lit(source_path).alias("source_path"), meta.alias("meta"),
    )


def question_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines; lines that are no record are skipped."""
    return spark.read.schema(QA).option("mode", "DROPMALFORMED").json(path).where("id is not null or question is not null")


def selected_questions(rows: DataFrame, label: str, n: int, seed: int = 42, least_score: int = 4, least_answer: int = 60, least_question: int = 8) -> DataFrame:
    """n records of a label that are good and long enough, drawn by hash."""
    fit = rows.where((F.col("label") == label) & (F.col("score") >= least_score) & (F.length(F.trim("answer")) >= least_answer) & (F.length(F.trim("question")) >= least_question))
    return fit.dropDuplicates(["id"]).orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col("id").cast("string"))), "id").limit(n).select("id", "question", "answer", "score", "label", "related_diseases")


def pdf(spark: SparkSession, folder: str, source_type: str | None = None) -> DataFrame:
    """One document for each PDF, its pages under page headers. Needs pypdf on the workers."""
    raw = spark.read.format("binaryFile").options(**_glob("*.{pdf,PDF}")).load(folder).select(_path(F.col("path")).alias("source_path"), "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            texts = [[p.extract_text() or "" for p in PdfReader(io.BytesIO(c)).pages] for c in batch["content"]]
            yield pd.DataFrame({"source_path": batch["source_path"], "text": ["\n\n".join(f"〔第{k}页〕\n{t}" for k, t in enumerate(x, 1)) for x in texts], "n": [str(len(x)) for x in texts]})

    read = _kept(raw).mapInPandas(pages, "source_path string, text string, n string")
    kind = F.lit(source_type) if source_type else inferred_type(F.col("source_path"), pdf=True)
    return read.select(doc_id(F.col("source_path")).alias("doc_id"), _stem(F.col("source_path")).alias("title"), "text", kind.alias("source_type"), "source_path", F.create_map(F.lit("n_pages"), "n").alias("meta"))


READERS = {".md": markdown, ".markdown": markdown, ".txt": text_files, ".json": lambda s, f, t=None: textbooks(s, f), ".jsonl": lambda s, f, t=None: questions_to_documents(question_records(s, f), f), ".pdf": pdf}


def kinds_of(spark: SparkSession, folder: str) -> list[str]:
    """The file types of a folder and the folders below it; hidden files don't count."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract(F.lower("path"), r"/[^/]*?(\.[^./]+)$", 1).alias("kind"))
    return sorted(r["kind"] for r in names.distinct().limit(1000).collect())


def corpus(spark: SparkSession, folder: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """All documents of a folder and the folders below it, by file type. Without kinds all files
    are read; a type that no reader knows is an error, never passed over."""
    kinds = tuple(kinds_of(spark, folder)) if kinds is None else kinds
    unknown = [k for k in kinds if k not in READERS]
    if unknown or not kinds:
        raise ValueError(f"no reader for {unknown}" if unknown else f"no files in {folder}")
    out = None
    for make in dict.fromkeys(READERS[k] for k in kinds):
        part = make(spark, folder).select(*DOCUMENT)
        out = part if out is None else out.unionByName(part)
    return out


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of reports: JSON lines, or a file that is one object or list of objects."""
    return spark.read.option("multiLine", str(path.endswith(".json"))).json(path)


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL).json(path)


def lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """term, type from an object of kind to list of terms."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return raw.select(F.explode("m").alias("type", "terms")).select(F.explode("terms").alias("term"), "type").distinct()


def stored(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table written by the sinks, by its name."""
    return spark.read.parquet(f"{folder}/{name}")
