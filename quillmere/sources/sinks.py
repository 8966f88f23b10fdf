"""Tables, indexes and reports to files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import store
from quillmere.session import cut


def write(df: DataFrame, folder: str, name: str, mode: str = "overwrite", by: list[str] | None = None) -> str:
    """A table as Parquet, over an earlier one unless told otherwise; by names partition columns."""
    path = f"{folder}/{name}"
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def upsert_table(new: DataFrame, folder: str, name: str, key: str | list[str] = "chunk_id", at: str = "indexed_at") -> str:
    """Puts rows into a stored table, over rows of the same key. The result is checkpointed
    before the table is overwritten, as it is read from that table."""
    spark = new.sparkSession
    try:
        old = spark.read.parquet(f"{folder}/{name}")
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return write(store.latest(new, key, at), folder, name)
    return write(cut(store.upsert(old, new, key, at)), folder, name)


def delete_rows(keys: DataFrame, folder: str, name: str, key: str) -> str:
    """Takes rows of the given keys out of a stored table."""
    old = keys.sparkSession.read.parquet(f"{folder}/{name}")
    return write(cut(old.join(keys.select(key).distinct(), key, "left_anti")), folder, name)


def json_lines(df: DataFrame, path: str) -> str:
    """Rows as JSON lines; NaN becomes null, as JSON has no NaN."""
    clean = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    clean.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def lexicon_json(lexicon: DataFrame, path: str) -> str:
    """A lexicon as one object of kind to sorted terms. It is a bounded table."""
    one = lexicon.groupBy("type").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    whole = one.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "terms"))))).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)
    return path


def metric_index(metrics: dict[str, DataFrame]) -> DataFrame:
    """metric, label, value of several one-level metric tables, each with where it comes from."""
    out = None
    for origin, df in metrics.items():
        labels = [c for c, t in df.dtypes if t == "string"]
        values = [c for c, t in df.dtypes if t in ("double", "int", "bigint", "float")]
        entries = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]))
        part = df.select(F.lit(origin).alias("origin"), F.concat_ws("/", *labels).alias("label"), entries.alias("e")).select("origin", "label", "e.metric", "e.value")
        out = part if out is None else out.unionByName(part)
    return out


def markdown_report(title: str, tables: dict[str, DataFrame], limit: int = 200) -> str:
    """A report of small result tables; each may have at most limit rows, more are an error."""
    show = lambda v: "—" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)
    lines = [f"# {title}", ""]
    for name, df in tables.items():
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name} has more than {limit} rows")
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows), ""]
    return "\n".join(lines)
