"""Problem 7: mixing sources to target weights.

Method: hierarchical budgeting. The shares of a mix are weights of the leaves of a tree
domain - language - source; a budget is handed down by weight, no node gets more than its
leaves can give at their repeat caps, and what a node can't take goes to its siblings before
it goes to the siblings of its ancestors. Each leaf then gives whole epochs of its documents
and, for the rest of its budget, a prefix (by tokens) of one more epoch in seeded order.

Sizes are tokens of a public tokenizer. Only sums by leaf reach the driver. The prefix is found
by sums over hash buckets first; documents are sorted only within the one bucket in which a
leaf's budget ends.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.llm.language import language
from quillmere.session import cut


@dataclass(frozen=True)
class Settings:
    tokenizer: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    seed: int = 11
    buckets: int = 4096
    #: More leaves than this are refused: their sums are handled by the driver.
    max_leaves: int = 1_000_000


# Fixed value: the pattern that splits texts for byte-level encodings of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[int, object] = {}


def _encoding(ranks: bytes):
    """The encoding of a rank file, made once per worker."""
    if (known := hash(ranks)) not in _encodings:
        import tiktoken

        try:
            from public_tokenizers import PATTERN as pattern
        except ImportError:
            pattern = PATTERN
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encodings[known] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _encodings[known]


def sized(documents: DataFrame, s: Settings) -> DataFrame:
    """doc_id, source, lang, tokens of documents that have tokens; a repeated doc_id counts once."""
    kind = dict(documents.dtypes)["doc_id"]
    # The file is needed at the driver alone; one vocabulary of some tens of thousands of entries is sent along.
    with open(s.tokenizer, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(ranks.value)
        for batch in batches:
            codes, distinct = pd.factorize(batch["text"])
            tokens = [len(encoding.encode_ordinary(t)) for t in distinct]
            langs = [language(t) or "none" for t in distinct]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "lang": [langs[c] for c in codes], "tokens": [tokens[c] for c in codes]})

    rows = documents.select("doc_id", "source", F.col("text").cast("string").alias("text")).where("doc_id is not null and source is not null and text is not null and text <> ''")
    counted = rows.mapInPandas(count, f"doc_id {kind}, source string, lang string, tokens long").where("tokens > 0")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("source", "lang", "tokens")).alias("d"))
    return one.select("doc_id", "d.source", "d.lang", "d.tokens")


def domain_of(source: str) -> str:
    """What a source is about: the last part of its name."""
    return source.rpartition("_")[2]


def water_fill(budget: float, weights: list[float], caps: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its cap; what doesn't fit goes to the others."""
    given = [0.0] * len(weights)
    open_ = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    left = min(budget, sum(caps[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= caps[i] - 1e-9]
        if not full:
            for i in open_:
                given[i] = left * weights[i] / total
            break
        for i in full:
            given[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in set(full)]
    return given


def budgets(leaves: dict[tuple[str, str, str], tuple[float, float]], size: float) -> dict[tuple[str, str, str], float]:
    """Tokens for each leaf (domain, language, source) -> (weight, cap) of a mix of so many tokens."""

    def hand_down(keys: list[tuple[str, str, str]], depth: int, budget: float) -> dict[tuple[str, str, str], float]:
        if depth == 3:
            return {keys[0]: budget}
        groups: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for k in sorted(keys):
            groups[k[depth]].append(k)
        names = sorted(groups)
        weights = [sum(leaves[k][0] for k in groups[n]) for n in names]
        caps = [sum(leaves[k][1] for k in groups[n] if leaves[k][0] > 0) for n in names]
        out: dict[tuple[str, str, str], float] = {}
        for n, given in zip(names, water_fill(budget, weights, caps), strict=True):
            out.update(hand_down(groups[n], depth + 1, given))
        return out

    return hand_down(list(leaves), 0, size) if leaves else {}


@dataclass(frozen=True)
class Plan:
    """What each leaf of each mix gives, as rows for the cluster and the report."""

    leaves: list[tuple[str, str, str, str, int, float, int]]
    report: list[tuple]


def plan(sizes: list[tuple[str, str, int, int]], targets: list[tuple[str, str, float, int, float]], total: int) -> Plan:
    """sizes: source, lang, documents, tokens. targets: mix_id, source, share, max_repeats, size_ratio.

    Null or negative shares and repeats count as zero, a null size ratio as one; rows of one
    source in a mix add their shares and take the largest cap.
    """
    of_source: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for source, lang, _, tokens in sizes:
        of_source[source].append((lang, tokens))
    mixes: dict[str, dict[str, list]] = defaultdict(dict)
    ratio: dict[str, float] = {}
    for mix, source, share, repeats, size_ratio in sorted(targets, key=lambda t: (t[0], t[1])):
        had = mixes[mix].setdefault(source, [0.0, 0])
        had[0] += max(0.0, share or 0.0)
        had[1] = max(had[1], repeats or 0)
        ratio[mix] = max(ratio.get(mix, 0.0), 1.0 if size_ratio is None else size_ratio)
    rows, report = [], []
    for mix, sources in sorted(mixes.items()):
        weight = sum(share for share, _ in sources.values()) or 1.0
        leaves: dict[tuple[str, str, str], tuple[float, float]] = {}
        for source, (share, repeats) in sources.items():
            available = sum(t for _, t in of_source[source])
            for lang, tokens in of_source[source] or [("none", 0)]:
                leaves[domain_of(source), lang, source] = (share / weight * (tokens / available if available else 1.0), float(tokens * repeats))
        size = ratio[mix] * total
        for (domain, lang, source), given in budgets(leaves, size).items():
            tokens = dict(of_source[source]).get(lang, 0)
            epochs = int(given // tokens + 1e-9) if tokens else 0
            rows.append((mix, domain, lang, source, epochs, given - epochs * tokens if epochs < sources[source][1] else 0.0, tokens))
        for source, (share, repeats) in sources.items():
            report.append((mix, source, share / weight, repeats, sum(t for _, t in of_source[source]), size * share / weight, sum(r[4] * r[6] + r[5] for r in rows if r[0] == mix and r[3] == source), size))
    return Plan(rows, report)


def _planned(documents: DataFrame, targets: DataFrame, s: Settings) -> tuple[DataFrame, Plan]:
    docs = cut(sized(documents, s))
    sizes = docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).limit(s.max_leaves + 1).collect()
    wanted = targets.select("mix_id", "source", "target_share", "max_repeats", "size_ratio").where("mix_id is not null and source is not null").distinct().limit(s.max_leaves + 1).collect()
    if max(len(sizes), len(wanted)) > s.max_leaves:
        raise ValueError(f"more than {s.max_leaves} leaves or targets")
    return docs, plan([tuple(r) for r in sizes], [tuple(r) for r in wanted], sum(r["tokens"] for r in sizes))


def _selected(docs: DataFrame, made: Plan, s: Settings) -> DataFrame:
    spark = docs.sparkSession
    leaf = ["mix_id", "lang", "source"]
    rows = [(m, lang, source, epochs, float(rest)) for m, _, lang, source, epochs, rest, tokens in made.leaves if tokens and (epochs or rest > 0)]
    plans = spark.createDataFrame(rows, "mix_id string, lang string, source string, epochs int, rest double")
    order = F.xxhash64(F.lit(s.seed), "mix_id", "epochs", "doc_id")
    asked = docs.join(F.broadcast(plans), ["lang", "source"]).withColumn("order", order).withColumn("bucket", F.pmod(F.shiftright("order", 40), F.lit(s.buckets)).cast("int"))
    sums = asked.where("rest > 0").groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("inside"))
    upto = Window.partitionBy(*leaf).orderBy("bucket")
    last = (
        sums.withColumn("upto", F.sum("inside").over(upto))
        .where("upto > rest")
        .groupBy(*leaf)
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("inside")).alias("before"))).alias("l"))
        .select(*leaf, F.col("l.bucket").alias("last_bucket"), F.col("l.before").alias("before"))
    )
    # One row for each leaf of each mix, as many as the driver has planned.
    marked = asked.join(F.broadcast(last), leaf, "left")
    in_order = Window.partitionBy(*leaf).orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        marked.where("rest > 0 and bucket = last_bucket")
        .withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(in_order), F.lit(0)))
        .withColumn("copies", F.col("epochs") + F.when(F.col("so_far") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    )
    whole = marked.where("not (rest > 0 and last_bucket is not null and bucket = last_bucket)").withColumn(
        "copies", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("last_bucket").isNull() | (F.col("bucket") < F.col("last_bucket"))), 1).otherwise(0)
    )
    cols = ["mix_id", "doc_id", "source", "lang", "tokens", F.col("copies").cast("int").alias("copies")]
    return whole.select(*cols).unionByName(edge.select(*cols)).where("copies > 0")


def mix(documents: DataFrame, targets: DataFrame, s: Settings | None = None) -> DataFrame:
    """mix_id, doc_id, source, lang, tokens, copies: how often each document is in each mix.

    A document without tokens, source or id is in no mix. No document is in a mix more often
    than its source's cap. Empty tables give an empty mix.
    """
    s = s or Settings()
    docs, made = _planned(documents, targets, s)
    return _selected(docs, made, s)


def report(documents: DataFrame, targets: DataFrame, s: Settings | None = None) -> DataFrame:
    """One row for each source of each mix: its target and actual share and tokens, what it has,
    its cap, and the tokens of the whole mix wanted and made."""
    s = s or Settings()
    docs, made = _planned(documents, targets, s)
    spark = documents.sparkSession
    wanted = spark.createDataFrame(made.report, "mix_id string, source string, target_share double, max_repeats int, available_tokens long, target_tokens double, planned_tokens double, mix_target_tokens double")
    got = _selected(docs, made, s).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("most_copies"), F.count("*").alias("documents"))
    whole = Window.partitionBy("mix_id")
    actual = F.coalesce("actual_tokens", F.lit(0)).cast("long")
    return (
        wanted.join(got, ["mix_id", "source"], "left")
        .withColumn("actual_tokens", actual)
        .withColumn("most_copies", F.coalesce("most_copies", F.lit(0)))
        .withColumn("documents", F.coalesce("documents", F.lit(0)))
        .withColumn("mix_actual_tokens", F.sum("actual_tokens").over(whole))
        .withColumn("actual_share", F.try_divide("actual_tokens", "mix_actual_tokens"))
    )
