"""Settings of the retrieval engine, as frozen values handed to the operators."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Chunking:
    target_tokens: int = 256
    max_tokens: int = 480
    overlap_tokens: int = 32
    min_tokens: int = 24
    naive_tokens: int = 512


@dataclass(frozen=True)
class Retrieval:
    dense_top_k: int = 30
    bm25_top_k: int = 30
    rrf_k: int = 60
    rerank_top_k: int = 12
    final_top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    embedding_dim: int = 256
    #: Query sets up to this many rows are broadcast; larger ones go in blocks of this size.
    query_block: int = 5000
    #: Whether a stored index keeps the terms of the lexicon whole, beside pairs of characters.
    whole_terms: bool = False


@dataclass(frozen=True)
class EvidenceFilter:
    enabled: bool = True
    min_rel_score: float = 0.30
    ocr_noise_max: float = 0.18
    min_chars: int = 24
    dedup_jaccard: float = 0.72


@dataclass(frozen=True)
class Agent:
    max_rounds: int = 3
    answer_threshold: float = 0.45
    refusal_threshold: float = 0.33
    consistency_threshold: float = 0.50
    max_claims: int = 8
    max_answer_chars: int = 600


@dataclass(frozen=True)
class ShortTerm:
    window_turns: int = 6
    max_window_tokens: int = 900
    decay: float = 0.82
    summary_max_tokens: int = 220


@dataclass(frozen=True)
class LongTerm:
    merge_similarity: float = 0.88
    write_importance: float = 0.50
    candidate_similarity: float = 0.45
    recall_top_k: int = 3
    policy: str = "newer_wins"
    neighbours: int = 5


@dataclass(frozen=True)
class Lexicon:
    base_importance: float = 0.15
    entity_bonus: float = 0.85
    #: A lexicon of more terms is matched from a broadcast automaton only after this check.
    max_terms: int = 500_000


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evidence: EvidenceFilter = field(default_factory=EvidenceFilter)
    agent: Agent = field(default_factory=Agent)
    short_term: ShortTerm = field(default_factory=ShortTerm)
    long_term: LongTerm = field(default_factory=LongTerm)
    lexicon: Lexicon = field(default_factory=Lexicon)
    seed: int = 42


def dotenv(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file put into the environment, where the key isn't set yet."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                key, eq, value = line.strip().partition("=")
                if eq and key and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
    for key, value in found.items():
        os.environ.setdefault(key, value)
    return found


def load(overrides: dict | None = None, prefix: str = "QUILLMERE_") -> Config:
    """Defaults, then overrides by section and name, then the environment (SECTION__NAME)."""
    config = Config()
    merged = {section: dict(values) for section, values in (overrides or {}).items() if isinstance(values, dict)}
    for key, value in os.environ.items():
        if key.startswith(prefix) and "__" in key:
            section, _, name = key[len(prefix) :].lower().partition("__")
            merged.setdefault(section, {})[name] = value
    for section, values in merged.items():
        part = getattr(config, section, None)
        if part is None or not hasattr(part, "__dataclass_fields__"):
            raise ValueError(f"no section {section!r}")
        known = {f.name: type(getattr(part, f.name)) for f in fields(part)}
        unknown = set(values) - set(known)
        if unknown:
            raise ValueError(f"no setting {sorted(unknown)} in {section!r}")
        cast = lambda t, v: str(v).lower() in ("1", "true", "yes") if t is bool and not isinstance(v, bool) else t(v)
        config = replace(config, **{section: replace(part, **{k: cast(known[k], v) for k, v in values.items()})})
    return config
