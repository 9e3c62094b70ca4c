"""Settings as dataclasses, read from YAML or JSON; unknown keys are dropped, ranges are checked."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class Retrieval:
    alpha: float = 0.5
    alpha_bridge: float | None = None
    alpha_comparison: float | None = None
    rrf_k: int = 20
    candidate_pool_size: int = 100
    top_k: int = 20
    hop2_confidence: float = 0.3
    max_bridge_entities: int = 3
    fuzzy_title_threshold: float = 70.0


@dataclass
class Rerank:
    top_k: int = 5
    sentence_score_threshold: float = 0.4
    max_sentences_per_passage: int = 5
    sentence_passage_limit: int = 3
    title_overlap_boost: float = 0.05


@dataclass
class Prompt:
    evidence_first: bool = True
    max_evidence_chars: int = 6000
    complexity_routing_threshold: float = 0.5
    temperature_small_model: float = 0.1
    temperature_large_model: float = 0.3


@dataclass
class Generation:
    model_small: str = "small"
    model_large: str = "large"
    extraction_model: str = "large"
    validate_citations: bool = True
    retry_on_parse_failure: bool = True
    specialist_mode: bool = False


@dataclass
class Verification:
    enabled: bool = True
    mode: str = "overlap"
    support_threshold: float = 0.55
    claim_threshold: float = 0.45
    min_supported_claim_ratio: float = 1.0
    max_claims: int = 6
    retry_on_failure: bool = True
    max_verification_retries: int = 1
    retry_score_threshold: float = 0.4
    abstain_on_unsupported: bool = False


@dataclass
class Settings:
    retrieval: Retrieval = field(default_factory=Retrieval)
    reranker: Rerank = field(default_factory=Rerank)
    prompt_builder: Prompt = field(default_factory=Prompt)
    generator: Generation = field(default_factory=Generation)
    verifier: Verification = field(default_factory=Verification)

    def validate(self) -> "Settings":
        """Raises ValueError for a setting out of range."""
        r, v = self.retrieval, self.verifier
        unit = {"alpha": r.alpha, "alpha_bridge": r.alpha_bridge, "alpha_comparison": r.alpha_comparison, "hop2_confidence": r.hop2_confidence, "support_threshold": v.support_threshold, "claim_threshold": v.claim_threshold, "min_supported_claim_ratio": v.min_supported_claim_ratio, "retry_score_threshold": v.retry_score_threshold, "complexity_routing_threshold": self.prompt_builder.complexity_routing_threshold}
        for name, x in unit.items():
            if x is not None and not 0 <= x <= 1:
                raise ValueError(f"{name} must be between 0 and 1: {x}")
        for name, n in {"rrf_k": r.rrf_k, "candidate_pool_size": r.candidate_pool_size, "top_k": r.top_k, "reranker.top_k": self.reranker.top_k, "max_claims": v.max_claims, "max_evidence_chars": self.prompt_builder.max_evidence_chars}.items():
            if n < 1:
                raise ValueError(f"{name} must be 1 or more: {n}")
        if v.mode not in ("overlap", "nli", "qa"):
            raise ValueError(f"unknown verifier mode: {v.mode}")
        return self


def build(kind: type, values: Any) -> Any:
    """A dataclass from nested dicts; unknown keys are dropped, missing ones keep their default."""
    if not isinstance(values, dict):
        return kind()
    hints = {f.name: f for f in dataclasses.fields(kind)}
    known = {}
    for k, v in values.items():
        if k in hints:
            default = hints[k].default_factory() if hints[k].default_factory is not dataclasses.MISSING else None
            known[k] = build(type(default), v) if dataclasses.is_dataclass(default) else v
    return kind(**known)


def load(path: str | None = None) -> Settings:
    """Settings of a JSON or YAML file (YAML where its library is installed); defaults without a path."""
    if path is None:
        return Settings().validate()
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        values = json.loads(text)
    else:
        import yaml

        values = yaml.safe_load(text)
    return build(Settings, values or {}).validate()
