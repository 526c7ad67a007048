"""Settings of retrieval and maintenance, all in one place, with checks that report every violation together."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    # Defaults that decide results.
    top_k: int = 8
    top_k_rules: int = 4
    unit_chunks_per_unit: int = 2
    unit_saturation: float = 0.05
    unit_second_ratio: float = 0.3
    unit_second_floor: float = 0.1
    rest_gate: float = 0.0
    similarity_threshold: float = 0.3
    context_token_budget: int = 2800
    max_history_messages: int = 6
    reduced_history_messages: int = 2
    reduced_top_k: int = 3
    token_char_ratio: int = 4
    authority_tiebreak: float = 0.001
    rerank_cosine_floor: float = 0.4
    dependency_margin: float = 0.02
    dependency_step: float = 0.001
    dependency_max: int = 5
    rerank_candidates: int = 48
    segment_max: int = 2
    segment_tiebreak: float = 0.05
    span_gate_min: float = 0.45
    referenced_parent_min: float = 0.45
    lexical_candidates: int = 30
    lexical_inject_max: int = 5
    lexical_min_overlap: float = 0.8
    lexical_sim_floor: float = 0.40
    lexical_sim_ceiling: float = 0.55
    orphan_share_limit: float = 0.40
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    default_edition: str = "10e"
    editions: tuple[str, ...] = ("10e", "11e")
    core_category: str = "Core_Rules"
    pack_category: str = "Muster_Pack"
    pack_name: str = "Muster Pack"
    core_phrases: tuple[str, ...] = (
        "core rule", "universal rule", "in every army", "basic rule", "all armies", "always active", "mission rule", "secondary mission",
        "primary mission", "tournament", "matched play", "victory points", "embark", "disembark", "riding in",
    )
    core_words: tuple[str, ...] = ("vp", "scoring", "transport", "inside")
    unit_categories: tuple[str, ...] = ("Datasheet", "Ability", "Datasheet_Section")
    rule_categories: tuple[str, ...] = ("Army_Rule", "Detachment_Rule")
    sequences: dict[str, list[str]] = field(default_factory=dict)


SETTINGS = Settings()


def check(s: Settings) -> None:
    """Raise a ValueError that lists all violated invariants."""
    rules = {
        "top_k >= top_k_rules >= 1": s.top_k >= s.top_k_rules >= 1,
        "unit_chunks_per_unit >= 1": s.unit_chunks_per_unit >= 1,
        "candidates cover the result": s.rerank_candidates >= s.top_k,
        "lexical candidates cover what is injected": s.lexical_candidates >= s.lexical_inject_max >= 0,
        "lexical scores are ordered": 0 <= s.lexical_sim_floor <= s.lexical_sim_ceiling <= 1,
        "tiebreaks stay under margins": 0 <= 2 * s.authority_tiebreak < s.dependency_margin,
        "dependency steps stay under the margin": s.dependency_max * s.dependency_step < s.dependency_margin,
        "reduced retry is smaller": s.reduced_top_k <= s.top_k and s.reduced_history_messages <= s.max_history_messages,
        "budget is positive": s.context_token_budget > 0 and s.token_char_ratio > 0,
        "default edition is known": s.default_edition in s.editions,
        "editions are distinct": len(set(s.editions)) == len(s.editions),
        "core rules and pack differ": s.core_category != s.pack_category and s.pack_name.strip() != "",
        "phrases that mean core rules are lower-case": all(p and p == p.lower() for p in (*s.core_phrases, *s.core_words)),
        "candidates of a unit are at most those of the result": s.unit_chunks_per_unit <= s.top_k,
        "saturation and rest gate are shares": 0 <= s.unit_saturation <= 1 and 0 <= s.rest_gate <= 1,
        "second rows need less than first ones": 0 <= s.unit_second_floor <= 1,
        "BM25 constants": s.bm25_k1 >= 0 and 0 <= s.bm25_b <= 1 and s.bm25_epsilon >= 0,
        "segments": s.segment_max >= 1 and 0 <= s.segment_tiebreak < 1,
        "sequences name each stem once": all(len(set(v)) == len(v) for v in s.sequences.values()),
        "category groups are disjoint": not set(s.unit_categories) & set(s.rule_categories),
    }
    for f in fields(s):
        value = getattr(s, f.name)
        if f.type == "float" and ("min" in f.name or "ratio" in f.name or "threshold" in f.name or "limit" in f.name):
            rules[f"{f.name} in 0..1"] = 0 <= value <= 1
    failed = [name for name, ok in rules.items() if not ok]
    if failed:
        raise ValueError("settings: " + "; ".join(failed))
