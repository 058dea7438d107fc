"""Thresholds of the engine in one frozen object; every operator takes its own from here by default."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Address prefix -> script type, longest rules first.
SCRIPT_PREFIXES = (
    ("bc1p", "p2tr"), ("bc1q", "p2wpkh"), ("tb1q", "p2wpkh"), ("3", "p2sh"), ("2", "p2sh"), ("1", "p2pkh"), ("m", "p2pkh"), ("n", "p2pkh"),
)
#: A version-0 witness address longer than this pays to a script.
LONG_WITNESS = 50


@dataclass(frozen=True)
class Config:
    """The engine's published thresholds."""

    equal_tolerance: float = 0.02
    dust: float = 0.0000273
    coinjoin_inputs: int = 3
    coinjoin_outputs: int = 3
    coinjoin_group: int = 3
    change_votes: int = 2
    cluster_guard: int = 500
    round_units: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)
    round_tolerance: float = 1e-6
    dormancy_days: float = 90.0
    burst_days: float = 1.0
    rule_base: float = 0.35
    rule_keep: float = 0.4
    taint_decay: float = 0.5
    taint_hops: int = 4
    taint_floor: float = 0.01
    trace_hops: int = 8
    trace_share: float = 0.001
    trace_value: float = 0.001
    trace_paths: int = 3
    exit_candidates: int = 10
    exit_sink: float = 0.05
    peel_ratio: float = 0.35
    peel_hops: int = 3
    layering_hops: int = 6
    layering_hours: float = 24.0
    layering_outs: int = 4
    layering_ins: int = 3
    layering_traced: float = 0.5
    ransom_senders: int = 5
    ransom_new: float = 0.6
    ransom_walk: int = 2
    single_row_confidence: float = 0.15
    low_confidence: float = 0.35
    masked_discount: float = 0.4
    asn_penalty: float = 0.2
    shared_from: int = 3
    shared_floor: float = 0.02
    peer_quantiles: tuple[float, ...] = (0.5, 0.9, 0.99)
    peer_group_least: int = 30
    class_weights: dict[str, float] = field(
        default_factory=lambda: {"residential": 1.0, "relay": 0.3, "hosting": 0.5, "tor": 0.2}
    )


DEFAULT = Config()
