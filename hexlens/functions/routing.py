"""Routing gates and verdict rules (F11-F13, P5) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexlens import config as C


def _c(x):
    if isinstance(x, str):
        return F.col(x)
    if isinstance(x, (int, float)):
        return F.lit(float(x))
    return x


def sigmoid_gate_score(high_entropy_ratio, packed_sections_ratio, packer_keyword_hits_ratio) -> Column:
    """1/(1+exp(-10*max(he-0.8, ps-0.3, kh-0.1)))."""
    m = F.greatest(_c(high_entropy_ratio) - C.GATE_HIGH_ENTROPY_RATIO,
                   _c(packed_sections_ratio) - C.GATE_PACKED_SECTIONS_RATIO,
                   _c(packer_keyword_hits_ratio) - C.GATE_PACKER_RATIO)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-C.GATE_SIGMOID_SLOPE * m))


def sigmoid_gate(high_entropy_ratio, packed_sections_ratio, packer_keyword_hits_ratio) -> Column:
    """F11 route: 1 = packed expert, 0 = normal expert."""
    return (sigmoid_gate_score(high_entropy_ratio, packed_sections_ratio, packer_keyword_hits_ratio)
            > C.GATE_THRESHOLD).cast("int")


def routing_label(packed_sections_ratio, packer_keyword_hits_count) -> Column:
    """F12 training rule: ratio > 0.4 or keyword hits > 0."""
    return ((_c(packed_sections_ratio) > C.PACKED_SECTIONS_RATIO_THRESHOLD)
            | (_c(packer_keyword_hits_count) > C.PACKER_KEYWORD_HITS_THRESHOLD)).cast("int")


def gate_signals(high_entropy_ratio, packed_sections_ratio, overlay_high_entropy_flag,
                 packer_keyword_hits_ratio, packer_section_flags: list) -> dict[str, Column]:
    """the five raw signals; a ratio on its threshold fires."""
    any_packer = F.greatest(*[_c(f) for f in packer_section_flags]) > 0 if len(packer_section_flags) > 1 else (
        _c(packer_section_flags[0]) > 0 if packer_section_flags else F.lit(False))
    return {
        "entropy": _c(high_entropy_ratio) >= C.GATE_HIGH_ENTROPY_RATIO,
        "packed_sections": _c(packed_sections_ratio) >= C.GATE_PACKED_SECTIONS_RATIO,
        "overlay": _c(overlay_high_entropy_flag) > 0,
        "keywords": _c(packer_keyword_hits_ratio) >= C.GATE_PACKER_RATIO,
        "packer_section": any_packer,
    }


def gate_vote(high_entropy_ratio, packed_sections_ratio, overlay_high_entropy_flag,
              packer_keyword_hits_ratio, packer_section_flags: list) -> Column:
    """packed when at least two of the five signals fire."""
    signals = gate_signals(high_entropy_ratio, packed_sections_ratio, overlay_high_entropy_flag, packer_keyword_hits_ratio, packer_section_flags)
    votes = sum(s.cast("int") for s in signals.values())
    return (votes >= 2).cast("int")


def verdict(score, threshold: float = C.PREDICTION_THRESHOLD) -> tuple[Column, Column]:
    """P5: (is_malware, confidence); strictly greater than the threshold."""
    s = _c(score)
    is_mal = s > threshold
    return is_mal, F.when(is_mal, s).otherwise(F.lit(1.0) - s)
