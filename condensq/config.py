"""Settings handed to operators; never changed at run time."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class LabelSettings:
    protein_threshold: float = 0.0
    conflict_strategy: str = "strongest"
    rna_min_abs_log2fc: float = 0.0
    positive: int = 1
    negative: int = 0


@dataclass(frozen=True)
class TierSettings:
    tier1_max: float = 10.0
    tier2_max: float = 30.0
    budgets: tuple[int, int, int] = (100, 50, 100)


@dataclass(frozen=True)
class SplitSettings:
    train: float = 0.70
    val: float = 0.15
    seed: int = 42
    similarity_threshold: float = 0.4


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 500
    max_depth: int = 30  # as deep as Spark grows a tree
    min_leaf: int = 2
    feature_subset: str = "sqrt"
    seed: int = 42


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 500
    max_depth: int = 6
    step: float = 0.05
    subsample: float = 0.8
    feature_subset: str = "0.8"
    min_leaf: int = 5
    tolerance: float = 0.01
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    labels: LabelSettings = field(default_factory=LabelSettings)
    tiers: TierSettings = field(default_factory=TierSettings)
    splits: SplitSettings = field(default_factory=SplitSettings)
    forest: ForestSettings = field(default_factory=ForestSettings)
    boost: BoostSettings = field(default_factory=BoostSettings)
