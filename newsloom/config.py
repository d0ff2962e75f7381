"""Default parameters of the recommendation operators."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class ItemCf:
    forward: float = 1.0
    backward: float = 0.7
    gap_decay: float = 0.9
    seeds: int = 2
    top_m: int = 200
    seed_decay: float = 0.7
    k: int = 100
    block: int = 20_000  # positions of a long history that a task takes at a time


@dataclass(frozen=True)
class Swing:
    alpha: float = 1.0
    users_per_item: int = 80
    items_per_user: int = 200
    common_items: int = 80
    seeds: int = 2
    top_m: int = 80
    seed_decay: float = 0.7
    k: int = 50
    seed: int = 2020


@dataclass(frozen=True)
class ColdStart:
    seeds: int = 3
    top_m: int = 200
    seed_decay: float = 0.7
    raw_k: int = 300
    k: int = 50
    history: int = 50
    seen_penalty: float = 1.0
    category_bonus: float = 0.6
    category_penalty: float = 0.12
    words_weight: float = 0.4
    words_scale: float = 250.0
    fresh_weight: float = 0.5
    fresh_days: float = 120.0
    day: float = 86400.0  # divides created_at in its own unit; 86400000 reads it as milliseconds


@dataclass(frozen=True)
class Fusion:
    weights: dict = field(default_factory=lambda: {"itemcf": 1.0, "w2v": 0.2, "youtubednn": 0.01, "swing": 0.8, "cold_start": 0.06})
    k: int = 150


@dataclass(frozen=True)
class Negatives:
    power: float = 0.75
    unit: int = 1 << 20  # weights are whole multiples of 1 / unit
    attempts: int = 10
    seed: int = 2020


@dataclass(frozen=True)
class TwoTower:
    dim: int = 32
    hidden: int = 128
    length: int = 30
    negatives: int = 1000  # of a step, shared by its samples
    epochs: int = 3
    steps: int = 8  # of an epoch
    batch: int = 256  # samples that a shard takes at a time; their gradients are added up
    rate: float = 5e-3
    clip: float = 1.0
    temperature: float = 1.0
    shard_rows: int = 20000  # bound of the samples that meet in one task
    seed: int = 2020


@dataclass(frozen=True)
class Item2Vec:
    dim: int = 256
    window: int = 3
    negatives: int = 5
    pool: int = 4096  # noise drawn for a shard in an epoch
    epochs: int = 1
    batch: int = 256
    rate: float = 0.025
    least: float = 1e-4
    shard_rows: int = 50_000  # bound of the samples that meet in one task
    seed: int = 2020


@dataclass(frozen=True)
class LambdaRank:
    folds: int = 5
    trees: int = 500
    leaves: int = 64
    depth: int = 10
    rate: float = 0.05
    patience: int = 20  # rounds without a better NDCG of the held-out fold
    bins: int = 63
    rows: float = 0.8  # share of the users that a tree learns from
    columns: float = 0.8
    l1: float = 0.5
    l2: float = 0.5
    min_rows: int = 20
    min_curve: float = 1e-3
    few: int = 16  # partitions whose histograms the driver adds up itself
    seed: int = 2020


EVAL_AT = (5, 10, 20, 40, 50)
EMB_TOP = 200
VECTOR_K = 50
VECTOR_FETCH = 100
OVERFETCH = 50
EPS = 1e-3


@dataclass(frozen=True)
class Settings:
    """All parameters of a run."""

    itemcf: ItemCf = field(default_factory=ItemCf)
    swing: Swing = field(default_factory=Swing)
    cold: ColdStart = field(default_factory=ColdStart)
    fusion: Fusion = field(default_factory=Fusion)
    item2vec: Item2Vec = field(default_factory=Item2Vec)
    two_tower: TwoTower = field(default_factory=TwoTower)
    lambda_rank: LambdaRank = field(default_factory=LambdaRank)

    def set(self, *given: str) -> Settings:
        """With ``section.name=value`` put in; a value is read as the type that it replaces. Names that are not there raise ValueError."""
        out = self
        for one in given:
            name, _, value = one.partition("=")
            section, _, key = name.strip().partition(".")
            part = getattr(out, section, None)
            if not key or part is None or key not in {f.name for f in fields(part)}:
                raise ValueError(f"no parameter {name}")
            old = getattr(part, key)
            try:
                new = json.loads(value) if isinstance(old, dict) else type(old)(value)
            except ValueError as e:
                raise ValueError(f"{name}: {value} is not of type {type(old).__name__}") from e
            out = replace(out, **{section: replace(part, **{key: new})})
        return out
