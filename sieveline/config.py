"""Parameters of runs, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Label 0 is trusted (positive), label 1 noisy (negative).
TRUSTED, NOISY = 0, 1
#: Code of categories that training has not seen, and of missing ones.
UNSEEN = -1
#: Categories beyond which a column is reported as of high cardinality.
MANY_CATEGORIES = 50
STRATEGIES = ("random", "reliable", "informed", "kmeans", "boundary", "hybrid")


@dataclass(frozen=True)
class Predictor:
    """The in-context predictor: softmax temperature, members, batch size, cached context, seed."""

    temperature: float = 0.1
    members: int = 8
    batch_size: int = 8
    cache: bool = True
    seed: int = 42


@dataclass(frozen=True)
class Scoring:
    """Weights of the reliability score, neighbours, and how scores become classes."""

    mean: float = 0.30
    stability: float = 0.20
    certainty: float = 0.15
    agreement: float = 0.20
    density: float = 0.15
    neighbours: int = 15
    method: str = "percentile"
    reliable_percent: float = 30
    suspect_percent: float = 30
    reliable_at: float = 0.75
    uncertain_at: float = 0.45


@dataclass(frozen=True)
class Run:
    """A construction run: probes, target size, rounds, strategy."""

    probes: int = 20
    probe_size: int = 500
    target_size: int | None = None
    rounds: int = 5
    convergence: float = 0.005
    strategy: str = "random"
    seed: int = 42
    top_features: int = 150
    scoring: Scoring = field(default_factory=Scoring)
    predictor: Predictor = field(default_factory=Predictor)


@dataclass(frozen=True)
class Architecture:
    """Dimensions of the transformer that the cost model counts (fixed values of the published model)."""

    embedding: int = 128
    column_blocks: int = 3
    inducing: int = 128
    group: int = 3
    row_blocks: int = 3
    cls: int = 4
    icl_blocks: int = 12
    model: int = 512
    widening: int = 2
    ssmax: int = 64
    classes: int = 10
    decoder: int = 1024
