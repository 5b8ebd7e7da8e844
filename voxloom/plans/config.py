"""Configuration objects with their checks."""

from __future__ import annotations

import hashlib
import json
import math
import os
from dataclasses import asdict, dataclass, field


@dataclass(frozen=True)
class BatchLimits:
    """Limits of one batch profile; at least one of max_cost and max_samples must be set."""

    max_cost: float | None = None
    max_samples: int | None = None
    min_samples: int = 1
    oversized_sample: str = "drop"

    def __post_init__(self) -> None:
        if self.max_cost is None and self.max_samples is None:
            raise ValueError("set max_cost or max_samples")
        if self.max_cost is not None and not (math.isfinite(self.max_cost) and self.max_cost > 0):
            raise ValueError("max_cost must be positive")
        if self.max_samples is not None and self.max_samples < 1:
            raise ValueError("max_samples must be positive")
        if self.min_samples < 1 or (self.max_samples is not None and self.min_samples > self.max_samples):
            raise ValueError("min_samples must lie between 1 and max_samples")
        if self.oversized_sample not in ("drop", "single"):
            raise ValueError("oversized_sample is drop or single")


@dataclass(frozen=True)
class SourceConfig:
    """One streaming source."""

    name: str
    shards: tuple[str, ...] = ()
    layout: str = "auto"
    weight: float | None = None
    ratio: float = 1.0

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a source needs a name")
        if not (math.isfinite(self.ratio) and self.ratio > 0):
            raise ValueError("ratio must be a positive number")
        if self.weight is not None and not (math.isfinite(self.weight) and self.weight >= 0):
            raise ValueError("weight must not be negative")
        if self.layout not in ("auto", "s2s_pair", "shared_audio_tasks"):
            raise ValueError(f"unknown layout {self.layout}")


@dataclass(frozen=True)
class StreamConfig:
    """A record stream: sampling mode, seed, topology and limits."""

    sources: tuple[SourceConfig, ...]
    limits: BatchLimits
    mode: str = "finite_exact"
    seed: int = 0
    epoch: int = 0
    world_size: int = 1
    workers: int = 1
    pool_samples: int = 2048
    chunk_size: int = 128
    shuffle: bool = True
    distributed: bool = False
    fixed_batches: int | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.mode not in ("finite_exact", "finite_padded", "resampled"):
            raise ValueError(f"unknown mode {self.mode}")
        if not self.sources:
            raise ValueError("a stream needs a source")
        if len({s.name for s in self.sources}) < len(self.sources):
            raise ValueError("source names must differ")
        if min(self.world_size, self.workers, self.pool_samples, self.chunk_size) < 1:
            raise ValueError("sizes must be positive")
        if self.distributed and (self.mode != "resampled" or self.fixed_batches is None):
            raise ValueError("distributed training needs resampled mode and a fixed number of batches")
        if self.mode != "resampled" and any(s.weight is not None for s in self.sources):
            raise ValueError("weights mix sources in resampled mode only")

    def for_validation(self) -> StreamConfig:
        """Padded, unshuffled, a window of one."""
        values = {k: getattr(self, k) for k in self.__dataclass_fields__}
        plain = tuple(SourceConfig(s.name, s.shards, s.layout, None, s.ratio) for s in self.sources)
        return StreamConfig(**values | {"sources": plain, "mode": "finite_padded", "shuffle": False, "pool_samples": 1, "distributed": False})

    def quotas(self) -> list[int]:
        """Batches of each consumer when the number is fixed: an even share, the first ones one more."""
        consumers = self.world_size * self.workers
        each, more = divmod(self.fixed_batches or 0, consumers)
        return [each + (i < more) for i in range(consumers)]

    def check_quotas(self, made: list[int]) -> None:
        """Fails if a consumer's stream ended before its quota of batches: ``made`` batches by consumer."""
        if self.fixed_batches is None:
            return
        short = [(i, n, q) for i, (n, q) in enumerate(zip(made, self.quotas())) if n < q]
        if short or len(made) != self.world_size * self.workers:
            raise RuntimeError("a stream ended before its quota: " + ", ".join(f"consumer {i} gave {n} of {q}" for i, n, q in short))

    def signature(self) -> str:
        """Fingerprint of everything that decides the order of the stream."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, default=str).encode()).hexdigest()


def expand_env(text: str) -> str:
    """``$VAR`` and ``${VAR}`` from the environment; unknown names stay."""
    return os.path.expandvars(text)


def load_config(path: str) -> dict:
    """A YAML or JSON mapping with ``$VAR`` expanded; YAML needs PyYAML, which is imported only then."""
    with open(path, encoding="utf-8") as file:
        content = expand_env(file.read())
    if path.endswith(".json"):
        values = json.loads(content)
    else:
        import yaml

        values = yaml.safe_load(content)
    if not isinstance(values, dict):
        raise ValueError(f"{path}: a configuration is a mapping")
    return values


def reject_unknown(values: dict, known: set[str]) -> None:
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown keys: {', '.join(unknown)}")


def require(values: dict, needed: set[str]) -> None:
    missing = sorted(needed - set(values))
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
