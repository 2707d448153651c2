"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.compaction import CompactionPolicy


@dataclass(frozen=True)
class EngineConfig:
    """``bloom``: Parquet Bloom filters on keys; ``partitions``: files of a snapshot (0: Spark's shuffle setting); ``value_quota``: most bytes of one value."""

    bloom: bool = True
    partitions: int = 0
    value_quota: int = (2**16 - 1) * 16
    policy: CompactionPolicy = field(default_factory=CompactionPolicy)
