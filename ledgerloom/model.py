"""Data model: schemas, pipeline settings and failure classes."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

TOPIC = "ledger-events"
KEYS = ("topic", "partition_id", "offset_value")

COMMAND_SCHEMA = "account_number string, amount long, reason string"
CHANGE_SCHEMA = "topic string, partition_id int, offset_value long, account_number string, amount long, reason string, resulting_balance long"
BALANCE_SCHEMA = "account_number string, balance long"
TOKEN_SCHEMA = "topic string, partition_id int, num_offset long"
DEAD_SCHEMA = "topic string, partition_id int, offset_value long, payload string, cause string"

#: Longest text that a column of the change history holds.
REASON_LIMIT = 256
NO_TOKEN = -1


class TransientError(Exception):
    """The write may succeed if it is repeated."""


class SingleItemError(Exception):
    """One record of the batch can't be written, ever."""


class UnrecoverableError(Exception):
    """The writer has to stop; a restart resumes from the committed token."""


class FencedError(UnrecoverableError):
    """Somebody else has moved the tokens of ``partitions``: (topic, partition_id) pairs."""

    def __init__(self, partitions: list[tuple[str, int]]):
        super().__init__("fenced: " + ", ".join(f"{topic}-{partition}" for topic, partition in partitions))
        self.partitions = partitions


@dataclass(frozen=True)
class PersistenceConfig:
    """How a pipeline writes: rows per batch, and repeats of a batch after transient errors."""

    batch_size: int = 1_000
    max_retries: int = 5

    def __post_init__(self):
        if self.batch_size < 1:
            raise ValueError("batch_size must be 1 or more")
        if self.max_retries < 0:
            raise ValueError("max_retries must be 0 or more")


@dataclass(frozen=True)
class Watermarks:
    """Buffer depths between which backpressure keeps its state; both ends are inclusive."""

    high: int = 50_000
    low: int = 20_000

    def __post_init__(self):
        if self.low < 0:
            raise ValueError("low must be 0 or more")
        if self.high <= self.low:
            raise ValueError("high must be above low")


@dataclass(frozen=True)
class PipelineSpec:
    """One named pipeline from a topic to a store."""

    name: str
    topic: str
    concurrency: int = 3
    watermarks: Watermarks = field(default_factory=Watermarks)
    persistence: PersistenceConfig = field(default_factory=PersistenceConfig)

    def __post_init__(self):
        if not self.name or not self.name.strip():
            raise ValueError("a pipeline needs a name")
        if not self.topic or not self.topic.strip():
            raise ValueError("a pipeline needs a topic")
        if self.concurrency < 1:
            raise ValueError("concurrency must be 1 or more")


@dataclass(frozen=True)
class EngineConfig:
    """Defaults for all pipelines, and settings of single pipelines by name."""

    persistence: PersistenceConfig = field(default_factory=PersistenceConfig)
    watermarks: Watermarks = field(default_factory=Watermarks)
    overrides: dict[str, dict] = field(default_factory=dict)

    def spec(self, name: str, topic: str, **more) -> PipelineSpec:
        own = dict(self.overrides.get(name, {}))
        persistence = replace(self.persistence, **own.pop("persistence", {}))
        watermarks = replace(self.watermarks, **own.pop("watermarks", {}))
        return PipelineSpec(name, topic, persistence=persistence, watermarks=watermarks, **{**own, **more})
