"""Settings: dataclasses with defaults, read from the environment where it has them."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession

from mergelens.operators.diff import DEFAULT_EXCLUDES, DEFAULT_MAX_FILES


@dataclass(frozen=True)
class ReviewOptions:
    max_files: int = DEFAULT_MAX_FILES
    max_diff_lines: int = 3000
    context_lines: int = 3
    exclude_patterns: tuple[str, ...] = DEFAULT_EXCLUDES


@dataclass(frozen=True)
class QueueOptions:
    path: str = "queue"
    checkpoint: str = "queue-state"
    files_per_trigger: int = 1


@dataclass(frozen=True)
class Provider:
    """One model service. ``kind`` is the shape of its envelope: messages, chat or generate."""

    name: str
    kind: str
    model: str
    enabled: bool = True
    max_tokens: int | None = None
    temperature: float = 0.1
    fallback_to: str | None = None


#: The chain of services that is configured by default.
DEFAULT_PROVIDERS = (
    Provider("claude", "messages", "model-c", fallback_to="openai"),
    Provider("openai", "chat", "model-o", fallback_to="gemini"),
    Provider("gemini", "generate", "model-g", enabled=False),
)


@dataclass(frozen=True)
class ModelOptions:
    default_provider: str = "claude"
    max_tokens: int = 4096
    providers: tuple[Provider, ...] = field(default=DEFAULT_PROVIDERS)

    def __post_init__(self) -> None:
        if not any(p.enabled for p in self.providers):
            raise ValueError("no provider is enabled")

    def table(self, spark: SparkSession) -> DataFrame:
        """Providers as a small table; a provider's own token limit overrides the general one."""
        rows = [(p.name, p.kind, p.model, p.enabled, p.max_tokens or self.max_tokens, p.temperature, p.fallback_to) for p in self.providers]
        return spark.createDataFrame(rows, "name string, kind string, model string, enabled boolean, max_tokens int, temperature double, fallback_to string")


def from_environment(kind: type, prefix: str = "MERGELENS_"):
    """A settings object with those plain fields taken over that the environment names, such as MERGELENS_MAX_FILES."""
    found = {}
    for f in fields(kind):
        raw = os.environ.get(prefix + f.name.upper())
        if raw is not None and isinstance(f.default, (int, str)):
            found[f.name] = type(f.default)(raw)
        elif raw is not None and isinstance(f.default, tuple):
            found[f.name] = tuple(x for x in raw.split(",") if x)
    return kind(**found)
