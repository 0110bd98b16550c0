"""Typed, validated settings."""

from __future__ import annotations

from dataclasses import dataclass, field


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not v > 0:
            raise ValueError(f"{name} must be positive")


# The defaults.
@dataclass(frozen=True)
class Noise:
    epsilon: float = 0.5
    relative_sensitivity: float = 0.02
    absolute_sensitivity: float = 1.0
    min_magnitude: float = 1000.0
    year_floor: int = 1900
    year_ceiling: int = 2100
    budget: float = 5.0
    idle_reset_hours: int = 24
    #: The kill switch, and whether a spent budget holds a text back instead of sending its numbers as they are.
    enabled: bool = True
    fail_closed: bool = False

    def __post_init__(self) -> None:
        _positive(epsilon=self.epsilon, relative_sensitivity=self.relative_sensitivity, absolute_sensitivity=self.absolute_sensitivity, budget=self.budget, idle_reset_hours=self.idle_reset_hours)


@dataclass(frozen=True)
class Vault:
    max_values: int = 500
    max_sessions: int = 10_000
    ttl_minutes: int = 5
    letters: int = 14

    def __post_init__(self) -> None:
        _positive(max_values=self.max_values, max_sessions=self.max_sessions, ttl_minutes=self.ttl_minutes)
        if not 8 <= self.letters <= 32:
            raise ValueError("letters must be 8 to 32")


@dataclass(frozen=True)
class RateLimit:
    capacity: float = 10.0
    per_minute: float = 20.0

    def __post_init__(self) -> None:
        _positive(capacity=self.capacity, per_minute=self.per_minute)


@dataclass(frozen=True)
class Screening:
    threshold: float = 0.75
    fail_closed: bool = False
    breaker_failures: int = 3
    breaker_seconds: int = 30

    def __post_init__(self) -> None:
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be in (0, 1]")
        _positive(breaker_failures=self.breaker_failures, breaker_seconds=self.breaker_seconds)


@dataclass(frozen=True)
class Settings:
    noise: Noise = field(default_factory=Noise)
    vault: Vault = field(default_factory=Vault)
    rate: RateLimit = field(default_factory=RateLimit)
    screening: Screening = field(default_factory=Screening)
    max_prompt_chars: int = 10_000
    retention_days: int = 30

    def __post_init__(self) -> None:
        _positive(max_prompt_chars=self.max_prompt_chars, retention_days=self.retention_days)
