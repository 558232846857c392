"""A source's contract: which fields its rows have, and how good a run of it must be."""

from __future__ import annotations

from dataclasses import dataclass, field

TYPES = {"string": "string", "decimal": "decimal(38,18)", "integer": "bigint", "boolean": "boolean", "datetime": "timestamp"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "string"
    required: bool = False
    min_fill_rate: float | None = None
    low: float | None = None
    high: float | None = None
    enum: tuple[str, ...] | None = None
    pattern: str | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"{self.name}: no type {self.type}")
        if self.min_fill_rate is None:
            object.__setattr__(self, "min_fill_rate", 1.0 if self.required else 0.0)


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    natural_key: tuple[str, ...]
    min_rows_per_run: int = 1
    row_count_deviation: float = 0.30
    max_duplicate_rate: float = 0.02
    max_range_violation_rate: float = 0.05
    max_auto_versions: int = 3
    baseline_runs: int = field(default=3)

    def __post_init__(self) -> None:
        names = {f.name for f in self.fields}
        if not self.natural_key or not names.issuperset(self.natural_key):
            raise ValueError("the natural key must name fields")
