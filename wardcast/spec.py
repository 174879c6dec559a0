"""Parameters of an analysis. Every operator takes a spec instead of module constants,
so one code path serves any diagnosis set, region level and horizon."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CohortSpec:
    """Which admissions to keep and how to label them.

    ``labels`` is ordered: reports list the groups in this order, also those without rows. It becomes
    literals of the plan; the operators take a table of labels instead, which is joined.
    Age bands are right-closed: ``age_edges[i] < age <= age_edges[i + 1]``.
    """

    prefixes: tuple[str, ...]
    labels: dict[str, str] = field(default_factory=dict)
    region: str | None = None
    region_digits: int = 6
    group_chars: int = 3
    sex_labels: dict[str, str] = field(default_factory=dict)
    age_edges: tuple[int, ...] = (0, 200)
    age_labels: tuple[str, ...] = ("all",)

    def __post_init__(self) -> None:
        if not self.prefixes:
            raise ValueError("a cohort needs at least one code prefix")
        if len(self.age_edges) != len(self.age_labels) + 1:
            raise ValueError("age_edges must have one more entry than age_labels")
        if list(self.age_edges) != sorted(set(self.age_edges)):
            raise ValueError("age_edges must be strictly increasing")


@dataclass(frozen=True)
class ProjectionSpec:
    """Rate, cost base and scenarios of a projection.

    ``scenarios`` maps a short name to a yearly adjustment; costs grow from ``base_year`` on
    and are flat before it.
    """

    rate: float
    base_year: int
    end_year: int
    base_value: float
    scenarios: dict[str, float]
    frozen: str = "a"
    full: str = "c"
    milestones: tuple[int, ...] = ()

    def __post_init__(self) -> None:
        for name in (self.frozen, self.full):
            if name not in self.scenarios:
                raise ValueError(f"scenario {name!r} is not in {sorted(self.scenarios)}")


@dataclass(frozen=True)
class TerritorySpec:
    """Cut-offs (descending) from a 0-100 score to a named level, and the level names per display tier."""

    levels: tuple[tuple[int, str], ...]
    floor_level: str
    tier_one: tuple[str, ...]
    tier_two: tuple[str, ...]
