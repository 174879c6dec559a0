"""Hospital-admission cohorts, indicators and long-range projections on Spark DataFrames."""

from wardcast.presets import DEMENTIA_COHORT, DEMENTIA_PROJECTION, DEMENTIA_TERRITORY
from wardcast.spec import CohortSpec, ProjectionSpec, TerritorySpec

__all__ = [
    "CohortSpec",
    "DEMENTIA_COHORT",
    "DEMENTIA_PROJECTION",
    "DEMENTIA_TERRITORY",
    "ProjectionSpec",
    "TerritorySpec",
]
