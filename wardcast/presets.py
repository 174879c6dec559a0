"""The dementia preset: one value of each spec."""

from __future__ import annotations

from wardcast.spec import CohortSpec, ProjectionSpec, TerritorySpec

# Diagnosis groups, labels, age bands, population anchors and parameters that results must reproduce.
AGE_EDGES = (0, 59, 69, 74, 79, 84, 200)
AGE_LABELS = ("<60", "60-69", "70-74", "75-79", "80-84", "85+")
DEMENTIA_LABELS = {
    "F00": "Alzheimer (F00)",
    "F01": "Demência Vascular",
    "F02": "Demência por outras doenças",
    "F03": "Demência não especificada",
    "G30": "Doença de Alzheimer (G30)",
}
SEX_LABELS = {"1": "Masculino", "3": "Feminino"}
SAO_PAULO_CITY = "355030"

# Population aged 60+ of Brazil, in millions.
BRAZIL_60_PLUS = (
    (2020, 29.9),
    (2025, 34.6),
    (2030, 40.3),
    (2035, 47.1),
    (2040, 53.7),
    (2045, 59.1),
    (2050, 64.5),
)

CONDITION_LABELS = {
    "J18": "Pneumonia",
    "N39": "Infecção urinária",
    "J69": "Pneumonite aspirativa",
    "S72": "Fratura de fêmur",
    "I63": "AVC isquêmico",
    "E86": "Desidratação",
}

DEMENTIA_COHORT = CohortSpec(
    prefixes=("F00", "F01", "F02", "F03", "G30"),
    labels=DEMENTIA_LABELS,
    region=SAO_PAULO_CITY,
    sex_labels=SEX_LABELS,
    age_edges=AGE_EDGES,
    age_labels=AGE_LABELS,
)

DEMENTIA_PROJECTION = ProjectionSpec(
    rate=24.25,
    base_year=2025,
    end_year=2050,
    base_value=4000.0,
    scenarios={"a": 0.0, "b": 0.0175, "c": 0.035},
    milestones=(2020, 2025, 2030, 2035, 2040, 2050),
)

# The cut-offs are this library's choice; the level names are fixed.
DEMENTIA_TERRITORY = TerritorySpec(
    levels=((90, "Crítico"), (80, "Alto"), (72, "Médio-Alto")),
    floor_level="Médio",
    tier_one=("Crítico",),
    tier_two=("Alto", "Médio-Alto"),
)
