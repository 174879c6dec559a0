"""Column expressions shared by the operators."""

from wardcast.functions.bands import right_closed_band
from wardcast.functions.numbers import (
    compound,
    exact_mean,
    exact_ratio,
    half_even,
    half_up,
    in_millions,
    null_if_not_finite,
    parse_decimal,
    parse_double,
    parse_int,
    parse_whole,
)
from wardcast.functions.text import (
    code_group,
    code_with_description,
    decimal_comma,
    dotted_thousands,
    in_region,
    lookup,
    signed_percent,
    starts_with_any,
)

__all__ = [
    "code_group",
    "code_with_description",
    "compound",
    "decimal_comma",
    "dotted_thousands",
    "exact_mean",
    "exact_ratio",
    "half_even",
    "half_up",
    "in_millions",
    "in_region",
    "lookup",
    "null_if_not_finite",
    "parse_decimal",
    "parse_double",
    "parse_int",
    "parse_whole",
    "right_closed_band",
    "signed_percent",
    "starts_with_any",
]
