from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from itertools import product
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

def _spellings(prefix: str) -> list[str]:
    return ["".join(chars) for chars in product(*[sorted({ch.upper(), ch.lower()}) for ch in prefix])]


def _one_letter_part(prefix: str) -> str:
    """The prefix up to, but not including, its second letter."""
    letters = [i for i, ch in enumerate(prefix) if ch.upper() != ch.lower()]
    return prefix if len(letters) < 2 else prefix[: letters[1]]


#: With more prefixes than this, they are looked up in sets instead of being spelled out.
SPELLED_PREFIXES = 48


def starts_with_any(code: Column, prefixes: Iterable[str]) -> Column:
    """True if the code starts with one of the prefixes, ignoring case. The code is not trimmed.

    ``upper(code)`` would keep the test from the file reader. So it is spelled out on the bare
    column: ``F00`` or ``f00``. Prefixes with more letters are spelled out up to the second one and
    compared in upper case after that.

    Many prefixes are sets by length, in which the code's first characters are looked up, so a row costs one look-up
    for each length. What is spelled out then, and reaches the reader, are their first characters.
    """
    wanted = list(dict.fromkeys(p.upper() for p in prefixes))
    if len(wanted) > SPELLED_PREFIXES and "" not in wanted:
        return _in_prefix_sets(code, wanted)
    tests: list[Column] = []
    for prefix in wanted:
        head = _one_letter_part(prefix)
        spelled = reduce(or_, [code.startswith(s) for s in _spellings(head)])
        tests.append(spelled if head == prefix else spelled & F.upper(code).startswith(prefix))
    return reduce(or_, tests)


def _in_prefix_sets(code: Column, prefixes: list[str]) -> Column:
    """Whether the code's first characters are in the set of prefixes of that length. A prefix that a shorter one covers
    is left out."""
    known = set(prefixes)
    least = [p for p in prefixes if not any(p[:n] in known for n in range(1, len(p)))]
    of_length: dict[int, list[str]] = {}
    for prefix in least:
        of_length.setdefault(len(prefix), []).append(prefix)
    found = reduce(or_, [F.substring(F.upper(code), 1, n).isin(same) for n, same in sorted(of_length.items())])
    begins = sorted({s for p in least for s in _spellings(p[0])})
    return reduce(or_, [code.startswith(s) for s in begins]) & found


def in_region(code: Column, region: str, digits: int = 6) -> Column:
    """True if the first ``digits`` characters of the code equal ``region``."""
    if len(region) == digits:
        return code.startswith(region)
    if len(region) < digits:
        return code == F.lit(region)
    return F.lit(False)


def code_group(code: Column, chars: int = 3) -> Column:
    return F.upper(F.substring(code, 1, chars))


def lookup(key: Column, labels: Mapping[str, str]) -> Column:
    """Label of the key from a small dictionary, NULL if it has none."""
    if not labels:
        return F.lit(None).cast("string")
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def code_with_description(code: Column, description: Column) -> Column:
    return F.concat_ws(" · ", code, description)


def dotted_thousands(value: Column, digits: int = 0) -> Column:
    """``15641`` as ``15.641``: dot for thousands, comma for decimals."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def decimal_comma(value: Column, digits: int = 2) -> Column:
    """``64.50`` as ``64,5``: comma for decimals, no trailing zeros."""
    text = value.cast(f"decimal(24,{digits})").cast("string")
    trimmed = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.translate(trimmed, ".", ",")


def signed_percent(percent: Column) -> Column:
    """Nearest whole percent, halves towards plus infinity, with its sign: ``+116%``."""
    whole = F.floor(percent + F.lit(0.5)).cast("long")
    return F.concat(F.when(whole >= 0, F.lit("+")).otherwise(F.lit("")), whole.cast("string"), F.lit("%"))
