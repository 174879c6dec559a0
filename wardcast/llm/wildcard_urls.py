"""URL filter rules as one bit-parallel wildcard automaton.

Rules are globs over a canonical URL: ``*`` is any run of bytes but ``/``, ``**`` any run, ``?`` one byte, ``\\``
takes the next byte as it is. All globs are packed into one state of several 64-bit words (extended
Shift-And): a bit stands for "so much of this glob has been read". Reading a byte shifts all words,
masks them by the states that accept the byte, and keeps the states whose wildcard takes it. The state
of a whole batch of URLs is one numpy matrix, so a step advances every glob on every URL.

The rules are parameters: their masks (256 x words) travel with the job. Scanning is one narrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.llm.words import utf8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CELLS = 1 << 22


class Rule(NamedTuple):
    """A glob over ``.host/path`` with its verdict; ``name`` is what results call it."""

    glob: str
    verdict: str
    name: str


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, all its subdomains, and paths that begin with ``path``."""
    plain = "".join(f"\\{c}" if c in "*?\\" else c for c in f".{host}{path}")
    return Rule(f"*{plain}**", verdict, f"{host}{path}")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class Automaton:
    """The globs in order of precedence: of several that match, the first counts."""

    def __init__(self, globs: Sequence[str]):
        elements = [_parsed(g) for g in globs]
        starts = np.concatenate(([0], np.cumsum([len(e) + 1 for e, _ in elements]))).astype(int)
        self.words = -(-int(starts[-1]) // 64) or 1
        bits = self.words * 64
        accept, loop = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        begin, final = np.zeros(bits, bool), np.zeros(bits, bool)
        self.rule_at = np.full(bits, -1, np.int64)
        for i, (element, stars) in enumerate(elements):
            at = starts[i]
            begin[at] = True
            final[at + len(element)] = True
            self.rule_at[at + len(element)] = i
            for k, byte in enumerate(element):
                accept[slice(None) if byte is None else byte, at + k + 1] = True
            for k, slash in stars.items():
                loop[:, at + k] = True
                loop[ord("/"), at + k] = slash
        self.accept, self.loop, self.begin, self.final = (_packed_bits(x) for x in (accept, loop, begin, final))

    def first_match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each of the strings the number of the first glob that matches all of it, or -1."""
        sizes = np.diff(offsets)
        order = np.argsort(-sizes, kind="stable")
        starts, longest = offsets[:-1][order], sizes[order]
        state = np.repeat(self.begin[None, :], len(sizes), axis=0)
        for step in range(int(longest[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-longest, -step, side="left"))
            byte = data[starts[:live] + step]
            now = state[:live]
            ahead = now << np.uint64(1)
            ahead[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (ahead & self.accept[byte]) | (now & self.loop[byte])
        state &= self.final
        word = (state != 0).argmax(axis=1)
        hit = state[np.arange(len(state)), word]
        lowest = hit & (~hit + np.uint64(1))
        bit = np.where(hit > 0, np.log2(np.maximum(lowest, 1).astype(np.float64)), 0).astype(np.int64)
        out = np.full(len(sizes), -1, np.int64)
        out[order] = np.where(hit > 0, self.rule_at[word * 64 + bit], -1)
        return out


def _parsed(glob: str) -> tuple[list[int | None], dict[int, bool]]:
    """The bytes that must be read (None: any) and, by the number read before it, each wildcard run and whether
    it takes ``/``."""
    element: list[int | None] = []
    stars: dict[int, bool] = {}
    data, i = glob.encode(), 0
    while i < len(data):
        c = data[i : i + 1]
        if c == b"*":
            wide = data[i + 1 : i + 2] == b"*"
            stars[len(element)] = stars.get(len(element), False) or wide
            i += wide
        elif c == b"?":
            element.append(None)
        else:
            i += c == b"\\" and i + 1 < len(data)
            element.append(data[i])
        i += 1
    return element, stars


def _packed_bits(x: np.ndarray) -> np.ndarray:
    return np.packbits(x, axis=-1, bitorder="little").view(np.uint64)


def judged(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of the rows with host, path, rule (null without a match) and verdict.

    Of several matching rules the one with the longest name wins, then the earlier one. A null URL, or one without
    ``://``, has an empty host and path; rules that ask for neither may still match it. URLs of any
    length are read whole. Repeated rows are judged alike. Columns named like the new ones are replaced.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([r.glob for r in ranked])

    @F.arrow_udf("int")
    def matched(canonical: pa.Array) -> pa.Array:
        data, offsets = utf8(canonical)
        found = []
        for low in range(0, len(canonical), max(1, _CELLS // automaton.words)):
            part = offsets[low : low + max(1, _CELLS // automaton.words) + 1]
            found.append(automaton.first_match(data, part))
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int32())

    parts = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parts = parts.withColumn("_rule", matched(F.concat(F.lit("."), "host", "path")))
    names = F.array(*[F.lit(r.name) for r in ranked]) if ranked else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in ranked]) if ranked else F.array().cast("array<string>")
    hit = F.col("_rule") >= 0
    return parts.withColumns(
        {
            "rule": F.when(hit, F.get(names, F.col("_rule"))),
            "verdict": F.when(hit, F.get(verdicts, F.col("_rule"))).otherwise(F.lit(default)),
        }
    ).drop("_rule")
