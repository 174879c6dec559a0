from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tests.llm.rows import frame
from wardcast.llm import wildcard_urls as urls
from wardcast.llm.words import utf8


def pattern(glob: str) -> re.Pattern:
    out, i, data = b"", 0, glob.encode()
    while i < len(data):
        c = data[i : i + 1]
        if c == b"*":
            wide = data[i : i + 2] == b"**"
            out += b".*" if wide else b"[^/]*"
            i += wide
        elif c == b"?":
            out += b"."
        else:
            i += c == b"\\" and i + 1 < len(data)
            out += re.escape(data[i : i + 1])
        i += 1
    return re.compile(out, re.S)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab/*?\\é", max_size=70), max_size=5), st.lists(st.text(alphabet="ab/é", max_size=90), max_size=8))
def test_automaton_equals_patterns(globs, texts):
    got = urls.Automaton(globs).first_match(*utf8(pa.array(texts, pa.string()))).tolist()
    patterns = [pattern(g) for g in globs]
    assert got == [next((k for k, p in enumerate(patterns) if p.fullmatch(t.encode())), -1) for t in texts]


def test_many_globs_over_several_words():
    globs = [f"*key{i}/**" for i in range(300)]
    automaton = urls.Automaton(globs)
    assert automaton.words > 30
    texts = [f".x.key{i}/path" for i in range(300)] + [".x.key7", "key8/x", "a/key9/b"]
    got = automaton.first_match(*utf8(pa.array(texts))).tolist()
    assert got == [*range(300), -1, 8, -1]
    assert len(automaton.first_match(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0


ROWS = [
    (1, "http://www.Example.COM/en/x?y#z"),
    (2, "https://a.example.com/en/"),
    (3, "http://notexample.com/fr/"),
    (4, "http://com/"),
    (5, "http://example.net/es/1"),
    (6, "ftp://example.net/essay"),
    (7, None),
    (8, ""),
    (9, "no scheme example.com/en/"),
    (10, "http://example.com"),
    (11, "http://host.org/a.com/en/"),
    (12, "http://ÉXAMPLE.com/" + "long/" * 20_000),
    (13, "http://x.net/es/?u=http://example.com/en/"),
    (14, "a://b://c.com/"),
    (1, "http://www.Example.COM/en/x?y#z"),
    (None, "http://example.com/en/*"),
]
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h + p, v) for h, p, v in RULES if ("." + host).endswith("." + h) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0])) if fits else (None, "block")
    return host, path, rule, verdict


@pytest.mark.parametrize("rows", [ROWS, []])
def test_judged(spark, rows):
    pages = frame(spark, rows, ("page_id", "url"), (T.LongType(), T.StringType()))
    got = urls.judged(pages, [urls.site_rule(*r) for r in RULES], default="block")
    assert set(got.columns) == {*pages.columns, "host", "path", "rule", "verdict"}
    found = sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect())
    assert found == sorted(str((i, *plain(u))) for i, u in rows)


def test_no_rules(spark):
    pages = frame(spark, ROWS[:3], ("page_id", "url"), (T.LongType(), T.StringType()))
    assert {(r.rule, r.verdict) for r in urls.judged(pages, []).collect()} == {(None, "allow")}
