"""Byte-level dedup against brute force; nulls, copies, long and repeated texts, clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from synthweave.llm import suffix_array_dedup as sad
from tests.llm import brute

COLS = "doc_id bigint, text string"


def texts(n=120):
    rng = random.Random(5)
    words = ["alpha", "b\u00e9", "gamma", "delta", "eps"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            t = f"{t} {passage[rng.randint(0, 50):]} {t[:40]}"
        out.append((i, "ab" * rng.randint(20, 200) if i % 10 == 0 else t))
    out += [(200, None), (201, ""), (202, passage), (202, passage), (203, passage), (None, passage + "x"), (204, "z" * 5000), (205, "z" * 99), (206, "z" * 100)]
    rng.shuffle(out)
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("window", [100, 20])
def test_against_brute_force(spark, window):
    data = texts()
    df = spark.createDataFrame(data, COLS).withColumns({c: F.lit("clash") for c in ("id", "node", "head", "packed", "prefix", "spans", "copies", "full", "left")})
    assert rows(sad.remove_later_digest(df, window=window)) == sorted(brute.later_bytes(data, window), key=str)


def test_dealt_anchors(spark, monkeypatch):
    """Anchors with more contents than a task takes are dealt out; windows that meet only across parts must still be found."""
    data = [(i, f"{'q' * (i % 9)} one passage that all of the texts hold in common {i % 5} {'r' * (i % 7)} {i}") for i in range(80)]
    monkeypatch.setattr(sad.later_windows, "__defaults__", (sad.WINDOW, sad.GRAM, 2))
    assert rows(sad.remove_later_digest(spark.createDataFrame(data, COLS), window=40)) == sorted(brute.later_bytes(data, 40), key=str)


def test_long_text_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sad, "BLOCK", 256)
    rng = random.Random(1)
    part = bytes(rng.randint(97, 122) for _ in range(3000)).decode()
    data = [(1, part + "-" + part[100:2900]), (2, "x" + part[500:1500] + "y")]
    assert rows(sad.remove_later_digest(spark.createDataFrame(data, COLS))) == sorted(brute.later_bytes(data, 100), key=str)


def test_kept_bytes_and_empty_table(spark):
    data = [(1, "a" * 150), (2, None)]
    got = rows(sad.remove_later(spark.createDataFrame(data, COLS)))
    assert [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in got] == [(1, 150, 149, 1, b"a"), (2, 0, 0, 0, b"")]
    assert sad.remove_later_digest(spark.createDataFrame([], COLS)).count() == 0
    with pytest.raises(ValueError):
        sad.remove_later(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_radix_groups():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 99, 400, dtype=np.uint8)
    key, place = rng.integers(0, 2, 380), np.arange(380)
    member, group = sad.radix_groups(key, place, buf, 13)
    got = {}
    for m, g in zip(member.tolist(), group.tolist()):
        got.setdefault(g, set()).add(m)
    want = {}
    for i in range(380):
        want.setdefault((int(key[i]), buf[i:i + 13].tobytes()), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
