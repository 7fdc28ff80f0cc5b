"""Beginnings of a prefix's suffixes are told apart step by step, no further than their groups ask for."""

import random

from synthweave.llm import substring_dedup as S


def test_longer_beginnings_of_large_groups_only(spark, monkeypatch):
    rng, count, seen = random.Random(3), S.beginning_counts, []
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    shared = [word() for _ in range(30)]
    rows = [(i, " ".join([*(word() for _ in range(25)), *shared, *(word() for _ in range(25))])) for i in range(12)]

    def spy(*args):
        out = count(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(S, "beginning_counts", spy)
    found = S.repeated_windows(spark.createDataFrame(rows, "node bigint, text string"), 20, 8, group=4).collect()
    covered = {(r["node"], at) for r in found for at in range(r["first"], r["last"] + 1)}
    assert covered == {(i, at) for i in range(12) for at in range(25, 36)}
    # every window was a row at every level
    assert len(seen) > 1 and seen[0] > seen[1] and seen[0] > seen[-1]


def covered(found):
    return {(r["node"], at) for r in found.collect() for at in range(r["first"], r["last"] + 1)}


def repeated(rows, window):
    """Places of windows that start at two or more places, by brute force."""
    starts = {}
    for node, text in rows:
        w = text.split()
        for p in range(len(w) - window + 1):
            starts.setdefault(tuple(w[p:p + window]), []).append((node, p))
    return {x for places in starts.values() if len(places) > 1 for x in places}


def test_equal_rows_of_a_large_prefix_meet_once(spark, monkeypatch):
    """A passage and a sentence said over and over in many texts: no row for each of their windows."""
    rng, seen = random.Random(5), []
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    passage, chant = [word() for _ in range(150)], ["is", "one"] * 40
    rows = [(i, " ".join([*(word() for _ in range(9)), *passage, *(word() for _ in range(9)), *chant, *(word() for _ in range(9))])) for i in range(12)]
    want = repeated(rows, 20)
    assert len(want) == 12 * (131 + 61)

    def spied(name):
        count = getattr(S, name, None)

        def spy(*args):
            out = count(*args)
            seen.append(out.count())
            return out

        monkeypatch.setattr(S, name, spy, raising=False)

    spied("beginning_counts")
    spied("row_counts")
    assert covered(S.repeated_windows(spark.createDataFrame(rows, "node bigint, text string"), 20, 8, group=4)) == want
    # a row for each window of the passage, at every level, before
    assert sum(seen) < len(want) / 2


def test_equal_rows_against_brute_force(spark):
    """Few different words: equal rows within a text and across texts, and equal windows of rows that differ."""
    rng = random.Random(11)
    parts = [[f"p{i}{j % (i + 2)}" for j in range(rng.randrange(8, 40))] for i in range(5)]
    rows = [(i, " ".join(w for _ in range(rng.randrange(1, 5)) for w in [*rng.choice(parts), *([f"u{rng.randrange(3)}"] if rng.random() < 0.6 else [])]))
            for i in range(80)]
    rows += [(100, "run " * 60), (101, "run " * 45), (102, "x " + "run " * 30 + "y"), (103, "")]
    df = spark.createDataFrame(rows, "node bigint, text string").dropDuplicates(["text"])
    rows = [tuple(r) for r in df.collect()]
    for window, gram in ((12, 4), (9, 9)):
        want = repeated(rows, window)
        for group in (1, 3, 20):
            assert covered(S.repeated_windows(spark.createDataFrame(rows, "node bigint, text string"), window, gram, group=group)) == want
