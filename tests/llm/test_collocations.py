"""Phrase mining against DuckDB and brute force; the trie alone, sieves that drop much, many small tries."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synthweave.llm import collocations as col

COLS = "doc_id bigint, text string, lang string"


def corpus(n=400):
    rng = np.random.default_rng(0)
    pick = lambda ws, k: " ".join(rng.choice(ws, rng.integers(0, k)))
    texts = [(i, pick(["the", "of", "Cat", "dog", "a", "\u00e9", "x\ty"], 40) + str(rng.choice([". ", ",", "\n", ""])) + pick(["the", "of", "cat"], 20),
              ["en", "de", None][i % 3]) for i in range(n)]
    return texts + [(n, None, "en"), (n, "", None), (n, "...", "fr"), (n, "New York City. " * 12, "fr"), (n, "one", "und")]


def brute(texts, least, most):
    f, total = Counter(), Counter()
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for _, text, lang in texts:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in found.items():
        lang, w = p[0], p[1:]
        if any(q[0] == lang and len(q) > len(p) and w in (q[1:3], q[2:4]) and 100 * b >= 50 * a for q, b in found.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return [(lang, i + 1, t.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for i, (s, a, t, left, right) in enumerate(sorted(rows)[:most])]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("most", [2000, 7])
def test_against_brute_force(spark, most):
    data = corpus()
    df = spark.createDataFrame(data, COLS).withColumns({c: F.lit("clash") for c in ("word", "n", "symbol", "s1", "phrase", "rank", "trie")})
    assert rows(col.collocations(df, most=most)) == sorted(brute(data, 10, most), key=str)


def test_many_tries_and_a_full_sieve(spark, monkeypatch):
    """Small tries in several rounds, and a sieve so small that every slot is full, change nothing."""
    monkeypatch.setattr(col.occurrences, "__defaults__", (10, 20, 2))
    monkeypatch.setattr(col, "SIEVE_BITS", (4, 4))
    data = corpus(150)
    assert rows(col.collocations(spark.createDataFrame(data, COLS))) == sorted(brute(data, 10, 2000), key=str)


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([(10 ** 12, 3 * 10 ** 12, 2 * 10 ** 12)], "a bigint, l bigint, r bigint")
    assert df.select(col._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10 ** 6 * 10 ** 24 // (6 * 10 ** 24)


def test_trie():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    symbols, size = words[rng.integers(0, 700, (3000, 3))], rng.integers(2, 4, 3000)
    symbols[size == 2, 2] = 0
    symbols = np.unique(symbols, axis=0)
    size = np.where(symbols[:, 2] == 0, 2, 3)
    trie = col.Trie.from_bytes(col.Trie.of(symbols, size).to_bytes())
    text = words[rng.integers(0, 700, 4000)]
    text[:1000] = symbols[rng.integers(0, len(symbols), 1000), rng.integers(0, 2, 1000)]
    text = np.concatenate([text, symbols[size == 3][:200].ravel()])
    left = np.arange(len(text), 0, -1)
    want = Counter(tuple(text[i:i + k].tolist()) for k in (2, 3) for i in range(len(text) - k + 1))
    got = trie.count(col.Pieces(None, text, left))
    assert [want[tuple(s[:k].tolist())] for s, k in zip(symbols, size)] == got.tolist() and got.sum() > 200


def test_long_text_and_empty_table(spark):
    data = [(1, "big apple " * 200_000, "en"), (2, "w" * 300_000, "en")]
    assert rows(col.collocations(spark.createDataFrame(data, COLS))) == sorted(brute(data, 10, 2000), key=str)
    none = col.collocations(spark.createDataFrame([], COLS))
    assert none.count() == 0 and none.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_oracle(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = col.collocations(spark.read.parquet(f"{sf}/documents.parquet"))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({col.oracle_sql()})").fetchall()
    assert rows(df) == sorted(want, key=str) and len(want) > 50


def test_texts_are_read_as_often_for_any_number_of_tries(spark, monkeypatch):
    """Four tries took one more pass over all texts, so the passes grew with the candidates."""
    df = spark.createDataFrame(corpus(150), COLS)
    frame, passes, tried = type(df), [], []
    run, deal = frame.mapInArrow, col.dealt

    def spy(self, f, schema, *a, **b):
        passes.extend([1] * (self.columns == ["text", "lang"]))
        return run(self, f, schema, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", spy)
    monkeypatch.setattr(col, "dealt", lambda *a: tried.append(deal(*a)) or tried[-1])
    monkeypatch.setattr(col, "SIEVE_BITS", (4, 4))
    monkeypatch.setattr(col.occurrences, "__defaults__", (10, 25, 4))
    got = rows(col.collocations(df, most=50))
    assert max(trie + split for _, trie, split in tried[0]) > 4 and len(passes) == 4
    assert got == sorted(brute(corpus(150), 10, 50), key=str)


def test_ranges_of_phrases_to_tries(spark):
    """Small ranges share a trie, one that is larger than a trie takes several."""
    sizes = {0: 3, 1: 4, 2: 4, 5: 25, 7: 1}
    table = spark.createDataFrame([(p, p * 100 + i, i, None if i % 2 else 7) for p, n in sizes.items() for i in range(n)], "part int, s1 bigint, s2 bigint, s3 bigint")
    found = col.dealt(table, 10)
    assert found == [(0, 0, 1), (1, 0, 1), (2, 1, 1), (5, 2, 3), (7, 5, 1)]
    built = {r["trie"]: col.Trie.from_bytes(r["data"]) for r in col.tries(table, found).collect()}
    phrases = {i: {tuple(t.vocabulary[p[p >= 0]].tolist()) for p in t.phrases} for i, t in built.items()}
    assert len(phrases[0]) == 7 and len(phrases[1]) == 4 and len(set().union(*phrases.values())) == sum(map(len, phrases.values())) == 37
    seen = np.array([[500, 0, 3], [501, 1, 9], [999, 1, 5]], np.uint64)
    assert sum(t.count_windows(seen).sum() for i, t in built.items() if 2 <= i < 5) == 9          # (500, 0) is no phrase of two words
    assert not col._added(np.zeros(0, np.uint64), np.zeros((0, 3), np.uint64))[1].size
