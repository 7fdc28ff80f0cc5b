"""URL filters: host rules first, then segmented words and multinomial naive Bayes.

Host names run words together.  A unigram model -- word counts over the
visible text of all pages -- lets a Viterbi search split every host label and
path part into its most likely words.  Token counts of the pages that a rule
decides, plus pseudo-counts of a short seed list, train naive Bayes; it
judges the pages that no rule fits.

Nothing is cut by rank or size.  Equal urls are judged once.  Every distinct
run of letters is joined with the counts of its own substrings, so a task
holds the words that one run can be split into and never the vocabulary;
scores are sums over a join with the full token counts.  Seed words weigh a
fixed share of all counts, so their say is the same for any number of pages.

A null url, or one without ``://``, has an empty host and path and score 0.
Null or empty pages have no words.  Repeated rows are judged alike, and ties
(score 0) are allowed.  Very long urls and pages are worked on whole, in time
that grows with their length; an element that is never closed reaches to the
page's end.  Empty tables give empty results; columns but key, url and page
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from synthweave.session import stored

# (host, path prefix, verdict); a rule's name is host + path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Words that mark unwanted sites before any count is known.
SEED = {"block": ("casino", "bets", "poker", "pills", "adult", "porn", "xxx", "spam", "ads", "viagra", "win", "cheap", "free", "track"),
        "allow": ("blog", "wiki", "docs", "edu", "library", "museum")}
SEED_SHARE = 0.001      # of all words, and of a class's tokens, that each seed word counts for (1 at least)
LONGEST_WORD = 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matched_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def visible_words(html: Column) -> Column:
    """Lower-cased ASCII words of a page's text, scripts, styles and tags removed."""
    plain = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)", " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(f"(?<![\\p{{L}}])[a-z]{{1,{LONGEST_WORD}}}(?![\\p{{L}}])"), F.lit(0))


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """``(word, n)`` over the visible text of all pages."""
    return pages.select(F.explode(visible_words(F.col(f"`{html}`"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def seeded(counts: DataFrame, seed: dict = SEED, share: float = SEED_SHARE) -> tuple[DataFrame, int]:
    """Counts with every seed word's share added, and their total."""
    words = sorted({w for ws in seed.values() for w in ws})
    extra = max(1, round(share * (counts.agg(F.sum("n")).first()[0] or 0)))
    more = counts.sparkSession.createDataFrame([(w, extra) for w in words], "word string, n bigint")
    out = stored(counts.unionByName(more).groupBy("word").agg(F.sum("n").alias("n")))
    return out, out.agg(F.sum("n")).first()[0]


def split(run: str, counts: dict[str, int], total: int, longest: int = LONGEST_WORD) -> list[str]:
    """Unigram Viterbi: the split of a run of letters with the highest product of word probabilities."""
    whole = math.log(total + 1)
    cost = {w: whole - math.log(n) for w, n in counts.items()}
    best, back = [0.0], [0]
    for end in range(1, len(run) + 1):                     # an unseen word is the rarer, the longer it is
        found = min((best[at] + cost.get(run[at:end], whole + 2.5 * (end - at)), at) for at in range(max(0, end - longest), end))
        best.append(found[0])
        back.append(found[1])
    words, end = [], len(run)
    while end:
        words.append(run[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(runs: DataFrame, counts: DataFrame, total: int, longest: int = LONGEST_WORD) -> DataFrame:
    """``(run, words)`` for distinct runs of letters: each meets the counts of its own substrings only."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[str, str]] = []
            for run in batch.column(0).to_pylist():
                for at in range(0, len(run), 1000):
                    held += [(run, w) for w in {run[i:i + k] for i in range(at, min(at + 1000, len(run))) for k in range(1, longest + 1)}]
                    if len(held) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["run", "word"])
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], ["run", "word"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split(run, {k["word"]: k["n"] for k in known or ()}, total, longest)
                     for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    known = (runs.mapInArrow(parts, "run string, word string").distinct().join(counts, "word")
             .groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known")))
    return runs.join(known, "run", "left").select("run", "known").mapInArrow(cut, "run string, words array<string>")


def site_tokens(sites: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``(host, path, at, token)``: ``h:word`` for the host's words and ``p:word`` for the path's; runs of digits are one token."""
    runs = lambda mark, c: F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\p{Nd}+"), F.lit(0)), lambda r: F.struct(F.lit(mark).alias("mark"), r.alias("run")))
    each = (sites.select("host", "path", F.posexplode(F.concat(runs("h:", F.col("host")), runs("p:", F.lower("path")))).alias("at", "r"))
            .select("host", "path", "at", "r.mark", "r.run"))
    letters = each.where(F.col("run").rlike(r"^\p{L}"))
    words = segmented(letters.select("run").distinct(), counts, total)
    spelt = (letters.join(words, "run").select("host", "path", "at", "mark", F.posexplode("words").alias("nth", "word"))
             .select("host", "path", F.struct("at", "nth").alias("at"), F.concat("mark", "word").alias("token")))
    digits = each.where(~F.col("run").rlike(r"^\p{L}")).select("host", "path", F.struct("at", F.lit(0).alias("nth")).alias("at"), F.concat("mark", F.lit("0")).alias("token"))
    return spelt.unionByName(digits)


def token_weights(tokens: DataFrame, sites: DataFrame, seed: dict = SEED, share: float = SEED_SHARE) -> DataFrame:
    """``(token, weight)``: log P(token | block) - log P(token | allow), of multinomial naive Bayes with add-one smoothing.

    Counts are those of all pages that a rule decides, plus the seed words.
    """
    per = (tokens.join(sites.where("by_rule is not null").select("host", "path", "by_rule", "pages"), ["host", "path"])
           .groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("by_rule") == c, F.col("pages"))), F.lit(0)).alias(c) for c in ("allow", "block")]))
    per = stored(per)
    sums = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("allow", "block")]).first()
    extra = [("h:" + w, *(max(1, round(share * sums[k])) if k == c else 0 for k in ("allow", "block"))) for c, ws in seed.items() for w in ws]
    more = per.sparkSession.createDataFrame(extra, "token string, allow bigint, block bigint")
    both = per.unionByName(more).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    total = both.agg(F.count(F.lit(1)).alias("kinds"), F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    log = lambda c: F.log((F.col(c) + 1) / F.lit(float(total[c] + total["kinds"] + 1)))
    return both.select("token", (log("block") - log("allow")).alias("weight"))


def _parsed(pages: DataFrame, key: str, url: str, rules: tuple) -> DataFrame:
    host, path = host_and_path(F.col(f"`{url}`"))
    return (pages.select(F.col(f"`{key}`").alias("id"), host.alias("host"), path.alias("path"))
            .withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
            .select("id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("by_rule")))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple = RULES) -> DataFrame:
    """``(key, host, path, rule, verdict, words, score)`` for every page.

    ``words`` are the segmented tokens, ``score`` the log odds of block
    against allow (tokens that no class has seen say nothing); the verdict is
    the rule's where one fits, else block for a positive score.
    """
    parsed = _parsed(pages, key, url, rules)
    counts, total = seeded(stored(word_counts(pages, html)))
    sites = stored(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("pages"), F.first("by_rule").alias("by_rule")))
    tokens = stored(site_tokens(sites.select("host", "path"), counts, total))
    weights = token_weights(tokens, sites)
    # summed as decimals: the same in any order
    told = tokens.join(weights, "token", "left").groupBy("host", "path").agg(
        F.sum(F.col("weight").cast("decimal(24,14)")).cast("double").alias("score"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda t: t["token"]), " ").alias("words"))   # one url's tokens
    score = F.coalesce("score", F.lit(0.0))
    verdict = F.coalesce("by_rule", F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return parsed.join(told, ["host", "path"], "left").select(F.col("id").alias(key), "host", "path", "rule", verdict.alias("verdict"),
                                                              F.coalesce("words", F.lit("")).alias("words"), score.alias("score"))
