"""Plain single-process versions of the operators' contracts, for small inputs."""

import base64
import collections
import hashlib
import itertools
import math
import re

import numpy as np

from synthweave.llm import mixing, quality_rules, secrets_scan, url_filter, weighted_minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, window=35):
    seen = collections.Counter()
    split = [(i, words(t)) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[p:p + window]) for p in range(len(w) - window + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p:p + window])] > 1:
                gone[p:p + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def later_bytes(rows, window):
    """Bytes covered by a string that starts earlier; ids in order, null ids last."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - window + 1):
            if raw[p:p + window] in seen:
                gone[p:p + window] = [True] * window
            seen.add(raw[p:p + window])
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        out.append((i, len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone) if not g))))
    return out


def bpe(rows, path, pattern):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(enc.decode_bytes(ids))))
    return out


def nearest(rows, asks, n=10):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if asks(i):
            d = np.sqrt(((x - v) ** 2).sum(1))
            order = [k for k in np.lexsort((ids, d)) if ids[k] != i][:n]
            out[i] = [(int(ids[k]), float(d[k])) for k in order]
    return out


ASSIGN = re.compile(r"""(?a:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    n = collections.Counter(k for *_, k in found)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in found))


def shingle_weights(rows, idf):
    out = {}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[p:p + 5]) for p in range(len(w) - 4)] or ([tuple(w)] if w else [])
        out[i] = {g: c * idf(g) for g, c in collections.Counter(grams).items()}
    return out


def weighted_jaccard(a, b):
    keys = set(a) | set(b)
    low = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys)
    high = sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    return low / high if high else 0.0


def accepted(text):
    """The quality rules, one text at a time."""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    starts = collections.defaultdict(list)
    for i in range(len(w) - quality_rules.WINDOW + 1):
        starts[tuple(w[i:i + quality_rules.WINDOW])].append(i)
    repeated = {p + k for at in starts.values() if len(at) > 1 for p in at for k in range(quality_rules.WINDOW)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
         "n_stop_words": sum(x.lower() in quality_rules.STOP_WORDS for x in w), "n_repeat_words": len(repeated), "n_lines": len(lines),
         "n_dup_lines": len(lines) - len(set(lines)), "n_ellipsis_lines": sum(x.rstrip(" ").endswith(("...", "\u2026")) for x in lines),
         "n_bullet_lines": sum(x.lstrip(" ")[:1] in ("-", "*", "\u2022") for x in lines)}
    for value, per, low, high in quality_rules.RULES.values():
        x = m[value] if per is None else m[value] / m[per] if m[per] else 0.0
        if (low is not None and x < low) or (high is not None and x > high):
            return False
    return len(w) >= 20 and 100 * len(repeated) <= 30 * len(w)


def classes(texts, threshold=weighted_minhash.THRESHOLD):
    """The least id of every text's near-duplicate class, by all pairs."""
    held = shingle_weights(texts, lambda g: 1)
    df = collections.Counter(g for t in held.values() for g in t)
    w = shingle_weights(texts, lambda g: 1 + weighted_minhash.IDF_STRENGTH * math.log((len(texts) + 1) / (df[g] + 1)) / math.log(len(texts) + 1))
    least = {i: i for i, _ in texts}
    for a, b in itertools.combinations(sorted(least), 2):
        if least[a] != least[b] and weighted_jaccard(w[a], w[b]) >= threshold:
            least = {i: min(least[a], least[b]) if c in (least[a], least[b]) else c for i, c in least.items()}
    return least


def masked(rows):
    """``(id, text, source)`` with live and unclear spans masked."""
    found = {i: secrets_scan.find_spans(t) for i, t, _ in rows}
    owners = collections.defaultdict(set)
    for i, _, source in rows:
        for *_, value, _ in found[i]:
            owners[value].add(source)
    out = []
    for i, t, source in rows:
        spans = sorted((s, e) for kind, s, e, v, live in found[i] if len(owners[v]) < secrets_scan.EXAMPLE_OWNERS and (live or kind in secrets_scan.BASE))
        text, at = "", 0
        for s, e in spans:
            text += t[at:s] + "[secret]" if s >= at else ""
            at = max(at, e)
        out.append((i, text + t[at:], source))
    return out


def mixed(rows):
    """Every ``(id, text, source)`` as often as the mix takes it."""
    size = collections.Counter()
    for _, t, source in rows:
        size[source] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            target = {s: 3 * size[s] if s in full else weight[s] * level for s in names}
            break
        full |= over
    out = []
    for i, t, source in rows:
        rate = target[source] / size[source] if size[source] else 0.0
        draw = int(hashlib.md5(f"{i}:{mixing.SEED}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out += [(i, t, source)] * (int(rate) + (draw < rate - int(rate)))
    return out


def url_verdicts(pages):
    """``{id: (rule, verdict, words, score)}`` of ``(id, url, html)``, all in one process."""
    text = collections.Counter()
    for _, _, html in pages:
        plain = re.sub(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)", " ", html or "", flags=re.S | re.I)
        text.update(re.findall(r"(?<![^\W\d_])[a-z]{1,20}(?![^\W\d_])", plain.lower()))
    extra = max(1, round(url_filter.SEED_SHARE * sum(text.values())))
    for w in {w for ws in url_filter.SEED.values() for w in ws}:
        text[w] += extra
    total = sum(text.values())
    split, token_count = {}, {"allow": collections.Counter(), "block": collections.Counter()}
    for i, url, _ in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        rule = max(((h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=(None, None))
        tokens = []
        for mark, part in (("h:", host), ("p:", path.lower())):
            for run in re.findall(r"[^\W\d_]+|\d+", part):
                tokens += [mark + "0"] if run[0].isdigit() else [mark + w for w in url_filter.split(run, text, total)]
        split[i] = (rule, tokens)
        if rule[1]:
            token_count[rule[1]].update(tokens)
    sums = {c: sum(n.values()) for c, n in token_count.items()}
    for c, ws in url_filter.SEED.items():
        for w in ws:
            token_count[c]["h:" + w] += max(1, round(url_filter.SEED_SHARE * sums[c]))
    kinds = set(token_count["allow"]) | set(token_count["block"])
    log = lambda c, t: math.log((token_count[c][t] + 1) / (sum(token_count[c].values()) + len(kinds) + 1))
    out = {}
    for i, (rule, tokens) in split.items():
        score = sum(log("block", t) - log("allow", t) for t in tokens if t in kinds)
        out[i] = (rule[0], rule[1] or ("block" if score > 1e-12 else "allow"), " ".join(tokens), score)
    return out


def languages(docs, pages, module):
    """Language of every page, by the operator's formulas without Spark; labelled ``(id, text, lang)`` all count."""
    langs = sorted({x for _, _, x in docs})
    table = np.ones((len(langs), module.BUCKETS))
    for _, t, x in docs:
        np.add.at(table[langs.index(x)], module._trigrams(np.frombuffer((t or "").encode(), np.uint8)), 1)
    logp = np.log(table / table.sum(axis=1, keepdims=True))
    out = {}
    for i, html in pages:
        grams = module._trigrams(np.frombuffer(module._TAGS.sub(" ", html or "").encode(), np.uint8))
        out[i] = langs[int(logp[:, grams].sum(axis=1).argmax())] if len(grams) else None
    return out
