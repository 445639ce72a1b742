"""Plain loops with the results that the operators must have."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_ASCII)


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def measures(text):
    words = solid(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if solid(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


def base_failed(text):
    n, _, _, _, repeated, _ = measures(text)
    return n < 20 or 100 * repeated > 30 * n


def kept_by_rules(rows):
    """Whether the quality rules keep each (text, host)."""
    found = [measures(t) for t, _ in rows]
    failed = [(base_failed(t), m[2] > 0.3 * m[1], m[3] > 0.5 * m[5]) for (t, _), m in zip(rows, found)]
    kept = [not f[0] for f in failed]
    for rule in range(3):
        hosts = {h: [f[rule] for f, (_, own) in zip(failed, rows) if own == h] for h in {h for _, h in rows}}
        raw = [sum(x) / len(x) for x in hosts.values()]
        mean = sum(raw) / len(raw)
        spread = sum((x - mean) ** 2 for x in raw) / len(raw)
        strength = min(max(mean * (1 - mean) / spread - 1, 1), 1e6) if spread > 0 else 1e6
        for i, (_, host) in enumerate(rows):
            rate = (strength * mean + sum(hosts[host])) / (strength + len(hosts[host]))
            junk, other = (0.9, 0.01) if failed[i][rule] else (0.1, 0.99)
            if rate * junk >= (1 - rate) * other:
                kept[i] = False
    return kept


def fingerprint(text, size=4):
    words = solid(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    """The smallest position that each fingerprint is connected with."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def windows(items, size=10):
    """Window to the items that have it."""
    out = {}
    for item, text in items:
        words = alnum(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out.setdefault(tuple(words[i:i + size]), set()).add(item)
    return out


def contaminated(text, phrases):
    """Number of words, of hit words, and the items that hit."""
    words, hit, found = alnum(text), set(), set()
    for n in {len(p) for p in phrases}:
        for i in range(len(words) - n + 1):
            if items := phrases.get(tuple(words[i:i + n])):
                found |= items
                hit |= set(range(i, i + n))
    return len(words), len(hit), found


def deduplicated(rows, least=20, over_blanks=False):
    """Text and removed byte spans of each (key, text), in order of key. With ``over_blanks``, units without
    a word have no number, so that runs go on over them."""
    first, out = {}, {}
    for key, text in sorted(rows):
        data, at, runs = (text or "").encode(), 0, []
        ends = {m.end() for m in re.finditer(rb"(?<=[.!?])[\x20\x09-\x0D]+", data)} | {i + 1 for i, c in enumerate(data) if c == 10}
        ends = sorted(ends | ({len(data)} if data else set()))
        number = -1
        for end in ends:
            words = tuple(alnum(data[at:end].decode()))
            number += bool(words) or not over_blanks
            if words and first.setdefault(words, (key, number)) != (key, number):
                if runs and runs[-1][0] == number - 1:
                    runs[-1][0], runs[-1][2], runs[-1][3] = number, end, runs[-1][3] + len(words)
                else:
                    runs.append([number, at, end, len(words)])
            at = end
        spans = [(a, b) for _, a, b, n in runs if n >= least]
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + data[at:a], b
        out[key] = (None if text is None else (kept + data[at:]).decode(), spans)
    return out


def runs(words, least=24, times=3):
    """(start, length, period) of every run, by each lag's stretches of equal words."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                part = words[i - q:j]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((i - q, length, q))
            i = j + 1
    return sorted(out)


def rewritten(words, key):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic(text, key):
    """All columns of the run detection but the id."""
    words = rewritten(solid(text), key)
    found = runs(words)
    gone = {i for s, l, p in found for i in range(s + p, s + l)}
    best = min(found, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if found else (None,) * 3
    digests = ["".join(f"{s},{l},{p}\n" for s, l, p in found), " ".join(w for i, w in enumerate(words) if i not in gone)]
    return len(found), *best, 1000 * best[1] // best[2] if found else None, *(hashlib.sha256(d.encode()).hexdigest() for d in digests)


def audit(rows, least_docs, top):
    """(lang, source, part, item, value, rank) from (text, lang, source)."""
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in rows]
    out = []
    for lang in {x[0] for x in words}:
        docs = Counter(t for l, _, ws in words if l == lang for t in set(ws))
        kept = sorted((t for t, n in docs.items() if n >= least_docs), key=str.encode)
        counts = {s: Counter() for l, s, _ in words if l == lang}
        for l, s, ws in words:
            if l == lang:
                counts[s].update(t for t in ws if docs[t] >= least_docs)
        price = {}
        for s, c in [*counts.items(), (None, sum(counts.values(), Counter()))]:
            total = sum(c.values()) + 5 * len(kept)
            price[s] = {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}
        for s in counts:
            pairs = [(o, sum(abs(price[s][t] - price[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, price[s][t] - price[None][t]) for t in kept if counts[s][t] and price[s][t] > price[None][t]]
            for part, listed, most in (("pair", pairs, None), ("term", terms, top)):
                listed.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(listed[:most])]
    return out


def nearest(rows, asked, k=5):
    """(query id, rank, id, score) from different (id, whole components)."""
    out = []
    for key, vec in rows:
        if asked(key):
            found = sorted((-sum(a * b for a, b in zip(vec, other)), i) for i, other in rows if (i, other) != (key, vec))
            out += [(key, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out
