"""Plain versions of the operators, for small inputs."""

import math
from collections import Counter, defaultdict

import regex

WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
CUT = regex.compile(r"[.!?]+[ \t\r\n]+|[。！？]+[ \t\r\n]*|[ \t\r]*\n[ \t\r\n]*")


def near_classes(docs: dict[int, str], threshold: float = 0.8, rare: int = 2**14) -> dict[int, int]:
    """Class ids by all pairs that share a run of five words."""
    words = {i: WORD.findall(t.lower()) for i, t in docs.items()}
    runs = {}
    for i, ws in words.items():
        k = min(5, len(ws))
        runs[i] = Counter(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)) if ws else Counter()
    df = Counter(s for some in runs.values() for s in some)
    idf = {s: 1 + math.log((1 + len(docs)) / (1 + max(c, len(docs) / rare))) / math.log(2**18) for s, c in df.items()}
    weights, holders = {}, defaultdict(list)
    for i, some in runs.items():
        weights[i] = {s: n * idf[s] for s, n in some.items()}
        for s in some:
            holders[s].append(i)
    both = defaultdict(float)
    for s, ids in holders.items():
        for x, a in enumerate(ids):
            for b in ids[x + 1 :]:
                both[a, b] += min(weights[a][s], weights[b][s])
    total = {i: sum(w.values()) for i, w in weights.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    same = defaultdict(list)
    for i, t in docs.items():
        same[t].append(i)
    pairs = [p for p, o in both.items() if o / (total[p[0]] + total[p[1]] - o) >= threshold]
    for a, b in pairs + [(ids[0], i) for ids in same.values() for i in ids[1:]]:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in docs}


def without_repeats(docs: dict[int, str], words: int = 25, long: int = 50) -> dict[int, str]:
    """Texts without the sentences under spans that came before, in ascending id."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        parts, at = [], 0
        for m in CUT.finditer(t):
            parts.append((t[at : m.end()], WORD.findall(t[at : m.start()].lower())))
            at = m.end()
        parts.append((t[at:], WORD.findall(t[at:].lower())))
        some = [k for k, p in enumerate(parts) if p[1]]
        count = [len(parts[k][1]) for k in some]
        runs = {(p, p) for p, n in enumerate(count) if n >= long}
        for p in range(len(some)):
            ends = [q for q in range(p + 1, len(some)) if sum(count[p : q + 1]) >= words]
            starts = [q for q in range(p) if sum(count[q : p + 1]) >= words]
            runs |= {(p, min(ends))} if ends else set()
            runs |= {(max(starts), p)} if starts else set()
        if len(some) > 1 and sum(count) < words:
            runs.add((0, len(some) - 1))
        gone = set()
        for p, q in sorted(runs):
            key = tuple(w for k in some[p : q + 1] for w in parts[k][1])
            if key in seen:
                gone |= set(some[p : q + 1])
            seen.add(key)
        out[i] = "".join(p for k, (p, _) in enumerate(parts) if k not in gone)
    return out


def chunk_set(data: bytes, gear: list[int]) -> dict[bytes, int]:
    """Chunks of ``data`` and their lengths, byte by byte."""
    out, at, h = {}, 0, 0
    for k, byte in enumerate(data):
        h = ((h << 1) + gear[byte]) % 2**32
        size = k + 1 - at
        small = 16 <= size < 64 and h < 2**24
        large = 64 <= size and h < 2**28
        # a rest of at most the smallest size is one chunk
        if (small or large or size == 256 or k + 1 == len(data)) and (k + 1 == len(data) or len(data) - at > 16):
            out[data[at : k + 1]] = size
            at = k + 1
    return out


def covered(a: dict[bytes, int], b: dict[bytes, int]) -> float:
    return sum(n for c, n in a.items() if c in b) / sum(a.values()) if a else float(not b)


def trigrams(text: str) -> Counter:
    """Byte trigrams of lower-case words with one blank for what is between and around them, digits too, by hashed slot."""
    data = regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", text.lower()).encode()
    data = bytes(32 if 48 <= c <= 57 else c for c in data)
    return Counter(((int.from_bytes(data[k : k + 3], "little") * 2654435761) % 2**32) >> 20 for k in range(len(data) - 2))


def table_of(shards, size, digest) -> list[int]:
    """The lookup table by taking turns in a loop."""
    first = [digest(s, 0) % size for s in shards]
    skip = [digest(s, 8) % (size - 1) + 1 for s in shards]
    owner, at = [-1] * size, [0] * len(shards)
    for step in range(size):
        k = step % len(shards)
        while owner[(first[k] + at[k] * skip[k]) % size] >= 0:
            at[k] += 1
        owner[(first[k] + at[k] * skip[k]) % size] = k
    return owner


def best_score(text: str, pieces: dict[bytes, float], worst: float) -> float:
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 50) + 1):
            s = pieces.get(text[i:j].encode())
            if s is not None:
                best[j] = max(best[j], best[i] + s)
        if text[i].encode() not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + worst)
    return best[-1]
