"""Plain restatements of the operators, for small inputs."""

import re
from collections import defaultdict

import numpy as np
import xxhash

SF001 = "/root/testdata/sf0.001"


def join_groups(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def edits(a, b):
    row = np.arange(len(b) + 1)
    for i, c in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + np.array([x != c for x in b], bool), row[1:] + 1)
        steps = np.arange(len(row))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def simhash(norm, common=None, long=40):
    """``common``: a byte a hash place; in long lines the words of marked places don't vote."""
    hashes = [xxhash.xxh64_intdigest(w, seed=42) for w in norm.split(" ")]
    if common and len(hashes) >= long:
        hashes = [h for h in hashes if not common[h & len(common) - 1]]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def share_block(x, bits, blocks=8):
    """Whether two SimHashes with the differing bits ``x`` share a block of ``bits`` bits, blocks being cut around the circle."""
    step = 64 // blocks
    return any((x >> step * k | x << 64 - step * k) & (1 << bits) - 1 == 0 for k in range(blocks))


def removed_lines(docs, min_words=5, similarity=0.8, flips=None, bits=None, common=None):
    """docs: (id, text). {(id, text): sorted numbers of the removed lines}. With ``bits``, pairs must share a block and lie within ``flips``."""
    where = defaultdict(set)
    for ident, text in docs:
        for i, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"[\W_]+", " ", line.lower()).strip(" ")
            if norm:
                where[norm].add((ident is not None, ident or 0, ident, text, i))
    norms = sorted(where)
    long = [i for i, x in enumerate(norms) if x.count(" ") >= min_words - 1]
    sims = {i: simhash(norms[i], common) for i in long} if bits else {}
    links = []
    for k, a in enumerate(long):
        for b in long[k + 1:]:
            if bits and ((sims[a] ^ sims[b]).bit_count() > flips or not share_block(sims[a] ^ sims[b], bits)):
                continue
            x, y = norms[a].split(" "), norms[b].split(" ")
            allowed = int(np.floor(round((1 - similarity) * max(len(x), len(y)), 6)))
            if abs(len(x) - len(y)) <= allowed and edits(x, y) <= allowed:
                links.append((a, int(b)))
    groups = defaultdict(list)
    for x, g in zip(norms, join_groups(len(norms), links)):
        groups[g] += where[x]
    gone = defaultdict(set)
    for places in groups.values():
        order = sorted(places, key=lambda p: (p[0], p[1], xxhash_row(p[2], p[3]), p[4]))
        for p in order[1:]:
            gone[(p[2], p[3])].add(p[4])
    return {k: sorted(v) for k, v in gone.items()}, links


def xxhash_row(ident, text):
    h = 42
    if ident is not None:
        h = xxhash.xxh64_intdigest(int(ident).to_bytes(8, "little", signed=True), seed=h)
    if text is not None:
        h = xxhash.xxh64_intdigest(text, seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h
