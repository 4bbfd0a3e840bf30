"""Plain versions of what the operators compute, for small tables."""

import re
from collections import Counter, defaultdict
from math import log10

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lowered(text):
    return bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in (text or "").encode())


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text, width):
    w = WORD.findall(lowered(text))
    return [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)] * bool(w)


def linked(nodes, links):
    """The smallest node that can be reached from each."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def without_repeats(texts, length):
    """Words of each text that lie in no window that starts twice."""
    own = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in own for i in range(len(w) - length + 1))
    out = []
    for w in own:
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                keep[i : i + length] = [False] * length
        out.append((len(w), [x for x, k in zip(w, keep, strict=True) if k]))
    return out


class Ppm:
    """PPM with exclusion, escape method C; all contexts of up to ``order`` bytes."""

    def __init__(self, texts, order=4):
        self.order = order
        self.counts = defaultdict(Counter)
        for text in texts:
            x = b"\xff" * order + lowered(text) + b"\xff"
            for i in range(order, len(x)):
                for k in range(order + 1):
                    self.counts[x[i - k : i]][x[i]] += 1

    def probability(self, context, symbol):
        k = self.order
        p, out = 1.0, set()
        while k >= 0:
            here = self.counts[context[len(context) - k :]]
            free = {s: c for s, c in here.items() if s not in out}
            escape = len(free) if len(here) < 256 else 0
            total = sum(free.values()) + escape
            if symbol in free:
                return p * free[symbol] / total
            p *= escape / total if total else 1
            out |= set(here)
            k -= 1
        return p / (256 - len(out))

    def score(self, text):
        x = b"\xff" * self.order + lowered(text) + b"\xff"
        return sum(log10(self.probability(x[i - self.order : i], x[i])) for i in range(self.order, len(x)))
