"""Plain versions of what the operators compute, over Python lists."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return (text or "").encode().translate(LOWER).split()


def shingles(text, width):
    w = words(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def components(docs, num, den, width):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common) and find(i) != find(j):
                    x, y = sorted((find(i), find(j)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def held(i, of, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % of == remainder


def sha(data):
    return hashlib.sha256(data).hexdigest()


def _discounts(counts):
    n1, n2, n3, n4 = (sum(1 for c in counts if c == i) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0, 0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0, *(min(max(v, 0), i) for i, v in enumerate(raw, 1))]


class Bigrams:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        self.count, self.pair = Counter(), Counter()
        for t in texts:
            tokens = [*words(t), "end"]
            self.count.update(tokens)
            self.pair.update(zip(["start", *tokens], tokens, strict=False))
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.left, self.after = Counter(), defaultdict(list)
        for (a, b), c in self.pair.items():
            self.left[b] += 1
            self.after[a].append(c)
        self.total = {a: sum(c) for a, c in self.after.items()}
        self.d, self.dw = _discounts(list(self.pair.values())), _discounts(list(self.left.values()))
        self.word_mass = sum(self.dw[min(c, 3)] for c in self.left.values())
        self.mass = {a: sum(self.d[min(x, 3)] for x in c) for a, c in self.after.items()}

    def word(self, w):
        if not self.pair:
            return 1 / (self.v + 1)
        mass = self.word_mass / len(self.pair)
        return max(self.left[w] - self.dw[min(self.left[w], 3)], 0) / len(self.pair) + mass / (self.v + 1)

    def probability(self, before, w):
        if before not in self.after:
            return self.word(w)
        total, c = self.total[before], self.pair[before, w]
        mass = self.mass[before] / total
        return max(c - self.d[min(c, 3)], 0) / total + mass * self.word(w)

    def score(self, text):
        tokens = [*words(text), "end"]
        score = sum(math.log10(self.probability(a, b)) for a, b in zip(["start", *tokens], tokens, strict=False))
        base = sum(math.log10((self.count[t] + 1) / (self.n + self.v + 1)) for t in tokens)
        return len(tokens), sum(1 for t in tokens if self.count[t]), base, score


def tiling(text, item, least):
    """Greedy string tiling by trying every pair of places."""
    least = min(least, len(item))
    free_t, free_i, found = [True] * len(text), [True] * len(item), []
    while least:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and free_t[i + n] and free_i[j + n] and text[i + n] == item[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            break
        for n in range(best[2]):
            free_t[best[0] + n] = free_i[best[1] + n] = False
        found.append(best)
    return found
