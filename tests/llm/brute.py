"""Plain versions of operators, for tests."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WINDOW = 10


def contamination(texts: list[str | None], items: list[tuple[str | None, str | None]]) -> list[tuple[int, int, int, str]]:
    """(n_words, n_hit, n_items, items_sha256) of each text, window by window."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - WINDOW + 1, 1 if w else 0)):
            windows.setdefault(tuple(w[k : k + WINDOW]), set()).add(i)
    sizes, out = sorted({len(k) for k in windows}), []
    for t in texts:
        w = split(t)
        hit, ids = set(), set()
        for a in range(len(w)):
            for z in sizes:
                if a + z <= len(w) and (own := windows.get(tuple(w[a : a + z]))):
                    hit.update(range(a, a + z))
                    ids |= own
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(i for i in ids if i is not None)).encode()).hexdigest()))
    return out


def longest_matches(text, items):
    """{(id, first word, words)}: matches of whole windows that can be made longer on neither side, by trying all places."""
    own, out = words(text), set()
    for i, t in items:
        w = words(t)
        z = min(len(w), WINDOW)
        at = {(a, b) for a in range(len(own) - z + 1) for b in range(len(w) - z + 1) if z and own[a : a + z] == w[b : b + z]}
        spans = set()
        for a, b in at:
            if (a - 1, b - 1) not in at:
                n = 0
                while (a + n, b + n) in at:
                    n += 1
                spans.add((a, n))
        out |= {(i, a, n + z - 1) for a, n in spans if not any(x <= a and a + n <= x + m and (x, m) != (a, n) for x, m in spans)}
    return out


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def near_classes(rows):
    """Least id of the class of each (id, text), by the exact similarity of all pairs."""
    bags = []
    for _, t in rows:
        w = words(t)
        bags.append(Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1 if w else 0))))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for a, bag in enumerate(bags):
        for g in bag:
            holders[g].append(a)
    for a in range(len(rows)):
        # texts that share nothing are not similar; equal ones without words are one class
        for b in sorted({b for g in bags[a] for b in holders[g] if b < a} | ({b for b in range(a) if rows[b][1] == rows[a][1]} if not bags[a] else set())):
            both = sum((bags[a] | bags[b]).values())
            if rows[a][1] is not None and rows[a][1] == rows[b][1] or both and sum((bags[a] & bags[b]).values()) / both >= 0.8:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


def kneser_ney(train, texts, discounts, order=2):
    """(n_tokens, n_known, train_tokens, base_score, score) of each text."""

    def tokens(t):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x20\x09-\x0d]+", t or "")] + ["</s>"]

    def grams(t):
        padded = ["<s>"] * (order - 1) + tokens(t)
        return [tuple(padded[k : k + order]) for k in range(len(padded) - order + 1)]

    one = Counter(w for t in train for w in tokens(t))
    n, v = sum(one.values()), len(one)
    counts = {order: Counter(g for t in train for g in grams(t))}
    for k in range(order - 1, 0, -1):  # how many different words stand before
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: discounts([sum(x == j for x in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, x in c.items():
            after[k][g[:-1]].append(x)

    def probability(g):
        if not g:
            return 1 / (v + 1)
        own = after[len(g)].get(g[:-1])
        if not own:
            return probability(g[1:])
        x, rest = counts[len(g)].get(g, 0), sum(d[len(g)][min(y, 3)] for y in own)
        return max(x - d[len(g)][min(x, 3)], 0) / sum(own) + rest / sum(own) * probability(g[1:])

    out = []
    for t in texts:
        own = tokens(t)
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own)
        out.append((len(own), sum(one[w] > 0 for w in own), n, base, sum(math.log10(probability(g)) for g in grams(t))))
    return out


def mixed_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing out, stopping what is full and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    rest, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def mixed_copies(rows, weights=(5, 2, 1)):
    """Copies of each (key, source, size): whole times, and once more below the source's budget in the order of the keys' first 60 bits."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, out = mixed_targets(sizes, weights), [0] * len(rows)
    for s, n in sizes.items():
        whole = math.floor(target[s] / n) if n else 0
        left = target[s] - whole * n
        if not n:  # a source without words takes nothing
            continue
        groups = defaultdict(list)
        for k, (key, own, _) in enumerate(rows):
            if own == s:
                out[k] = whole
                groups[(key % 2**64) >> 4].append(k)
        for g in sorted(groups):
            words = sum(rows[k][2] for k in groups[g])
            if words > left:
                if 2 * left >= words:
                    for k in groups[g]:
                        out[k] += 1
                break
            for k in groups[g]:
                out[k] += 1
            left -= words
    return out


def factorized(machine, word_id, text):
    """The margin of a text by all its pairs."""
    own, place = words(text), {int(k): n for n, k in enumerate(machine.keys)}
    at = [place[i] for i in {word_id(w) for w in own} if i in place]
    both = sum(float(machine.factors[a] @ machine.factors[b]) for x, a in enumerate(at) for b in at[:x])
    return machine.bias + sum(float(machine.weights[a]) for a in at) + both / max(len(own), 1)


def ftrl(rows, order, scale, alpha, beta, l1, l2):
    """(bias, weights) after the rows in this order, a coordinate at a time."""
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for k in order:
        label, ids, counts = rows[k]
        x = {int(i): scale * int(c) / sum(map(int, counts)) for i, c in zip(ids, counts, strict=True)}
        bias = -bz / ((beta + math.sqrt(bn)) / alpha)
        w = {i: weight(i) for i in x}
        err = 1 / (1 + math.exp(-(bias + sum(w[i] * v for i, v in x.items())))) - label
        for i, v in x.items():
            g = err * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
            n[i] += g * g
        bz += err - (math.sqrt(bn + err * err) - math.sqrt(bn)) / alpha * bias
        bn += err * err
    return -bz / ((beta + math.sqrt(bn)) / alpha), {i: weight(i) for i in z}
