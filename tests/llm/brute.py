"""Plain re-statements of the contracts on small data."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def kept_words(docs, window):
    """docs: (doc_id, text) in document order. Lists of kept words."""
    seen, out = set(), []
    for _, text in docs:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append([w for i, w in enumerate(words) if i not in gone])
    return out


def shingles(text, width):
    words = WORD.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def classes(docs, width, percent):
    """{row: (set size, component id)} by comparing every pair."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            smallest[root(i)] = min(doc_id, smallest.get(root(i), doc_id))
    return [(len(sets[i]), smallest.get(root(i))) for i in range(len(docs))]


def viterbi(chars, scores, unknown, longest):
    """Best score over all segmentations of a text in the model's form."""
    best = [0.0]
    for end in range(1, len(chars) + 1):
        options = [best[s] + scores[chars[s:end]][1] for s in range(max(0, end - longest), end) if chars[s:end] in scores]
        if chars[end - 1] not in scores:
            options.append(best[end - 1] + unknown)
        best.append(max(options))
    return best[-1]


def longest_match(word, pieces, longest):
    at, n = 0, 0
    word = "▁" + word
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in pieces:
                break
        else:
            return 1
        at += size
        n += 1
    return n


def targets(sizes, weights, share, most):
    """sizes: {source: words}. Targets by repeated resharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        level = (total - sum(stopped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return {**stopped, **{s: level * weight[s] for s in free}}
        stopped.update({s: most * sizes[s] for s in over})


def sainte_lague(weights, seats):
    """Seats by highest quotients, one at a time; equal quotients go to the smaller unit."""
    got = Counter()
    for _ in range(seats):
        got[max(sorted(weights), key=lambda u: weights[u] / (2 * got[u] + 1))] += 1
    return got
