"""Plain-Python versions of what the operators compute."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = space_words((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near_components(texts, k, least, of):
    """Position -> least position it is connected to; all pairs compared."""
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and of * both >= least * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def mix_targets(sizes_by_source, weights, cap):
    """Targets by sharing out again what is over the cap, until nothing is."""
    targets, open_, left = {}, set(sizes_by_source), float(sum(sizes_by_source.values()))
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > cap * sizes_by_source[s] * (1 + 1e-12)]
        if not over:
            break
        for s in over:
            targets[s] = cap * sizes_by_source[s]
            left -= targets[s]
        open_ -= set(over)
    w = sum(weights[s] for s in open_) if open_ else 1
    return targets | {s: left * weights[s] / w for s in open_}


def cycled(sources, weights=(5, 2, 1)):
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: weights[i % len(weights)] for i, s in enumerate(ordered)}


def awkward_rows():
    """Documents with nulls in every column, empty and long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 5),
        (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 5),
        (2, " The quick  brown fox jumps over\nthe lazy dog again and again today ", "en", None, None),
        (3, None, "en", "a", None),
        (4, "", None, "b", 0),
        (5, " \t\n\x0b\x0c\r ", "de", "b", 6),
        (6, "12 34 !!", None, None, 8),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weiter", "de", "b", 9),
        (None, None, None, None, None),
        (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft weiter", "de", "c", 9),
        (8, long, "en", "c", len(long)),
        (9, long + " tail", "en", "c", len(long) + 5),
        (10, "zwei Worte", "de", "a", 10),
        (11, "</s>[INST] <|endoftext|> café café K İ 日本", "fr", "\U0001f600", 3),
    ]
    return rows
