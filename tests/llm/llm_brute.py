"""Results by definition, for several tests."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text, k):
    w = WORD.findall((text or "").encode().translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def all_segments(scores):
    """Maximal scoring segments by definition: the best segment, then both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    best, place = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, place = total, (i, j + 1)
    a, b = place
    return [*all_segments(scores[:a]), (a, b, best), *((x + b, y + b, s) for x, y, s in all_segments(scores[b:]))]
