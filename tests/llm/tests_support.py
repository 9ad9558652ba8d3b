"""Plain versions of the pipeline's stages."""

import re

from test_ngram_join import sets_of
from test_secret_scan import base
from test_wu_manber import WORD, lower


def plain_keepers(docs):
    sets, root = [sets_of(r.text) for r in docs], list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                if 100 * len(a & b) >= 75 * len(a | b):
                    root[find(i)] = find(j)
    best = {}
    for k, r in enumerate(docs):
        key = find(k) if sets[k] else ("empty", r.doc_id, r.text)
        order = (r.doc_id is None, r.doc_id or 0)
        if key not in best or order < best[key][0]:
            best[key] = (order, tuple(r))
    return [r for _, r in best.values()]


def plain_contaminated(text, items, window=10):
    words = WORD.findall(lower(text))
    spelled = f" {' '.join(words)} "
    for _, item in items:
        w = WORD.findall(lower(item))
        m = min(window, len(w))
        if m and any(f" {' '.join(w[k:k + m])} " in spelled for k in range(len(w) - m + 1)):
            return True
    return False


def plain_redacted(before, after):
    """Whether all base spans are gone and the rest is as it was, up to marks."""
    if before is None:
        return after is None
    pieces, at = after.split("[SECRET]"), 0
    for piece in pieces:
        at = before.find(piece, at)
        if at < 0:
            return False
        at += len(piece)
    kept = "\x00".join(pieces)
    return all(re.escape(before[a:b]) and before[a:b] not in kept for a, _, b in base(before))
