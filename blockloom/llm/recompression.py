"""Rounds of recompression over word names, and the symbol by which each window is looked up.

A round names maximal runs of equal neighbours, then pairs: a symbol of the left class takes the
symbol of the right class behind it (classes are a bit of a hash of name and round). A
name is a 64-bit hash of what it stands for, so all tasks of all shards give equal strings
the same name without meeting: naming is global, and a round is a map over documents.

Every symbol carries its witness: the words that must be seen to know that the symbol stands there.
Wherever these words recur, the symbol recurs. So the set of symbols with their witness inside a
window follows from the window's words alone, and equal windows choose the same symbol as their key.
"""

from __future__ import annotations

import numpy as np

from .rolling import mix, of_names

ROUNDS = 2
FAR = 1 << 40


def _hull(low: np.ndarray, high: np.ndarray, a: np.ndarray, b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Witness of symbols a..b with the neighbours on both sides; none at a text's edge, so a symbol there is never known."""
    n = len(text)
    before, after = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
    wl = np.where((a > 0) & (text[before] == text[a]), np.minimum(low[before], low[a]), -FAR)
    wh = np.where((b < n - 1) & (text[after] == text[b]), np.maximum(high[after], high[b]), FAR)
    return wl, wh


def symbols(names: np.ndarray, text: np.ndarray, rounds: int = ROUNDS):
    """names, text: of every word. Yields (name, first word, words, first and end of the witness) of what each round made; first the words."""
    n = len(names)
    lo = np.arange(n)
    hi, wl, wh, name = lo + 1, lo, lo + 1, names
    yield name, lo, hi - lo, wl, wh
    for r in range(rounds):
        if not len(name):
            return
        # runs: every symbol must see both neighbours to know that it is no part of a longer run
        joined = (name[1:] == name[:-1]) & (text[1:] == text[:-1])
        a = np.flatnonzero(np.concatenate(([True], ~joined)))
        b = np.concatenate((a[1:], [len(name)])) - 1
        run = b > a
        wl, wh = _hull(wl, wh, a, b, text)
        with np.errstate(over="ignore"):
            name = np.where(run, mix(name[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), name[a])
        lo, hi, text = lo[a], hi[b], text[a]
        yield name[run], lo[run], (hi - lo)[run], wl[run], wh[run]
        # pairs: a left one that stays alone must see that no right one follows, a right one that no left one precedes
        n = len(name)
        if n < 2:
            return
        with np.errstate(over="ignore"):
            left = (mix(name + np.uint64(r + 1)) & np.uint64(1)) == 1
        near = text[1:] == text[:-1]
        pair = np.concatenate((near & left[:-1] & ~left[1:], [False]))
        first = np.flatnonzero(pair)
        stays = np.ones(n, bool)
        stays[first + 1] = False
        next_high = np.concatenate((np.where(near, wh[1:], FAR), [FAR]))
        previous_low = np.concatenate(([-FAR], np.where(near, wl[:-1], -FAR)))
        low = np.where(left, wl, np.minimum(previous_low, wl))
        high = np.where(left, np.maximum(next_high, wh), wh)
        high[first], hi = wh[first + 1], hi.copy()
        hi[first] = hi[first + 1]
        with np.errstate(over="ignore"):
            made = mix(name[first] * np.uint64(0xA24BAED4963EE407) + name[first + 1] + np.uint64(r))
        name[first] = made
        made = pair[stays]
        lo, hi, wl, wh, name, text = lo[stays], hi[stays], low[stays], high[stays], name[stays], text[stays]
        yield name[made], lo[made], (hi - lo)[made], wl[made], wh[made]


def window_keys(names: np.ndarray, at: np.ndarray, window: int, most: int = 3, rounds: int = ROUNDS) -> np.ndarray:
    """The key of every place: that of the window that starts there (places without a whole window in their text have no meaning).

    The window's symbol is the longest (all of ``most`` words or more count alike; then the name decides,
    then the first). Its key is the hash of the symbol and of the words beside it, on the side where the
    window has more of them, as many as half of what the symbol leaves: so keys are long, whatever the symbol.
    """
    n = len(names)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    best = np.zeros((window, n + window), np.uint64)
    width = n + window
    for name, low, words, wl, wh in symbols(names, text, rounds):
        slack = window - (wh - wl)
        ok = slack >= 0
        # how many words count, 52 bits of the name, the place in the witness, the size
        score = (np.minimum(words[ok], most).astype(np.uint64) << np.uint64(60)) | (name[ok] >> np.uint64(4)) & ~np.uint64(255) | ((low - wl)[ok].astype(np.uint64) << np.uint64(4)) | words[ok].astype(np.uint64)
        order = np.argsort(score, kind="stable")
        flat = (np.minimum(slack[ok], window - 1) * width + wl[ok])[order]
        # the last write wins, and scores ascend; what earlier rounds put there stays if it is more
        best.ravel()[flat] = np.maximum(best.ravel()[flat], score[order])
    # a symbol whose witness begins d places behind the start needs a slack of d at least
    for d in range(window - 2, -1, -1):
        np.maximum(best[d], best[d + 1], out=best[d])
    key, place = best[0, :n].copy(), np.zeros(n, np.int64)
    for d in range(1, window):
        more = best[d, d : n + d] > key
        np.copyto(key, best[d, d : n + d], where=more)
        place[more] = d
    size = (key & np.uint64(15)).astype(np.int64)
    left = place + (key >> np.uint64(4) & np.uint64(15)).astype(np.int64)
    half = (window - size + 1) // 2
    to_right = window - size - left >= left
    start = np.arange(n) + left
    a = np.maximum(np.where(to_right, start, start - half), 0)
    b = np.minimum(np.where(to_right, start + size + half, start + size), n)
    return of_names(names).of(a, np.maximum(a, b)) ^ (key << np.uint64(56)) ^ to_right.astype(np.uint64)
