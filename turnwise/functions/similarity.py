"""String similarity from 0 to 100 on the longest common subsequence: 200 LCS / (len a + len b)."""

from __future__ import annotations


def _places(a: str) -> dict[str, int]:
    """The places of each character, as bits of an int."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _lcs(a: str, b: str, at: dict[str, int] | None = None) -> int:
    """The length of the longest common subsequence, with one machine word a column (bits of an int); ``at``: ``a``'s places."""
    at = _places(a) if at is None else at
    rows = (1 << len(a)) - 1
    state = rows
    for c in b:
        hit = state & at.get(c, 0)
        state = (state + hit | state - hit) & rows
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any stretch of the longer one of its length, or cut at an edge."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def reaches(a: str, b: str, least: int) -> bool:
    """Whether ``ratio`` or ``partial_ratio`` is ``least`` or more.

    A stretch of w letters has w letters in common at most, and no more than the whole, so most stretches need no look.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return least <= (0 if b else 100)
    n, at = len(a), _places(a)
    most = _lcs(a, b, at)
    if 200 * most >= least * (n + len(b)):
        return True
    if most * (200 - least) < least * n:
        return False
    at_least = lambda piece: 200 * _lcs(a, piece, at) >= least * (n + len(piece))
    if 200 * most >= least * 2 * n and any(at_least(b[i : i + n]) for i in range(len(b) - n + 1)):
        return True
    for w in range(n - 1, 0, -1):  # cut at an edge
        if (200 - least) * w < least * n:
            return False
        if 200 * most >= least * (n + w) and (at_least(b[:w]) or at_least(b[-w:])):
            return True
    return False


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio of the common words with each side's words, and of both sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left = (both + " " + " ".join(sorted(x - y))).strip()
    right = (both + " " + " ".join(sorted(y - x))).strip()
    if both and (not x - y or not y - x):
        return 100.0
    return max(ratio(left, right), ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0)
