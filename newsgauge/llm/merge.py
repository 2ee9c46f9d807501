"""Front-coded sorted runs of byte strings, and their merge by a loser tree that knows prefixes.

A run keeps, for each string, how many bytes it shares with the one before and the rest. The merge
compares two strings only from the first byte that is not known to be shared: each string in the
tree carries the length of its common prefix with the last winner, the longer prefix is the smaller
string, and only equal lengths need a look at bytes, from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

Item = tuple[bytes, int]


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Shared prefix lengths and rests of sorted strings."""
    shared, rests, last = [], [], b""
    for s in strings:
        h = common_prefix(last, s, 0)
        shared.append(h)
        rests.append(s[h:])
        last = s
    return shared, rests


def front_decode(shared: list[int], rests: list[bytes]) -> list[bytes]:
    strings, last = [], b""
    for h, rest in zip(shared, rests):
        last = last[:h] + rest
        strings.append(last)
    return strings


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Merge sorted runs, given as strings and shared prefix lengths.

    Yields the run, the place in it, and the common prefix with the string yielded before. Equal
    strings come in the order of their runs.
    """
    size = 1
    while size < len(runs):
        size *= 2
    strings = [r[0] for r in runs] + [[] for _ in range(size - len(runs))]
    shared = [r[1] for r in runs] + [[] for _ in range(size - len(runs))]
    places = [0] * size
    known = [0] * size  # common prefix of each run's current string with the last winner

    def beats(a: int, b: int) -> bool:
        """Whether run a's string comes before run b's; the loser's prefix is renewed."""
        if places[a] >= len(strings[a]):
            return False
        if places[b] >= len(strings[b]):
            return True
        if known[a] != known[b]:
            return known[a] > known[b]
        x, y = strings[a][places[a]], strings[b][places[b]]
        h = common_prefix(x, y, known[a])
        if h < len(x) and h < len(y):
            first = x[h] < y[h]
        else:
            first = len(x) < len(y) or (len(x) == len(y) and a < b)
        known[b if first else a] = h
        return first

    # losers[1..size-1]: the run that lost at each inner node.
    losers = [0] * size
    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        after = []
        for i in range(level):
            a, b = winners[2 * i], winners[2 * i + 1]
            first = beats(a, b)
            losers[level + i] = b if first else a
            after.append(a if first else b)
        winners = after
    winner = winners[0]
    while places[winner] < len(strings[winner]):
        yield winner, places[winner], known[winner]
        places[winner] += 1
        at = places[winner]
        if at < len(strings[winner]):
            known[winner] = shared[winner][at]
        node = (winner + size) // 2
        while node:
            other = losers[node]
            if not beats(winner, other):
                losers[node], winner = winner, other
            node //= 2
