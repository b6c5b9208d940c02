"""Edit distances and alignments of strings by bit-parallel dynamic programming.

A column of the distance table is held as two integers with a bit for each character of the
pattern: where the next cell is one more, and where it is one less. A character of the other
text moves the whole column on by a few operations on integers of any length.
"""

from __future__ import annotations

import numpy as np

#: Bits of columns kept for a trace back; beyond, the longer text is halved.
MOST_BITS = 1 << 27
#: Characters from which on common substrings are looked up by hash, and how many may meet for each character of the texts.
LEAST_RUN, MOST_MEETINGS = 8, 16
#: Places that meet are compared so many at a time.
MET_AT_ONCE = 1 << 17
#: Characters of two parts of texts beyond which no automaton is built of them.
LONG_PART = 1 << 13
#: Windows times words of bits that are aligned at a time.
MOST_WINDOWS = 1 << 16
#: How much longer the longest of the patterns that are aligned together may be.
LIKE_LENGTH = 1.25
#: Windows that are first looked at stand so far apart.
FIRST_STRIDE = 16


def common(a: str, b: str) -> tuple[int, int]:
    """The lengths of the common beginning and, after it, of the common end."""
    least, head, tail = min(len(a), len(b)), 0, 0
    while head < least and a[head] == b[head]:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return head, tail


def columns(pattern: str, text: str):
    """After each character of text: the bits at which going down the pattern costs one more, and one less."""
    bits: dict[str, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    every = (1 << len(pattern)) - 1
    up, down = every, 0
    for c in text:
        same = bits.get(c, 0)
        diagonal = ((same & up) + up ^ up | same | down) & every
        right_up = down | ~(diagonal | up) & every
        right_down = up & diagonal
        # The first row grows by one with every character.
        right_up, right_down = (right_up << 1 | 1) & every, right_down << 1 & every
        up, down = right_down | ~(diagonal | right_up) & every, right_up & diagonal
        yield up, down


def last_column(pattern: str, text: str) -> np.ndarray:
    """Distances of all beginnings of the pattern to the text."""
    up, down = (1 << len(pattern)) - 1, 0
    for up, down in columns(pattern, text):
        pass
    size = len(pattern) // 8 + 1
    row = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(pattern)].astype(np.int64)
    return len(text) + np.concatenate([[0], np.cumsum(row(up) - row(down))])


def edit_distance(a: str, b: str) -> int:
    """The least number of characters to replace, insert and delete."""
    head, tail = common(a, b)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    up, down = 0, 0
    for up, down in columns(a, b):
        pass
    return len(b) + up.bit_count() - down.bit_count()


def edits(a: str, b: str) -> str:
    """A least sequence of edits from a to b, a letter each: = kept, s replaced, d deleted, i inserted.

    Of several the trace back from the ends takes a deletion if it can, then an insertion.
    """
    head, tail = common(a, b)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        middle = "d" * len(x) + "i" * len(y)
    elif len(x) * len(y) > MOST_BITS and len(y) > 1:
        half = len(y) // 2
        split = int((last_column(x, y[:half]) + last_column(x[::-1], y[half:][::-1])[::-1]).argmin())
        middle = edits(x[:split], y[:half]) + edits(x[split:], y[half:])
    else:
        table, out = list(columns(x, y)), []
        i, j = len(x), len(y)
        while i and j:
            bit = 1 << i - 1
            if table[j - 1][0] & bit:
                out.append("d")
                i -= 1
                continue
            left_down = j > 1 and table[j - 2][1] & bit
            if left_down:
                out.append("i")
            else:
                out.append("=" if x[i - 1] == y[j - 1] else "s")
                i -= 1
            j -= 1
        middle = "i" * j + "d" * i + "".join(reversed(out))
    return "=" * head + middle + "=" * tail


def opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Stretches of equal edits: (tag, range of a, range of b); tag is equal, replace, delete or insert."""
    names = {"=": "equal", "s": "replace", "d": "delete", "i": "insert"}
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for e in edits(a, b):
        to = i + (e != "i"), j + (e != "d")
        if out and out[-1][0] == names[e]:
            out[-1] = (out[-1][0], out[-1][1], to[0], out[-1][3], to[1])
        else:
            out.append((names[e], i, to[0], j, to[1]))
        i, j = to
    return out


class Substrings:
    """All substrings of a text as a suffix automaton: states with the longest substring's length, where the first one ends, and which state a letter leads to."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, c in enumerate(text):
            state = self.state(self.length[last] + 1, i, {})
            while last >= 0 and c not in self.next[last]:
                self.next[last][c] = state
                last = self.link[last]
            if last >= 0:
                old = self.next[last][c]
                if self.length[old] > self.length[last] + 1:
                    # Only the shorter substrings of the old state go on to end here as well: they get a state of their own.
                    part = self.state(self.length[last] + 1, self.end[old], dict(self.next[old]))
                    self.link[part], self.link[old] = self.link[old], part
                    while last >= 0 and self.next[last].get(c) == old:
                        self.next[last][c] = part
                        last = self.link[last]
                    old = part
                self.link[state] = old
            last = state

    def state(self, length: int, end: int, leads: dict[str, int]) -> int:
        self.next.append(leads)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest_in(self, other: str) -> tuple[int, int, int]:
        """Where in other, and where in the text, the longest common substring begins, and its length; of several the first in other, then in the text."""
        state = n = 0
        best = 0, 0, 0
        for i, c in enumerate(other):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            if n > best[2]:
                best = i + 1 - n, self.end[state] + 1 - n, n
        return best


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shared_runs(a: str, b: str, least: int = LEAST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """All common substrings of `least` characters and more that go on at neither end: places in a and b, and lengths, by place in a, then b. None where they are too many for the texts.

    Places that begin with equal characters meet by a hash of `least` of them; what meets is compared.
    """
    x, y = codes_of(a), codes_of(b)
    if min(len(x), len(y)) < least:
        return (np.zeros(0, np.int64),) * 3
    rolled = []
    for z in (x, y):
        h = np.zeros(len(z) - least + 1, np.uint64)
        for k in range(least):
            h = h * np.uint64(0x9E3779B97F4A7C15) + z[k : k + len(h)]
        rolled.append(h ^ h >> np.uint64(29))
    order = np.argsort(rolled[1], kind="stable")
    there = rolled[1][order]
    lo, hi = np.searchsorted(there, rolled[0]), np.searchsorted(there, rolled[0], side="right")
    n = hi - lo
    if n.sum() > MOST_MEETINGS * (len(x) + len(y)):
        return None
    # Of what meets only where runs begin and end is kept, some places of a at a time. Beside a text stands what is in neither.
    wide_x, wide_y = np.pad(x, 1, constant_values=1 << 31), np.pad(y, 1, constant_values=1 << 32)
    starts, ends, before = [], [], np.cumsum(n) - n
    for some in np.split(np.arange(len(n)), np.searchsorted(before, np.arange(MET_AT_ONCE, n.sum(), MET_AT_ONCE))):
        i = np.repeat(some, n[some])
        j = order[np.arange(len(i)) - np.repeat(before[some] - before[some[:1]], n[some]) + np.repeat(lo[some], n[some])]
        for kept, edge in ((starts, wide_x[i] != wide_y[j]), (ends, wide_x[i + least + 1] != wide_y[j + least + 1])):
            u, v = i[edge], j[edge]
            same = np.ones(len(u), bool)
            for k in range(least):
                same &= x[u + k] == y[v + k]
            kept.append((u[same], v[same]))
    (i, j), (last, ends_j) = ([np.concatenate(z) for z in zip(*kept)] for kept in (starts, ends))
    # On a diagonal starts and ends take turns.
    first, then = np.lexsort((i, j - i)), np.lexsort((last, ends_j - last))
    i, j, n = i[first], j[first], last[then] - i[first] + least
    order = np.lexsort((j, i))
    return i[order], j[order], n[order]


class Grams:
    """Substrings of two texts by number: at each place that of the 1, 2, 4 ... characters there, as far as the texts share any. Others are pairs of two that overlap."""

    def __init__(self, a: str, b: str, most: int):
        none = np.array([1 << 31], np.uint64)  # no character, so nothing goes on from one text into the other
        self.levels, self.there, self.asked, self.most = [numbered(np.concatenate([codes_of(a), none, codes_of(b)]))], len(a) + 1, most, most
        self.last: tuple[tuple[int, ...], np.ndarray, np.ndarray] | None = None
        n = 1
        while 2 * n <= most:
            if not np.intersect1d(self.levels[-1][: max(0, self.there - n)], self.levels[-1][self.there :]).size:
                self.most = n - 1
                break
            self.levels.append(numbered(self.pairs(2 * n, 0, len(self.levels[0]))))
            n *= 2

    def pairs(self, n: int, start: int, stop: int) -> np.ndarray:
        """What tells apart the n characters at each place from start that end by stop."""
        level = min(n.bit_length(), len(self.levels)) - 1
        p, at = 1 << level, self.levels[level]
        return at[start : stop - n + 1].astype(np.uint64) << np.uint64(32) | at[start + n - p : stop - p + 1].astype(np.uint64)

    def longest(self, i: int, j: int, k: int, l: int, most: int) -> tuple[int, int, int]:
        """As Substrings.longest_in of the part from k to l of b, for that from i to j of a, if it has `most` characters at most. What was found last is kept, as parts of it often share as much again."""
        best, low, high = (0, 0, 0), 0, min(most, self.most, j - i, l - k)
        n = high
        while low < high:
            of, here, there = self.last if self.last else ((0,) * 5, None, None)
            if not (of[0] == n and of[1] <= i and j <= of[2] and of[3] <= k and l <= of[4]):
                each = numbered(np.concatenate([self.pairs(n, i, j), self.pairs(n, self.there + k, self.there + l)]))
                of, here, there = (n, i, j, k, l), each[: j - i - n + 1], each[j - i - n + 1 :]
            x, y = here[i - of[1] : j - n + 1 - of[1]], there[k - of[3] : l - n + 1 - of[3]]
            both = np.zeros(int(max(x.max(), y.max())) + 1, bool)
            both[y] = True
            place = int(both[x].argmax())
            if both[x[place]]:
                self.last, low, best = (of, here, there), n, (place, int((y == x[place]).argmax()), n)
            else:
                high = n - 1
            n = (low + high + 1) // 2
        return best


def numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint32)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """Stretches (place in a, place in b, length) that the texts share, in order: the longest, then the same before and behind it. Neighbours are one.

    Of several longest ones the first in a, then in b, is taken. Memory grows with the texts' lengths.
    Long ones come from shared_runs, each part of the texts keeping those that lie in it; where none is left, or they
    were too many, an automaton is built of a short part, and numbers of substrings are compared of a long one.
    """
    found, grams = [], None
    todo = [(0, len(a), 0, len(b), shared_runs(a, b), len(a) + len(b), min(len(a), len(b)))]
    while todo:
        i, j, k, l, runs, tried, most = todo.pop()
        if i == j or k == l:
            continue
        if runs is None and j - i + l - k <= tried // 2:
            tried, runs = j - i + l - k, shared_runs(a[i:j], b[k:l])
            runs = runs and (runs[0] + i, runs[1] + k, runs[2])
        x = y = n = 0
        if j - i == l - k and a[i:j] == b[k:l]:
            n = j - i
        elif runs is not None:
            ra, rb, rn = runs
            cut = np.maximum(np.maximum(i - ra, k - rb), 0)
            size = np.minimum(np.minimum(j - ra, l - rb), rn) - cut
            kept = size >= LEAST_RUN
            ra, rb, rn = runs = (ra + cut)[kept], (rb + cut)[kept], size[kept]
            if len(rn):
                n = int(rn.max())
                best = np.flatnonzero(rn == n)
                x, y = min(zip(ra[best].tolist(), rb[best].tolist()))
                x, y = x - i, y - k
            else:
                most = min(most, LEAST_RUN - 1)
        if not n and j - i + l - k <= LONG_PART:
            x, y, n = Substrings(b[k:l]).longest_in(a[i:j])
        elif not n:
            if grams is None or grams.asked < most:
                grams = Grams(a, b, most)
            x, y, n = grams.longest(i, j, k, l, most)
        if n:
            found.append((i + x, k + y, n))
            todo += [(i, i + x, k, k + y, runs, tried, n), (i + x + n, j, k + y + n, l, runs, tried, n)]
    out: list[tuple[int, int, int]] = []
    for x, y, n in sorted(found):
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (x, y):
            x, y, n = *out[-1][:2], out.pop()[2] + n
        out.append((x, y, n))
    return out


def block_opcodes(a: str, b: str) -> list[tuple[str, int, int, int, int]]:
    """Stretches as opcodes() gives them, but by matching_blocks(): easier to read, not always the fewest edits."""
    out, i, j = [], 0, 0
    for x, y, n in [*matching_blocks(a, b), (len(a), len(b), 0)]:
        if (x, y) != (i, j):
            out.append(("insert" if x == i else "delete" if y == j else "replace", i, x, j, y))
        if n:
            out.append(("equal", x, x + n, y, y + n))
        i, j = x + n, y + n
    return out


def window_likeness(short: str, text: str) -> float:
    """How alike `short` and the likest window of text are: twice their longest common subsequence by both lengths, from 0 to 1.

    Windows are as long as short, or shorter ones at either end of text. All are aligned together,
    bit by bit of short, so that memory grows with text times the words that short's bits take, in blocks.
    """
    m, n = len(short), len(text)
    if not m or not n:
        return float(m == n)
    letters = {c: k for k, c in enumerate(dict.fromkeys(short), 1)}
    words = -(-m // 64)
    bits = np.zeros((words, len(letters) + 1), np.uint64)
    for i, c in enumerate(short):
        bits[i // 64, letters[c]] |= np.uint64(1 << i % 64)
    # Beyond its ends the text has letters that short has not.
    codes = np.zeros(n + 2 * (m - 1), np.int64)
    codes[m - 1 : m - 1 + n] = [letters.get(c, 0) for c in text]
    starts = np.arange(n + m - 1)
    sizes = np.minimum(starts + m, m - 1 + n) - np.maximum(starts, m - 1)
    best, step = 0.0, max(1, MOST_WINDOWS // words)
    for at in range(0, len(starts), step):
        count = min(step, len(starts) - at)
        column = np.full((words, count), ~np.uint64(0))
        for j in range(at, at + m):
            here = codes[j : j + count]
            carry = np.zeros(count, bool)
            for w in range(words):
                v = column[w]
                both = v & bits[w, here]
                total = v + both
                over = total < v
                total += carry
                carry = over | (total < carry)
                column[w] = total | (v - both)
        same = np.bitwise_count(~column).sum(axis=0)
        best = max(best, float((2 * same / (m + sizes[at : at + count])).max()))
    return best


def partial_likeness(a: str, b: str) -> float:
    """window_likeness of the shorter text in the longer one; of texts of one length, the better way round."""
    if len(a) == len(b):
        return max(window_likeness(a, b), window_likeness(b, a))
    return window_likeness(*sorted((a, b), key=len))


def alike(pairs: list[tuple[str, str]], least: float) -> np.ndarray:
    """Whether partial_likeness of each pair is `least` or more.

    Most windows aren't aligned: of two that are, the common subsequences tell how long those between can be at
    most, as a window that moves by a character gains or loses one at most. So windows far apart
    are looked at first, then those between them that may still be alike enough. Those of many pairs are aligned together.
    """
    out = np.zeros(len(pairs), bool)
    todo: list[tuple[int, int, str, str]] = []
    for k, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)} if len(a) == len(b) else [tuple(sorted((a, b), key=len))]:
            if not x:
                out[k] |= float(x == y) >= least
            elif x in y:
                out[k] |= 1.0 >= least  # a window is all of it
            else:
                todo.append((-(-len(x) // 64), len(x), k, x, y))
    todo.sort(key=lambda r: r[:3])
    at = 0
    while at < len(todo):
        words, shortest, *_ = todo[at]
        to, size = at, 0
        while to < len(todo) and todo[to][0] == words and todo[to][1] <= LIKE_LENGTH * shortest + 8 and (to == at or size + len(todo[to][4]) <= 8 * MOST_WINDOWS):
            size += len(todo[to][4])
            to += 1
        found = _alike_together([r[3:] for r in todo[at:to]], words, least)
        np.logical_or.at(out, [r[2] for r in todo[at:to]], found)
        at = to
    return out


def _alike_together(pairs: list[tuple[str, str]], words: int, least: float) -> np.ndarray:
    """Whether window_likeness of each pair is `least` or more."""
    m, n = (np.array([len(p[side]) for p in pairs]) for side in (0, 1))
    windows = n + m - 1
    ends = np.cumsum(windows)
    first, total = ends - windows, int(ends[-1])
    letters = max(len(set(x)) for x, _ in pairs) + 1
    bits = np.zeros((words, len(pairs) * letters), np.uint64)
    # All texts in a row, each with as much before and behind it as its pattern is long, and no letters there.
    widths = windows + m - 1
    base = np.cumsum(widths) - widths
    codes = np.repeat(np.arange(len(pairs)) * letters, widths)
    codes = np.append(codes, np.zeros(int(m.max()), np.int64))
    for k, (x, y) in enumerate(pairs):
        own, number = np.unique(codes_of(x), return_inverse=True)
        i = np.arange(len(x))
        for w in range(words):
            here = slice(64 * w, 64 * (w + 1))
            np.bitwise_or.at(bits[w], k * letters + 1 + number[here], np.uint64(1) << (i[here] & 63).astype(np.uint64))
        cy = codes_of(y)
        place = np.minimum(np.searchsorted(own, cy), len(own) - 1)
        codes[base[k] + m[k] - 1 : base[k] + m[k] - 1 + n[k]] += np.where(own[place] == cy, place + 1, 0)
    found = np.zeros(len(pairs), bool)
    seen = same = np.zeros(0, np.int64)
    left = np.arange(total)  # windows that may be alike enough, and how long their common subsequences can be at most
    of = np.repeat(np.arange(len(pairs)), windows)
    start = left - first[of]
    width = np.minimum(start + m[of], m[of] - 1 + n[of]) - np.maximum(start, m[of] - 1)
    most, stride = np.minimum(width, m[of]), FIRST_STRIDE
    while len(left):
        o = of[left]
        now = (start[left] % stride == 0) | (start[left] == windows[o] - 1)
        ask, got = left[now], []
        step = max(1, MOST_WINDOWS // 4 // words)
        for a in range(0, len(ask), step):
            some = ask[a : a + step]
            got.append(_common(codes, base[of[some]] + start[some], m[of[some]], bits))
        if got:
            got = np.concatenate(got)
            found[of[ask[2 * got / (m[of[ask]] + width[ask]) >= least]]] = True
            order = np.argsort(np.concatenate([seen, ask]), kind="stable")
            seen, same = np.concatenate([seen, ask])[order], np.concatenate([same, got])[order]
        left, most, o = left[~now], most[~now], o[~now]
        keep = ~found[o]
        left, most, o = left[keep], most[keep], o[keep]
        if len(seen) and len(left):
            # From what is known on either side.
            right = np.searchsorted(seen, left)
            for side in (np.minimum(right, len(seen) - 1), np.maximum(right - 1, 0)):
                near = seen[side]
                most = np.where(of[near] == o, np.minimum(most, same[side] + np.abs(near - left)), most)
            keep = 2 * most / (m[o] + width[left]) >= least
            left, most = left[keep], most[keep]
        stride = max(1, stride // 2)
    return found


def _common(codes: np.ndarray, start: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How long the longest common subsequences of windows (where they start, and their sizes) with their patterns are."""
    words = len(bits)
    column = np.full((words, len(start)), ~np.uint64(0))
    for j in range(int(size.max())):
        here = codes[start + j]
        inside = j < size
        carry = np.zeros(len(start), bool)
        for w in range(words):
            v = column[w]
            both = np.where(inside, v & bits[w][here], np.uint64(0))
            total = v + both
            over = total < v
            total += carry
            carry = over | (total < carry)
            column[w] = total | (v - both)
    return np.bitwise_count(~column).sum(axis=0).astype(np.int64)
