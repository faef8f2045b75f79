"""A bidirectional FM-index over a delimited vocabulary, and the search for words one edit away.

The text of the index is ``$word$word$..$`` with the words in order, so that the rows of ``$`` in the suffix
array are the words themselves. A second index holds the reversed words. A pattern is a pair of suffix-rank
intervals of equal size, one in each; extending it on either side keeps both in step.
All searches of a shard advance together, one symbol a step, as NumPy arrays.
"""

import numpy as np

#: Queries that advance together; bounds the open search states.
TOGETHER = 20_000
#: Rank queries answered at once.
RANKS = 1 << 16


class Words:
    """Distinct words as one array of symbol codes (from 1), sorted by code point."""

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.codes = (codes + 1).astype(np.int64)
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def reversed(self) -> "Words":
        back = object.__new__(Words)
        back.alphabet, back.length, back.start = self.alphabet, self.length, self.start
        place = np.arange(len(self.codes)) - np.repeat(self.start, self.length)
        back.codes = self.codes[np.repeat(self.start + self.length, self.length) - 1 - place]
        return back

    def symbol(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code at a place of each word; 0, the delimiter, right after its end."""
        inside = at < self.length[word]
        where = np.where(inside, self.start[word] + at, 0)
        return np.where(inside, self.codes[where], 0)

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=np.int64)
        going = np.arange(len(a))
        while len(going):
            at = out[going]
            x, y = self.symbol(a[going], at), self.symbol(b[going], at)
            going = going[(x == y) & (x > 0)]
            out[going] += 1
        return out


class Index:
    """Burrows-Wheeler transform of ``$word$word$..$`` with counts of smaller symbols by block."""

    def __init__(self, words: Words):
        n_words, sigma = len(words.length), len(words.alphabet)
        ranks = order_of(words)
        #: The word of each delimiter row but the first.
        self.ids = ranks
        length, first = words.length[ranks], words.start[ranks]
        begin = np.cumsum(length + 1) - length - 1
        n = int(length.sum()) + n_words + 1
        text = np.zeros(n, dtype=np.int64)
        inner = np.repeat(begin + 1, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        source = np.repeat(first, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        text[inner] = words.codes[source]
        suffixes = suffix_order(text, sigma)
        transform = text[suffixes - 1]
        self.n, self.size = n, max(64, 1 << int(sigma).bit_length())
        padded = np.full(-(-n // self.size) * self.size + self.size, sigma + 1, dtype=np.uint8 if sigma < 255 else np.uint32)
        padded[:n] = transform
        self.blocks = padded.reshape(-1, self.size)
        per_block = np.zeros((len(self.blocks), sigma + 3), dtype=np.int64)
        np.add.at(per_block, (np.arange(len(padded)) // self.size, padded.astype(np.int64) + 1), 1)
        below = per_block.cumsum(axis=1)
        self.below = (below.cumsum(axis=0) - below).astype(np.int32)
        self.first = np.cumsum(np.bincount(transform, minlength=sigma + 1)) - np.bincount(transform, minlength=sigma + 1)

    def smaller(self, at: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols before row ``at`` are smaller than ``c``, and how many are ``c``."""
        less, same = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
        for a in range(0, len(at), RANKS):
            p, s = at[a : a + RANKS], c[a : a + RANKS]
            b = p // self.size
            rows = self.blocks[b]
            here = np.arange(self.size) < (p % self.size)[:, None]
            less[a : a + RANKS] = self.below[b, s] + ((rows < s[:, None]) & here).sum(axis=1)
            same[a : a + RANKS] = self.below[b, s + 1] - self.below[b, s] + ((rows == s[:, None]) & here).sum(axis=1)
        return less, same

    def extend(self, lo, other, size, c):
        """The intervals after one more symbol ``c`` before the pattern: here by rank, in the other index by order."""
        less_lo, same_lo = self.smaller(lo, c)
        less_hi, same_hi = self.smaller(lo + size, c)
        return self.first[c] + same_lo, other + less_hi - less_lo, same_hi - same_lo

    def before(self, lo: np.ndarray, size: np.ndarray, sigma: int) -> tuple[np.ndarray, np.ndarray]:
        """Each interval's distinct symbols other than the delimiter, as ``interval, symbol``.

        Short intervals are read row by row; of long ones every symbol is a candidate.
        """
        short = np.flatnonzero(size <= sigma)
        long = np.flatnonzero(size > sigma)
        at = np.repeat(lo[short] - np.cumsum(size[short]) + size[short], size[short]) + np.arange(int(size[short].sum()))
        seen = np.unique(np.repeat(short, size[short]) * (sigma + 1) + self.blocks.reshape(-1)[at])
        every = (np.repeat(long, sigma) * (sigma + 1)) + np.tile(np.arange(1, sigma + 1), len(long))
        both = np.concatenate([seen[seen % (sigma + 1) > 0], every])
        return both // (sigma + 1), both % (sigma + 1)


def order_of(words: Words) -> np.ndarray:
    """The words in order of their symbols."""
    longest = int(words.length.max(initial=0))
    number = np.arange(len(words.length))
    rank, width = packed(words, len(words.alphabet))
    while width < longest:
        # Ranks of suffixes of the words, twice as long each time.
        reach = (words.start + words.length)[np.repeat(number, words.length)] - np.arange(len(words.codes))
        after = np.where(reach > width, rank[np.minimum(np.arange(len(rank)) + width, len(rank) - 1)] + 1, 0)
        rank = dense(rank, after)
        width *= 2
    return np.argsort(rank[words.start], kind="stable") if longest else number


def packed(words: Words, sigma: int) -> tuple[np.ndarray, int]:
    """Ranks of the words' suffixes by their first symbols, as many as fit into 62 bits."""
    bits = max(1, int(sigma).bit_length())
    width = 62 // bits
    end = np.repeat(words.start + words.length, words.length)
    at = np.arange(len(words.codes))
    key = np.zeros(len(words.codes), dtype=np.int64)
    for k in range(width):
        inside = at + k < end
        key = (key << bits) | np.where(inside, words.codes[np.minimum(at + k, len(at) - 1)], 0)
    return dense(key, np.zeros_like(key)), width


def dense(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks from 0 of pairs."""
    order = np.lexsort((second, first))
    new = np.ones(len(first), dtype=bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    rank = np.empty(len(first), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def suffix_order(text: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array of ``$word$word$..$`` with sorted distinct words.

    A suffix is told apart by its symbols up to the next delimiter, and by which delimiter that is:
    delimiters are in the order of the words after them, the last one first.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    which = np.searchsorted(ends, np.arange(n))
    reach = ends[which] - np.arange(n)
    bits = max(1, int(sigma).bit_length())
    width = 62 // bits
    key = np.zeros(n, dtype=np.int64)
    for k in range(width):
        key = (key << bits) | np.where(reach > k, text[np.minimum(np.arange(n) + k, n - 1)], 0)
    rank = dense(key, np.zeros(n, dtype=np.int64))
    while width < int(reach.max()):
        after = np.where(reach > width, rank[np.minimum(np.arange(n) + width, n - 1)] + 1, 0)
        rank = dense(rank, after)
        width *= 2
    which = np.where(which == len(ends) - 1, -1, which)
    return np.lexsort((which, rank))


class Searcher:
    """Words of a shard that are one edit apart, by two mirrored search schemes."""

    def __init__(self, words: list[str]):
        self.words = Words(words)
        mirrored = self.words.reversed()
        ahead, back = Index(self.words), Index(mirrored)
        #: Per direction: words as read in it, the index that extends before, the one that extends after.
        self.views = {False: (self.words, ahead, back), True: (mirrored, back, ahead)}

    def near(self, word: np.ndarray, shorter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``query, word`` for every word one edit away from a query.

        A query is a word, the length of the shorter of the two words, and the zone ``lo <= e < hi`` of the
        first place where they differ (at most ``shorter - 1``). What stands before or behind the
        zone, whichever is longer, is matched exactly, the rest with one error.
        """
        left = lo < shorter - hi
        found = []
        for mirror in (False, True):
            chosen = np.flatnonzero(left == mirror)
            for a in range(0, len(chosen), TOGETHER):
                part = chosen[a : a + TOGETHER]
                exact = np.where(left, shorter - hi, lo)[part]
                q, v = self.search(mirror, word[part], exact, self.words.length[word[part]] > shorter[part])
                q = part[q]
                gap = np.minimum(self.words.common_prefix(word[q], v), shorter[q] - 1)
                meant = (gap >= lo[q]) & (gap < hi[q])
                found.append((q[meant], v[meant]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))

    def search(self, mirror: bool, word: np.ndarray, exact: np.ndarray, drops: np.ndarray):
        """``query, word`` one edit behind the first ``exact`` symbols; ``drops``: the query is the longer word.

        The exact part is matched from its end to the delimiter before it; then the search turns round.
        """
        words, behind, ahead = self.views[mirror]
        sigma = len(words.alphabet)
        q = np.arange(len(word))
        lo, other, size = np.zeros_like(q), np.zeros_like(q), np.full(len(q), behind.n)
        for t in range(int(exact.max(initial=-1)) + 1):
            on = np.flatnonzero(exact >= t)
            symbol = np.where(exact[on] > t, words.symbol(word[on], np.maximum(exact[on] - 1 - t, 0)), 0)
            lo[on], other[on], size[on] = behind.extend(lo[on], other[on], size[on], symbol)
        # Exact states, and the pool of states that have spent their error.
        k = exact.copy()
        pool = [np.empty(0, dtype=np.int64)] * 5
        hits = []
        while len(q) or len(pool[0]):
            born = [pool]
            if len(q):
                symbol = words.symbol(word[q], k)
                gives = drops[q]
                # The query holds one symbol more: skip it, unless the next one is the same.
                skip = np.flatnonzero(gives & (symbol > 0) & (symbol != words.symbol(word[q], k + 1)))
                born.append([q[skip], k[skip] + 1, lo[skip], other[skip], size[skip]])
                # The other word has another symbol here, or one more.
                takes = np.flatnonzero(~gives)
                state, c = ahead.before(other[takes], size[takes], sigma)
                state = takes[state]
                differs = c != symbol[state]
                state, c = state[differs], c[differs]
                o, low, s = ahead.extend(other[state], lo[state], size[state], c)
                some = np.flatnonzero(s > 0)
                state, low, o, s = state[some], low[some], o[some], s[some]
                born.append([q[state], k[state], low, o, s])
                inside = np.flatnonzero(symbol[state] > 0)
                born.append([q[state[inside]], k[state[inside]] + 1, low[inside], o[inside], s[inside]])
                on = np.flatnonzero(symbol > 0)
                q, k, symbol = q[on], k[on], symbol[on]
                other, lo, size = ahead.extend(other[on], lo[on], size[on], symbol)
                k = k + 1
            pool = [np.concatenate(x) for x in zip(*born, strict=True)]
            if len(pool[0]):
                pq, pk, plo, pother, psize = pool
                symbol = words.symbol(word[pq], pk)
                pother, plo, psize = ahead.extend(pother, plo, psize, symbol)
                done = np.flatnonzero((symbol == 0) & (psize > 0))
                hits.append((pq[done], behind.ids[plo[done] - 1]))
                on = np.flatnonzero((symbol > 0) & (psize > 0))
                pool = [pq[on], pk[on] + 1, plo[on], pother[on], psize[on]]
        if not hits:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))
