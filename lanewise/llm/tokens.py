"""Token counts: greedy longest-match pieces, counted in one pass by an automaton.

The vocabulary is a byte trie. Where no edge continues the match, the longest vocabulary pieces of
what was read are taken off its front, their number was worked out beforehand, and a failure link
leads to the node for what is left. So every byte is looked at once and no piece is ever built.
"""

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import annotate

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is a fixed file; more lines than this are refused rather than shipped to all tasks.
MOST_PIECES = 2_000_000
SPACE = 0x20
WHITE = b"\t\n\x0b\x0c\r "


def read_vocabulary(spark, path: str = VOCABULARY) -> list[bytes]:
    """Pieces from lines of ``base64 rank``, read by Spark, so that the file may be in any store."""
    lines = spark.read.text(path).limit(MOST_PIECES + 1).collect()
    if len(lines) > MOST_PIECES:
        raise ValueError(f"{path} has more than {MOST_PIECES} pieces")
    return [base64.b64decode(line[0].split()[0]) for line in lines if line[0].strip()]


def build_trie(pieces: list[bytes]) -> tuple[list[dict[int, int]], np.ndarray]:
    """Edges by node (node 0 is the empty string) and which nodes are pieces."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    for p in pieces:
        at = 0
        for b in p:
            nxt = edges[at].get(b)
            if nxt is None:
                nxt = edges[at][b] = len(edges)
                edges.append({})
                final.append(False)
            at = nxt
        final[at] = bool(p)
    return edges, np.array(final)


def build_automaton(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``step[node, byte]``, ``popped[node, byte]`` and ``rest[node]``.

    ``step`` and ``popped`` follow failure links to the end: the next node, and how many pieces are
    taken off on the way. ``rest`` is the number of pieces that a word ending at the node still
    makes. A byte that no piece starts with makes a piece of its own.
    """
    edges, final = build_trie(pieces)
    n = len(edges)
    step = np.zeros((n, 256), np.int32)
    popped = np.zeros((n, 256), np.uint8)
    link = np.full(n, -1, np.int32)
    taken = np.zeros(n, np.int32)
    popped[0, :] = 1  # an unknown byte
    for b, child in edges[0].items():
        step[0, b], popped[0, b] = child, 0

    level = list(edges[0].items())
    level = [(0, b, c) for b, c in level]
    while level:
        parents = np.array([p for p, _, _ in level])
        bytes_ = np.array([b for _, b, _ in level])
        nodes = np.array([c for _, _, c in level])
        whole = final[nodes]
        # A piece is taken whole; a lone first byte that is none counts as unknown; else what the
        # parent's failure leads to.
        up = np.where(parents > 0, link[parents], 0)
        link[nodes] = np.where(whole, 0, np.where(parents == 0, 0, step[up, bytes_]))
        taken[nodes] = np.where(whole | (parents == 0), 1, taken[parents] + popped[up, bytes_])
        step[nodes] = step[link[nodes]]
        more = popped[link[nodes]].astype(np.int32) + taken[nodes][:, None]
        if more.max(initial=0) > 255:
            raise ValueError("a piece holds more than 255 others")
        popped[nodes] = more
        level = [(int(c), b, d) for c in nodes for b, d in edges[c].items()]
        for c, b, d in level:
            step[c, b], popped[c, b] = d, 0

    rest = np.zeros(n, np.int32)
    for v in range(1, n):  # links point to shorter strings, which need not have smaller numbers
        at, count = v, 0
        while at:
            count += taken[at]
            at = link[at]
        rest[v] = count
    return step, popped, rest


def count_pieces(words: list[bytes], automaton) -> np.ndarray:
    """Pieces of each word, all words advancing together, longest first."""
    step, popped, rest = automaton
    if not words:
        return np.zeros(0, np.int64)
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    sizes = lengths[order]
    state = np.zeros(len(words), np.int32)
    count = np.zeros(len(words), np.int64)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    for i, k in enumerate(alive):
        b = flat[starts[:k] + i]
        s = state[:k]
        count[:k] += popped[s, b]
        state[:k] = step[s, b]
    out = np.empty(len(words), np.int64)
    out[order] = count + rest[state]
    return out


class Counter:
    """Counts per text; remembers the counts of short words, at most ``keep`` of them."""

    def __init__(self, automaton, keep: int = 200_000):
        self.automaton, self.keep, self.known = automaton, keep, {}

    def add(self, new: list[bytes]) -> dict[bytes, int]:
        counts = dict(zip(new, count_pieces(new, self.automaton).tolist(), strict=True))
        if len(self.known) < self.keep:
            self.known.update((w, c) for w, c in counts.items() if len(w) <= 32)
        return counts

    def __call__(self, texts: list[bytes | None]) -> list[int]:
        split = [[b" " + w for w in t.split()] if t else [] for t in texts]
        if not any(split):
            return [0] * len(split)
        fresh = self.add(list({w for ws in split for w in ws} - self.known.keys()))
        known = self.known
        return [sum([known.get(w) or fresh[w] for w in ws]) for ws in split]


def count_tokens(docs: DataFrame, pieces: list[bytes], column: str = "text") -> DataFrame:
    """``row`` (the input) and ``n_tokens`` of each whole text.

    A text is cut at white space (space and the control characters tab to carriage return); each
    word, with one space before it, makes greedy longest-match pieces of its UTF-8 bytes. A null,
    empty or blank text has 0. Repeated rows count alike; no rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)

    def make():
        counter = Counter(automaton_of(shipped))
        return lambda texts: [counter(texts)]

    return annotate(docs, column, make, [T.StructField("n_tokens", T.LongType())])


_BUILT: dict[int, tuple] = {}


def automaton_of(shipped) -> tuple:
    """One automaton per Python process and vocabulary: tasks that run one after another share it."""
    pieces = shipped.value
    key = hash(tuple(pieces[:: max(1, len(pieces) // 1000)])), len(pieces)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = build_automaton(pieces)
    return _BUILT[key]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` with the vocabulary at ``path``."""
    counted = count_tokens(docs.select("doc_id", "text"), read_vocabulary(docs.sparkSession, path))
    return counted.select(F.col("row.doc_id").alias("doc_id"), "n_tokens")
