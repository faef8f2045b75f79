"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt into blocks. In a block, each component is cut to its upper bits and stored as
bitmaps over the block's rows, one for each bit. A query's weighted sum is worked out for all rows
at once by adding bitmaps (carry-save), selection walks the sum's bitmaps from the most significant
one down, and rows that the cut-off bits could still lift into the first k are resolved exactly.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
CUT_BITS = 4
BLOCK_ROWS = 65_536
SMALL_BLOCK_ROWS = 4_096
BLOCK_QUERIES = 1_024


def quantised(vector: Column) -> Column:
    """floor(1024 x) of each component as bigint; null for a null vector or one with a null or non-finite part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), ints)


class BitSlices:
    """One block of the index. Rows are in order of id, so that smaller ids come first among equals."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cut: int = CUT_BITS):
        self.ids, self.x, self.cut = ids, x, cut
        n, dims = x.shape
        self.words = -(-n // 64)
        upper = (x - x.min(axis=0)) >> cut
        bits = max(1, int(upper.max(initial=0)).bit_length())
        # [0]: as is, for positive weights; [1]: complement, for negative ones.
        self.slices = np.zeros((2, dims, bits, self.words), np.uint64)
        for b in range(bits):
            on = self.pack(((upper >> b) & 1).T)
            self.slices[0, :, b], self.slices[1, :, b] = on, ~on
        self.valid = self.pack(np.ones((1, n), np.uint8))[0]

    def pack(self, rows: np.ndarray) -> np.ndarray:
        full = np.zeros((rows.shape[0], self.words * 64), np.uint8)
        full[:, : rows.shape[1]] = rows
        return np.packbits(full, axis=1, bitorder="little").view(np.uint64)

    def weighted_sum(self, q: np.ndarray) -> list[np.ndarray]:
        """Bitmaps, least significant first, of the sum of |weight| times component or complement."""
        side, weight = (q < 0).astype(int), np.abs(q)
        bits = self.slices.shape[2]
        out, carried, j = [], np.zeros((0, self.words), np.uint64), 0
        top = int(weight.max(initial=0)).bit_length() + bits
        while j < top or len(carried):
            terms = [carried]
            for b in range(min(bits, j + 1)):
                d = np.flatnonzero((weight >> (j - b)) & 1) if j - b < 63 else np.zeros(0, int)
                if len(d):
                    terms.append(self.slices[side[d], d, b])
            layer, carried = add_layer(np.concatenate(terms))
            out.append(layer)
            j += 1
        return out

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows but the query's own."""
        among = self.valid.copy()
        own = np.searchsorted(self.ids, query_id)
        if own < len(self.ids) and self.ids[own] == query_id:
            among[own // 64] &= ~np.uint64(1 << int(own % 64))
        sums = self.weighted_sum(q)
        least = kth_value(sums, among, k)
        slack = -(-int(np.abs(q).sum()) * ((1 << self.cut) - 1) // (1 << self.cut))
        near = at_least(sums, among, least - slack)
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        scores = self.x[rows] @ q
        first = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[first]], scores[first]


def add_layer(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of one weight to their sum bit and the carries into the next weight; full adders in rows."""
    carries = []
    while len(terms) > 2:
        n = len(terms) // 3
        a, b, c = terms[:n], terms[n : 2 * n], terms[2 * n : 3 * n]
        half = a ^ b
        carries.append((a & b) | (half & c))
        terms = np.concatenate([half ^ c, terms[3 * n :]])
    if len(terms) == 2:
        carries.append((terms[0] & terms[1])[None])
        terms = (terms[0] ^ terms[1])[None]
    layer = terms[0] if len(terms) else np.zeros(terms.shape[1], np.uint64)
    return layer, np.concatenate(carries) if carries else np.zeros((0, terms.shape[1]), np.uint64)


def kth_value(sums: list[np.ndarray], among: np.ndarray, k: int) -> int:
    """The k-th greatest sum, or 0 if there are fewer rows; from the most significant bitmap down."""
    taken, value, tied = 0, 0, among
    for bit in reversed(range(len(sums))):
        on = tied & sums[bit]
        n = int(np.bitwise_count(on).sum())
        if taken + n >= k:
            value |= 1 << bit
            tied = on
        else:
            taken += n
            tied = tied & ~sums[bit]
    return value


def at_least(sums: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
    """Rows whose sum is ``value`` or more."""
    if value <= 0:
        return among
    over, tied = np.zeros_like(among), among
    for bit in reversed(range(max(len(sums), value.bit_length()))):
        row = sums[bit] if bit < len(sums) else np.zeros_like(among)
        if value >> bit & 1:
            tied = tied & row
        else:
            over |= tied & row
            tied = tied & ~row
    return over | tied


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _unique(frame: pd.DataFrame) -> pd.DataFrame:
    """One row an id, that of the smallest vector."""
    keyed = frame.assign(_k=[tuple(v) for v in frame["v"]]).sort_values(["id", "_k"])
    return keyed.drop_duplicates("id")


def search_block(k: int, cut: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows, queries = _unique(rows), _unique(queries)
            dims = max(rows["v"].map(len).max(), queries["v"].map(len).max())
            index = BitSlices(rows["id"].to_numpy(), _matrix(rows["v"], dims), cut)
            for query_id, q in zip(queries["id"], _matrix(queries["v"], dims), strict=True):
                ids, scores = index.best(query_id, q, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        return pd.concat(out) if out else empty

    return run


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 10,
    cut: int = CUT_BITS,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
    small_block_rows: int = SMALL_BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's k best other rows by integer inner product.

    ``vectors`` has ``vec_id`` and ``embedding``; ``queries`` is the condition for a query row. Equal
    scores go to the smaller id. Rows without an id, and vectors that are null or hold a null or
    non-finite part, take no part. Rows of one id count once, with the smallest vector. A shorter
    vector counts as filled up with zeros. With fewer than k other rows all are returned. Scores must
    fit into 64 bits.

    Every block of rows meets every block of queries, so memory is bounded by a pair of blocks and
    the work is spread over pairs.
    """
    base = vectors.select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"), queries.alias("_q"))
    base = base.where("id is not null and v is not null")
    asked = base.where("_q").select("id", "v")
    n, m = base.agg(F.count("*"), F.count_if("_q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(1, -(-n // block_rows), min(cores, -(-n // small_block_rows)))
    query_blocks = max(1, -(-m // block_queries))
    block = lambda blocks, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = base.select("id", "v", block(row_blocks, 1).alias("row_block"), every(query_blocks).alias("query_block"))
    asks = asked.select("id", "v", every(row_blocks).alias("row_block"), block(query_blocks, 2).alias("query_block"))
    keys = ["row_block", "query_block"]
    found = (
        rows.groupBy(keys)
        .cogroup(asks.groupBy(keys))
        .applyInPandas(search_block(k, cut), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
