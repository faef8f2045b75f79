"""N-gram Jaccard join: fixed MinHash banding in place of an LSH forest, and exact verification.

Texts with the same words are one class from the start. The LSH forest this stands in for is not
built: no signatures are sorted and no prefix is shortened by what was found. Each of the trees has
one band of the same depth, worked out beforehand as the longest at which the expected share of pairs
at the threshold that meet in some tree reaches the target recall; classes with the same band are candidates. One depth is
enough since the threshold is fixed, and it needs one hash a tree. Candidates are gathered into groups, every group's
shingle sets are compared exactly, and large groups are cut into blocks that meet pair by pair.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import annotate, slices, words
from lanewise.llm.components import components
from lanewise.plans.staging import staged

WORDS = 5
THRESHOLD = 0.8
TREES = 30
DEPTH = 8
RECALL = 0.9999
#: Shingles a block of a group may hold, and those that small groups compared in one go may hold.
BLOCK_SHINGLES = 400_000
#: A shingle that more classes of a block share is counted by matrix products, a rarer one by pairs.
DENSE_FROM = 24
#: Bits of the table that keeps texts without candidates out of the shuffle (4 MB), and of one of its rows.
FILTER_BITS = 1 << 25
PART_BITS = 1 << 15

_RNG = np.random.default_rng(20_240_229)
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(1, 1 << 63, 1024, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from ``depth``, at which the expected recall reaches the target."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_hashes(split: list[list[bytes]], width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, text after text, and how many each text has.

    A text of fewer words, but not none, has one run. Repeats stay in. Hashes are differences of
    one running polynomial over all bytes, so that each byte is read once.
    """
    counts = np.array([len(w) for w in split], np.int64)
    every = [x for w in split for x in w]
    if not every:
        return np.zeros(0, np.uint64), counts
    lengths = np.fromiter(map(len, every), np.int64, len(every)) + 1
    flat = np.frombuffer(b" ".join(every) + b" ", np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    n = len(flat)
    powers = np.full(n, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[flat] * powers, out=running[1:])
    back = np.full(n, _INVERSE, np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    runs = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    first_word = np.repeat(np.cumsum(counts) - counts, runs)
    own = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    first = first_word + own
    last = first + np.repeat(np.minimum(counts, width), runs) - 1
    a, b = starts[first], ends[last]
    return mix((running[b] - running[a]) * back[a]), runs


def signatures(hashes: np.ndarray, runs: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """One prefix hash a text and tree, texts without runs left out: shape (texts, trees)."""
    starts = (np.cumsum(runs) - runs)[runs > 0]
    out = np.zeros((len(starts), trees), np.uint64)
    if not len(starts):
        return out.view(np.int64)
    # A few texts at a time, so that their hashes stay in the cache over all functions.
    cuts = [0, *(np.flatnonzero(np.diff(starts // 32_768)) + 1).tolist(), len(starts)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo == hi:
            continue
        a, b = starts[lo], starts[hi] if hi < len(starts) else len(hashes)
        part, at = hashes[a:b], starts[lo:hi] - a
        for t in range(trees):
            acc = np.full(hi - lo, t + 1, np.uint64)
            for k in range(t * depth, (t + 1) * depth):
                least = np.minimum.reduceat((part ^ _SHIFTS[k]) * _FACTORS[k], at)
                acc = mix(acc * _BASE + least)
            out[lo:hi, t] = acc
    return out.view(np.int64)


def word_key(w: list[bytes]) -> str | None:
    """Names the sequence of words; null without words."""
    return hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest() if w else None


SIGNED = [
    T.StructField("key", T.StringType()),
    T.StructField("runs", T.LongType()),
    T.StructField("prefixes", T.ArrayType(T.LongType())),
]


def sign(docs: DataFrame, column: str, threshold: float, width: int, trees: int, recall: float) -> DataFrame:
    depth = prefix_depth(threshold, trees, DEPTH, recall)
    if trees * depth > len(_FACTORS):
        raise ValueError(f"{trees} trees of depth {depth} need more than {len(_FACTORS)} hash functions")

    def make():
        def run(texts):
            split = [words(t) for t in texts]
            hashes, runs = shingle_hashes(split, width)
            rows = iter(signatures(hashes, runs, trees, depth).tolist())
            prefixes = [next(rows) if r else None for r in runs]
            return [word_key(w) for w in split], runs.tolist(), prefixes

        return run

    return annotate(docs, column, make, SIGNED)


def shingle_sets(split: list[list[bytes]], width: int) -> list[np.ndarray]:
    hashes, runs = shingle_hashes(split, width)
    return [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(runs)[:-1])] if len(runs) else []


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (or of ``left``)."""
    sets = left + (right or [])
    n = len(left)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    ids = np.cumsum(new) - 1
    shared = np.bincount(ids)
    out = np.zeros((n, n if right is None else len(right)), np.int64)

    dense = shared[ids] > DENSE_FROM
    if dense.any():
        _, col = np.unique(ids[dense], return_inverse=True)
        rows = owner[dense]
        for lo in range(0, int(col.max()) + 1, 4096):
            inside = (col >= lo) & (col < lo + 4096)
            m = np.zeros((len(sets), min(4096, int(col.max()) + 1 - lo)), np.float32)
            m[rows[inside], col[inside] - lo] = 1
            out += np.rint(m[:n] @ (m[:n] if right is None else m[n:]).T).astype(np.int64)

    rare = ~dense & (shared[ids] > 1)
    group, member = ids[rare], owner[rare]
    flat = out.reshape(-1)
    for shift in range(1, DENSE_FROM + 1):
        if shift >= len(group):
            break
        same = group[shift:] == group[:-shift]
        if not same.any():
            break
        a, b = member[:-shift][same], member[shift:][same]  # owners rise within a group: the sort is stable
        if right is None:
            flat += np.bincount(a * n + b, minlength=len(flat))
        else:
            cross = (a < n) & (b >= n)
            flat += np.bincount(a[cross] * out.shape[1] + b[cross] - n, minlength=len(flat))
    if right is None:
        upper = np.triu(out, 1)  # the product has both halves, the pairs only the upper one
        out = upper + upper.T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose Jaccard similarity is at least ``threshold``; within ``left``, each pair once."""
    common = overlaps(left, right)
    a = np.array([len(s) for s in left])[:, None]
    b = np.array([len(s) for s in (left if right is None else right)])[None, :]
    near = common >= threshold * (a + b - common) - 1e-9
    if right is None:
        near = np.triu(near, 1)
    return np.nonzero(near)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges to the smallest index of each component: as many as there are other members."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(i, int(r)) for i, r in enumerate(label) if r != i]


def compare_unit(threshold: float):
    """One unit: whole small groups, or two blocks of a large one."""

    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.drop_duplicates("key").sort_values("key")
        out = []
        for _, g in unit.groupby("group", sort=False):
            first, second = g[g["block"] == g["low"]], g[g["block"] != g["low"]]
            cross = bool((g["low"] != g["high"]).any())
            if len(first) == 0 or (cross and len(second) == 0):
                continue
            left, right = list(first["shingles"]), list(second["shingles"]) if cross else None
            a, b = linked(left, right, threshold)
            members = pd.concat([first, second]) if cross else first
            if cross:
                b = b + len(first)
            keys, copies = members["key"].to_numpy(), members["copies"].to_numpy()
            n = len(keys)
            texts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            others = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            hit = np.flatnonzero(texts)
            if len(hit):
                out.append(pd.DataFrame({"key": keys[hit], "other": None, "texts": texts[hit], "copies": others[hit].astype(np.int64)}))
                tree = forest(n, a, b)
                out.append(pd.DataFrame({"key": [keys[i] for i, _ in tree], "other": [keys[j] for _, j in tree], "texts": 0, "copies": 0}))
        empty = pd.DataFrame({"key": pd.Series(dtype=object), "other": pd.Series(dtype=object), "texts": pd.Series(dtype="int64"), "copies": pd.Series(dtype="int64")})
        return pd.concat(out) if out else empty

    return run


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``node, component`` of classes that share a prefix in some tree, chained; a node is the hash of a class's key.

    Numbers instead of keys, as there are as many rows as classes times trees; they are dealt by prefix once. Two
    classes of one hash are one node, which adds candidates; groups are compared exactly afterwards.
    """
    prefixes = classes.select(F.xxhash64("key").alias("node"), F.explode("prefixes").alias("prefix"))
    first = F.min("node").over(Window.partitionBy("prefix"))
    edges = prefixes.withColumn("first", first).where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return components(edges)


def likely(docs: DataFrame, column: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``docs`` whose ``column`` may be among the ``wanted``: all of those, and few others.

    ``wanted`` becomes a table of ``bits`` bits, whatever its size, that is broadcast; so a join that follows shuffles
    hardly more than the rows it keeps.
    """

    def placed(df: DataFrame) -> DataFrame:
        slot = F.pmod(F.xxhash64(column), F.lit(bits))
        return df.withColumns({"_part": F.floor(slot / PART_BITS), "_bit": slot % PART_BITS})

    parts = (
        placed(wanted.select(column).where(F.col(column).isNotNull()))
        .repartition("_part")
        .groupBy("_part")
        .agg(F.bitmap_construct_agg("_bit").alias("_set"))
    )
    byte = "cast(conv(hex(substring(_set, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int)"
    met = placed(docs.where(F.col(column).isNotNull())).join(F.broadcast(parts), "_part")
    return met.where(F.expr(f"(shiftright({byte}, cast(_bit % 8 as int)) & 1) = 1")).select(*docs.columns)


def verify(docs: DataFrame, classes: DataFrame, column: str, threshold: float, width: int) -> DataFrame:
    """``key, other, texts, copies``: counts of links per class (no ``other``) and edges of a spanning forest."""
    members = staged(
        candidate_groups(classes)
        .join(classes.select(F.xxhash64("key").alias("node"), "key", "rep", "copies", "runs"), "node")
        .select("key", F.col("component").cast("string").alias("group"), "rep", "copies", "runs")
    )
    # Blocks by the number of shingles, so that long texts do not make large blocks.
    sizes = members.groupBy("group").agg(F.sum("runs").alias("total"))
    cut = members.join(sizes, "group").withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
    small = F.col("blocks") <= 1
    total = sizes.where(F.col("total") <= BLOCK_SHINGLES).agg(F.sum("total")).first()[0] or 0
    bins = max(docs.sparkSession.sparkContext.defaultParallelism * 4, -(-total // (BLOCK_SHINGLES // 2)))
    chosen = cut.withColumn("block", F.when(small, 0).otherwise(F.pmod(F.xxhash64("key"), "blocks").cast("int")))

    wanted = chosen.select("key", "rep", "group", "copies", "block", "blocks")
    text = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.col(column).alias("text"))
    named = likely(text, "rep", wanted).join(wanted.where("rep is not null"), "rep").drop("rep")
    # Texts without an id are told apart by their key, each once.
    nameless = with_key(docs.where("doc_id is null"), column).groupBy("key").agg(F.first(f"row.`{column}`").alias("text"))
    unnamed = nameless.join(wanted.where("rep is null").drop("rep"), "key")
    with_text = named.unionByName(unnamed)
    at = {c: i for i, c in enumerate(with_text.columns)}
    kept = ["key", "group", "copies", "block", "blocks"]

    def sets(batches):
        for part in (part for batch in batches for part in slices(batch, batch.column(at["text"]))):
            split = [words(t) for t in part.column(at["text"]).cast(pa.binary()).to_pylist()]
            # Rows of the same id but another text are not the class's.
            keys = part.column(at["key"]).to_pylist()
            mine = [i for i, w in enumerate(split) if word_key(w) == keys[i]]
            rest = part.take(pa.array(mine, pa.int64()))
            found = [s.tolist() for s in shingle_sets([split[i] for i in mine], width)]
            yield pa.RecordBatch.from_arrays(
                [*[rest.column(at[c]) for c in kept], pa.array(found, pa.list_(pa.int64()))], names=[*kept, "shingles"]
            )

    made = with_text.mapInArrow(sets, "key string, group string, copies long, block int, blocks int, shingles array<long>")
    # A block meets every block of its group, itself included; small groups share units.
    units = (
        made.withColumn("with", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("blocks") - 1))))
        .withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
        .withColumn(
            "unit",
            F.when(F.col("blocks") <= 1, F.concat(F.lit("bin "), F.pmod(F.xxhash64("group"), F.lit(bins)).cast("string")))
            .otherwise(F.concat_ws(" ", "group", "low", "high")),
        )
    )
    return units.select("unit", "key", "group", "copies", "block", "low", "high", "shingles").groupBy("unit").applyInPandas(
        compare_unit(threshold), "key string, other string, texts long, copies long"
    )


def jaccard_join(
    docs: DataFrame,
    column: str = "text",
    threshold: float = THRESHOLD,
    width: int = WORDS,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """``doc_id, key, class_id, winner, n_links, n_texts``: one row per document row.

    ``n_texts`` is the number of different texts with a similarity of ``threshold`` or more,
    ``n_links`` that of other document rows, copies included. Classes are chained links; ``class_id``
    is a class's smallest doc_id and ``winner`` the key of the text that has it. Similarity is that
    of the sets of runs of ``width`` words of the whole texts, A-Z lower-cased; a text of fewer words
    has one run. A null text or one without words is linked to nothing and its own class. Rows with
    equal words are copies, whether or not their ids differ. No rows give no rows.
    """
    source = docs.select("doc_id", column)
    signed = staged(sign(source, column, threshold, width, trees, recall).select("row.doc_id", "key", "runs", "prefixes"))
    classes = staged(
        signed.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("runs").alias("runs"), F.first("prefixes").alias("prefixes"))
    )
    found = staged(verify(source, classes, column, threshold, width))
    counts = found.where("other is null").groupBy("key").agg(F.sum("texts").alias("n_texts"), F.sum("copies").alias("linked"))
    chained = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    by_key = classes.select("key", "rep", "copies").join(chained.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "component", F.coalesce("component", "key")
    )
    best = by_key.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "key")).alias("b"))
    about = (
        by_key.join(best, "component")
        .join(counts, "key", "left")
        .select(
            "key",
            F.col("b.rep").alias("class_id"),
            F.col("b.key").alias("winner"),
            (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
        )
    )
    own = F.col("key").isNull()
    return signed.select("doc_id", "key").join(about, "key", "left").select(
        "doc_id",
        "key",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        "winner",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
    )


def one_of_each(docs: DataFrame, column: str = "text", **how) -> DataFrame:
    """The documents, all columns, with one row of each class: the one of the smallest doc_id."""
    joined = jaccard_join(docs, column, **how)
    winners = staged(joined.where("key = winner").select(F.col("class_id").alias("_id"), F.col("winner").alias("_key")).distinct())
    named = with_key(docs.join(winners.where("_id is not null"), docs["doc_id"] == winners["_id"]), column).where("row._key = key")
    # Rows without an id are found by their key.
    nameless = with_key(docs.where("doc_id is null"), column).groupBy("key").agg(F.first("row").alias("row"))
    unnamed = nameless.join(winners.where("_id is null").select(F.col("_key").alias("key")), "key", "left_semi")
    names = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    mine = (
        named.select("key", F.struct(*names).alias("row"))
        .unionByName(unnamed.select("key", F.struct(*names).alias("row")))
        .groupBy("key")
        .agg(F.first("row").alias("row"))
    )
    empty = with_key(docs, column).where("key is null")
    return mine.select(*names).unionByName(empty.select(*names))


def with_key(docs: DataFrame, column: str) -> DataFrame:
    def make():
        return lambda texts: [[word_key(words(t)) for t in texts]]

    return annotate(docs, column, make, SIGNED[:1])
