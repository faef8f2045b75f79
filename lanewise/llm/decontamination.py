"""Benchmark decontamination: Wu-Manber search for benchmark passages in documents.

Patterns are all runs of ``window`` consecutive words of an item (a shorter item is one pattern).
For each pattern length there is a table of blocks of three words: how far the scan may jump when
it sees the block. A block that ends a pattern allows no jump; its bucket, split by the pattern's
first words, holds the patterns to compare word by word.
"""

import hashlib
import pickle
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import annotate, text_bytes, words
from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

WINDOW = 13
BLOCK = 3
#: Items are searched in shares of about this many bytes, one share in memory at a time.
SHARE_BYTES = 32 << 20


def build_tables(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[tuple]:
    """``(length, block, farthest, shifts, buckets)`` for each pattern length."""
    patterns: dict[int, dict[tuple, set]] = {}
    for item_id, text in items:
        w = words(text)
        m = min(window, len(w))
        if m:
            own = patterns.setdefault(m, {})
            for i in range(len(w) - m + 1):
                own.setdefault(tuple(w[i : i + m]), set()).add(item_id)
    tables = []
    for m, own in sorted(patterns.items()):
        block = min(BLOCK, m)
        farthest = m - block + 1
        shifts: dict[tuple, int] = {}
        buckets: dict[tuple, dict] = {}
        for p, ids in own.items():
            for end in range(block, m + 1):
                key = p[end - block : end]
                shifts[key] = min(shifts.get(key, farthest), m - end)
            buckets.setdefault(p[m - block :], {}).setdefault(p[:block], []).append((list(p), frozenset(ids)))
        tables.append((m, block, farthest, shifts, buckets))
    return tables


def search(w: list[bytes], tables: list[tuple], hit: bytearray, found: set) -> None:
    """Marks in ``hit`` every word inside a pattern's occurrence and adds its items to ``found``."""
    n = len(w)
    for m, block, farthest, shifts, buckets in tables:
        jump = shifts.get
        end = m
        while end <= n:
            key = tuple(w[end - block : end])
            step = jump(key, farthest)
            if step:
                end += step
                continue
            start = end - m
            for p, ids in buckets[key].get(tuple(w[start : start + block]), ()):
                if w[start:end] == p:
                    hit[start:end] = b"\x01" * m
                    found |= ids
            end += 1


def named_items(benchmark: DataFrame) -> DataFrame:
    """An item without an id or without words takes no part."""
    return benchmark.where("item_id is not null and text is not null").select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")
    )


def loaded(items: DataFrame):
    """The items of one share as a broadcast; its size is bounded by the share's."""
    return items.sparkSession.sparkContext.broadcast(pickle.dumps([tuple(r) for r in items.collect()]))


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()),
]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, column: str = "text", share_bytes: int = SHARE_BYTES
) -> DataFrame:
    """``row`` (the document), ``n_words, n_hit, items, items_sha256`` for every document row.

    Words are runs of letters and digits, A-Z lower-cased, of the whole text. ``items`` are the ids,
    sorted as strings, with an occurring pattern. A null or empty text has no words and no hits;
    repeated rows are judged alike; without items nothing is hit; no rows give no rows.

    A benchmark of up to ``share_bytes`` is searched in one pass without a shuffle. A larger one is
    dealt into shares; see ``find_by_shares``.
    """
    items = named_items(benchmark)
    n = -(-text_bytes(items, "text") // share_bytes)
    if n > 1:
        return find_by_shares(docs, items, n, window, column)
    share = loaded(items)

    def make():
        tables = build_tables(pickle.loads(share.value), window)

        def run(texts):
            split = [words(t) for t in texts]
            hits = [bytearray(len(w)) for w in split]
            found: list[set] = [set() for _ in split]
            for w, h, f in zip(split, hits, found, strict=True):
                search(w, tables, h, f)
            items = [sorted(f) for f in found]
            sums = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            return [len(w) for w in split], [sum(h) for h in hits], items, sums

        return run

    return annotate(docs, column, make, FIELDS)


#: ``text_key`` names the words of a text; repeated texts have one.
KEY = T.StructField("text_key", T.StringType())
HITS = [KEY, T.StructField("first", T.ArrayType(T.LongType())), T.StructField("end", T.ArrayType(T.LongType())), FIELDS[2]]


def text_key(w: list[bytes]) -> str:
    return hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest()


def runs_of(hit: bytearray) -> tuple[list[int], list[int]]:
    """Where the runs of marked words begin and end."""
    edges = np.flatnonzero(np.diff(np.frombuffer(b"\x00" + bytes(hit) + b"\x00", np.int8)))
    return edges[0::2].tolist(), edges[1::2].tolist()


def hits_of_share(docs: DataFrame, share, window: int, column: str) -> DataFrame:
    """``text_key, first, end, items`` of the texts in which the share's items occur, each text once."""

    def make():
        tables = build_tables(pickle.loads(share.value), window)

        def run(texts):
            out = []
            for w in map(words, texts):
                hit, found = bytearray(len(w)), set()
                search(w, tables, hit, found)
                out.append((text_key(w), *runs_of(hit), sorted(found)))
            return [list(c) for c in zip(*out)]

        return run

    texts = docs.select(F.col(f"`{column}`").alias("text"))
    return annotate(texts, "text", make, HITS).where("size(items) > 0").select(*[f.name for f in HITS]).distinct()


def find_by_shares(docs: DataFrame, items: DataFrame, n: int, window: int = WINDOW, column: str = "text") -> DataFrame:
    """What ``find_passages`` returns, for a benchmark of any size: one share at a time.

    Driver and executors hold one share. Its hits, rows for texts with hits only, are written before
    the next share is read, and are united by text at the end.
    """
    spread = items.withColumn("share", F.expr(f"pmod(xxhash64(item_id, text), {n})"))
    written = []
    for k in range(n):
        share = loaded(spread.where(F.col("share") == k).select("item_id", "text"))
        written.append(staged(hits_of_share(docs, share, window, column)))
        share.destroy()
    hits = reduce(DataFrame.unionByName, written)
    hit_words = (
        hits.select("text_key", F.explode(F.arrays_zip("first", "end")).alias("run"))
        .select("text_key", F.explode(F.sequence("run.first", F.col("run.end") - 1)).alias("word"))
        .distinct()
        .groupBy("text_key")
        .agg(F.count("*").alias("n_hit"))
    )
    ids = (
        hits.select("text_key", F.explode("items").alias("item")).groupBy("text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    united = staged(hit_words.join(ids, "text_key"))

    def make():
        def run(texts):
            split = [words(t) for t in texts]
            return [text_key(w) for w in split], [len(w) for w in split]

        return run

    counted = annotate(docs, column, make, [KEY, FIELDS[0]])
    none = F.array().cast("array<string>")
    return (
        lookup_join(counted, united, ["text_key"])
        .withColumn("items", F.coalesce("items", none))
        .select(
            "row",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            "items",
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        )
    )


def is_contaminated(share: int = 20) -> Column:
    """At least one word in ``share`` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    return find_passages(docs, benchmark, **how).where(~is_contaminated()).select("row.*")
