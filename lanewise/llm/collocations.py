"""Collocations: phrases whose words stand together far more often than their parts do.

Every place of a text starts a suffix of at most three words, cut off at the end of its piece. Suffixes are
routed by their leading words, so that a phrase's places meet in one task; there a multikey three-way
quicksort over pointers to them counts phrases by the sizes of equal partitions and abandons
partitions that are too small for any phrase that counts.

A leading word (or pair) that fills much of a shard is routed by two (or three) words. Which ones do is read
from sums over a fixed number of hash slots, an upper bound on each word's count: the table of
full slots stays the same size whatever the corpus, and a slot that is full by chance only splits
more than it had to. Counts of what was split are added up afterwards.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import slices
from lanewise.plans.staging import staged

DEPTH = 3
LEAST = 10
#: Share of a phrase's places, in percent, inside one longer phrase at which the phrase goes.
COVERED = 50
TOP = 2000
#: Suffixes that one task sorts, and slots of the table of heavy words and pairs.
SHARD_SUFFIXES = 2_000_000
SLOTS = 1 << 16
#: Bytes of text whose suffixes are packed together before the shuffle.
PACK_BYTES = 4 << 20
#: Parts in which a language's best phrases are first picked.
PARTS = 64

#: A-Z lower-cased, ends of pieces turned into line feeds, tabs into spaces.
PIECES = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if b in b".,;:!?\n\v\f\r" else 0x20 if b == 9 else b for b in range(256))


class Slice:
    """The words of some texts as numbers, with the pieces they stand in."""

    def __init__(self, langs: list[str | None], texts: list[bytes | None]):
        flat, ends, of = [], [], []
        names = {}
        for lang, text in zip(langs, texts, strict=True):
            number = names.setdefault("und" if lang is None else lang, len(names))
            for piece in (text or b"").translate(PIECES).split(b"\n"):
                words = piece.split()
                if words:
                    flat += words
                    ends.append(len(flat))
                    of.append(number)
        self.langs = list(names)
        coded = pa.array(flat, pa.binary()).dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        ends, n = np.array(ends, dtype=np.int64), len(flat)
        piece = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        self.lang = np.array(of, dtype=np.int64)[piece]
        self.left = ends[piece] - np.arange(n)

    def suffixes(self) -> np.ndarray:
        """Per place the numbers of its ``DEPTH`` words; past the end of the piece -1."""
        n = len(self.ids)
        at = np.arange(n)
        return np.stack(
            [np.where(self.left > k, self.ids[np.minimum(at + k, max(n - 1, 0))], -1) if n else self.ids for k in range(DEPTH)],
            axis=1,
        )

    def hashes(self, suffixes: np.ndarray) -> list[np.ndarray]:
        """Hashes of each suffix's language with its first one, two and three words."""
        word = np.array([zlib.crc32(w) for w in self.words] + [0], dtype=np.uint64)
        state = np.array([zlib.crc32(x.encode()) for x in self.langs] + [0], dtype=np.uint64)[self.lang]
        out = []
        for k in range(DEPTH):
            state = (state ^ word[suffixes[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
            out.append(state)
        return out


def parts_of(batches, size: int):
    """Rows of (lang, text) in slices of about ``size`` bytes of text, across batches."""
    langs, texts, held = [], [], 0
    for batch in batches:
        for part in slices(batch, batch.column(1)):
            langs += part.column(0).to_pylist()
            texts += part.column(1).cast(pa.binary()).to_pylist()
            held += sum(len(t) for t in texts[-part.num_rows :] if t) + 64 * part.num_rows
            if held >= size:
                yield Slice(langs, texts)
                langs, texts, held = [], [], 0
    if texts:
        yield Slice(langs, texts)


def slot_counts(texts: DataFrame, slots: int) -> DataFrame:
    """``depth, slot, n``: places by the hash of their first word, and of their first two."""

    def run(batches):
        counts = np.zeros((2, slots), dtype=np.int64)
        for part in parts_of(batches, PACK_BYTES):
            suffixes = part.suffixes()
            for depth, h in enumerate(part.hashes(suffixes)[:2]):
                counts[depth] += np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots)
        depth, slot = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[depth, slot])],
            names=["depth", "slot", "n"],
        )

    return texts.mapInArrow(run, "depth int, slot int, n long").groupBy("depth", "slot").agg(F.sum("n").alias("n"))


def routed(texts: DataFrame, heavy: list[np.ndarray], shards: int) -> DataFrame:
    """``shard, lang, words, rows``: the different suffixes of a slice that go to a shard, packed.

    ``rows`` holds, column by column, the numbers of the suffixes' words, their counts and how many words they were
    routed by; numbers count the lines of ``words``.
    """
    slots = np.uint64(len(heavy[0]))

    def run(batches):
        for part in parts_of(batches, PACK_BYTES):
            s = part.suffixes()
            base = len(part.words) + 1
            # Equal suffixes of a slice are one row with a count.
            key = np.unique((part.lang * base + s[:, 0] + 1) * base + s[:, 1] + 1, return_inverse=True)[1] * base + s[:, 2] + 1
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            s, part.lang = s[first], part.lang[first]
            h = part.hashes(s)
            by = np.ones(len(s), dtype=np.int64)
            for k in range(2):
                by += (by == k + 1) & heavy[k][(h[k] % slots).astype(np.int64)]
            shard = (np.choose(by - 1, h) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((s[:, 2], s[:, 1], s[:, 0], part.lang, shard))
            s, count, by, shard, lang = s[order], count[order], by[order], shard[order], part.lang[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1) | np.diff(lang, prepend=-1)).tolist()
            squeeze = zstandard.ZstdCompressor(level=1)
            out = [[], [], [], []]
            for a, b in zip(cuts, [*cuts[1:], len(s)]):
                used, local = np.unique(s[a:b], return_inverse=True)
                local = local.reshape(-1, DEPTH) - (used[0] < 0)
                names = b"\n".join(part.words[i] for i in used[used >= 0].tolist())
                table = np.concatenate([local.T, count[None, a:b], by[None, a:b]]).astype(np.int32)
                row = int(shard[a]), part.langs[lang[a]], squeeze.compress(names), squeeze.compress(table.tobytes())
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64(), pa.string(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, types, strict=True)], names=["shard", "lang", "words", "rows"]
            )

    return texts.mapInArrow(run, "shard long, lang string, words binary, rows binary")


def partitions(keys: np.ndarray, weight: np.ndarray, least: int):
    """Multikey three-way quicksort of pointers to suffixes, all partitions of a level at once.

    ``keys`` has a row of numbers per suffix, -1 past its end. Yields, for each prefix of total weight
    ``least`` or more, its depth, a pointer to one of its suffixes and the weight. Each round splits every
    partition by a pivot on the key of its depth into less, equal and greater; what weighs less
    than ``least`` is abandoned, equal parts go on to the next key.
    """
    rng = np.random.default_rng(0)
    pointer = np.arange(len(keys))
    start, depth = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(pointer):
        length = np.diff(np.append(start, len(pointer)))
        part = np.repeat(np.arange(len(start)), length)
        key = keys[pointer, depth[part]]
        pivot = key[start + (rng.random(len(start)) * length).astype(np.int64)]
        side = 1 + np.sign(key - pivot[part])
        # Stable places: sizes of the three sides of each partition, then running numbers within each side.
        group = part * 3 + side
        size = np.bincount(group, minlength=3 * len(start))
        place = np.empty(len(pointer), dtype=np.int64)
        before = np.cumsum(size) - size
        for x in range(3):
            of = np.flatnonzero(side == x)
            running = np.arange(len(of)) - (np.cumsum(size[x::3]) - size[x::3])[part[of]]
            place[of] = before[group[of]] + running
        moved = np.empty_like(pointer)
        moved[place] = pointer
        total = np.bincount(group, weights=weight[pointer], minlength=3 * len(start)).astype(np.int64)
        level = np.repeat(depth, 3)
        level[1::3] += 1
        equal = np.zeros(len(size), dtype=bool)
        equal[1::3] = True
        ended = equal.copy()
        ended[1::3] = pivot < 0
        found = np.flatnonzero(equal & ~ended & (total >= least))
        yield level[found], moved[before[found]], total[found]
        goes_on = (total >= least) & (size > 0) & ~ended & (level < keys.shape[1])
        keep = np.repeat(goes_on, size)
        pointer, depth = moved[keep], level[goes_on]
        start = (np.cumsum(size[goes_on]) - size[goes_on]).astype(np.int64)


FOUND = "lang string, words array<string>, n long"


def count_shard(least: int):
    """From a shard's packed suffixes to its phrases of ``least`` places or more, and partial counts of split ones.

    A row without words carries the number of places of a language.
    """

    def unpack(table: pa.Table):
        numbers, names, langs, parts = {}, [], {}, []
        for lang, words, rows in zip(*(table[c].to_pylist() for c in ("lang", "words", "rows")), strict=True):
            mine = zstandard.decompress(words).split(b"\n")
            seen = np.array([numbers.setdefault(w, len(numbers)) for w in mine] + [-1], dtype=np.int64)
            data = np.frombuffer(zstandard.decompress(rows), dtype=np.int32).reshape(DEPTH + 2, -1)
            number = langs.setdefault(lang, len(langs))
            parts.append(np.concatenate([np.full((1, data.shape[1]), number), seen[data[:DEPTH]], data[DEPTH:]]))
        names = [w.decode("utf-8", "surrogateescape") for w in numbers]
        return names, list(langs), np.concatenate(parts, axis=1)

    def run(table: pa.Table) -> pa.Table:
        names, langs, data = unpack(table)
        keys, weight, by = np.ascontiguousarray(data[: DEPTH + 1].T), data[DEPTH + 1], data[DEPTH + 2]
        out_lang, out_words, out_n = [], [], []

        def emit(rows: np.ndarray, depth: np.ndarray, n: np.ndarray):
            for row, d, c in zip(keys[rows].tolist(), depth.tolist(), n.tolist(), strict=True):
                out_lang.append(langs[row[0]])
                out_words.append([names[w] for w in row[1 : d + 1]])
                out_n.append(c)

        # What was routed by more words is not whole here at the words before: partial counts, all of them.
        for d in range(DEPTH):
            split = np.arange(len(keys)) if d == 0 else np.flatnonzero((by > d) & (keys[:, d] >= 0))
            prefix, first, where = np.unique(keys[split, : d + 1], axis=0, return_index=True, return_inverse=True)
            if len(prefix):
                emit(split[first], np.full(len(first), d), np.bincount(where.ravel(), weights=weight[split]).astype(np.int64))
        for depth, at, n in partitions(keys, weight, least):
            # Depth 1 is the language itself.
            whole = np.flatnonzero((depth > 1) & (depth - 1 >= by[at]))
            emit(at[whole], depth[whole] - 1, n[whole])
        return pa.table(
            {"lang": pa.array(out_lang, pa.string()), "words": pa.array(out_words, pa.list_(pa.string())), "n": pa.array(out_n, pa.int64())}
        )

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, shard: int = SHARD_SUFFIXES, slots: int = SLOTS) -> DataFrame:
    """``lang, words, n``: every phrase of one to three words with ``least`` places or more, and per language
    a row with no words for the number of all word places.

    A null language is ``und``, a null text is empty. Repeated rows count again; extra columns are left out.
    """
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    sums = staged(slot_counts(texts, slots))
    places = sums.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    # At most ``slots`` rows of each depth.
    full = sums.where(F.col("n") >= max(shard // 4, 1)).select("depth", "slot").collect()
    heavy = [np.zeros(slots, dtype=bool) for _ in range(2)]
    for row in full:
        heavy[row.depth][row.slot] = True
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, -(-places // shard))
    found = routed(texts, heavy, shards).groupBy("shard").applyInArrow(count_shard(least), FOUND)
    total = found.groupBy("lang", "words").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= least) | (F.size("words") == 0))


def scored(counts: DataFrame, covered: int = COVERED) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the phrases that no longer one covers.

    The lowest-scoring cut counts, ties to the earliest. Products are decimals of 38 digits, which hold
    a million times the square of 10^15.
    """
    counts = staged(counts)
    sizes = counts.where("size(words) = 0").select("lang", F.col("n").alias("_places"))
    named = counts.where("size(words) > 0").select("lang", "words", F.array_join("words", " ").alias("phrase"), "n")
    longer = named.where("size(words) > 1")
    # A phrase and what it may cover; of the longer ones the most frequent matters.
    inner = longer.where("size(words) > 2").select(
        "lang", "n", F.expr("explode(transform(sequence(1, size(words) - 1), i -> array_join(slice(words, i, 2), ' '))) as phrase")
    )
    over = inner.groupBy("lang", "phrase").agg(F.max("n").alias("_over"))
    free = longer.join(over, ["lang", "phrase"], "left").where(
        f"_over is null or 100 * _over < {covered} * n"
    )
    cuts = free.select(
        "lang", "phrase", F.col("n").alias("a"), "words", F.expr("explode(sequence(1, size(words) - 1)) as k")
    ).select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(words, 1, k), ' ')").alias("_left"),
        F.expr("array_join(slice(words, k + 1, size(words) - k), ' ')").alias("_right"),
    )
    parts = named.select("lang", "phrase", "n")
    left = parts.select("lang", F.col("phrase").alias("_left"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("_right"), F.col("n").alias("r"))
    big = "cast({} as decimal(19, 0))".format
    score = f"cast(({big('a')} * {big('a')} * 1000000) div ({big('l')} * {big('r')}) as bigint)"
    worst = (
        cuts.join(left, ["lang", "_left"])
        .join(right, ["lang", "_right"])
        .withColumn("score", F.expr(score))
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    )
    return worst.join(sizes, "lang").select("lang", "phrase", "a", "c.l", "c.r", F.col("_places").alias("n"), "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, covered: int = COVERED, **how) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    By score, then places ``a``, both descending, then phrase in byte order. A language without phrases has no rows.
    Null languages are ``und``, null and empty texts have no words, repeated rows count again, other columns are
    ignored; no rows give no rows.
    """
    rows = staged(scored(phrase_counts(docs, least, **how), covered))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # First within parts of a language, so that no task sorts all phrases of one.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = rows.withColumn("_part", part).withColumn(
        "_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    )
    ranked = near.where(F.col("_place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
