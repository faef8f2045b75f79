"""Spelling variants: words one edit away from a far more frequent word, by bidirectional FM-index search schemes.

Two words one edit apart share everything before the first place ``e`` where they differ and everything
behind it. ``e`` lies in one of the halves of the shorter word, so the other half is equal in both:
words are dealt to shards by (length of the shorter word, zone of ``e``, what stands outside the zone), each
word as the shorter and as the longer one. A bucket that is too large for a task is dealt again by halves of
its zone. A shard builds one index over its words and searches all of them in it (``bidirectional``).
"""

from math import log10

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

#: A-Z and a-z and the letters of Latin-1, and the letters of A-Z alone.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH = 7
MIN_COUNT = 2
#: Every so manieth (document, word) loses a letter.
DROP = 31
#: How much more frequent a word's form is.
RATIO = 10
#: Words of a bucket, and of a shard: what a task indexes at once.
BUCKET_WORDS = 50_000
SHARD_WORDS = 200_000

KEY = ["shorter", "lo", "hi", "head", "tail"]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """``word, n``: words of whole texts with at least ``min_length`` code points and ``min_count`` places.

    A null text has no words; a null id counts as an empty one. Repeated rows count again. Counts are
    added up before they are shuffled, so a very frequent word is no burden.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= min_length)
    small = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")))
    hashed = small.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % drop == 0, less).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(
        F.col("n") >= min_count
    )


def placed(rows: DataFrame, shorter: Column, lo: Column, hi: Column) -> DataFrame:
    """Adds the bucket ``KEY`` of a word for one zone."""
    zone = rows.withColumns({"shorter": shorter.cast("int"), "lo": lo.cast("int"), "hi": hi.cast("int")})
    behind = F.col("shorter") - F.col("hi")
    return zone.withColumns(
        {
            "head": F.substring("word", F.lit(1), F.col("lo")),
            "tail": F.substring("word", F.length("word") - behind + 1, behind),
        }
    )


def buckets(words: DataFrame, most: int = BUCKET_WORDS) -> DataFrame:
    """``word, n`` with a ``KEY`` for every bucket the word belongs to; none over ``most`` words can be cut further."""
    length = F.length("word")
    halves = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("_s")).where("_s > 0")
    middle = F.ceil(F.col("_s") / 2)
    zones = F.array(
        F.struct(F.lit(0).cast("long").alias("lo"), middle.alias("hi")),
        F.struct(middle.alias("lo"), F.col("_s").cast("long").alias("hi")),
    )
    dealt = halves.select("word", "n", "_s", F.explode(zones).alias("_z")).where("_z.lo < _z.hi")
    left = placed(dealt, F.col("_s"), F.col("_z.lo"), F.col("_z.hi")).select("word", "n", *KEY)
    done = None
    while True:
        left = staged(left)
        large = staged(
            left.where("hi - lo > 1").groupBy(*KEY).agg(F.count("*").alias("_size")).where(F.col("_size") > most).select(*KEY)
        )
        if large.isEmpty():
            return left if done is None else done.unionByName(left)
        marked = lookup_join(left, large.withColumn("_large", F.lit(True)), KEY)
        kept = marked.where("_large is null").select("word", "n", *KEY)
        done = kept if done is None else done.unionByName(kept)
        split = marked.where("_large").withColumn(
            "_z", F.expr("explode(array(struct(lo, (lo + hi) div 2 as hi), struct((lo + hi) div 2 as lo, hi)))")
        )
        left = placed(split.select("word", "n", "shorter", "_z"), F.col("shorter"), F.col("_z.lo"), F.col("_z.hi")).select(
            "word", "n", *KEY
        )


NEAR = "word string, n_near bigint, best_n bigint, best string"


def near_words(words: DataFrame, most: int = BUCKET_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: how many words are one edit away, and the most frequent of them.

    ``words`` has distinct ``word`` and ``n``. Of equally frequent ones the smallest by code point is the best.
    Every pair is found in exactly one bucket; words without near words have no row.
    """
    dealt = staged(buckets(words, most))
    shards = max(words.sparkSession.sparkContext.defaultParallelism, -(-dealt.count() // shard_words))
    shard = F.pmod(F.xxhash64(*KEY), F.lit(shards))
    found = (
        dealt.select(shard.alias("shard"), "word", "n", "shorter", "lo", "hi").groupBy("shard").applyInArrow(search_shard, NEAR)
    )
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    total = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return total.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def search_shard(rows: pa.Table) -> pa.Table:
    """Every word of a shard, searched for in the index of the shard's words."""
    import numpy as np

    from lanewise.llm.bidirectional import Searcher

    given = rows["word"].combine_chunks().dictionary_encode()
    words = given.dictionary.to_pylist()
    # By code point, so that the smaller number is the smaller word.
    order = sorted(range(len(words)), key=words.__getitem__)
    number = np.empty(len(words), dtype=np.int64)
    number[order] = np.arange(len(words))
    words = [words[i] for i in order]
    query = number[given.indices.to_numpy()]
    n = np.empty(len(words), dtype=np.int64)
    n[query] = rows["n"].to_numpy()
    zone = [rows[c].to_numpy().astype(np.int64) for c in ("shorter", "lo", "hi")]
    q, v = Searcher(words).near(query, *zone)
    order = np.lexsort((v, -n[v], query[q]))
    w, v = query[q][order], v[order]
    head = np.flatnonzero(np.diff(w, prepend=-1))
    names = pa.array(words)
    return pa.table(
        {
            "word": names.take(pa.array(w[head])),
            "n_near": pa.array(np.diff(np.append(head, len(w)))),
            "best_n": pa.array(n[v[head]]),
            "best": names.take(pa.array(v[head])),
        }
    )


def follow(forms: DataFrame, ratio: int) -> DataFrame:
    """``word, root`` of ``word, form`` rows: the last form of each chain, by path doubling.

    Each form is ``ratio`` times as frequent as its word, so that chains have few steps.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 1
    steps = int(log10(most) / log10(ratio)) + 1
    jumps, span = staged(forms.select("word", F.col("form").alias("root"))), 1
    while span < steps:
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        jumps = staged(lookup_join(jumps, on, ["root"]).select("word", F.coalesce("_next", "root").alias("root")))
        span *= 2
    return jumps


def spelling_variants(words: DataFrame, ratio: int = RATIO, **how) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``word, n`` rows.

    ``form`` is the most frequent word one edit away (ties: the smallest by code point) if it is at least
    ``ratio`` times as frequent, ``root`` what forms lead to in the end. Words that are null go, repeats of a word add
    up; no rows give no rows. Other columns of ``words`` are left out.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    vocabulary = staged(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    joined = vocabulary.join(near_words(vocabulary, **how), "word", "left")
    has = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    formed = staged(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
        )
    )
    roots = follow(formed.where("form is not null"), ratio)
    return formed.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
