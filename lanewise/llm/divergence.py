"""Quality rules by distribution divergence: DataFrame functions only.

Each document has two histograms: characters by class, and the language's most common words with one
bin for all other words. Both are compared with the language's own, counted over all documents long
enough to count, by the Jensen-Shannon distance (base 2, so 0 to 1). A short text strays further by
chance alone: ``(bins - 1) / (8 n ln 2)`` is about the divergence a sample of ``n`` is expected to show
against its own source, and ``SLACK`` times that is allowed on top of the limit.

Everything about one document stays in its row, so that ids may be null or repeat and no text is
shuffled; only word counts per language are.
"""

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

#: White space between words, as a regular expression's set and as characters.
SPACE = r"\x20\x09-\x0D"
#: Classes in the order in which they are taken out of the text; what is left is ``other``.
CLASSES = {
    "lower": r"a-zß-öø-ÿ",
    "space": SPACE,
    "upper": r"A-ZÀ-ÖØ-Þ",
    "mark": r".,;:!?'\"()\x2D",
    "digit": "0-9",
    "symbol": r"#*$%&|<>",
}
COMMON_WORDS = 20
MIN_WORDS = 50
#: Words a language's documents must hold together before it has a reference.
MIN_REFERENCE_WORDS = 1_000
CLASS_LIMIT = 0.18
WORD_LIMIT = 0.45
SLACK = 4.0
#: Repeated three-word windows a text may consist of, as a share of 100.
MAX_REPEATED = 50
WINDOW = 3

NAMES = [*CLASSES, "other"]


def with_classes(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds ``_classes``, the number of code points of each class, from one text that gets shorter class by class."""
    out, before = docs.withColumn("_n0", F.length(text)), text
    for i, chars in enumerate(CLASSES.values(), 1):
        out = out.withColumn(f"_rest{i}", F.regexp_replace(before, f"[{chars}]+", ""))
        out = out.withColumn(f"_n{i}", F.length(f"_rest{i}"))
        before = f"_rest{i}"
    last = len(CLASSES)
    counts = [F.col(f"_n{i}") - F.col(f"_n{i + 1}") for i in range(last)] + [F.col(f"_n{last}")]
    return out.withColumn("_classes", F.array(*[c.cast("long") for c in counts])).drop(
        *[f"_n{i}" for i in range(last + 1)], *[f"_rest{i + 1}" for i in range(last)]
    )


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, as the only element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def twins(ordered: Column, key: str) -> Column:
    """Elements of a sorted array of structs whose ``key`` equals that of a neighbour."""

    def beside(x: Column, k: Column) -> Column:
        return (F.get(ordered, k - 1)[key] == x[key]) | (F.get(ordered, k + 1)[key] == x[key])

    return F.filter(ordered, lambda x, k: F.coalesce(beside(x, k), F.lit(False)))


def repeated_words(words: str) -> Column:
    """How many of the words lie in a three-word window that the text holds twice or more.

    Most texts have no two windows of the same hash and are done. In the others the windows that share
    a hash are sorted by their words, so that equal ones, and only these, stand side by side.
    """
    w = F.col(words)
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*window(i)))

    def covered(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        suspects = bound(by_hash, lambda s: twins(s, "h"))
        by_words = F.sort_array(F.transform(suspects, lambda x: F.struct(F.array(*window(x["i"])).alias("w"), x["i"].alias("i"))))
        places = F.transform(bound(by_words, lambda s: twins(s, "w")), lambda x: F.array(*[x["i"] + k for k in range(WINDOW)]))
        return F.size(F.array_distinct(F.flatten(places)))

    count = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > WINDOW, count).otherwise(0).cast("long")


def letter_words() -> Column:
    return F.array_remove(F.split(F.lower("_text"), r"\P{L}+"), "")


def with_rules(docs: DataFrame) -> DataFrame:
    """``row`` (the document), the base columns and ``_classes``, ``_spaced`` (words of letters, lower case, two spaces around each)."""
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = source.withColumn("_text", F.coalesce(F.col("row")["text"], F.lit("")))
    symbol = NAMES.index("symbol")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return (
        with_classes(text)
        .withColumns(
            {
                "_tokens": F.array_remove(F.split("_text", f"[{SPACE}]+"), ""),
                "_lines": lines,
                "_spaced": F.regexp_replace(F.concat(F.lit(" "), F.lower("_text"), F.lit(" ")), r"\P{L}+", "  "),
            }
        )
        .withColumns(
            {
                "n_words": F.size("_tokens").cast("long"),
                "word_chars": (F.length("_text") - F.get("_classes", F.lit(NAMES.index("space")))).cast("long"),
                "n_symbols": F.get("_classes", F.lit(symbol)),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": repeated_words("_tokens"),
            }
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        )
        .drop("_text", "_tokens", "_lines")
    )


def references(docs: DataFrame, common: int = COMMON_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per language (null is one): ``ref_classes``, ``ref_words``, ``ref_counts`` (one more bin for other words).

    Counted over all documents of at least ``min_words`` words, in one pass: words and the documents' class
    shares, as marked values beside them, are added up before they are shuffled. The first ``common`` words,
    ties by code point, are picked per language; of the shares (whole permilles) the median counts,
    which junk and copies move little.
    """
    text = docs.select(F.col("lang"), F.coalesce("text", F.lit("")).alias("_text"))
    long = with_classes(text.where(F.regexp_count("_text", F.lit(f"[^{SPACE}]+")) >= min_words))
    # A mark holds a character that no word of letters has.
    marks = [
        F.concat(F.lit(f"{i}#"), F.floor(F.get("_classes", F.lit(i)) * 1000 / F.length("_text")).cast("string"))
        for i in range(len(NAMES))
    ]
    values = long.select("lang", F.explode(F.concat(letter_words(), F.array(*marks))).alias("w"))
    counted = staged(values.groupBy("lang", "w").agg(F.count("*").alias("n")))
    marked = F.col("w").contains("#")
    vocabulary = counted.where(~marked)
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "w")
    tops = (
        vocabulary.withColumn("place", F.row_number().over(first))
        .where(F.col("place") <= common)
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("place", "w", "n"))).alias("top"), F.sum("n").alias("common"))
    )
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1001 shares per class and language.
    shares = counted.where(marked).select(
        "lang", "n", *[F.split("w", "#")[i].cast("long").alias(c) for i, c in enumerate(("class", "share"))]
    )
    of_class = Window.partitionBy("lang", "class")
    upto = F.sum("n").over(of_class.orderBy("share").rowsBetween(Window.unboundedPreceding, 0))
    medians = (
        shares.withColumns({"upto": upto, "docs": F.sum("n").over(of_class)})
        .where(F.col("upto") * 2 >= F.col("docs"))
        .groupBy("lang", "class")
        .agg(F.min("share").alias("share"))
    )
    classes = medians.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "share"))), lambda x: x["share"]).alias("ref_classes")
    )
    # Languages as keys: null becomes a marked empty string.
    def keyed(df):
        return df.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_none": F.col("lang").isNull()}).drop("lang")

    joined = keyed(tops).join(keyed(sizes), ["_lang", "_none"]).join(keyed(classes), ["_lang", "_none"])
    return staged(
        joined.select(
            "_lang", "_none", "ref_classes",
            F.col("top.w").alias("ref_words"),
            F.concat(F.col("top.n"), F.array(F.col("total") - F.col("common"))).alias("ref_counts"),
            F.col("total").alias("ref_total"),
        )
    )


def shares(counts: Column) -> Column:
    """Counts as shares of their sum; null if they are all zeros."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return bound(total, lambda n: F.when(n > 0, F.transform(counts, lambda c: c / n)))


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence (base 2) of two arrays of counts; null if either is all zeros."""

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log(p / ((p + q) / 2))).otherwise(0.0)

    parts = F.zip_with(shares(counts), shares(reference), lambda p, q: half(p, q) + half(q, p))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    return F.greatest(total / (2 * log(2)), F.when(total.isNotNull(), F.lit(0.0)))


def judge(
    docs: DataFrame,
    class_limit: float = CLASS_LIMIT,
    word_limit: float = WORD_LIMIT,
    slack: float = SLACK,
    common: int = COMMON_WORDS,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``row`` (all columns of a document), the base columns, ``class_distance``, ``word_distance``, ``kept``.

    One row per document row, repeats too. A null text is an empty one; it has no words, fails the base
    rules and has no distances. A language (null is one) whose long documents hold fewer than
    ``MIN_REFERENCE_WORDS`` words has no reference: its documents pass unless the base rules fail. No
    rows give no rows. Equal counts of common words are ordered by code point. Columns of any
    other name stay inside ``row``.
    """
    ruled = with_rules(docs).withColumns(
        {"_lang": F.coalesce(F.col("row")["lang"], F.lit("")), "_none": F.col("row")["lang"].isNull()}
    )
    refs = references(docs, common, min_words).where(F.col("ref_total") >= MIN_REFERENCE_WORDS)
    # Each word stands between two spaces of its own, so that a common one is counted by what its removal takes away.
    bytes_of = F.octet_length
    times = lambda w: (bytes_of("_spaced") - bytes_of(F.replace("_spaced", w, F.lit("")))).cast("long")
    met = lookup_join(ruled, refs, ["_lang", "_none"]).withColumns(
        {
            "_n": (times(F.lit("  ")) / 2).cast("long") - 1,
            "_bins": F.transform(
                "ref_words", lambda r: (times(F.concat(F.lit(" "), r, F.lit(" "))) / (bytes_of(r) + 2)).cast("long")
            ),
        }
    )
    rest = F.col("_n") - F.aggregate("_bins", F.lit(0).cast("long"), lambda s, x: s + x)
    measured = (
        met.withColumn("_counts", F.concat("_bins", F.array(rest)))
        .withColumns(
            {
                "_class_js": divergence(F.col("_classes"), F.col("ref_classes")),
                "_word_js": divergence(F.col("_counts"), F.col("ref_counts")),
            }
        )
        .withColumns({"class_distance": F.sqrt("_class_js"), "word_distance": F.sqrt("_word_js")})
    )

    def within(js: str, limit: float, bins: Column, n: Column) -> Column:
        chance = slack * (bins - 1) / (8 * log(2) * n)
        return F.coalesce(F.col(js) <= limit * limit + chance, F.lit(True))

    long_enough = F.col("n_words") >= min_words
    passes = within("_class_js", class_limit, F.lit(len(NAMES)), F.col("word_chars")) & within(
        "_word_js", word_limit, F.size("ref_counts"), F.col("_n")
    )
    return measured.withColumn("kept", ~F.col("base_failed") & (~long_enough | passes)).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept",
    )


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns."""
    return judge(docs, **how).where("kept").select("row.*")
