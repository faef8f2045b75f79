"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

The model is a table of n-grams with their interpolated probability and their weight as a context,
spread over the cluster by n-gram. Documents are dealt into blocks; a block asks for its distinct
n-grams only, the join with the table answers, and the block's documents are scored from the
answers. A document's perplexity is held against quantiles of the trusted documents' perplexities
in its language. The high one is taken by models that have not seen them: trusted texts are dealt
into folds, and the counts of a fold are subtracted for its own documents. The low one is that of
texts the whole model knows, since a model of fewer texts would set it too high.

Few characters of context cannot tell a word said again from any other. So a word that the next one
repeats is a mark of its own to the model: rare in trusted text, and all there is in a run of one word.
"""

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import blocks_for
from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

ORDER = 4
BEGIN, END, AGAIN = "\x02", "\x03", "\x04"
#: A word that is followed by itself, with the space between.
REPEATED = re.compile(r"(?<!\S)((\S)\S*+)\s++(?=\1(?!\S))")
BLOCK_BYTES = 16 << 20
#: Trusted texts are dealt into so many folds by hash of the text, so that copies share one.
FOLDS = 4
#: Between a language and the fold that its model leaves out; nothing after it for the whole model.
MARK = "\x1f"
#: Perplexities of trusted documents are counted in steps of this logarithm.
BIN = 0.002
LOW, HIGH = 0.001, 0.995
#: How far, in the logarithm of the perplexity, a document may lie beyond the quantiles.
MARGIN = 0.05
#: The mean over n n-grams scatters as 1 / sqrt(n): short texts get so much more room.
SCATTER = 2.0
#: Bytes of text that are worked on at a time: the arrays over them are the memory a task needs.
SLICE = 1 << 18
#: Rows that go back to Spark at a time.
OUT_ROWS = 1000
#: Up to this many possible contexts, n-grams are counted in arrays, else by sorting.
MOST_CELLS = 1 << 22


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each between marks, and how many n-grams each text has.

    Digits count as one character; NUL, which strings in arrays cannot end with, as a space; a word that
    is followed by itself, with the space between, as the mark ``AGAIN`` and its first character: what
    follows that pair in trusted text is the rest of the word, not the pair again.
    """
    texts = [REPEATED.sub(AGAIN + r"\2", t) for t in texts]
    head = BEGIN * (ORDER - 1)
    flat = np.frombuffer("".join([f"{head}{t}{END}" for t in texts]).encode("utf-32-le", "replace"), np.uint32).copy()
    flat[(flat >= 0x30) & (flat <= 0x39)] = 0x30
    flat[flat == 0] = 0x20
    return flat, np.array([len(t) + 1 for t in texts], np.int64)


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams as strings, the index of each n-gram in the texts among them, n-grams a text."""
    flat, runs = codes_of(texts)
    number = np.zeros(0x110000, np.int32)
    number[flat] = 1
    letters = np.flatnonzero(number)
    number[letters] = np.arange(len(letters))
    code, width = number[flat], len(letters)
    ends = np.cumsum(runs + ORDER - 1)
    last = np.arange(int(runs.sum())) + np.repeat(ends - runs - (np.cumsum(runs) - runs), runs)
    key = code[last - (ORDER - 1)].astype(np.int64)
    for k in range(ORDER - 2, -1, -1):
        key = key * width + code[last - k]
        cells = int(key.max(initial=0)) + 1
        if k or cells > MOST_CELLS:
            key = dense(key, cells)
    seen, first, index = distinct(key)
    at = last[first]
    chars = flat[at[:, None] + np.arange(-(ORDER - 1), 1)[None, :]]
    return np.ascontiguousarray(chars).view(f"<U{ORDER}")[:, 0], index, runs


def dense(key: np.ndarray, cells: int) -> np.ndarray:
    """The keys numbered without gaps, in order."""
    if cells > MOST_CELLS:
        return np.unique(key, return_inverse=True)[1]
    present = np.zeros(cells, bool)
    present[key] = True
    return (np.cumsum(present) - 1)[key]


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, a place of each, and each key's index among them."""
    cells = int(key.max(initial=-1)) + 1
    if cells > MOST_CELLS:
        return np.unique(key, return_index=True, return_inverse=True)
    place = np.full(cells, -1, np.int32)
    place[key] = np.arange(len(key))
    seen = np.flatnonzero(place >= 0)
    number = np.zeros(cells, np.int32)
    number[seen] = np.arange(len(seen))
    return seen, place[seen], number[key]


def by_language(langs: list, column):
    """``lang, positions, texts`` in slices of bounded size; null and empty texts are left out.

    A language's slices come in a row.

    ``column`` is an Arrow column of strings, of which only a slice at a time becomes Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    groups: dict[str, list[int]] = {}
    for i, (lang, size) in enumerate(zip(langs, sizes, strict=True)):
        if size:
            groups.setdefault(lang, []).append(i)
    for lang, rows in groups.items():
        start, size = 0, 0
        for k, i in enumerate(rows):
            size += sizes[i]
            if size >= SLICE or k == len(rows) - 1:
                yield lang, rows[start : k + 1], [column[j].as_py() for j in rows[start : k + 1]]
                start, size = k + 1, 0


# ---- the model ----------------------------------------------------------------------------


def count_grams(docs: DataFrame, folds: int = 1) -> DataFrame:
    """``lang, gram, c0, c1, ..`` over all documents of ``lang, text``, a count for each fold of the texts.

    Tasks hand on distinct n-grams only.
    """
    columns = [f"c{f}" for f in range(folds)]

    def run(batches):
        for batch in batches:
            fold = batch.column(2).to_numpy(zero_copy_only=False)
            for lang, rows, texts in by_language(batch.column(0).to_pylist(), batch.column(1)):
                grams, index, runs = grams_of(texts)
                cell = index * folds + np.repeat(fold[rows], runs)
                c = np.bincount(cell, minlength=len(grams) * folds).reshape(-1, folds)
                yield pa.RecordBatch.from_pydict(
                    {"lang": [lang] * len(grams), "gram": grams.tolist(), **{n: c[:, f] for f, n in enumerate(columns)}}
                )

    schema = ", ".join(["lang string", "gram string", *[f"{c} long" for c in columns]])
    counted = docs.select("lang", "text", fold_of("text", folds).alias("fold")).mapInArrow(run, schema)
    return counted.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in columns])


def fold_of(text: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(folds))


def without_each_fold(counts: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``lang, gram, c``: the whole counts, and for each fold those of the others, by marked language."""
    whole = sum((F.col(f"c{f}") for f in range(folds)), F.lit(0))
    of = lambda fold, c: F.struct(F.concat("lang", F.lit(f"{MARK}{fold}")).alias("lang"), "gram", c.alias("c"))
    rows = F.array(of("", whole), *[of(f, whole - F.col(f"c{f}")) for f in range(folds)])
    return counts.select(F.inline(rows)).where("c > 0")


def discounts(counts: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3`` from the counts of counts; sensible constants where these are missing."""
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)

    def d(k: int) -> Column:
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        kept = F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), value))
        return F.when(whole, kept).otherwise(F.lit((0.5, 0.75, 0.9)[k - 1])).alias(f"d{k}")

    return n.select("lang", d(1), d(2), d(3))


def train(trusted: DataFrame) -> DataFrame:
    """``lang, gram, p, weight``: the model of ``lang, text`` rows, see ``model_of``."""
    return model_of(staged(count_grams(trusted)).withColumnRenamed("c0", "c"))


def train_in_folds(trusted: DataFrame) -> DataFrame:
    """The models of ``lang, text`` rows, the whole ones and those without each fold, by marked language."""
    return model_of(without_each_fold(staged(count_grams(trusted, FOLDS))))


def model_of(counts: DataFrame) -> DataFrame:
    """``lang, gram, p, weight`` of ``lang, gram, c``; the levels are written on the way.

    ``p`` is the interpolated probability of a gram's last character after the others (null for what
    occurs as a context only), ``weight`` what a context hands on to the next shorter one. The empty
    gram's ``p`` is that of an unseen character.
    """
    levels = [counts]
    for _ in range(ORDER - 1):  # lower orders count the different characters in front
        shorter = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))
        levels.insert(0, staged(shorter))

    lower = None
    tables, contexts = [], []
    for n, level in enumerate(levels, 1):
        with_d = lookup_join(level, staged(discounts(level)), ["lang"], "inner").withColumns(
            {
                "context": F.expr(f"substring(gram, 1, {n - 1})"),
                "d": F.expr("case c when 1 then d1 when 2 then d2 else d3 end"),
            }
        )
        context = with_d.groupBy("lang", "context").agg(
            F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"), F.count("*").alias("follow")
        )
        held = with_d.join(context, ["lang", "context"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if lower is None:
            unseen = F.col("weight") / (F.col("follow") + 1)
            table = held.select("lang", "gram", (own + unseen).alias("p"))
            tables.append(context.select("lang", F.lit("").alias("gram"), unseen.alias("p")))
        else:
            after = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
            table = held.withColumn("tail", F.expr("substring(gram, 2)")).join(after, ["lang", "tail"]).select(
                "lang", "gram", (own + F.col("weight") * F.col("lower")).alias("p")
            )
            contexts.append(context.select("lang", F.col("context").alias("gram"), "weight"))
        lower = staged(table)
        tables.append(lower)

    return _union(tables).join(_union(contexts), ["lang", "gram"], "full")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def parts_of(gram: str) -> list[str]:
    """All that the probability of a gram may need: its tails and their contexts."""
    return [p for k in range(len(gram)) for p in (gram[k:], gram[k:-1])] + [""]


def log_probability(gram: str, p: dict[str, float], weight: dict[str, float]) -> float:
    """The longest tail with a probability, and the weights of the contexts left behind."""
    held_back = 1.0
    for k in range(len(gram) + 1):
        if gram[k:] in p:
            return math.log(held_back * p[gram[k:]])
        if len(gram) - k > 1:
            held_back *= weight.get(gram[k:-1], 1.0)
    return math.nan


# ---- scoring ------------------------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """``text`` compressed row by row: what the shuffle to the blocks writes is mostly text."""
    at = docs.columns.index("text")
    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema])

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [None if t is None else squeeze(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.set_column(at, "text", pa.array(texts, pa.binary()))

    return docs.mapInArrow(run, schema)


def unpacked(block: pa.Table) -> pa.Table:
    grow = zstandard.ZstdDecompressor().decompress
    texts = pa.array((grow(t.as_py()) if t.is_valid else None for t in block["text"]), pa.binary())
    return block.set_column(block.column_names.index("text"), "text", texts.cast(pa.string()))


ASKED = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("gram", pa.string())])


def _ask(block: pa.Table) -> pa.Table:
    """The distinct grams, and parts of grams, that a block's texts are scored from."""
    block = unpacked(block)
    wanted: dict[str, set] = {}
    number = block["block"][0].as_py()
    keys = zip(block["lang"].to_pylist(), block["trusted"].to_pylist(), strict=True)
    for (lang, trusted), _, texts in by_language(list(keys), block.column("text").combine_chunks()):
        grams = grams_of(texts)[0].tolist()
        wanted.setdefault(f"{lang}{MARK}", set()).update(grams)
        if trusted:  # all of one fold, see judge()
            wanted.setdefault(f"{lang}{MARK}{number % FOLDS}", set()).update(grams)
    out = []
    for lang, grams in wanted.items():
        need = list({p for g in grams for p in parts_of(g)})
        out.append(pa.table([[number] * len(need), [lang] * len(need), need], schema=ASKED))
    return pa.concat_tables(out) if out else ASKED.empty_table()


def _column_by_gram(answers: pa.Table, column: str) -> dict[str, float]:
    known = answers.filter(pc.is_valid(answers[column]))
    return dict(zip(known["gram"].to_pylist(), known[column].to_pylist(), strict=True))


def _scorer(trusted_only: bool):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        fold = block["block"][0].as_py() % FOLDS if block.num_rows else 0
        block = block.drop_columns(["block"])
        block = unpacked(block.filter(block["trusted"]) if trusted_only else block)
        n = np.zeros(block.num_rows, np.int64)
        marks = ["", str(fold)] if trusted_only else [""]
        logs = [np.full(block.num_rows, np.nan) for _ in marks]
        now, models, values = None, [], []
        for lang, rows, texts in by_language(block["lang"].to_pylist(), block["text"].combine_chunks()):
            grams, index, runs = grams_of(texts)
            n[rows] = runs
            if lang != now:  # one language at a time is held
                now, models, values = lang, [], [{} for _ in marks]
                for mark in marks:
                    own = answers.filter(pc.equal(answers["lang"], f"{lang}{MARK}{mark}"))
                    models.append(tuple(_column_by_gram(own, c) for c in ("p", "weight")))
            for log, model, known in zip(logs, models, values, strict=True):
                if model[0]:
                    known.update((g, log_probability(g, *model)) for g in grams.tolist() if g not in known)
                    value = np.array([known[g] for g in grams.tolist()])
                    log[rows] = -np.add.reduceat(value[index], np.cumsum(runs) - runs) / runs
        scored = block.select(["lang"]) if trusted_only else block
        scored = scored.append_column("n_grams", pa.array(n))
        for name, log in zip(("log_perplexity", "held_out"), logs):
            scored = scored.append_column(name, pa.array(log, from_pandas=True))
        return pa.Table.from_batches(scored.combine_chunks().to_batches(OUT_ROWS), scored.schema)

    return run


def trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``trusted``: labelled good and never bad."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg((F.min("quality") >= 1).alias("_good"))
    side = good.where("_good").select(F.col("doc_id").alias("_id"), "_good")
    joined = lookup_join(docs.withColumn("_id", F.col("doc_id")), side, ["_id"], "left")
    return joined.withColumn("trusted", F.coalesce("_good", F.lit(False))).drop("_id", "_good")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    low: float = LOW,
    high: float = HIGH,
    margin: float = MARGIN,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``row`` (the document), ``n_grams, perplexity, least, most, keep`` for every document row.

    Trusted are the documents of ``docs`` that ``labels`` calls good. ``least`` and ``most`` are the
    ``low`` quantile of the trusted perplexities of the language and the ``high`` one of the
    held-out ones, widened by ``margin`` and, for the text's length, by ``SCATTER``. A document
    outside is not kept. A null or empty text is not kept; a language without trusted text, null
    included unless it has some, has no limits, and its documents are kept. One whose trusted texts
    all fall into one fold has no held-out perplexity, and so no ``most``.
    Repeated rows are judged alike; a label that comes twice counts as bad if one of them is. No
    rows give no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    lang = F.coalesce("lang", F.lit(""))
    marked = trust(docs.select(F.struct(*columns).alias("row"), "doc_id", lang.alias("lang"), "text"), labels)
    model = train_in_folds(marked.where("trusted"))

    # The trusted documents of a block are of one fold, so that it asks one held-out model a language.
    blocks = -(-blocks_for(docs, "text", block_bytes) // FOLDS) * FOLDS
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    block = F.when(F.col("trusted"), block - block % FOLDS + fold_of("text")).otherwise(block)
    dealt = marked.select("row", "lang", "text", "trusted", block.alias("block"))
    # Carried once: the text stays out of ``row`` on the way.
    others = [c for c in docs.columns if c != "text"]
    dealt = dealt.select(F.struct(*[F.col(f"row.`{c}`") for c in others]).alias("rest"), "lang", "text", "trusted", "block")
    schema = T.StructType(
        [*[f for f in dealt.schema if f.name != "block"], T.StructField("n_grams", T.LongType()), T.StructField("log_perplexity", T.DoubleType())]
    )
    dealt = packed(dealt)
    asked = dealt.groupBy("block").applyInArrow(_ask, "block long, lang string, gram string")
    answers = asked.join(model, ["lang", "gram"])

    def scored(trusted_only: bool, schema) -> DataFrame:
        return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(trusted_only), schema)

    own = scored(True, "lang string, n_grams long, log_perplexity double, held_out double")
    room = F.lit(SCATTER) / F.sqrt(F.greatest("n_grams", F.lit(1)))
    bounds = F.array(F.col("log_perplexity") + room, F.col("held_out") - room)
    counted = (
        own.select("lang", F.posexplode(bounds).alias("side", "value"))
        .where("value is not null")
        .groupBy("lang", "side", F.floor(F.col("value") / BIN).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    limits = quantiles(counted, low, high).select(
        "lang",
        ((F.col("low_bin") * BIN) - margin).alias("_least"),
        ((F.col("high_bin") + 1) * BIN + margin).alias("_most"),
    )
    # One row for each language with trusted text.
    both = scored(False, schema).join(F.broadcast(limits), "lang", "left").withColumns(
        {"_least": F.col("_least") - room, "_most": F.col("_most") + room}
    )
    inside = F.col("log_perplexity").between(F.col("_least"), F.col("_most"))
    return both.select(
        F.struct(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]).alias("row"),
        "n_grams",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp("_least").alias("least"),
        F.exp("_most").alias("most"),
        F.when(F.col("n_grams") == 0, False).otherwise(F.coalesce(inside, F.lit(True))).alias("keep"),
    )


def quantiles(counted: DataFrame, low: float, high: float) -> DataFrame:
    """``lang, low_bin, high_bin`` of ``lang, side, bin, n``: side 0 has the low one, side 1 the high one.

    A language has at most a few thousand bins, whatever its size.
    """
    grouped = counted.groupBy("lang", "side").agg(
        F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("all")
    )
    share = F.when(F.col("side") == 0, F.lit(low)).otherwise(F.lit(high))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found"))

    def step(a, b):
        seen = a["seen"] + b["n"]
        here = a["found"].isNull() & (seen >= F.col("all") * share)
        return F.struct(seen.alias("seen"), F.when(here, b["bin"]).otherwise(a["found"]).alias("found"))

    found = grouped.withColumn("found", F.aggregate("bins", start, step)["found"])
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("found")))
    return found.groupBy("lang").agg(pick(0).alias("low_bin"), pick(1).alias("high_bin"))


def good_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents, all columns, that are kept."""
    return judge(docs, labels, **how).where("keep").select("row.*")
