"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.plans.joins import lookup_join
from lanewise.plans.staging import staged

#: Verdict and rule; a rule is a host and a path. It fits the host's subdomains too.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Words by which hosts are labelled bad for training.
BAD_WORDS = tuple(
    "adult ads bet bets casino cheap escort farm free loan pills poker porn replica sex spam torrent track viagra win xxx".split()
)
#: At most so many different labelled urls, those of the smallest hashes, train the trees.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 17
BLOCK_FROM = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(at > 0, F.translate(host, upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)).otherwise("")


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), ".")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does. Of rules of one length the last counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / F.length(text)
    shares = F.transform(F.array_distinct(chars), share)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


FEATURES = (
    "url_length host_length path_length depth labels hyphens digit_ratio host_entropy path_entropy"
    " parameters longest_label vowel_ratio secure suffix_rate"
).split()


def with_features(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``path``, ``suffix`` and all features but ``suffix_rate``."""
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    labels = F.split(host, r"\.")
    return (
        pages.withColumns({"host": host_of(url), "path": path_of(url)})
        .withColumns(
            {
                "suffix": suffix_of(host),
                "url_length": F.length(url).cast("double"),
                "host_length": F.length("host").cast("double"),
                "path_length": F.length("path").cast("double"),
                "depth": count_of(path, "/[^/]"),
                "labels": F.size(labels).cast("double"),
                "hyphens": count_of(host, "-"),
                "digit_ratio": count_of(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
                "host_entropy": entropy(host),
                "path_entropy": entropy(path),
                "parameters": F.when(url.contains("?"), count_of(url, r"[?&][^=&#]+=")).otherwise(0.0),
                "longest_label": F.array_max(F.transform(labels, F.length)).cast("double"),
                "vowel_ratio": count_of(host, "[aeiou]") / F.greatest(F.length("host"), F.lit(1)),
                "secure": url.startswith("https:").cast("double"),
            }
        )
    )


def is_bad_host(host: Column, words=BAD_WORDS) -> Column:
    """A label, or a part of one between hyphens, is one of ``words``."""
    return F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(w) for w in words]))


class UrlModel:
    """Trees and suffix statistics learnt from ``url, bad`` rows (bad: 0.0 or 1.0).

    Suffix statistics are smoothed shares of bad rows under each suffix, counted over all rows. Only
    the trees are fitted on a sample: of the different urls, those beyond ``rows`` are left out by
    hash. If the sample has one class only, no trees are learnt and every url gets the share of bad
    rows as its score.
    """

    def __init__(self, labelled: DataFrame, rows: int = TRAINING_ROWS):
        known = labelled.where("url is not null").select("url", "bad")
        counted = staged(
            known.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
        )
        n, bad = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
        self.prior = bad / n if n else 0.0
        self.rates = counted.select("suffix", ((F.col("bad") + 10 * self.prior) / (F.col("n") + 10)).alias("suffix_rate"))
        chosen = known.distinct().orderBy(F.xxhash64("url"), "url", "bad").limit(rows)
        sample = staged(with_features(chosen.coalesce(1)))
        n, bad = sample.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
        self.model = None
        if 0 < bad < n:
            self.model = GBTClassifier(
                featuresCol="features", labelCol="bad", maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64
            ).fit(self._vectors(sample).select("features", "bad").coalesce(1))

    def _vectors(self, rows: DataFrame) -> DataFrame:
        rated = lookup_join(rows, self.rates, ["suffix"]).fillna(self.prior, ["suffix_rate"])
        return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rated)

    def score(self, pages: DataFrame) -> DataFrame:
        """``row`` (the input), ``host``, ``path`` and ``score``, the probability of being bad."""
        rows = with_features(pages.select(F.struct("*").alias("row"), F.col("url")))
        if self.model is None:
            return rows.select("row", "host", "path", F.lit(float(self.prior)).alias("score"))
        judged = self.model.transform(self._vectors(rows))
        return judged.select("row", "host", "path", vector_to_array("probability")[1].alias("score"))


def weak_labels(pages: DataFrame, words=BAD_WORDS) -> DataFrame:
    """``url, bad`` rows, labelled by the words of the host."""
    host = host_of(F.col("url"))
    return pages.where("url is not null").select("url", is_bad_host(host, words).cast("double").alias("bad"))


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """``row`` (the input), ``host, path, rule, verdict, score`` for every row.

    A rule's verdict counts; without one, the trees block from a probability of one half. A null url
    or one without a host has nothing to judge: without a rule it is allowed. Repeated rows are
    judged alike; no rows give no rows.
    """
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    judged = F.when((F.col("host") != "") & (F.col("score") >= BLOCK_FROM), "block").otherwise("allow")
    return model.score(pages).select(
        "row", "host", "path", rule.alias("rule"), F.coalesce(ruled, judged).alias("verdict"), "score"
    )
