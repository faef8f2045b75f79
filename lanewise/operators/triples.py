"""Typed scene interactions out of raw model text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.text import (
    entity_is_active,
    entity_type,
    json_array_text,
    motion_state,
    normalise_label,
    phase,
    triple_sentence,
)
from lanewise.plans.joins import lookup_join
from lanewise.schemas import TRIPLE

TICK = ["video_id", "frame_id"]
REQUIRED = ("subject", "predicate", "object")


def label_lookup(labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds ``class_id`` of the normalised ``label``; labels outside the vocabulary are dropped."""
    named = labels.withColumn("label", normalise_label(F.col("label")))
    return lookup_join(named, vocabulary.select("label", "class_id"), ["label"], "inner")


def _elements(texts: DataFrame) -> DataFrame:
    """``items``: the elements of each text's JSON array as JSON strings; null if it does not parse."""
    strict = {"allowSingleQuotes": "false"}
    return texts.withColumn("items", F.from_json(json_array_text(F.col("raw_text")), "array<string>", strict))


def extract_triples(texts: DataFrame) -> DataFrame:
    """One row per well-formed triple: all three parts present and not blank.

    A text that is not a JSON array yields no rows; array elements that are not objects are
    skipped. ``ord`` is the position in the answer.
    """
    strict = {"allowSingleQuotes": "false"}
    found = _elements(texts).select(*texts.columns, F.posexplode_outer("items").alias("ord", "item")).drop("raw_text")
    parsed = found.where(F.ltrim("item").startswith("{")).withColumn("t", F.from_json("item", TRIPLE, strict))
    complete = F.lit(True)
    for part in REQUIRED:
        complete = complete & (F.trim(F.col("t")[part]) != "")
    return parsed.where(complete).select(
        *[c for c in texts.columns if c != "raw_text"], "ord", *[f"t.{name}" for name in TRIPLE.fieldNames()]
    )


def normalise_triples(triples: DataFrame) -> DataFrame:
    """Known motion states and phases, typed entities, the tick's own time."""
    return triples.withColumns(
        {
            "motion_state": motion_state(F.col("motion_state")),
            "phase": phase(F.col("phase")),
            "subject_type": entity_type(F.col("subject_type"), F.col("subject")),
            "object_type": entity_type(F.col("object_type"), F.col("object")),
        }
    )


def _both_active():
    return entity_is_active(F.col("subject"), F.col("subject_type"), F.col("active_ids")) & entity_is_active(
        F.col("object"), F.col("object_type"), F.col("active_ids")
    )


def drop_hallucinated(triples: DataFrame) -> DataFrame:
    """Keeps triples whose vehicles are in ``active_ids``; a null list switches the check off."""
    return triples.where(_both_active())


def triple_drop_counts(texts: DataFrame) -> DataFrame:
    """Per tick: array elements, malformed ones, and triples naming an absent vehicle.

    Triples are summed up per tick before they meet the ticks again.
    """
    listed = _elements(texts).groupBy(*TICK).agg(
        F.sum(F.coalesce(F.size("items"), F.lit(0))).alias("elements"),
        F.count_if(F.col("items").isNotNull()).alias("parsed"),
    )
    kept = (
        normalise_triples(extract_triples(texts))
        .groupBy(*TICK)
        .agg(F.count("*").alias("triples"), F.count_if(~_both_active()).alias("hallucinated"))
    )
    return (
        listed.join(kept, TICK, "left")
        .fillna(0, ["triples", "hallucinated"])
        .withColumn("malformed", F.greatest("elements", F.lit(0)) - F.col("triples"))
        .select(*TICK, "elements", "triples", "malformed", "hallucinated")
    )


def tick_sentences(triples: DataFrame) -> DataFrame:
    """The triples of a tick as sentences in answer order; a tick has one model answer."""
    one = F.struct("ord", triple_sentence(F.col("subject"), F.col("predicate"), F.col("object")).alias("s"))
    return triples.groupBy(*TICK, "ts").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]), " ").alias("text")
    )
