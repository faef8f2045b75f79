"""String expressions for labels, entity names and model output."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.schemas import ENTITY_TYPES, MOTION_STATES, PHASES


def normalise_label(label: Column) -> Column:
    """Lower case, trimmed, without one leading article."""
    return F.regexp_replace(F.lower(F.trim(label)), "^(a|an|the) ", "")


def json_array_text(raw: Column) -> Column:
    """From the first ``[`` to the last ``]`` of a model answer, code fences removed; empty if none."""
    return F.regexp_extract(F.regexp_replace(raw, "```(json)?", ""), r"(?s)\[.*\]", 0)


def motion_state(value: Column) -> Column:
    upper = F.upper(F.trim(value))
    return F.when(upper.isin(*MOTION_STATES), upper).otherwise("APPROACHING")


def phase(value: Column) -> Column:
    lower = F.lower(F.trim(value))
    return F.when(lower.isin(*PHASES), lower).otherwise("normal")


def entity_type(given: Column, name: Column) -> Column:
    """A given type if it is a known one, else Vehicle; without one, what the name says."""
    by_name = (
        F.when(name.startswith("Vehicle "), "Vehicle")
        .when(name.startswith("Pedestrian"), "Pedestrian")
        .otherwise("Infrastructure")
    )
    return F.when(given.isNull(), by_name).when(given.isin(*ENTITY_TYPES), given).otherwise("Vehicle")


def vehicle_number(name: Column) -> Column:
    """The integer last word of a name of two words or more, else null."""
    words = F.split(F.trim(name), r"\s+")
    return F.when(F.size(words) >= 2, F.element_at(words, -1).try_cast("bigint"))


def entity_is_active(name: Column, kind: Column, active: Column) -> Column:
    """Whether an entity may appear in a frame: vehicles need an active track number."""
    number = vehicle_number(name)
    return (
        F.when(kind != "Vehicle", True)
        .when(active.isNull(), True)
        .otherwise(F.coalesce(F.array_contains(active, number), F.lit(False)))
    )


def triple_sentence(subject: Column, predicate: Column, obj: Column) -> Column:
    return F.concat(F.concat_ws(" ", subject, predicate, obj), F.lit("."))
