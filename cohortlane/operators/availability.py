"""Concept search and how often concepts occur per site."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.text import name_matches
from cohortlane.operators.codes import Codes, frame_of, join_codes


def concept_search(
    concepts: DataFrame, all_of: Iterable[str], none_of: Iterable[str] = ()
) -> DataFrame:
    """Concepts whose lower-cased name matches all patterns and no excluded one."""
    return concepts.where(name_matches("concept_name", all_of, none_of))


def search_topics(
    concepts: DataFrame, searches: Mapping[str, tuple[Iterable[str], Iterable[str]]]
) -> DataFrame:
    """(topic, concept_id) of several searches in one scan of the vocabulary.

    ``searches`` maps a topic to its wanted and its unwanted patterns.
    """
    topics = [
        F.when(name_matches("concept_name", wanted, unwanted), F.lit(topic))
        for topic, (wanted, unwanted) in searches.items()
    ]
    found = F.array_compact(F.array(*topics))
    return concepts.select(F.explode(found).alias("topic"), "concept_id")


def topic_codes(codes_by_topic: Mapping[str, Codes]) -> DataFrame:
    """(topic, concept_id) of several code sets."""
    return reduce(DataFrame.unionByName, [
        frame_of(codes).select(F.lit(topic).alias("topic"), "concept_id")
        for topic, codes in codes_by_topic.items()
    ])


def availability_by_site(events: DataFrame, concept_col: str, topics: Codes) -> DataFrame:
    """Event rows per topic and site: one scan for all topics.

    Events are counted per site and concept before they meet the topics, so
    what is joined and shuffled is as large as the vocabulary in use, and a
    concept with a third of all events is one row a site.
    """
    listed = (
        frame_of(topics).where(F.col("concept_id").isNotNull())
        .select("topic", F.col("concept_id").alias("_code"))
        .distinct()
    )
    counted = events.where(F.col(concept_col).isNotNull()).groupBy("site", concept_col).agg(F.count("*").alias("_rows"))
    matched = join_codes(counted, concept_col, listed, "inner", [topics])
    return matched.groupBy("topic", "site").agg(F.sum("_rows").alias("n"))


def observed_concepts(events: DataFrame, concept_col: str, concepts: DataFrame) -> DataFrame:
    """Those of the given concepts that occur in the events, with their columns.

    Events are reduced to distinct concept ids before anything is joined.
    """
    seen = events.select(F.col(concept_col).alias("concept_id")).distinct()
    return concepts.join(seen, "concept_id", "left_semi")


def observed_concepts_by_topic(
    events: DataFrame,
    concept_col: str,
    concepts: DataFrame,
    searches: Mapping[str, tuple[Iterable[str], Iterable[str]]],
) -> DataFrame:
    """(topic, concept columns) of the found concepts that occur in the events.

    One scan of the events and one of the vocabulary for all topics.
    """
    topics = search_topics(concepts, searches).distinct()
    return observed_concepts(events, concept_col, concepts.join(topics, "concept_id"))
