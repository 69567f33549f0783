"""The whole analysis of a corpus, and what is stored of it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklens.operators import catalog as C
from decklens.operators import judge as J
from decklens.operators import score as SC
from decklens.session import staged


class Analysis(NamedTuple):
    """``scored``: one row per slide; ``decks``: one per deck; ``documents``: JSON text, one per deck."""

    scored: DataFrame
    decks: DataFrame
    documents: DataFrame


#: texts, and counts of them for the rewriting rules, that no result needs once slides are scored
_TEXTS = ("title", "content", "footer", "slide_text", "body_text", "spoken_words", "body_plain_words")


def analyse_decks(
    slides: DataFrame, responses: DataFrame | None = None, rewriting: DataFrame | None = None
) -> Analysis:
    """Score slides, add the judge's answers and rewriting material, roll up decks.

    ``responses`` and ``rewriting`` are raw answers ``(deck_id, response)``. Scored slides are
    written once to the shared folder; decks and documents are computed from that table.
    """
    judged = J.parse_judge(responses) if responses is not None else None
    scored = SC.score_slides(slides, judged)
    if rewriting is not None:
        scored = J.enrich_slides(scored, J.parse_restructure(rewriting))
    scored = staged(scored.drop(*_TEXTS))
    decks = SC.summarise_decks(scored)
    topics = J.parse_topics(responses) if responses is not None else None
    return Analysis(scored, decks, SC.deck_documents(scored, topics, decks))


def store_analyses(analysis: Analysis, deck_versions: DataFrame, versions: DataFrame, analyses: DataFrame):
    """New ``(versions, analyses)`` tables with the analysis of ``deck_versions(deck_id, version_id)``:
    documents stored, score and zone set, versions marked as analysed."""
    stored = analysis.documents.join(deck_versions.select("deck_id", "version_id"), "deck_id")
    changed = analysis.decks.join(deck_versions, "deck_id").select(
        "version_id", F.col("deck_score").alias("score"), F.col("deck_zone").alias("zone"), F.lit(1).alias("analysed")
    )
    return (
        C.update_versions(versions, changed, "score", "zone", "analysed"),
        C.upsert_analyses(analyses, stored.select("version_id", "result")),
    )
