"""Rule-based slide types.

Features are columns; each rule is a condition over them. Rule ids, types and scores are fixed
values listed with the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens import constants as K
from decklens.functions import numeric as N
from decklens.functions import text as X

_SECTION = rf"(?iu)^(?:Tema|Unidad|Cap[íi]tulo|Módulo)[{X.WS}]+\p{{Nd}}"
# From the first opening to the last closing mark: when any quotation is long enough, this one is.
_QUOTE = "(?s)^[^«\"\u201c]*+[«\"\u201c].{60,}[»\"\u201d]"
_YEAR = r"\((?:19|20)\p{Nd}{2}\)"
_URL = r"(?i)https?://|www\."

FEATURES = (
    "w", "w_title", "bullets", "abw", "yp", "up", "is_quote", "is_section",
    "kt_portada", "kt_indice", "kt_referencias", "kt_cierre",
)


def classifier_features(slides: DataFrame) -> DataFrame:
    """Word, bullet, year and link counts of the body lines, and flags of the title."""
    title = F.coalesce("title", F.lit(""))
    lined = slides.withColumn("_lines", X.content_lines(F.col("content")))
    lines = F.col("_lines")

    def matching(test) -> Column:
        return F.size(F.filter(lines, test))

    def share(count: Column) -> Column:
        return F.coalesce(N.py_round(count / F.nullif(F.size(lines), F.lit(0)), 2), F.lit(0.0))

    counted = lined.withColumn("w", X.plain_word_count(F.array_join(lines, "\n")))
    flags = {
        f"kt_{kind}": title.rlike(X.whole_word(words)) for kind, words in K.TITLE_WORDS.items()
    }
    return counted.withColumns({
        "w_title": X.plain_word_count(title),
        "bullets": matching(X.is_bullet),
        "abw": share(F.col("w")),
        "yp": share(matching(lambda x: x.rlike(_YEAR))),
        "up": share(matching(lambda x: x.rlike(_URL))),
        "is_quote": F.concat_ws(" ", title, X.body_text(F.col("content"))).rlike(_QUOTE),
        "is_section": X.strip(title).rlike(_SECTION),
        **flags,
    }).drop("_lines")


def _rules() -> list[tuple[str, str, float, Column]]:
    """(id, type, score, condition), in the order that breaks ties."""
    c = F.col
    w, wt, b, abw, yp, up = c("w"), c("w_title"), c("bullets"), c("abw"), c("yp"), c("up")
    image = F.coalesce("image_only", F.lit(False))
    return [
        ("R01", "portada", 0.95, image & (w == 0) & (wt == 0)),
        ("R02", "portada", 0.90, (w <= 5) & (b == 0) & (wt <= 8)),
        ("R03", "portada", 0.85, c("kt_portada")),
        ("R03b", "portada", 0.85, c("is_section") & (w <= 15)),
        ("R04", "portada", 0.68, (w <= 20) & (b <= 1) & (abw <= 8) & (wt <= 8)),
        ("R05", "indice", 0.92, c("kt_indice")),
        ("R06a", "indice", 0.95, c("kt_indice") & (b >= 2)),
        ("R06b", "indice", 0.55, ~c("kt_indice") & (b >= 5) & (abw <= 3) & (wt <= 3)),
        ("R07", "referencias", 0.92, c("kt_referencias")),
        ("R08", "referencias", 0.88, yp >= 0.40),
        ("R09", "referencias", 0.82, up >= 0.30),
        ("R10", "referencias", 0.78, (yp >= 0.25) & (up >= 0.15)),
        ("R11", "cierre", 0.92, c("kt_cierre") & (w <= 20)),
        ("R12", "cierre", 0.75, c("kt_cierre") & (w <= 40)),
        ("R15", "cita", 0.85, c("is_quote")),
        ("R16", "sin_contenido", 0.80, (w + wt < K.USEFUL_MIN_WORDS) & ~image & ~c("kt_cierre")),
        ("R17", "contenido", 0.82, (wt >= 12) & (w <= 5)),
        ("R13", "contenido", 0.82, (w >= 25) & (yp < 0.25) & (up < 0.20)),
        ("R14", "contenido", 0.76, (w >= 15) & (b >= 2) & (yp < 0.25)),
        ("R18", "contenido", 0.72, (wt >= 4) & (w >= 8) & (w < 25) & (b == 0) & (yp < 0.25)),
        ("R19", "contenido", 0.70, (b >= 3) & (wt >= 4) & (abw <= 6) & (w >= 8)),
    ]


def classifier_rules(featured: DataFrame) -> DataFrame:
    """Fired rule ids, and the type with the highest score; a tie goes to the type that fired first."""
    rules = _rules()
    fired = featured.withColumns({f"_{rid}": cond for rid, _, _, cond in rules})
    ids = F.array_compact(F.array(*[F.when(F.col(f"_{rid}"), F.lit(rid)) for rid, *_ in rules]))
    per_type: dict[str, list[tuple[int, str, float]]] = {}
    for place, (rid, kind, score, _) in enumerate(rules):
        per_type.setdefault(kind, []).append((place, rid, score))

    def best(kind: str, hits: list[tuple[int, str, float]]) -> Column:
        # greatest and least skip nulls, i.e. rules that did not fire; they need two columns
        score = [F.when(F.col(f"_{rid}"), F.lit(-s)) for _, rid, s in hits]
        place = [F.when(F.col(f"_{rid}"), F.lit(p)) for p, rid, _ in hits]
        pad = F.lit(None)
        any_hit = reduce(lambda x, y: x | y, [F.col(f"_{rid}") for _, rid, _ in hits])
        return F.when(any_hit, F.struct(
            F.least(*score, pad.cast("double")).alias("score"),
            F.least(*place, pad.cast("int")).alias("place"),
            F.lit(kind).alias("kind"),
        ))

    winner = F.array_min(F.array(*[best(kind, hits) for kind, hits in per_type.items()]))
    return (
        fired.withColumns({"rules_fired": ids, "_winner": winner})
        .withColumns({
            "rule_type": F.col("_winner.kind"),
            "rule_confidence": F.coalesce(-F.col("_winner.score"), F.lit(0.0)),
        })
        .drop("_winner", *[f"_{rid}" for rid, *_ in rules])
    )


def classifier_decision(ruled: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Final type, confidence, method and exclusion.

    Below 0.60 the judge decides, where ``judged(deck_id, slide_number, judged_type)`` is given; a
    missing or invalid answer means content. Without a judge the rule's own type stands.
    """
    unsure = F.col("rule_confidence") < K.CONFIDENCE_MEDIUM
    if judged is None:
        df = ruled
        kind = F.coalesce("rule_type", F.lit("contenido"))
        confidence = F.when(F.col("rule_confidence") > 0, F.col("rule_confidence")).otherwise(F.lit(K.CONFIDENCE_FALLBACK))
        method = F.lit("fallback_contenido")
    else:
        df = ruled.join(judged.select("deck_id", "slide_number", "judged_type"), ["deck_id", "slide_number"], "left")
        valid = F.coalesce(F.col("judged_type").isin(*K.JUDGED_TYPES), F.lit(False))
        kind = F.when(valid, F.col("judged_type")).otherwise(F.lit("contenido"))
        confidence = F.when(valid, F.lit(K.CONFIDENCE_JUDGED)).otherwise(F.lit(K.CONFIDENCE_FALLBACK))
        method = F.when(valid, F.lit("llm")).otherwise(F.lit("fallback_contenido"))
    return df.withColumns({
        "type": F.when(unsure, kind).otherwise(F.col("rule_type")),
        "confidence": F.when(unsure, confidence).otherwise(F.col("rule_confidence")),
        "method": F.when(unsure, method).otherwise(F.lit("reglas")),
    }).withColumn("excluded", F.col("type").isin(*K.EXCLUDED_TYPES))


def classifier_callback(
    ruled: DataFrame, judge: Callable[[pa.RecordBatch], Sequence[str | None]], columns: Sequence[str] = ("title", "content"),
    together: int = 64,
) -> DataFrame:
    """The decision with a given function as judge, called for slides below 0.60 only.

    ``judge`` gets ``columns`` of up to ``together`` slides as an Arrow batch and returns their types in order. A type
    that is none of the valid ones, a call that fails, or one that returns another number of
    types means content at 0.50 for the slides it stands for. Gives ``(deck_id, slide_number, rule_type,
    rule_confidence, rules_fired, type, confidence, method, excluded)``; texts of slides that the rules decide do not leave the JVM.
    """
    unsure = F.col("rule_confidence") < K.CONFIDENCE_MEDIUM
    kept = ["deck_id", "slide_number", "rule_type", "rule_confidence", "rules_fired"]
    rows = ruled.select(*kept, F.when(unsure, F.struct(*columns)).alias("_asked"))
    valid, level = frozenset(K.JUDGED_TYPES), (K.CONFIDENCE_JUDGED, K.CONFIDENCE_FALLBACK)

    def answers(asked: pa.RecordBatch) -> list[str | None]:
        try:
            got = list(judge(asked))
        except Exception:  # noqa: BLE001 - whatever the given function raises
            return [None] * asked.num_rows
        return got if len(got) == asked.num_rows else [None] * asked.num_rows

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column("_asked")
            at = pc.indices_nonzero(asked.is_valid()).to_pylist()
            kind, confidence = b.column("rule_type").to_pylist(), b.column("rule_confidence").to_pylist()
            method = ["reglas"] * b.num_rows
            for i in range(0, len(at), together):
                places = at[i : i + together]
                part = pa.RecordBatch.from_struct_array(asked.take(pa.array(places)))
                for place, answer in zip(places, answers(part)):
                    good = answer in valid
                    kind[place], confidence[place] = answer if good else "contenido", level[0] if good else level[1]
                    method[place] = "llm" if good else "fallback_contenido"
            own = b.select(kept)
            found = [pa.array(kind, pa.string()), pa.array(confidence, pa.float64()), pa.array(method, pa.string())]
            yield pa.RecordBatch.from_arrays([*own.columns, *found], [*kept, "type", "confidence", "method"])

    schema = T.StructType([ruled.schema[c] for c in kept]).add("type", "string").add("confidence", "double").add("method", "string")
    return rows.mapInArrow(decided, schema).withColumn("excluded", F.col("type").isin(*K.EXCLUDED_TYPES))


def classify_slides(slides: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    return slides.transform(classifier_features).transform(classifier_rules).transform(classifier_decision, judged)
