"""Slide scores and deck roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N
from decklens.operators import metrics as M
from decklens.operators.folded import fold_text


def icd_normalised(icd: Column) -> Column:
    """10 inside 3.5..6.5, five points less per unit outside, never below 0; null counts 0."""
    value = F.coalesce(icd, F.lit(-100.0))  # far outside, hence 0
    outside = F.greatest(K.ICD_LOW - value, value - K.ICD_HIGH, F.lit(0.0))
    return F.greatest(F.lit(0.0), 10.0 - outside * K.ICD_PENALTY)


def with_status(df: DataFrame) -> DataFrame:
    """BIEN / MEJORAR per metric. A missing ICD is REVISAR, other missing metrics N/A."""

    def verdict(value: Column, is_good, missing: str) -> Column:
        return N.let(value, lambda v: F.when(v.isNull(), F.lit(missing)).when(
            is_good(v), F.lit("BIEN")
        ).otherwise(F.lit("MEJORAR")))

    rated = df.withColumns({
        "icd_status": verdict(F.col("icd_zone"), lambda z: z == "apropiado", "REVISAR"),
        "wps_status": verdict(F.col("wps_zone"), lambda z: z == "optima", "N/A"),
        "hss_status": verdict(F.col("hss"), lambda v: v > K.HSS_GOOD_ABOVE, "N/A"),
        "nts_status": verdict(F.col("nts"), lambda v: v > K.NTS_GOOD_ABOVE, "N/A"),
    })
    return rated.withColumn(
        "needs_recommendation",
        F.array_contains(F.array("icd_status", "wps_status", "hss_status", "nts_status"), "MEJORAR"),
    )


def with_slide_score(df: DataFrame) -> DataFrame:
    """Weighted 0..10 score; missing metrics count 0. The zone looks at the unrounded score."""
    w = K.WEIGHTS
    total_weight = w["icd"] + w["wps"] + w["hss"] + w["nts"]
    normalised = df.withColumns({
        "icd_norm": icd_normalised(F.col("icd")),
        "wps_norm": F.coalesce("wps", F.lit(0.0)),
        "hss_norm": F.coalesce("hss", F.lit(0.0)),
        "nts_norm": F.coalesce("nts", F.lit(0.0)),
    })
    points = (
        F.col("icd_norm") * w["icd"] + F.col("wps_norm") * w["wps"]
        + F.col("hss_norm") * w["hss"] + F.col("nts_norm") * w["nts"]
    )
    return normalised.withColumn("score_raw", points / total_weight).withColumns({
        "slide_score": N.py_round(F.col("score_raw"), 2),
        "slide_zone": N.label_up_to(F.col("score_raw"), K.SCORE_ZONES, K.SCORE_ZONE_REST),
    })


def combined_feedback(df: DataFrame, missing: str = "None") -> DataFrame:
    """The four feedback texts on one line; an absent one reads ``None``."""
    parts = [("ICD", "icd_feedback"), ("WPS", "wps_feedback"), ("HSS", "hss_text"), ("NTS", "nts_text")]
    return df.withColumn(
        "feedback",
        F.concat_ws(" | ", *[
            F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(missing))) for name, c in parts
        ]),
    )


def score_slides(slides: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Slides with every metric, type, status and score. One stage when there is no judge."""
    return (
        slides.transform(M.local_metrics)
        .transform(M.with_judge, judged)
        .transform(M.with_type)
        .transform(M.with_coherence)
        .transform(M.with_narrative)
        .transform(with_status)
        .transform(with_slide_score)
    )


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def summarise_decks(scored: DataFrame, *parts: str) -> DataFrame:
    """Deck roll-ups, all in one aggregation.

    ``parts`` picks among ``icd, wps, hss, nts, score, time`` (default all). The groups are
    pre-aggregated before the shuffle, so a deck holding a large share of all slides is no
    hot spot.
    """
    parts = parts or ("icd", "wps", "hss", "nts", "score", "time")
    content = F.col("is_content")
    aggs: dict[str, Column] = {}
    finish: list[tuple[str, Column]] = []
    keep = ["deck_id", "total_slides"]

    def mean(name: str, value: Column, n: Column, decimals: int = 4) -> Column:
        aggs[f"_{name}_sum"] = N.exact_sum(value, decimals)
        aggs[f"_{name}_n"] = n
        return N.mean_of(F.col(f"_{name}_sum"), F.col(f"_{name}_n"))

    raw: dict[str, Column] = {}
    if "icd" in parts:
        raw["_icd_mean"] = mean("icd", F.col("icd"), F.count("icd"), 2)
        aggs |= {
            "icd_min": F.min("icd"), "icd_max": F.max("icd"),
            "slides_computed": F.count("icd"), "slides_without_text": _count_if(F.col("icd").isNull()),
        }
        finish += [
            ("icd_avg", N.py_round(F.col("_icd_mean"), 2)),
            ("icd_zone", N.label_up_to(F.col("icd_avg"), K.ICD_ZONES, K.ICD_ZONE_REST)),
        ]
        keep += ["icd_avg", "icd_min", "icd_max", "icd_zone", "slides_computed", "slides_without_text"]
    if "wps" in parts:
        raw["_wps_mean"] = mean("wps", F.col("wps"), F.count("wps"), 2)
        raw["_words_mean"] = mean("words", F.col("body_words").cast("double"), F.count("body_words"), 0)
        aggs |= {
            f"slides_{z}": _count_if(F.col("wps_zone") == z) for z in ("optima", "densa", "saturada")
        }
        finish += [
            ("wps_avg", N.py_round(F.col("_wps_mean"), 2)),
            ("words_avg", N.py_round(F.col("_words_mean"), 1)),
        ]
        keep += ["wps_avg", "words_avg", "slides_optima", "slides_densa", "slides_saturada"]
    for m, labels in (
        ("hss", ("coherente", "debil", "no_coherente")),
        ("nts", ("relacionada", "debil", "desconectada")),
    ):
        if m not in parts:
            continue
        raw[f"_{m}_mean"] = mean(m, F.col(m), F.count(m))
        aggs |= {f"{m}_{x}": _count_if(F.col(f"{m}_label") == x) for x in labels}
        if m == "hss":
            aggs["hss_titled"] = _count_if(content & F.col("has_title"))
            keep.append("hss_titled")
        finish.append((f"{m}_avg", F.coalesce(N.py_round(F.col(f"_{m}_mean"), 2), F.lit(0.0))))
        keep += [f"{m}_avg"] + [f"{m}_{x}" for x in labels]
    if "score" in parts:
        n = _count_if(content)
        aggs["content_slides"] = n
        for m in ("icd", "wps", "hss", "nts"):
            raw[f"_{m}_norm_mean"] = F.coalesce(
                mean(f"{m}_norm", F.when(content, F.col(f"{m}_norm")), n), F.lit(0.0)
            )
            finish += [
                (f"{m}_score", N.py_round(F.col(f"_{m}_norm_mean"), 2)),
                (f"_{m}_points", F.col(f"{m}_score") * K.WEIGHTS[m]),
                (f"{m}_weighted", N.py_round(F.col(f"_{m}_points"), 3)),
            ]
            keep += [f"{m}_score", f"{m}_weighted"]
        finish += [
            ("_score_raw", F.col("icd_weighted") + F.col("wps_weighted") + F.col("hss_weighted") + F.col("nts_weighted")),
            ("deck_score", N.py_round(F.col("_score_raw"), 2)),
            ("deck_zone", N.label_up_to(F.col("_score_raw"), K.SCORE_ZONES, K.SCORE_ZONE_REST)),
        ]
        keep += ["content_slides", "deck_score", "deck_zone"]
    if "time" in parts:
        aggs["total_seconds"] = F.sum("seconds")
        finish.append(("total_time", N.format_seconds_total(F.col("total_seconds"))))
        keep += ["total_seconds", "total_time"]

    out = scored.groupBy("deck_id").agg(
        F.count(F.lit(1)).alias("total_slides"), *[c.alias(k) for k, c in aggs.items()]
    ).withColumns(raw or {"_": F.lit(None)})
    for name, c in finish:
        out = out.withColumn(name, c)
    return out.select(*keep)


def _totals_head() -> Column:
    """A deck's document up to its list of slides, as JSON text without the closing brace."""
    metrics = ("icd", "wps", "hss", "nts")
    head = F.to_json(F.struct(
        F.col("total_slides").alias("total_diapositivas"),
        F.struct(
            F.col("deck_score").alias("score_global"), F.col("deck_zone").alias("zona_global"),
            F.struct(*[F.col(f"{m}_score").alias(m) for m in metrics]).alias("scores_metrica"),
            F.struct(*[F.col(f"{m}_weighted").alias(f"{m}_pond") for m in metrics]).alias("desglose"),
            F.struct(*[F.lit(K.WEIGHTS[m]).alias(m) for m in metrics]).alias("pesos"),
        ).alias("score_global_presentacion"),
        F.col("total_seconds").alias("tiempo_total_exposicion_segundos"),
        F.col("total_time").alias("tiempo_total_formateado"),
        F.coalesce("temas_presentacion", F.array()).alias("temas_presentacion"),
    ), {"ignoreNullFields": "false"})
    return F.substring(head, F.lit(1), F.length(head) - 1)


def deck_documents(
    scored: DataFrame, topics: DataFrame | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """The stored analysis of each deck as JSON text: ``(deck_id, result)``, one row per deck of any size.

    Null fields are kept. Slides are written in order by :func:`decklens.operators.folded.fold_text`,
    the deck's totals travelling ahead of them; no task gathers a deck's slides, and a deck with a large share of
    all slides is spread. ``topics`` may bring ``(deck_id, temas_presentacion)``. Pass ``totals`` (from
    :func:`summarise_decks`) and a ``scored`` table that has been written when both are at hand: the
    texts are then not read a second time for the totals.
    """
    totals = totals if totals is not None else summarise_decks(scored, "score", "time")
    if topics is not None:
        totals = totals.join(topics.select("deck_id", "temas_presentacion"), "deck_id", "left")
    else:
        totals = totals.withColumn("temas_presentacion", F.lit(None).cast(
            "array<struct<unidad:string,temas:array<struct<tema:string,subtemas:array<string>>>>>"
        ))

    def metric(m: str, value: Column, text: str) -> Column:
        return F.struct(
            value.alias("valor"), F.col(f"{m}_status").alias("estado"), F.col(text).alias("feedback")
        ).alias(m)

    content = F.col("is_content")
    empty = F.when(content, F.array().cast("array<string>"))
    extra = {c: F.col(c) if c in scored.columns else empty for c in ("questions", "facts")}
    generated = (
        F.col("generated") if "generated" in scored.columns
        else F.lit(None).cast("array<struct<titulo_sugerido:string,contenido_optimizado:string,tipo_retorico_aplicado:string>>")
    )
    slide = F.struct(
        F.col("slide_number"),
        F.col("slide_type").alias("tipo"),
        F.col("seconds").alias("tiempo_exposicion"),
        (~content).alias("omitida"),
        F.when(content, F.col("needs_recommendation")).alias("requiere_reestructuracion"),
        F.when(content, F.col("slide_score")).alias("score_slide"),
        F.when(content, F.col("slide_zone")).alias("zona_slide"),
        F.when(content, F.struct(
            metric("icd", F.coalesce("icd", F.lit(0.0)), "icd_feedback"),
            metric("wps", F.col("wps"), "wps_feedback"),
            metric("hss", F.col("hss"), "hss_text"),
            metric("nts", F.col("nts"), "nts_text"),
        )).alias("metricas"),
        extra["questions"].alias("preguntas"),
        extra["facts"].alias("datos_curiosos"),
        F.when(content & (F.size(generated) > 0), F.struct(generated.alias("diapositivas_generadas"))).alias("reestructuracion"),
    )
    rows = scored.select("deck_id", "slide_number", F.to_json(slide, {"ignoreNullFields": "false"}).alias("entry"))
    whole = fold_text(rows, ["deck_id"], ["slide_number"], totals.select("deck_id", _totals_head().alias("head")))
    return whole.select("deck_id", F.concat("head", F.lit(',"slides":['), "text", F.lit("]}")).alias("result"))
