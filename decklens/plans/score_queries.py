"""Queries over slide scores and deck roll-ups, without and with judged slides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from decklens.operators import score as SC
from decklens.plans import sql as S
from decklens.plans import tables as T
from decklens.plans.analysis import analyse_decks
from decklens.plans.registry import query
from decklens.schemas import ANALYSED_SLIDE, ANALYSIS
from decklens.sources import analysis as AN

rnd = S.rnd

_KEYS = ["deck_id", "slide_number"]


def _scored(name: str, columns: list[str]):
    @query(name, f"WITH {S.SCORED} SELECT deck_id, slide_number, {', '.join(columns)} FROM scored")
    def _(spark, sf):
        return SC.score_slides(T.slides(spark, sf)).select(*_KEYS, *columns)


_scored("C19_metric_status", ["icd_status", "wps_status", "hss_status", "nts_status"])
_scored("C20_slide_score", ["icd_norm", "wps_norm", "hss_norm", "nts_norm", "slide_score"])
_scored("C21_score_zone", ["slide_score", "slide_zone"])
_scored("C22_needs_recommendation", ["needs_recommendation"])


@query("D1_deck_icd_summary", f"""
  WITH {S.SCORED},
  d AS (SELECT deck_id, count(*) AS total_slides, {rnd(S.total('icd', 2) + ' / nullif(count(icd), 0)', 2)} AS icd_avg,
    min(icd) AS icd_min, max(icd) AS icd_max, count(icd) AS slides_computed,
    count(*) - count(icd) AS slides_without_text FROM scored GROUP BY deck_id)
  SELECT *, {S.zone_up_to('icd_avg', S.K.ICD_ZONES, S.K.ICD_ZONE_REST)} AS icd_zone FROM d""")
def _(spark, sf):
    return SC.summarise_decks(SC.score_slides(T.slides(spark, sf)), "icd")


@query("D2_deck_wps_summary", f"""
  WITH {S.SCORED}
  SELECT deck_id, count(*) AS total_slides, {rnd(S.total('wps', 2) + ' / count(*)', 2)} AS wps_avg,
    {rnd('CAST(sum(body_words) AS DOUBLE) / count(*)', 1)} AS words_avg,
    count(*) FILTER (wps_zone = 'optima') AS slides_optima, count(*) FILTER (wps_zone = 'densa') AS slides_densa,
    count(*) FILTER (wps_zone = 'saturada') AS slides_saturada
  FROM scored GROUP BY deck_id""")
def _(spark, sf):
    return SC.summarise_decks(SC.score_slides(T.slides(spark, sf)), "wps")


@query("D5_deck_global_score", f"""
  WITH {S.deck_score(S.SCORED)}
  SELECT deck_id, total_slides, content_slides, icd_score, wps_score, hss_score, nts_score,
    icd_weighted, wps_weighted, hss_weighted, nts_weighted, deck_score, deck_zone
  FROM decks_scored""")
def _(spark, sf):
    return SC.summarise_decks(SC.score_slides(T.slides(spark, sf)), "score")


@query("FLAGSHIP_deck_scores_es", f"""
  WITH {S.deck_score(S.SCORED)}
  SELECT d.deck_id, total_slides, content_slides, deck_score, deck_zone, total_seconds, total_time
  FROM decks_scored d JOIN documents o ON o.doc_id = d.deck_id WHERE o.lang = 'es'""")
def _(spark, sf):
    return deck_scores(spark, sf, lang="es")


def deck_scores(spark, sf: str, lang: str | None = None):
    """Score, zone and time of every deck, best first. The language filter reaches the scan."""
    docs = T.documents(spark, sf)
    if lang:
        docs = docs.filter(F.col("lang") == lang)
    slides = T.SL.slides_from_documents(T.spread(docs, "doc_id"))
    decks = SC.summarise_decks(SC.score_slides(slides), "score", "time")
    return decks.select(
        "deck_id", "total_slides", "content_slides", "deck_score", "deck_zone", "total_seconds", "total_time"
    ).orderBy(F.desc("deck_score"), "deck_id")


_DOCUMENT = f"""
  WITH {S.deck_score(S.SCORED)}
  SELECT s.deck_id, s.slide_number,
    d.total_slides, d.deck_score, d.deck_zone, d.icd_score, d.wps_score, d.hss_score, d.nts_score, d.icd_weighted, d.wps_weighted,
    d.hss_weighted, d.nts_weighted, {' || '.join(f"'{w} '" for w in S.K.WEIGHTS.values())} AS weights, d.total_seconds, d.total_time, s.slide_type, s.seconds,
    NOT is_content AS omitted, CASE WHEN is_content THEN slide_score END AS slide_score,
    CASE WHEN is_content THEN slide_zone END AS slide_zone,
    CASE WHEN is_content THEN coalesce(icd, 0) END AS icd, CASE WHEN is_content THEN icd_status END AS icd_status,
    CASE WHEN is_content THEN wps END AS wps
  FROM scored s JOIN decks_scored d USING (deck_id)"""


def _flat(rows):
    return rows.select(
        "deck_id", "slide_number", F.col("total_diapositivas").alias("total_slides"),
        F.col("score_global").alias("deck_score"), F.col("zona_global").alias("deck_zone"),
        *[F.col(f"scores_metrica.{m}").alias(f"{m}_score") for m in S.K.WEIGHTS],
        *[F.col(f"desglose.{m}_pond").alias(f"{m}_weighted") for m in S.K.WEIGHTS],
        F.concat(*[F.concat(F.col(f"pesos.{m}").cast("string"), F.lit(" ")) for m in S.K.WEIGHTS]).alias("weights"),
        F.col("tiempo_total_exposicion_segundos").alias("total_seconds"),
        F.col("tiempo_total_formateado").alias("total_time"), F.col("tipo").alias("slide_type"),
        F.col("tiempo_exposicion").alias("seconds"), F.col("omitida").alias("omitted"),
        F.col("score_slide").alias("slide_score"), F.col("zona_slide").alias("slide_zone"),
        F.col("metricas.icd.valor").alias("icd"), F.col("metricas.icd.estado").alias("icd_status"),
        F.col("metricas.wps.valor").alias("wps"),
    )


def _fields(kind: StructType, **kept) -> StructType:
    """``kind`` with the named fields only; a value of True keeps a field whole."""
    return StructType([StructField(f.name, f.dataType if kept[f.name] is True else kept[f.name]) for f in kind.fields if f.name in kept])


#: what the comparison of documents reads of them
_METRIC = _fields(ANALYSED_SLIDE["metricas"].dataType["icd"].dataType, valor=True, estado=True)
_SHORT = _fields(
    ANALYSIS, total_diapositivas=True, score_global_presentacion=True, tiempo_total_exposicion_segundos=True, tiempo_total_formateado=True,
    slides=ArrayType(_fields(
        ANALYSED_SLIDE, slide_number=True, tipo=True, tiempo_exposicion=True, omitida=True, score_slide=True, zona_slide=True,
        metricas=_fields(ANALYSED_SLIDE["metricas"].dataType, icd=_METRIC, wps=_METRIC),
    )),
)


def _documents(spark, sf):
    return analyse_decks(T.slides(spark, sf)).documents


@query("D7_deck_document", _DOCUMENT)
def _(spark, sf):
    return _flat(AN.stored_slides(_documents(spark, sf), _SHORT))


@query("A17_analysis_json_source", _DOCUMENT)
def _(spark, sf):
    return _flat(AN.stored_slides(_documents(spark, sf)))


@query("A15_analysis_json_sink", _DOCUMENT)
def _(spark, sf):
    """One file per version, written and read back."""
    path = F.concat(F.lit("presentaciones/doc "), F.col("deck_id").cast("string"), F.lit("_v1.pptx")).alias("path")
    back = AN.written_and_read(_documents(spark, sf).select(path, "result"))
    number = F.regexp_extract("path", r"^presentaciones/doc (\d+)_v1$", 1).cast("bigint").alias("deck_id")
    return _flat(AN.stored_slides(back.select(number, "result")))


@query("A16_csv_report_sink", f"""
  WITH {S.METRICS}
  SELECT deck_id, slide_number, CAST(words AS INTEGER) AS words, {rnd('spw_raw', 2)} AS silabas_por_palabra,
    {rnd('wps_raw', 2)} AS palabras_por_frase, {rnd('fsz_raw', 2)} AS fsz, {rnd('dl_raw', 2)} AS dl
  FROM m WHERE words >= 10 AND tokens >= 5""")
def _(spark, sf):
    return AN.csv_report(T.slides(spark, sf))


@query("C23_combined_feedback", f"""
  WITH {S.SCORED}
  SELECT deck_id, slide_number, CASE WHEN icd IS NULL OR icd BETWEEN 3.5 AND 6.5 THEN 'ICD: None | ' ELSE 'ICD: +' END
    || CASE WHEN body_words <= 50 THEN 'WPS: None | ' ELSE 'WPS: + | ' END
    || CASE WHEN is_content THEN 'HSS:  | NTS: ' ELSE 'HSS: None | NTS: None' END AS shape
  FROM scored""")
def _(spark, sf):
    told = SC.combined_feedback(SC.score_slides(T.slides(spark, sf)))
    short = F.regexp_replace("feedback", "ICD: El.*? \\| WPS", "ICD: + | WPS")
    short = F.regexp_replace(short, "ICD: \\+ \\| WPS", "ICD: +WPS")
    short = F.regexp_replace(short, "WPS: Se ha.*? \\| HSS", "WPS: + | HSS")
    return told.select(*_KEYS, short.alias("shape"))
