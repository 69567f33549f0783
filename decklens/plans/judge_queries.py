"""Queries that exchange tables with the judge: payloads, answers, judged scores, rewriting."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklens import constants as K
from decklens.operators import catalog as CT
from decklens.operators import judge as J
from decklens.operators import metrics as M
from decklens.operators import score as SC
from decklens.plans import sql as S
from decklens.plans import tables as T
from decklens.plans import text_queries as TQ
from decklens.plans.analysis import analyse_decks, store_analyses
from decklens.plans.registry import query
from decklens.session import staged
from decklens.sources import analysis as AN

rnd = S.rnd
_KEYS = ["deck_id", "slide_number"]

#: the answers of ``tables.judge_responses`` after parsing, straight from their rule
_JUDGED = """
hashed AS (SELECT deck_id, slide_number, deck_id * 7 + slide_number * 13 AS h FROM slides
  WHERE deck_id % 17 <> 0 AND deck_id % 19 <> 1),
judged AS (
  SELECT deck_id, slide_number, lower(CASE WHEN slide_number % 6 = 5 THEN 'contenido'
      WHEN h % 10 = 0 THEN 'Portada' WHEN h % 10 <> 1 THEN 'contenido' END) AS judged_type,
    CAST(CASE WHEN slide_number % 6 = 5 THEN 1.0 WHEN h % 7 <> 0 THEN (h % 19) / 2.0 END AS DOUBLE) AS hss_judged,
    CASE WHEN slide_number % 6 <> 5 THEN 'Bien dicho' END AS hss_feedback,
    CAST(CASE WHEN slide_number % 6 <> 5 AND h % 5 <> 0 THEN (h % 21) / 2.0 END AS DOUBLE) AS nts_judged,
    CASE WHEN slide_number % 6 <> 5 AND h % 3 <> 0 THEN 'Sigue' END AS nts_feedback,
    CAST(CASE WHEN slide_number % 6 = 5 THEN 99 WHEN h % 4 <> 0 THEN 5 + h % 60 END AS INTEGER) AS judged_seconds
  FROM hashed WHERE slide_number % 9 <> 8 OR slide_number % 6 = 5)"""
_SCORED = S.scored(f"{S.METRICS}, {_JUDGED}", "judged")


def _judged(spark, sf):
    return J.parse_judge(T.judge_responses(spark, sf))


def _scored(spark, sf):
    return SC.score_slides(T.slides(spark, sf), _judged(spark, sf))


def _columns(name: str, columns: list[str]):
    @query(name, f"WITH {_SCORED} SELECT deck_id, slide_number, {', '.join(columns)} FROM scored")
    def _(spark, sf):
        return _scored(spark, sf).select(*_KEYS, *columns)


@query("F2_judge_response_parse", f"""
  WITH {S.SLIDES}, {_JUDGED}
  SELECT deck_id, slide_number, judged_type, hss_judged, hss_feedback, nts_judged, nts_feedback, judged_seconds FROM judged""")
def _(spark, sf):
    return _judged(spark, sf).drop("rhetoric_type").withColumn("judged_type", F.lower("judged_type"))


_columns("F3_judge_join", ["icd", "wps", "hss", "nts", "slide_score", "slide_zone", "needs_recommendation"])
_columns("C10_slide_type_gate", ["slide_type", "is_content"])
_columns("C11_exposure_time", ["seconds"])
_columns("C13_title_coherence_score", ["hss"])
_columns("C14_coherence_label", ["hss", "hss_label"])
_columns("C16_narrative_score", ["nts"])
_columns("C17_narrative_label", ["nts", "nts_label"])


@query("D3_deck_coherence_summary", f"""
  WITH {_SCORED}
  SELECT deck_id, count(*) AS total_slides, coalesce({rnd(S.total('hss') + ' / nullif(count(hss), 0)', 2)}, 0) AS hss_avg,
    count(*) FILTER (is_content AND trim(title) <> '') AS hss_titled,
    count(*) FILTER (hss_label = 'coherente') AS hss_coherente, count(*) FILTER (hss_label = 'debil') AS hss_debil,
    count(*) FILTER (hss_label = 'no_coherente') AS hss_no_coherente
  FROM scored GROUP BY deck_id""")
def _(spark, sf):
    return SC.summarise_decks(_scored(spark, sf), "hss")


@query("D4_deck_narrative_summary", f"""
  WITH {_SCORED}
  SELECT deck_id, count(*) AS total_slides, coalesce({rnd(S.total('nts') + ' / nullif(count(nts), 0)', 2)}, 0) AS nts_avg,
    count(*) FILTER (nts_label = 'relacionada') AS nts_relacionada, count(*) FILTER (nts_label = 'debil') AS nts_debil,
    count(*) FILTER (nts_label = 'desconectada') AS nts_desconectada
  FROM scored GROUP BY deck_id""")
def _(spark, sf):
    return SC.summarise_decks(_scored(spark, sf), "nts")


@query("D5_deck_global_score_judged", f"""
  WITH {S.deck_score(_SCORED)}
  SELECT deck_id, total_slides, content_slides, icd_score, wps_score, hss_score, nts_score,
    icd_weighted, wps_weighted, hss_weighted, nts_weighted, deck_score, deck_zone
  FROM decks_scored""")
def _(spark, sf):
    return SC.summarise_decks(_scored(spark, sf), "score")


@query("D6_deck_time_total", f"""
  WITH {S.deck_score(_SCORED)} SELECT deck_id, total_slides, total_seconds, total_time FROM decks_scored""")
def _(spark, sf):
    return SC.summarise_decks(_scored(spark, sf), "time")


# --- payloads -------------------------------------------------------------------------------------

_PERSON = "[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+[A-ZÁÉÍÓÚ][a-záéíóú]{2,}"
_SIMS = TQ._cosine_sql(S.SLIDES + ",", "slides", "slide_text").rsplit("SELECT deck_id, slide_number, CASE", 1)[0]


_PAYLOAD = f"""
  {_SIMS},
  told AS (SELECT deck_id, slide_number, title, trim(regexp_replace(body_text, '{_PERSON}', '', 'g')) AS body FROM slides),
  k AS (SELECT *, list_sort(list_intersect(
    list_filter({S.tokens('title', 4)}, lambda t: NOT list_contains({S.TITLE_STOP}, t)),
    list_filter({S.tokens('body', 4)}, lambda t: NOT list_contains({S.TITLE_STOP}, t)))) AS o FROM told)
  SELECT k.deck_id, k.slide_number, CASE WHEN title = '' THEN '[SIN TÍTULO]' ELSE title END AS titulo,
    {{body}} AS contenido_truncado,
    CASE WHEN len(o) > 0 THEN '["' || array_to_string(o, '","') || '"]' ELSE 'Ninguno' END AS solapamiento,
    CASE WHEN has_previous THEN {rnd('cosine', 4)} ELSE 1.0 END AS similitud
  FROM k JOIN sims s ON s.deck_id = k.deck_id AND s.slide_number = k.slide_number"""


def _told(payload):
    item = (
        "array<struct<slide_number:int,titulo:string,contenido_truncado:string,"
        "hss_diagnostico:struct<solapamiento_lexico:string>,nts_diagnostico:struct<similitud_coseno:double>>>"
    )
    return payload.select("deck_id", F.explode(F.from_json("batch_data", item)).alias("e")).select(
        "deck_id", "e.slide_number", "e.titulo", "e.contenido_truncado",
        F.col("e.hss_diagnostico.solapamiento_lexico").alias("solapamiento"),
        F.col("e.nts_diagnostico.similitud_coseno").alias("similitud"),
    )


@query("F1_judge_payload", _PAYLOAD.replace("{body}", "CASE WHEN length(body) > 400 THEN substring(body, 1, 400) || '...' ELSE body END"))
def _(spark, sf):
    return _told(J.judge_payload(T.slides(spark, sf)))


@query("F1_judge_payload_whole", _PAYLOAD.replace("{body}", "body"))
def _(spark, sf):
    return _told(J.judge_payload(T.slides(spark, sf), max_chars=None))


def _to_rewrite(text):
    return f"""
  WITH {_SCORED}
  SELECT deck_id, slide_number, {text} AS contenido_original,
    needs_recommendation AS requiere_reestructuracion FROM scored WHERE is_content"""


def _rewritable(spark, sf, **settings):
    payload = J.restructure_payload(SC.combined_feedback(_scored(spark, sf)), **settings)
    item = "array<struct<slide_number:int,contenido_original:string,requiere_reestructuracion:boolean>>"
    return payload.select("deck_id", F.explode(F.from_json("batch_data", item)).alias("e")).select("deck_id", "e.*")


@query("F5_restructure_payload", _to_rewrite("substring(body_text, 1, 1500)"))
def _(spark, sf):
    return _rewritable(spark, sf)


@query("F5_restructure_payload_whole", _to_rewrite("body_text"))
def _(spark, sf):
    return _rewritable(spark, sf, max_chars=None)


# --- rewriting --------------------------------------------------------------------------------------

_MATERIAL = """
material AS (SELECT deck_id, slide_number, '¿Qué enseña la diapositiva ' || slide_number || '?' AS question,
    CASE WHEN slide_number % 4 = 0 THEN 'Dato' ELSE '' END AS fact, CAST((deck_id + slide_number) % 3 AS INTEGER) AS generated
  FROM slides WHERE deck_id % 17 <> 0 AND slide_number % 7 <> 6)"""


def _material(spark, sf):
    return J.parse_restructure(T.restructure_responses(spark, sf))


def _enriched(spark, sf):
    return J.enrich_slides(_scored(spark, sf), _material(spark, sf))


@query("F6_restructure_parse", f"WITH {S.SLIDES}, {_MATERIAL} SELECT * FROM material")
def _(spark, sf):
    return _material(spark, sf).select(
        *_KEYS, F.array_join("questions", "|").alias("question"), F.array_join("facts", "|").alias("fact"),
        F.size("generated").alias("generated"),
    )


@query("F7_enrich_slides", f"""
  WITH {_SCORED}, {_MATERIAL}
  SELECT s.deck_id, s.slide_number, CASE WHEN is_content THEN coalesce(question, '') END AS question,
    CASE WHEN is_content THEN coalesce(fact, '') END AS fact,
    CASE WHEN is_content AND generated > 0 THEN generated END AS generated
  FROM scored s LEFT JOIN material USING (deck_id, slide_number)""")
def _(spark, sf):
    e = _enriched(spark, sf)
    return e.select(
        *_KEYS, F.array_join("questions", "|").alias("question"), F.array_join("facts", "|").alias("fact"),
        F.when(F.col("generated").isNotNull(), F.size("generated")).alias("generated"),
    )


@query("F8_recommendation_label", f"""
  WITH {_SCORED}, {_MATERIAL},
  g AS (SELECT deck_id, slide_number, generated, unnest(range(1, generated + 1)) AS option
    FROM scored JOIN material USING (deck_id, slide_number) WHERE is_content)
  SELECT deck_id, slide_number, CAST(option AS INTEGER) AS option,
    CASE WHEN generated > 1 THEN 'Se recomienda dividir la diapositiva en ' || generated || ' diapositivas:'
      ELSE '{K.REWRITE_MESSAGE}' END AS advice,
    CASE WHEN generated > 1 THEN 'Diapositiva ' || option || ': ' ELSE 'Contenido Optimizado: ' END
      || 'Título ' || slide_number || '.' || option AS heading,
    'Texto de la opción ' || option || '.' AS body
  FROM g""")
def _(spark, sf):
    return J.recommendations(_enriched(spark, sf))


@query("F9_slide_support_material", f"""
  WITH {_SCORED}, {_MATERIAL}
  SELECT s.deck_id, s.slide_number, coalesce(question, '') AS question, coalesce(fact, '') AS fact
  FROM (SELECT * FROM scored WHERE is_content) s LEFT JOIN material USING (deck_id, slide_number)
  UNION ALL SELECT deck_id, slide_number, '', '' FROM scored WHERE NOT is_content""")
def _(spark, sf):
    return J.support_material(_enriched(spark, sf)).select(
        *_KEYS, F.array_join("questions", "|").alias("question"), F.array_join("facts", "|").alias("fact")
    )


# --- prompt-level rules -------------------------------------------------------------------------------


@query("F10_estimated_time_rule", f"""
  WITH {_SCORED}
  SELECT deck_id, slide_number, CASE WHEN slide_type = 'contenido'
    THEN CAST(round_even(CAST(plain_words AS DOUBLE) / 130 * 60 * CAST(1.20 AS DOUBLE), 0) AS INTEGER) ELSE 10 END AS estimated
  FROM scored""")
def _(spark, sf):
    return _scored(spark, sf).select(*_KEYS, J.estimated_seconds(F.col("slide_type"), F.col("spoken_words")).alias("estimated"))


@query("F11_restructure_band", f"""
  WITH {_SCORED},
  f AS (SELECT *, {S.plain_words('body_text')} AS bw, CAST(icd_status = 'MEJORAR' AS INTEGER) + CAST(wps_status = 'MEJORAR' AS INTEGER)
    + CAST(hss_status = 'MEJORAR' AS INTEGER) + CAST(nts_status = 'MEJORAR' AS INTEGER) AS failing FROM scored),
  b AS (SELECT deck_id, slide_number, CASE WHEN failing = 0 THEN 0
    WHEN bw <= 75 OR (failing = 1 AND (icd_status = 'MEJORAR' OR hss_status = 'MEJORAR')) THEN 1
    WHEN bw <= 120 THEN 2 ELSE 4 END AS max_slides FROM f)
  SELECT deck_id, slide_number, max_slides, least(1, max_slides) AS min_slides FROM b""")
def _(spark, sf):
    return J.restructure_band(_scored(spark, sf)).select(*_KEYS, "max_slides", "min_slides")


@query("F12_generated_slide_check", f"""
  WITH {S.SLIDES},
  p AS (SELECT *, list_filter(regexp_split_to_array(body_text, '[.!?]+'), lambda x: trim(x) <> '') AS parts FROM slides)
  SELECT deck_id, slide_number, {S.plain_words('body_text')} BETWEEN 30 AND 50 AS words_ok, len(parts) BETWEEN 3 AND 4 AS sentences_ok,
    len(list_filter(parts, lambda x: {S.plain_words('x')} > 15)) = 0 AS sentence_length_ok,
    {S.plain_words('title')} BETWEEN 3 AND 8 AS title_ok,
    NOT regexp_matches(lower(title || ' ' || body_text), '{'|'.join(K.FORBIDDEN_TERMS)}') AS terms_ok
  FROM p""")
def _(spark, sf):
    rows = M.with_text(T.slides(spark, sf))
    return J.check_generated(rows, "title", "body_text").select(
        *_KEYS, "words_ok", "sentences_ok", "sentence_length_ok", "title_ok", "terms_ok"
    )


# --- syllabus coverage ----------------------------------------------------------------------------------

#: each deck reports the units whose number ends like its own, a real topic, and sometimes a made-up one
_COVERED = """
covered AS (
  SELECT doc_id AS deck_id, CAST(doc_id % 5 AS VARCHAR) AS subject_id,
    'Unidad Temática ' || n_nationkey || '. ' || n_name AS unit, n_nationkey AS nk,
    unnest(CASE WHEN doc_id % 4 = 0 THEN ['BUILDING', 'INVENTADO'] ELSE ['BUILDING'] END) AS seg
  FROM documents JOIN nation ON n_nationkey % 7 = doc_id % 7),
named AS (SELECT deck_id, subject_id, unit, nk || '.' || ascii(seg) || ' ' || seg AS topic, nk, seg FROM covered),
topics AS (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer UNION ALL SELECT n_nationkey, 'REPASO' FROM nation),
checked AS (
  SELECT n.deck_id, n.subject_id, n.unit, n.topic,
    t.c_nationkey IS NOT NULL AND CAST(x.n_regionkey AS VARCHAR) = n.subject_id AS official
  FROM named n JOIN nation x ON x.n_nationkey = n.nk
  LEFT JOIN topics t ON t.c_nationkey = n.nk AND t.c_mktsegment = n.seg)"""


def _coverage(spark, sf):
    docs = T.documents(spark, sf).select(F.col("doc_id").alias("deck_id"))
    nations = T.table(spark, sf, "nation")
    label = F.concat(F.lit("Unidad Temática "), F.col("n_nationkey").cast("string"), F.lit(". "), "n_name")

    def topic(name: str):
        return F.struct(
            F.concat(F.col("n_nationkey").cast("string"), F.lit(f".{ord(name[0])} {name}")).alias("tema"),
            F.array().cast("array<string>").alias("subtemas"),
        )

    topics = F.when(
        F.col("deck_id") % 4 == 0, F.array(topic("BUILDING"), topic("INVENTADO"))
    ).otherwise(F.array(topic("BUILDING")))
    # At most four of the 25 nations fall to one deck, so the collected list is bounded.
    responses = (
        docs.join(nations, F.col("n_nationkey") % 7 == F.col("deck_id") % 7)
        .groupBy("deck_id")
        .agg(F.collect_list(F.struct(label.alias("unidad"), topics.alias("temas"))).alias("temas_presentacion"))
        .select("deck_id", F.to_json(F.struct("temas_presentacion")).alias("response"))
    )
    covered = J.covered_topics(J.parse_topics(responses))
    subject = docs.withColumn("subject_id", (F.col("deck_id") % 5).cast("string"))
    official = staged(CT.syllabus_labels(*T.course_tables(spark, sf)))
    return J.check_coverage(covered, subject, official), official


@query("F4_syllabus_coverage", f"WITH {_COVERED} SELECT deck_id, subject_id, unit, topic, official FROM checked")
def _(spark, sf):
    return _coverage(spark, sf)[0].select("deck_id", "subject_id", "unit", "topic", "official")


@query("F4_unit_coverage", f"""
  WITH {_COVERED},
  sizes AS (SELECT c_nationkey, count(*) AS topics FROM topics GROUP BY c_nationkey)
  SELECT deck_id, subject_id, unit, count(DISTINCT topic) AS covered, topics, count(DISTINCT topic) / topics AS ratio
  FROM checked JOIN sizes ON unit LIKE 'Unidad Temática ' || c_nationkey || '. %' WHERE official
  GROUP BY deck_id, subject_id, unit, topics""")
def _(spark, sf):
    checked, official = _coverage(spark, sf)
    return J.unit_coverage(checked, official)


# --- the whole analysis -----------------------------------------------------------------------------


def _analysis(spark, sf):
    return analyse_decks(T.slides(spark, sf), T.judge_responses(spark, sf), T.restructure_responses(spark, sf))


_WHOLE = f"""
  WITH {S.deck_score(_SCORED)}, {_MATERIAL}
  SELECT s.deck_id, s.slide_number, slide_type, s.seconds, CASE WHEN is_content THEN slide_score END AS slide_score,
    deck_score, d.total_seconds, CASE WHEN is_content THEN coalesce(question, '') END AS question,
    CASE WHEN is_content AND generated > 0 THEN generated END AS generated,
    CASE WHEN is_content THEN coalesce(hss_feedback, '') END AS hss_feedback
  FROM scored s JOIN decks_scored d ON d.deck_id = s.deck_id
  LEFT JOIN material m ON m.deck_id = s.deck_id AND m.slide_number = s.slide_number"""


def _whole(rows):
    generated = F.col("reestructuracion.diapositivas_generadas")
    return rows.select(
        "deck_id", "slide_number", F.col("tipo").alias("slide_type"), F.col("tiempo_exposicion").alias("seconds"),
        F.col("score_slide").alias("slide_score"), F.col("score_global").alias("deck_score"),
        F.col("tiempo_total_exposicion_segundos").alias("total_seconds"), F.array_join("preguntas", "|").alias("question"),
        F.when(generated.isNotNull(), F.size(generated)).alias("generated"), F.col("metricas.hss.feedback").alias("hss_feedback"),
    )


@query("D7_whole_analysis", _WHOLE)
def _(spark, sf):
    return _whole(AN.stored_slides(_analysis(spark, sf).documents))


@query("G13_store_analysis", f"""
  WITH {S.deck_score(_SCORED)}
  SELECT doc_id || '/1' AS version_id, CAST(d.deck_id IS NOT NULL AS INTEGER) AS analysed, deck_score AS score, deck_zone AS zone,
    CASE WHEN d.deck_id IS NOT NULL THEN CAST(total_slides AS BIGINT) END AS stored_slides
  FROM documents LEFT JOIN decks_scored d ON d.deck_id = doc_id""")
def _(spark, sf):
    docs = T.documents(spark, sf)
    none = F.lit(None).cast
    version = F.concat(F.col("doc_id").cast("string"), F.lit("/1"))
    versions = docs.select(
        version.alias("version_id"), F.lit(0).alias("analysed"), none("double").alias("score"), none("string").alias("zone")
    )
    old = versions.select("version_id", F.lit(0).alias("slide_number"), F.lit("{old").alias("result"))
    current = docs.select(F.col("doc_id").alias("deck_id"), version.alias("version_id"))
    new_versions, analyses = store_analyses(_analysis(spark, sf), current, versions, old)
    stored = AN.stored_slides(analyses.drop("slide_number")).groupBy("version_id").agg(F.count(F.lit(1)).alias("stored_slides"))
    return new_versions.join(stored, "version_id", "left")
