"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _strings() -> T.ArrayType:
    return T.ArrayType(_s)


#: one slide as an extractor delivers it
SLIDE = _struct(
    slide_number=_i, title=_s, content=_strings(), footer=_strings(), images=_strings(),
    image_only=_b, image_count=_i,
)
#: one deck as an extractor delivers it
DECK_EXTRACT = _struct(deck_id=_s, filename=_s, total_slides=_i, slides=T.ArrayType(SLIDE))

#: one leaf shape; nested input adds ``children`` to it, leaf rows a ``path``
_LEAF = dict(
    shape_type=_s, is_title=_b, is_placeholder=_b, has_image=_b, name=_s, text=_s, top=_l,
    run_sizes=T.ArrayType(_i),
)
SHAPE = _struct(**_LEAF)

#: text-model answer for one deck
JUDGED_SLIDE = _struct(
    slide_number=_i, tipo=_s, tipo_retorico=_s, hss_score=_d, hss_feedback=_s, nts_score=_d,
    nts_feedback=_s, tiempo_estimado_segundos=_i,
)
COVERED_UNIT = _struct(
    unidad=_s, temas=T.ArrayType(_struct(tema=_s, subtemas=_strings()))
)
JUDGE_RESPONSE = _struct(
    diapositivas=T.ArrayType(JUDGED_SLIDE), temas_presentacion=T.ArrayType(COVERED_UNIT)
)
GENERATED_SLIDE = _struct(titulo_sugerido=_s, contenido_optimizado=_s, tipo_retorico_aplicado=_s)
RESTRUCTURED_SLIDE = _struct(
    slide_number=_i, preguntas=_strings(), datos_curiosos=_strings(),
    diapositivas_generadas=T.ArrayType(GENERATED_SLIDE),
)
RESTRUCTURE_RESPONSE = T.ArrayType(RESTRUCTURED_SLIDE)

#: stored analysis of one deck version
_METRIC = _struct(valor=_d, estado=_s, feedback=_s)
ANALYSED_SLIDE = _struct(
    slide_number=_i, tipo=_s, tiempo_exposicion=_i, omitida=_b, requiere_reestructuracion=_b,
    score_slide=_d, zona_slide=_s,
    metricas=_struct(icd=_METRIC, wps=_METRIC, hss=_METRIC, nts=_METRIC),
    preguntas=_strings(), datos_curiosos=_strings(),
    reestructuracion=_struct(diapositivas_generadas=T.ArrayType(GENERATED_SLIDE)),
)
ANALYSIS = _struct(
    total_diapositivas=_l,
    score_global_presentacion=_struct(
        score_global=_d, zona_global=_s, scores_metrica=_struct(icd=_d, wps=_d, hss=_d, nts=_d),
        desglose=_struct(icd_pond=_d, wps_pond=_d, hss_pond=_d, nts_pond=_d), pesos=_struct(icd=_d, wps=_d, hss=_d, nts=_d),
    ),
    tiempo_total_exposicion_segundos=_l, tiempo_total_formateado=_s,
    temas_presentacion=T.ArrayType(COVERED_UNIT),
    slides=T.ArrayType(ANALYSED_SLIDE),
)

#: class-time report of one deck version
_SECONDS = T.MapType(_s, _i)
SESSION = _struct(planeado_seg=_i, duracion_seg=_i, tiempos_slide=_SECONDS)
GROUP_REPORT = _struct(
    ultima_diapositiva=_i, tiempo_total_seg=_i, tiempos_por_slide=_SECONDS,
    historial_sesiones=T.MapType(_s, SESSION), planeado_seg=_i,
)
TIME_REPORT = _struct(archivo=_s, grupos=T.MapType(_s, GROUP_REPORT))

#: course tree as authored, and as a plain map of "1.2.1" -> name per unit
SYLLABUS = _struct(
    unidad_aprendizaje=_s,
    unidades=T.ArrayType(_struct(
        numero=_i, nombre=_s,
        temas=T.ArrayType(_struct(
            numero=_i, nombre=_s, subtemas=T.ArrayType(_struct(numero=_i, nombre=_s)),
        )),
    )),
)
SYLLABUS_MAP = T.MapType(_s, T.MapType(_s, _s))

#: catalogue tables
SUBJECTS = _struct(subject_id=_s, name=_s, active=_i)
UNITS = _struct(unit_id=_s, subject_id=_s, name=_s, number=_i)
TOPICS = _struct(topic_id=_s, unit_id=_s, name=_s, number=_i)
SUBTOPICS = _struct(subtopic_id=_s, topic_id=_s, name=_s, number=_i)
DECKS = _struct(deck_id=_s, subject_id=_s, file_name=_s)
VERSIONS = _struct(
    version_id=_s, deck_id=_s, version=_i, analysed=_i, loaded=T.DateType(), total_slides=_i,
    hash=_s, path=_s, thumb_path=_s, pdf_path=_s, score=_d, zone=_s, time_report=_s,
)
ANALYSES = _struct(version_id=_s, slide_number=_i, result=_s)
#: one tick of the class clock
TICKS = _struct(ts=T.TimestampNTZType(), deck_id=_s, group=_s, session=_s, slide=_i)
