"""Exchange with the text-model judge as tables: payloads out, responses in.

No model is called here. Payload rows go to whatever runs the model; its raw answers come back as
``(deck_id, response)`` rows. A payload is written slide by slide from sorted rows, so that no task gathers a deck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from decklens import constants as K
from decklens import schemas as S
from decklens.functions import text as X
from decklens.operators import metrics as M
from decklens.operators import ordered as O
from decklens.operators import similarity as SIM
from decklens.operators.folded import fold_text

_KEYS = ["deck_id", "slide_number"]
_READ = {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"}

# Scores and seconds are read as text, since a model may quote its numbers.
_ANSWERED_SLIDE = T.StructType([
    T.StructField(f.name, T.StringType() if f.name in ("hss_score", "nts_score", "tiempo_estimado_segundos") else f.dataType)
    for f in S.JUDGED_SLIDE.fields
])
_ANSWER = T.StructType([
    T.StructField("diapositivas", T.ArrayType(_ANSWERED_SLIDE)),
    T.StructField("temas_presentacion", T.ArrayType(S.COVERED_UNIT)),
])


# --- evaluation ---------------------------------------------------------------------------------


def payload_slides(slides: DataFrame, max_chars: int | None = K.PAYLOAD_CHARS) -> DataFrame:
    """What the judge is told of each slide: title, body, shared keywords, cosine.

    Bodies longer than ``max_chars`` are shortened with an ellipsis; None keeps them whole.
    """
    body = X.strip_person_names(X.body_text(F.col("content")))
    title = X.strip(F.col("title"))
    told = M.title_overlap(slides).select(
        *_KEYS,
        F.when(title != "", title).otherwise(F.lit(K.NO_TITLE)).alias("titulo"),
        (body if max_chars is None else X.truncate(body, max_chars)).alias("contenido_truncado"),
        "overlap",
    )
    similarity = SIM.previous_similarity(slides)
    return told.join(similarity, _KEYS).select(
        *_KEYS, "titulo", "contenido_truncado", "overlap",
        F.col("sim_average").alias("similitud_coseno"),
    )


def _calls(rows: DataFrame, call_slides: int | None, heads: DataFrame | None = None) -> DataFrame:
    """Entries ``(deck_id, slide_number, entry)`` as JSON arrays ``(deck_id[, call], batch_data, head)``.

    One array per deck; with ``call_slides``, one for each so many slides, ``call`` counting from 0.
    """
    keys = ["deck_id"]
    if call_slides is not None:
        place = O.dense_number(rows, keys, ["slide_number"], F.floor(F.col("slide_number") / 10_000), "_place")
        rows = place.withColumn("call", F.floor((F.col("_place") - 1) / call_slides).cast("int"))
        keys = ["deck_id", "call"]
        if heads is not None:
            heads = rows.select(*keys).distinct().join(heads, "deck_id")
    texts = fold_text(rows, keys, ["slide_number"], heads).filter("n > 0")
    return texts.select(*keys, F.concat(F.lit("["), "text", F.lit("]")).alias("batch_data"), "head")


def judge_payload(
    slides: DataFrame, syllabus: DataFrame | None = None, max_chars: int | None = K.PAYLOAD_CHARS,
    call_slides: int | None = None,
) -> DataFrame:
    """``(deck_id, batch_data, temario)``: one JSON array with all slides of a deck, of any size.

    Shared keywords are a list, or the word ``Ninguno`` when there are none. ``syllabus`` may
    bring ``(deck_id, temario)`` with the course tree as JSON. ``max_chars`` as in
    :func:`payload_slides`. A model that takes only so many slides in one call gets them by ``call_slides``:
    rows are then ``(deck_id, call, ...)``, slides counted in their order.
    """
    # The keyword field is a list or a plain word, so both forms are written and the right one kept.
    shared = F.when(F.size("overlap") > 0, F.to_json("overlap")).otherwise(F.lit(f'"{K.NO_OVERLAP}"'))
    entry = F.concat(
        F.lit("{"),
        F.regexp_extract(
            F.to_json(F.struct("slide_number", "titulo", "contenido_truncado")), r"(?s)^\{(.*)\}$", 1
        ),
        F.lit(',"hss_diagnostico":{"solapamiento_lexico":'), shared,
        F.lit('},"nts_diagnostico":{"similitud_coseno":'), F.col("similitud_coseno").cast("string"),
        F.lit("}}"),
    )
    rows = payload_slides(slides, max_chars).select(*_KEYS, entry.alias("entry"))
    trees = None if syllabus is None else syllabus.select("deck_id", F.col("temario").alias("head"))
    return _calls(rows, call_slides, trees).withColumn(
        "temario", F.lit("[]") if syllabus is None else F.col("head")
    ).drop("head")


def _answer(response: Column, outer: str, schema: T.DataType) -> Column:
    """The JSON between the outermost brackets, control characters blanked, parsed; else null."""
    raw = F.regexp_extract(response, f"(?s){outer}", 0)
    return F.from_json(F.regexp_replace(raw, "[\\n\\r\\t]+", " "), schema, _READ)


def _last_per_slide(entries: DataFrame, fields: list[str]) -> DataFrame:
    """The last entry of each slide number wins.

    (Entries come from the outer form of explode: the plain form makes the optimizer add a size
    filter, which would parse every response again.)
    """
    return (
        entries.filter(F.col("e.slide_number").isNotNull())
        .groupBy("deck_id", F.col("e.slide_number").alias("slide_number"))
        .agg(F.max_by(F.struct(*[F.col(f"e.{f}") for f in fields]), F.col("place")).alias("e"))
        .select(*_KEYS, "e.*")
    )


def parse_judge(responses: DataFrame) -> DataFrame:
    """Judged slides ``(deck_id, slide_number, judged_type, hss_judged, ...)``.

    A response without readable JSON gives no row, so the defaults apply downstream.
    """
    parsed = responses.select("deck_id", _answer(F.col("response"), r"\{.*\}", _ANSWER).alias("a"))
    entries = parsed.select("deck_id", F.posexplode_outer("a.diapositivas").alias("place", "e"))
    fields = [f.name for f in _ANSWERED_SLIDE.fields if f.name != "slide_number"]
    return _last_per_slide(entries, fields).select(
        *_KEYS,
        F.col("tipo").alias("judged_type"),
        F.col("tipo_retorico").alias("rhetoric_type"),
        F.col("hss_score").try_cast("double").alias("hss_judged"),
        "hss_feedback",
        F.col("nts_score").try_cast("double").alias("nts_judged"),
        "nts_feedback",
        F.col("tiempo_estimado_segundos").try_cast("double").try_cast("int").alias("judged_seconds"),
    )


def parse_topics(responses: DataFrame) -> DataFrame:
    """``(deck_id, temas_presentacion)``, one row per deck: the lists of all its answers together.

    An unreadable response gives an empty list; the lists of several answers stand in order of content.
    """
    parsed = _answer(F.col("response"), r"\{.*\}", _ANSWER)["temas_presentacion"]
    lists = responses.select(
        "deck_id",
        F.coalesce(parsed, F.array().cast(T.ArrayType(S.COVERED_UNIT))).alias("_topics"),
    )
    return lists.groupBy("deck_id").agg(F.flatten(F.sort_array(F.collect_list("_topics"))).alias("temas_presentacion"))


# --- syllabus coverage ------------------------------------------------------------------------------


def covered_topics(topics: DataFrame) -> DataFrame:
    """Reported units, topics and subtopics as flat rows (null where a level is absent)."""
    return (
        topics.select("deck_id", F.explode_outer("temas_presentacion").alias("u"))
        .filter(F.col("u").isNotNull())
        .select("deck_id", F.col("u.unidad").alias("unit"), F.explode_outer("u.temas").alias("t"))
        .select("deck_id", "unit", F.col("t.tema").alias("topic"), F.explode_outer("t.subtemas").alias("subtopic"))
    )


def check_coverage(covered: DataFrame, deck_subject: DataFrame, official: DataFrame) -> DataFrame:
    """Mark each reported row ``official`` when exactly these names stand in the deck's course tree.

    ``official`` holds ``(subject_id, unit, topic, subtopic)`` label rows. The stored form keeps
    reported names unchecked; here made-up names can be told apart.
    """
    none = F.lit(None).cast("string")
    topics = [(none, none), (F.col("topic"), none), (F.col("topic"), F.col("subtopic"))]
    levels = F.array(*[F.struct(t.alias("topic"), s.alias("subtopic")) for t, s in topics])
    every = (
        official.select("subject_id", "unit", F.explode(levels).alias("l")).select("subject_id", "unit", "l.*")
        .distinct()
        .withColumn("official", F.lit(True))
    )
    named = covered.join(deck_subject.select("deck_id", "subject_id"), "deck_id")
    c, e = named.alias("c"), every.alias("e")
    same = (
        (F.col("c.subject_id") == F.col("e.subject_id"))
        & (F.col("c.unit") == F.col("e.unit"))
        & F.col("c.topic").eqNullSafe(F.col("e.topic"))
        & F.col("c.subtopic").eqNullSafe(F.col("e.subtopic"))
    )
    return c.join(e, same, "left").select("c.*", F.coalesce("e.official", F.lit(False)).alias("official"))


def unit_coverage(checked: DataFrame, official: DataFrame) -> DataFrame:
    """Share of each unit's official topics that a deck reports."""
    sizes = official.filter("topic IS NOT NULL").groupBy("subject_id", "unit").agg(
        F.count_distinct("topic").alias("topics")
    )
    hit = (
        checked.filter("official AND topic IS NOT NULL")
        .groupBy("deck_id", "subject_id", "unit")
        .agg(F.count_distinct("topic").alias("covered"))
    )
    return hit.join(sizes, ["subject_id", "unit"]).select(
        "deck_id", "subject_id", "unit", "covered", "topics", (F.col("covered") / F.col("topics")).alias("ratio")
    )


# --- restructuring ------------------------------------------------------------------------------------


def restructure_payload(
    scored: DataFrame, with_feedback: bool = True, max_chars: int | None = K.RESTRUCTURE_CHARS,
    call_slides: int | None = None,
) -> DataFrame:
    """``(deck_id, batch_data)``: the content slides to rewrite, one JSON array per deck of any size.

    The feedback to correct is part of the payload; without it the receiver could not tell
    which metric failed. Texts end after ``max_chars`` characters; None keeps them whole.
    ``call_slides`` as in :func:`judge_payload`.
    """
    text = F.col("body_text")
    fields = [
        F.col("slide_number"),
        (text if max_chars is None else F.substring(text, 1, max_chars)).alias("contenido_original"),
        F.col("needs_recommendation").alias("requiere_reestructuracion"),
    ] + ([F.col("feedback").alias("feedback_a_corregir")] if with_feedback else [])
    rows = scored.filter("is_content").select(*_KEYS, F.to_json(F.struct(*fields)).alias("entry"))
    return _calls(rows, call_slides).drop("head")


def parse_restructure(responses: DataFrame) -> DataFrame:
    """Questions, curious facts and generated slides per slide; the last entry of a slide wins."""
    parsed = _answer(F.col("response"), r"\[\s*\{.*\}\s*\]", S.RESTRUCTURE_RESPONSE)
    entries = responses.select("deck_id", F.posexplode_outer(parsed).alias("place", "e"))
    fields = [f.name for f in S.RESTRUCTURED_SLIDE.fields if f.name != "slide_number"]
    return _last_per_slide(entries, fields).select(
        *_KEYS,
        F.col("preguntas").alias("questions"),
        F.col("datos_curiosos").alias("facts"),
        F.col("diapositivas_generadas").alias("generated"),
    )


def enrich_slides(scored: DataFrame, material: DataFrame) -> DataFrame:
    """Add the material to content slides (empty lists when none came); other slides keep null."""
    content = F.col("is_content")
    strings = F.array().cast("array<string>")
    joined = scored.join(material, _KEYS, "left")
    return joined.withColumns({
        "questions": F.when(content, F.coalesce("questions", strings)),
        "facts": F.when(content, F.coalesce("facts", strings)),
        "generated": F.when(content & (F.size("generated") > 0), F.col("generated")),
    })


def recommendations(enriched: DataFrame) -> DataFrame:
    """One row per generated slide with the heading shown above it."""
    n = F.size("generated")
    head, tail = (F.lit(p) for p in K.SPLIT_MESSAGE)
    told = enriched.filter(n > 0).select(
        *_KEYS,
        F.when(n > 1, F.concat(head, n.cast("string"), tail)).otherwise(F.lit(K.REWRITE_MESSAGE)).alias("advice"),
        n.alias("n"),
        F.posexplode("generated").alias("place", "g"),
    )
    label = F.when(F.col("n") > 1, F.concat(F.lit("Diapositiva "), (F.col("place") + 1).cast("string"), F.lit(": "))).otherwise(
        F.lit("Contenido Optimizado: ")
    )
    return told.select(
        *_KEYS, "advice", (F.col("place") + 1).alias("option"),
        F.concat(label, F.coalesce("g.titulo_sugerido", F.lit(""))).alias("heading"),
        F.coalesce("g.contenido_optimizado", F.lit("")).alias("body"),
    )


def support_material(enriched: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Questions and facts of a slide, empty lists when it has none.

    ``at`` may name the slides shown, as ``(deck_id, slide_number)``.
    """
    strings = F.array().cast("array<string>")
    shown = enriched if at is None else enriched.join(at, _KEYS, "left_semi")
    return shown.select(
        *_KEYS, F.coalesce("questions", strings).alias("questions"), F.coalesce("facts", strings).alias("facts")
    )


# --- rules the judge is asked to follow ---------------------------------------------------------------


def estimated_seconds(slide_type: Column, total_words: Column) -> Column:
    """Speaking time of content slides at 130 words a minute plus 20 %; 10 s for other types."""
    spoken = total_words / K.SPEAKING_WORDS_PER_MINUTE * 60 * K.EXPLAINING_MARGIN
    return F.when(slide_type == "contenido", F.rint(spoken).cast("int")).otherwise(
        F.lit(K.SECONDS_DEFAULT)
    )


def restructure_band(scored: DataFrame) -> DataFrame:
    """How many slides a rewrite may give: ``min_slides`` and ``max_slides`` (0, 0 when none is due)."""
    statuses = F.array("icd_status", "wps_status", "hss_status", "nts_status")
    failing = F.size(F.filter(statuses, lambda s: s == "MEJORAR"))
    alone = (failing == 1) & ((F.col("icd_status") == "MEJORAR") | (F.col("hss_status") == "MEJORAR"))
    words = F.col("body_plain_words")
    most = (
        F.when(~F.col("needs_recommendation"), F.lit(0))
        .when(alone | (words <= 75), F.lit(1))
        .when(words <= 120, F.lit(2))
        .otherwise(F.lit(4))
    )
    return scored.withColumn("max_slides", most).withColumn(
        "min_slides", F.least(F.col("max_slides"), F.lit(1))
    )


def check_generated(rows: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Whether generated slides keep the limits they were asked to keep, one flag per limit."""
    t, b = F.col(title), F.col(body)
    parts = F.filter(F.split(b, "[.!?]+"), X.has_text)
    low, high = K.GENERATED_WORDS
    s_low, s_high = K.GENERATED_SENTENCES
    t_low, t_high = K.GENERATED_TITLE_WORDS
    forbidden = "|".join(K.FORBIDDEN_TERMS)
    return rows.withColumns({
        "words_ok": X.plain_word_count(b).between(low, high),
        "sentences_ok": F.size(parts).between(s_low, s_high),
        "sentence_length_ok": ~F.exists(parts, lambda p: X.has_words(p, K.GENERATED_SENTENCE_WORDS + 1)),
        "title_ok": X.plain_word_count(t).between(t_low, t_high),
        "terms_ok": ~F.concat_ws(" ", t, b).rlike(f"(?iu){forbidden}"),
    })
