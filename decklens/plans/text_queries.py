"""Queries over texts: files and fingerprints, cleaning, counting, slide metrics, deck scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N
from decklens.functions import text as X
from decklens.operators import calibrate as CAL
from decklens.operators import metrics as M
from decklens.operators import score as SC
from decklens.operators import similarity as SIM
from decklens.plans import sql as S
from decklens.plans import tables as T
from decklens.plans.registry import query
from decklens.session import staged
from decklens.sources import files as FI
from decklens.sources import slides as SL

rnd = S.rnd

# --- sources ------------------------------------------------------------------------------------


@query("A1_scan_files")
def _(spark, sf):
    return FI.scan_files(spark, sf, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "length"
    )


@query("A2_size_gate", """
  SELECT doc_id, n_chars / 1048576.0 <= 0.002 AS accepted,
    CASE WHEN n_chars / 1048576.0 > 0.002 THEN 'El archivo es demasiado pesado ('
      || format('{:.2f}', n_chars / 1048576.0) || 'MB). El límite es 0.002MB.' END AS message
  FROM documents""")
def _(spark, sf):
    docs = T.documents(spark, sf).withColumnRenamed("n_chars", "length")
    return FI.size_gate(docs, limit_mb=0.002).select("doc_id", "accepted", "message")


@query("A3_content_fingerprint", "SELECT doc_id, sha256(text) AS hash FROM documents")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", FI.fingerprint(F.col("text")).alias("hash"))


@query("A4_read_slides", f"""
  WITH {S.SLIDES}
  SELECT deck_id, slide_number, title, body_text, len(content) AS blocks FROM slides""")
def _(spark, sf):
    return T.slides(spark, sf).select(
        "deck_id", "slide_number", "title", X.body_text(F.col("content")).alias("body_text"),
        F.size("content").cast("bigint").alias("blocks"),
    )


@query("A8_clean_text", f"""
  SELECT doc_id, array_to_string({S.lines('text')}, ' ' || chr(10) || ' ') AS cleaned FROM documents""")
def _(spark, sf):
    return T.documents(spark, sf).select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("A12_slide_count", f"""
  WITH {S.SLIDES} SELECT deck_id, count(*) AS total_slides FROM slides GROUP BY deck_id""")
def _(spark, sf):
    return SL.slide_count(T.slides(spark, sf))


# --- scalar text ------------------------------------------------------------------------------


def _doc(name: str, column, expr: str):
    """One value per document text."""

    @query(name, f"SELECT doc_id, {expr} AS value FROM documents")
    def _(spark, sf):
        return T.documents(spark, sf).select("doc_id", column(F.col("text")).alias("value"))


def _slide(name: str, column, expr: str, with_: str = S.SLIDES):
    """One value per slide."""

    @query(name, f"WITH {with_} SELECT deck_id, slide_number, {expr} AS value FROM slides")
    def _(spark, sf):
        return T.slides(spark, sf).select("deck_id", "slide_number", column().alias("value"))


_slide("B1_slide_text", lambda: X.slide_text(F.col("title"), F.col("content")), "slide_text")
_doc("B2_word_count", lambda c: X.word_count(c).cast("bigint"), S.words("text"))
_doc("B3_syllable_count", lambda c: X.syllable_count(c).cast("bigint"), f"CAST({S.syllables('text')} AS BIGINT)")

_SPLIT = f"""
  SELECT doc_id, unnest(list_transform(flatten(list_transform({S.lines('text')}, lambda l: CASE
      WHEN regexp_matches(l, '^\\s*([•\\-*]|\\d+[.)])\\s+') THEN [l]
      WHEN regexp_matches(l, '[.!?;]') THEN list_filter(list_transform(
        regexp_split_to_array(l, '[.!?;]'), lambda p: trim(p, ' ' || chr(9))), lambda p: p <> '')
      WHEN {S.plain_words('l')} > 20 THEN list_transform(
        range(0, {S.plain_words('l')}, 20), lambda i: array_to_string(
          regexp_extract_all(l, '\\S+')[i + 1 : i + 20], ' '))
      ELSE [l] END)), lambda s: s)) AS sentence
  FROM documents"""


@query("B4_sentence_split", f"""
  SELECT doc_id, sentence, count(*) AS n FROM ({_SPLIT}) GROUP BY doc_id, sentence""")
def _(spark, sf):
    split = T.documents(spark, sf).select(
        "doc_id", F.explode(X.sentence_split(F.col("text"))).alias("sentence")
    )
    return split.groupBy("doc_id", "sentence").agg(F.count(F.lit(1)).alias("n"))


@query("B4_sentence_count", f"""
  SELECT doc_id, CAST({S.sentences('text')} AS BIGINT) AS value FROM documents""")
def _(spark, sf):
    return T.documents(spark, sf).select(
        "doc_id", X.sentence_count(F.col("text")).cast("bigint").alias("value")
    )


_doc("B5_alpha_tokens", lambda c: F.array_join(X.alpha_tokens(c), " "),
     f"array_to_string({S.tokens('text')}, ' ')")
_doc("B6_title_keywords", lambda c: F.array_join(F.array_sort(X.title_keywords(c)), " "),
     f"array_to_string(list_sort(list_distinct(list_filter({S.tokens('text', 4)}, "
     f"lambda t: NOT list_contains({S.TITLE_STOP}, t)))), ' ')")
_doc("B7_strip_person_names", X.strip_person_names,
     "trim(regexp_replace(text, '[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+"
     "[A-ZÁÉÍÓÚ][a-záéíóú]{2,}', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))")
_slide("B8_joined_text", lambda: X.joined_text(F.col("title"), F.col("content")),
       "array_to_string(list_filter(list_concat([title], content), lambda b: b <> ''), ' ')")
_doc("B11_collapse_whitespace", X.collapse_whitespace, "trim(regexp_replace(text, '\\s+', ' ', 'g'))")
_doc("B13_truncate_ellipsis", X.truncate,
     "CASE WHEN length(text) > 400 THEN substring(text, 1, 400) || '...' ELSE text END")
_doc("B15_longest_words", lambda c: F.array_join(X.longest_words(c), ","),
     "array_to_string(list_transform(list_sort(list_transform(list_distinct(list_filter("
     f"{S.tokens('text', 6)}, lambda t: NOT list_contains({S.DENSITY_STOP}, t))), "
     "lambda w: {'n': -length(w), 'w': w}))[1:3], lambda s: s.w), ',')")
_slide("B16_content_lines", lambda: F.array_join(X.content_lines(F.col("content")), "|"),
       "array_to_string(content, '|')")


@query("B9_term_frequency", f"""
  WITH {S.SLIDES},
  t AS (SELECT deck_id, slide_number, unnest(list_filter({S.tokens('slide_text', 3)},
      lambda t: NOT list_contains({S.NARRATIVE_STOP}, t))) AS term FROM slides),
  c AS (SELECT deck_id, slide_number, term, count(*) AS n FROM t GROUP BY ALL)
  SELECT deck_id, slide_number, term, n, n / CAST(sum(n) OVER (PARTITION BY deck_id, slide_number) AS BIGINT) AS tf
  FROM c""")
def _(spark, sf):
    return SIM.term_frequency(T.slides(spark, sf))


def _cosine_sql(slides: str, source: str, text: str) -> str:
    return f"""
  WITH {slides}
  t AS (SELECT deck_id, slide_number, unnest(list_filter({S.tokens(text, 3)},
      lambda t: NOT list_contains({S.NARRATIVE_STOP}, t))) AS term FROM {source}),
  c AS (SELECT deck_id, slide_number, term, count(*) AS n FROM t GROUP BY ALL),
  norms AS (SELECT deck_id, slide_number, CAST(sum(n * n) AS DOUBLE) AS sq FROM c GROUP BY ALL),
  dots AS (SELECT b.deck_id, b.slide_number, CAST(sum(a.n * b.n) AS DOUBLE) AS dot
    FROM c b JOIN c a ON a.deck_id = b.deck_id AND a.slide_number = b.slide_number - 1 AND a.term = b.term
    GROUP BY ALL),
  sims AS (SELECT s.deck_id, s.slide_number, p.slide_number IS NOT NULL AS has_previous,
      coalesce(dot / (sqrt(na.sq) * sqrt(nb.sq)), 0) AS cosine
    FROM {source} s
    LEFT JOIN {source} p ON p.deck_id = s.deck_id AND p.slide_number = s.slide_number - 1
    LEFT JOIN dots d ON d.deck_id = s.deck_id AND d.slide_number = s.slide_number
    LEFT JOIN norms nb ON nb.deck_id = s.deck_id AND nb.slide_number = s.slide_number
    LEFT JOIN norms na ON na.deck_id = s.deck_id AND na.slide_number = s.slide_number - 1)
  SELECT deck_id, slide_number, CASE WHEN has_previous THEN {rnd('cosine', 4)} END AS sim_previous,
    CASE WHEN has_previous THEN {rnd('cosine', 4)} ELSE 1.0 END AS sim_average
  FROM sims"""


@query("B10_cosine_similarity", _cosine_sql(
    "turns AS (SELECT conv_id AS deck_id, CAST(turn + 1 AS INTEGER) AS slide_number, text FROM conversations),",
    "turns", "text"))
def _(spark, sf):
    return SIM.previous_similarity(T.turns(spark, sf))


@query("C15_previous_similarity", _cosine_sql(S.SLIDES + ",", "slides", "slide_text"))
def _(spark, sf):
    return SIM.previous_similarity(T.slides(spark, sf))


@query("B12_fold_search", """
  SELECT p_partkey, p_name FROM part WHERE contains(lower(strip_accents(p_name)), 'ring')""")
def _(spark, sf):
    parts = T.table(spark, sf, "part").select("p_partkey", "p_name")
    return parts.filter(X.fold_contains(F.col("p_name"), "  RÍNG "))


@query("B12_fold_search_count", """
  SELECT lang, count(*) FILTER (contains(lower(strip_accents(text)), 'etion')) AS k, count(*) AS n FROM documents GROUP BY lang""")
def _(spark, sf):
    hit = F.when(X.fold_contains(F.col("text"), "ÉTIÓN"), 1)
    return T.documents(spark, sf).groupBy("lang").agg(F.count(hit).alias("k"), F.count(F.lit(1)).alias("n"))


@query("B14_format_seconds", """
  WITH e AS (SELECT event_id, CAST(round_even(value, 0) AS BIGINT) AS s, CAST(floor(value) AS BIGINT) AS f FROM events)
  SELECT event_id,
    CASE WHEN s < 60 THEN format('{}s', s) ELSE format('{}m {:02d}s', s // 60, s % 60) END AS panel,
    CASE WHEN s < 60 THEN format('{}s', s) WHEN s % 60 = 0 THEN format('{}m', s // 60)
      ELSE format('{}m{:02d}s', s // 60, s % 60) END AS chart,
    format('{}m {}s', f // 60, f % 60) AS total,
    format('{:02d}:{:02d}', f // 60, f % 60) AS clock
  FROM e""")
def _(spark, sf):
    v = F.col("value")
    return T.table(spark, sf, "events").select(
        "event_id", N.format_seconds(v).alias("panel"), N.format_seconds_chart(v).alias("chart"),
        N.format_seconds_total(F.floor(v)).alias("total"), N.format_clock(F.floor(v)).alias("clock"),
    )


@query("B17_clamp_and_round", f"""
  WITH c AS (SELECT event_id, CASE WHEN value < 1 THEN 1 WHEN value > 90 THEN 90 ELSE value END / 7 AS x FROM events)
  SELECT event_id, {rnd('x', 2)} AS r2, {rnd('x', 3)} AS r3, {rnd('x', 4)} AS r4 FROM c""")
def _(spark, sf):
    x = T.table(spark, sf, "events").select(
        "event_id", (N.clamp(F.col("value"), 1.0, 90.0) / 7).alias("x")
    )
    return x.select("event_id", *[N.py_round(F.col("x"), d).alias(f"r{d}") for d in (2, 3, 4)])


# --- slide metrics ----------------------------------------------------------------------------------


def _metric(name: str, columns: list[str], sql_columns: str, with_: str = S.METRICS, source: str = "m"):
    @query(name, f"WITH {with_} SELECT deck_id, slide_number, {sql_columns} FROM {source}")
    def _(spark, sf):
        return M.local_metrics(T.slides(spark, sf)).select("deck_id", "slide_number", *columns)


_metric("C1_readability", ["syllables_per_word", "words_per_sentence", "fsz", "cf"],
    f"{rnd('spw_raw', 3)} AS syllables_per_word, {rnd('wps_raw', 3)} AS words_per_sentence, "
    f"CASE WHEN fsz_raw IS NOT NULL THEN {rnd('fsz_cl', 2)} END AS fsz, cf")
_metric("C2_readability_zone", ["fsz_zone"],
        f"{S.zone_from('fsz_cl', K.FSZ_ZONES, K.FSZ_ZONE_REST)} AS fsz_zone")
_metric("C3_lexical_density", ["dl", "dln"], f"{rnd('dl_raw', 2)} AS dl, dln")
_metric("C4_icd", ["icd", "cf", "dln"], "icd, cf, dln")
_metric("C5_icd_zone", ["icd", "icd_zone"], "icd, icd_zone")
_metric("C6_icd_feedback", ["icd_feedback"], f"""
    CASE WHEN icd > 6.5 THEN {S.quoted(K.ICD_HIGH_MESSAGE[0])} || icd || {S.quoted(K.ICD_HIGH_MESSAGE[1])}
      || CASE WHEN len(ex) > 0 THEN {S.quoted(K.ICD_HIGH_MESSAGE[2])} || array_to_string(ex, ', ')
        || {S.quoted(K.ICD_HIGH_MESSAGE[3])} ELSE '' END || {S.quoted(K.ICD_HIGH_MESSAGE[4])}
    WHEN icd < 3.5 THEN {S.quoted(K.ICD_LOW_MESSAGE[0])} || icd || {S.quoted(K.ICD_LOW_MESSAGE[1])} END AS icd_feedback""",
    S.METRICS + f""",
    mx AS (SELECT *, list_transform(list_sort(list_transform(list_distinct(list_filter(
      {S.tokens('slide_text', 6)}, lambda t: NOT list_contains({S.DENSITY_STOP}, t))),
      lambda w: {{'n': -length(w), 'w': w}}))[1:3], lambda s: s.w) AS ex FROM m)""", "mx")
_metric("C7_wps", ["body_words", "wps", "wps_excess", "wps_in_range"],
        "CAST(body_words AS INTEGER) AS body_words, wps, CAST(greatest(0, body_words - 50) AS INTEGER) AS wps_excess, "
        "body_words <= 50 AS wps_in_range")
_metric("C8_wps_zone", ["wps_zone"], "wps_zone")
_metric("C9_wps_feedback", ["wps_feedback"], f"""
    CASE WHEN body_words > 50 THEN {S.quoted(K.WPS_MESSAGE[0])} || (body_words - 50)
      || {S.quoted(K.WPS_MESSAGE[1])} END AS wps_feedback""")


@query("C12_title_overlap", f"""
  WITH {S.SLIDES},
  k AS (SELECT deck_id, slide_number, list_sort(list_intersect(
    list_filter({S.tokens('title', 4)}, lambda t: NOT list_contains({S.TITLE_STOP}, t)),
    list_filter({S.tokens("regexp_replace(body_text, '[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+[A-ZÁÉÍÓÚ][a-záéíóú]{2,}\\s+[A-ZÁÉÍÓÚ][a-záéíóú]{2,}', '', 'g')", 4)},
      lambda t: NOT list_contains({S.TITLE_STOP}, t)))) AS o FROM slides)
  SELECT deck_id, slide_number, CASE WHEN len(o) > 0 THEN array_to_string(o, ', ') ELSE 'Ninguno' END AS overlap_text
  FROM k""")
def _(spark, sf):
    return M.title_overlap(T.slides(spark, sf)).select("deck_id", "slide_number", "overlap_text")


@query("C18_icd_normalise", f"WITH {S.SCORED} SELECT deck_id, slide_number, icd, icd_norm FROM scored")
def _(spark, sf):
    m = M.local_metrics(T.slides(spark, sf))
    return m.select("deck_id", "slide_number", "icd", SC.icd_normalised(F.col("icd")).alias("icd_norm"))


# --- calibration over the corpus -----------------------------------------------------------------


def _quartile_sql(rows: str) -> str:
    """Exclusive quartiles of ``rows(metric, v)`` by row number."""
    value = "(a.v * (4 - d) + b.v * d) / CAST(4 AS DOUBLE)"
    return f"""{rows},
  ranked AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) AS r FROM rows),
  sizes AS (SELECT metric, count(*) AS n, min(v) AS lowest, max(v) AS highest FROM rows GROUP BY metric HAVING count(*) >= 2),
  spots AS (SELECT metric, n, lowest, highest, i, greatest(1, least(n - 1, i * (n + 1) // 4)) AS j FROM sizes, range(1, 4) t(i)),
  picked AS (SELECT s.metric, n, lowest, highest, i, (i * (n + 1) - j * 4) AS d, j FROM spots s),
  q AS (SELECT p.metric, n, lowest, highest, i, {value} AS x
    FROM picked p JOIN ranked a ON a.metric = p.metric AND a.r = p.j JOIN ranked b ON b.metric = p.metric AND b.r = p.j + 1)
  SELECT metric, n AS sample_size, {rnd('max(x) FILTER (i = 1)', 2)} AS q1, {rnd('max(x) FILTER (i = 2)', 2)} AS median,
    {rnd('max(x) FILTER (i = 3)', 2)} AS q3, lowest, highest
  FROM q GROUP BY metric, n, lowest, highest"""


@query("D8_word_calibration", "WITH " + _quartile_sql(f"""{S.COUNTS},
  rows AS (SELECT 'palabras' AS metric, CAST(body_words AS DOUBLE) AS v FROM counts WHERE body_words >= 5)"""))
def _(spark, sf):
    return CAL.word_calibration(T.slides(spark, sf))


@query("D9_metric_calibration", "WITH " + _quartile_sql(f"""{S.METRICS},
  base AS (SELECT {rnd('fsz_raw', 2)} AS fsz, {rnd('dl_raw', 2)} AS dl, {rnd('wps_raw', 2)} AS pf, {rnd('spw_raw', 2)} AS sp
    FROM m WHERE words >= 10 AND tokens >= 5),
  rows AS (SELECT 'fsz' AS metric, fsz AS v FROM base UNION ALL SELECT 'dl', dl FROM base
    UNION ALL SELECT 'palabras_por_frase', pf FROM base UNION ALL SELECT 'silabas_por_palabra', sp FROM base)"""))
def _(spark, sf):
    return CAL.metric_calibration(T.slides(spark, sf))


def _kept_counts(spark, sf, values, scale: int):
    """Counts kept over three batches of decks, and then without the decks whose number ends in 0."""
    slides = T.slides(spark, sf)
    state = None
    for batch in range(3):
        added = CAL.value_counts(values(slides.filter(F.col("deck_id") % 3 == batch)), scale)
        state = staged(added if state is None else CAL.merged_counts(state, added))
    gone = CAL.value_counts(values(slides.filter("deck_id % 10 = 0")), scale)
    return CAL.quartiles_of_counts(CAL.merged_counts(state, removed=gone), scale)


@query("D8_word_calibration_kept", "WITH " + _quartile_sql(f"""{S.COUNTS},
  rows AS (SELECT 'palabras' AS metric, CAST(body_words AS DOUBLE) AS v FROM counts WHERE body_words >= 5 AND deck_id % 10 <> 0)"""))
def _(spark, sf):
    return _kept_counts(spark, sf, CAL.word_values, 1)


@query("D9_metric_calibration_kept", "WITH " + _quartile_sql(f"""{S.METRICS},
  base AS (SELECT {rnd('fsz_raw', 2)} AS fsz, {rnd('dl_raw', 2)} AS dl, {rnd('wps_raw', 2)} AS pf, {rnd('spw_raw', 2)} AS sp
    FROM m WHERE words >= 10 AND tokens >= 5 AND deck_id % 10 <> 0),
  rows AS (SELECT 'fsz' AS metric, fsz AS v FROM base UNION ALL SELECT 'dl', dl FROM base
    UNION ALL SELECT 'palabras_por_frase', pf FROM base UNION ALL SELECT 'silabas_por_palabra', sp FROM base)"""))
def _(spark, sf):
    return _kept_counts(spark, sf, CAL.metric_values, 100)
