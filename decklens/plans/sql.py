"""Building blocks of the comparison SQL: the slide table and its metrics as common table
expressions over the supplied tables. Written from the definitions, not from the Spark code, so
that both sides check each other.
"""

from __future__ import annotations

from decklens import constants as K

LET = "a-zA-ZáéíóúüñÁÉÍÓÚÜÑ"


def rnd(x: str, d: int) -> str:
    """Round half-even on the binary value."""
    return f"CAST(format('{{:.{d}f}}', {x}) AS DOUBLE)"


def strings(words) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def plain_words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '\\S+'))"


def words(c: str) -> str:
    return (
        f"len(list_filter(regexp_extract_all({c}, '\\S+'), lambda w: NOT regexp_matches(w, "
        "'^\\d+$|^\\d+[.,/:-]\\d+|^[A-Z]{1,6}\\d+$')))"
    )


def syllables(c: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(regexp_extract_all({c}, '[{LET}]+'), lambda w: greatest(1, "
        "len(regexp_extract_all(regexp_replace(lower(w), 'y$', 'i'), "
        "'[iuüíú][aeiouáéíóúü]|[aeoáéó][iuüíú]|[aeiouáéíóúü]'))))), 0)"
    )


def sentences(c: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(string_split({c}, chr(10)), lambda l: CASE "
        "WHEN regexp_matches(l, '^\\s*([•\\-*]|\\d+[.)])\\s+') THEN 1 "
        "WHEN regexp_matches(l, '[.!?;]') THEN len(list_filter(regexp_split_to_array(l, '[.!?;]'), "
        "lambda p: trim(p) <> '')) "
        f"ELSE CAST(ceil({plain_words('l')} / 20.0) AS INTEGER) END)), 0)"
    )


def lines(c: str) -> str:
    return (
        f"list_filter(list_transform(string_split({c}, chr(10)), "
        "lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '')"
    )


def zone_up_to(x: str, zones, rest: str) -> str:
    body = " ".join(f"WHEN {x} <= {limit} THEN '{label}'" for limit, label in zones)
    return f"CASE WHEN {x} IS NULL THEN NULL {body} ELSE '{rest}' END"


def zone_from(x: str, zones, rest: str) -> str:
    body = " ".join(f"WHEN {x} >= {limit} THEN '{label}'" for limit, label in zones)
    return f"CASE WHEN {x} IS NULL THEN NULL {body} ELSE '{rest}' END"


def tokens(c: str, at_least: int = 1) -> str:
    size = "+" if at_least == 1 else f"{{{at_least},}}"
    return f"regexp_extract_all(lower({c}), '[a-záéíóúüñ]{size}')"


DENSITY_STOP = strings(K.DENSITY_STOP_WORDS)
TITLE_STOP = strings(K.TITLE_STOP_WORDS + K.ACADEMIC_FILLER)
NARRATIVE_STOP = strings(K.NARRATIVE_STOP_WORDS)

#: documents as slides: three non-blank lines each, short first line as title
SLIDES = f"""
doc_lines AS (SELECT doc_id, {lines('text')} AS ls FROM documents),
doc_blocks AS (
  SELECT doc_id AS deck_id, n, ls[3 * n + 1 : 3 * n + 3] AS block
  FROM (SELECT doc_id, ls, unnest(range(0, (len(ls) + 2) // 3)) AS n FROM doc_lines)),
doc_titled AS (
  SELECT *, {plain_words('block[1]')} <= 25 AND length(block[1]) <= 180 AS titled FROM doc_blocks),
slides AS (
  SELECT deck_id, CAST(n + 1 AS INTEGER) AS slide_number,
    CASE WHEN titled THEN block[1] ELSE '' END AS title,
    CASE WHEN titled THEN block[2:] ELSE block END AS content,
    array_to_string(block, chr(10)) AS slide_text,
    array_to_string(CASE WHEN titled THEN block[2:] ELSE block END, ' ') AS body_text
  FROM doc_titled)"""

COUNTS = f"""{SLIDES},
counts AS (
  SELECT *, {words('slide_text')} AS words, CAST({syllables('slide_text')} AS BIGINT) AS syllables,
    greatest(1, {sentences('slide_text')}) AS sentences,
    len({tokens('slide_text')}) AS tokens,
    len(list_filter({tokens('slide_text')}, lambda t: list_contains({DENSITY_STOP}, t))) AS function_words,
    {words('body_text')} AS body_words,
    {plain_words("title || ' ' || body_text")} AS plain_words
  FROM slides)"""

#: metrics that need no judge
METRICS = f"""{COUNTS},
ease AS (
  SELECT *, CASE WHEN words >= 5 THEN syllables / words END AS spw_raw,
    CASE WHEN words >= 5 THEN words / sentences END AS wps_raw
  FROM counts),
eased AS (SELECT *, 206.835 - (CAST(62.3 AS DOUBLE) * spw_raw) - wps_raw AS fsz_raw FROM
  (SELECT * REPLACE (CAST(spw_raw AS DOUBLE) AS spw_raw) FROM ease)),
clamped AS (
  SELECT *, CASE WHEN fsz_raw < 0 THEN 0.0 WHEN fsz_raw > 100 THEN 100.0 ELSE fsz_raw END AS fsz_cl,
    CASE WHEN tokens >= 5 THEN (tokens - function_words) / tokens * 100 END AS dl_raw
  FROM eased),
factors AS (
  SELECT *, {rnd('(CAST(100 AS DOUBLE) - fsz_cl) / 100', 4)} AS cf, {rnd('dl_raw / 100', 4)} AS dln FROM clamped),
icds AS (
  SELECT *, CASE WHEN words >= 15 THEN
      {rnd('(CAST(0.6 AS DOUBLE) * cf + CAST(0.4 AS DOUBLE) * dln) * 10', 2)} END AS icd,
    {rnd('greatest(CAST(0 AS DOUBLE), CAST(10 AS DOUBLE) - greatest(0, body_words - 50) / 15)', 2)} AS wps
  FROM factors),
m AS (
  SELECT *, {zone_up_to('icd', K.ICD_ZONES, K.ICD_ZONE_REST)} AS icd_zone,
    CASE WHEN body_words <= 50 THEN 'optima' WHEN body_words <= 70 THEN 'densa' ELSE 'saturada' END AS wps_zone
  FROM icds)"""


def scored(base: str, judged: str | None = None) -> str:
    """Scores over ``base`` (a chain ending in ``m``); ``judged`` names a table of judged slides."""
    if judged:
        join = f"m LEFT JOIN {judged} j USING (deck_id, slide_number)"
        cols = "j.judged_type, j.hss_judged, j.nts_judged, j.judged_seconds, j.hss_feedback, j.nts_feedback"
    else:
        join, cols = "m", (
            "NULL AS judged_type, CAST(NULL AS DOUBLE) AS hss_judged, CAST(NULL AS DOUBLE) AS nts_judged, "
            "CAST(NULL AS INTEGER) AS judged_seconds, CAST(NULL AS VARCHAR) AS hss_feedback, "
            "CAST(NULL AS VARCHAR) AS nts_feedback"
        )
    w = {k: f"CAST({v} AS DOUBLE)" for k, v in K.WEIGHTS.items()}
    return f"""{base},
typed AS (
  SELECT m.*, {cols}, CASE WHEN plain_words < 5 THEN 'sin_contenido'
      ELSE coalesce(lower(judged_type), 'contenido') END AS slide_type,
    coalesce(judged_seconds, 10) AS seconds
  FROM {join}),
rated AS (
  SELECT *, slide_type = 'contenido' AS is_content,
    CASE WHEN slide_type = 'contenido' THEN coalesce(hss_judged, 5.0) END AS hss,
    CASE WHEN slide_type = 'contenido' THEN coalesce(nts_judged, 10.0) END AS nts
  FROM typed),
normal AS (
  SELECT *,
    CASE WHEN hss IS NULL THEN 'no_aplica' ELSE {zone_from('hss', K.HSS_LABELS, K.HSS_LABEL_REST)} END AS hss_label,
    CASE WHEN nts IS NULL THEN 'no_aplica' ELSE {zone_from('nts', K.NTS_LABELS, K.NTS_LABEL_REST)} END AS nts_label,
    CASE WHEN icd IS NULL THEN 'REVISAR' WHEN icd_zone = 'apropiado' THEN 'BIEN' ELSE 'MEJORAR' END AS icd_status,
    CASE WHEN wps_zone = 'optima' THEN 'BIEN' ELSE 'MEJORAR' END AS wps_status,
    CASE WHEN hss IS NULL THEN 'N/A' WHEN hss > 7.0 THEN 'BIEN' ELSE 'MEJORAR' END AS hss_status,
    CASE WHEN nts IS NULL THEN 'N/A' WHEN nts > 5.0 THEN 'BIEN' ELSE 'MEJORAR' END AS nts_status,
    CASE WHEN icd IS NULL THEN CAST(0 AS DOUBLE)
      WHEN icd < 3.5 THEN greatest(CAST(0 AS DOUBLE), 10 - (CAST(3.5 AS DOUBLE) - icd) * 5)
      WHEN icd > 6.5 THEN greatest(CAST(0 AS DOUBLE), 10 - (icd - CAST(6.5 AS DOUBLE)) * 5)
      ELSE CAST(10 AS DOUBLE) END AS icd_norm,
    wps AS wps_norm, coalesce(hss, CAST(0 AS DOUBLE)) AS hss_norm, coalesce(nts, CAST(0 AS DOUBLE)) AS nts_norm
  FROM rated),
points AS (
  SELECT *, (icd_norm * {w['icd']} + wps_norm * {w['wps']} + hss_norm * {w['hss']} + nts_norm * {w['nts']})
      / ({w['icd']} + {w['wps']} + {w['hss']} + {w['nts']}) AS score_raw
  FROM normal),
scored AS (
  SELECT *, {rnd('score_raw', 2)} AS slide_score,
    {zone_up_to('score_raw', K.SCORE_ZONES, K.SCORE_ZONE_REST)} AS slide_zone,
    'MEJORAR' IN (icd_status, wps_status, hss_status, nts_status) AS needs_recommendation
  FROM points)"""


SCORED = scored(METRICS)


def total(x: str, d: int = 4) -> str:
    """Exact sum of short decimals."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,{d}))) AS DOUBLE)"


def deck_score(base: str, source: str = "scored") -> str:
    """Deck scores over a chain that ends in ``scored``."""
    means = ", ".join(
        f"coalesce({rnd(f'''{total(f'CASE WHEN is_content THEN {k}_norm END')} / nullif(count(*) FILTER (is_content), 0)''', 2)}, 0) AS {k}_score"
        for k in K.WEIGHTS
    )
    weighted = ", ".join(
        f"{rnd(f'{k}_score * CAST({v} AS DOUBLE)', 3)} AS {k}_weighted" for k, v in K.WEIGHTS.items()
    )
    return f"""{base},
deck_means AS (
  SELECT deck_id, count(*) AS total_slides, count(*) FILTER (is_content) AS content_slides,
    CAST(sum(seconds) AS BIGINT) AS total_seconds, {means}
  FROM {source} GROUP BY deck_id),
deck_parts AS (SELECT *, {weighted} FROM deck_means),
deck_sum AS (SELECT *, icd_weighted + wps_weighted + hss_weighted + nts_weighted AS raw FROM deck_parts),
decks_scored AS (
  SELECT * EXCLUDE (raw), {rnd('raw', 2)} AS deck_score,
    {zone_up_to('raw', K.SCORE_ZONES, K.SCORE_ZONE_REST)} AS deck_zone,
    format('{{}}m {{}}s', total_seconds // 60, total_seconds % 60) AS total_time
  FROM deck_sum)"""
