"""Queries over class time, and over live sessions as batch and stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklens.operators import catalog as C
from decklens.operators import timing as TM
from decklens.plans import tables as T
from decklens.plans.registry import query
from decklens.session import scratch_folder
from decklens.streaming import live as L

_TICKS = """
ticks AS (SELECT user_id % 7 AS deck_id, event_type AS "group", strftime(ts, '%Y-%m-%d') AS session,
    CAST(user_id % 20 + 1 AS INTEGER) AS slide, ts FROM events),
plans AS (SELECT DISTINCT deck_id, "group", session,
    CAST((deck_id * 3 + day(CAST(session AS DATE))) % 13 AS INTEGER) AS planned FROM ticks),
times AS (SELECT deck_id, "group", slide, CASE WHEN count(*) % 97 = 0 THEN 0 ELSE count(*) END AS seconds, min(ts) AS seen
    FROM ticks GROUP BY ALL),
reference AS (SELECT deck_id, slide, CAST(CASE WHEN slide = 9 THEN 0 ELSE 10 + (slide * 7 + deck_id) % 30 END AS INTEGER) AS recommended
    FROM (SELECT deck_id, CAST(unnest(range(1, 19)) AS INTEGER) AS slide FROM (SELECT DISTINCT deck_id FROM ticks))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY deck_id, "group" ORDER BY session) AS k FROM plans)"""


def _pct(real: str, ref: str) -> str:
    return f"CASE WHEN {ref} IS NULL OR {ref} = 0 THEN 0 ELSE CAST(round_even(({real} - {ref}) / {ref} * 100, 0) AS INTEGER) END"


def _status(pct: str) -> str:
    return (
        f"CASE WHEN {pct} IS NULL THEN 'Sin tiempo real' WHEN {pct} < -20 THEN 'Poco tiempo' "
        f"WHEN {pct} > 20 THEN 'Excedió tiempo' ELSE 'En rango' END"
    )


_DEVS = f"""{_TICKS},
devs AS (SELECT t.*, r.recommended, {_pct('t.seconds', 'r.recommended')} AS pct
    FROM times t JOIN reference r ON r.deck_id = t.deck_id AND r.slide = t.slide)"""


def _tables(spark, sf):
    ticks = T.ticks(spark, sf)
    return T.times(ticks), T.reference_times(ticks)


def _sessions(spark, sf):
    ticks = T.ticks(spark, sf)
    merged = L.merge_sessions(None, L.session_rows(L.slide_dwell(ticks), T.plans(ticks)))
    return merged.select("deck_id", "group", F.col("session_number").cast("string").alias("session"), "planned", "duration")


@query("H1_planned_seconds", f"""
  WITH {_TICKS} SELECT deck_id, "group", arg_max(planned, k) AS planned FROM numbered GROUP BY ALL""")
def _(spark, sf):
    return TM.planned_seconds(_sessions(spark, sf))


@query("H2_real_vs_recommended", f"""
  WITH {_DEVS} SELECT deck_id, "group", slide, seconds, recommended FROM devs""")
def _(spark, sf):
    return TM.deviations(*_tables(spark, sf)).select("deck_id", "group", "slide", "seconds", "recommended")


@query("H2_real_vs_recommended_report", f"""
  WITH {_DEVS} SELECT deck_id, "group", slide, seconds, recommended FROM devs WHERE seconds > 0""")
def _(spark, sf):
    return TM.deviations(*_tables(spark, sf), presented_only=True).select("deck_id", "group", "slide", "seconds", "recommended")


@query("H3_deviation_pct", f'WITH {_DEVS} SELECT deck_id, "group", slide, pct FROM devs')
def _(spark, sf):
    return TM.deviations(*_tables(spark, sf)).select("deck_id", "group", "slide", "pct")


@query("H4_deviation_status", f'WITH {_DEVS} SELECT deck_id, "group", slide, {_status("pct")} AS status FROM devs')
def _(spark, sf):
    return TM.deviations(*_tables(spark, sf)).select("deck_id", "group", "slide", "status")


@query("H5_top_deviations", f"""
  WITH {_DEVS},
  u AS (SELECT *, 'under' AS side, row_number() OVER (PARTITION BY deck_id, "group" ORDER BY pct, seen, slide) AS rank FROM devs WHERE pct < 0),
  o AS (SELECT *, 'over' AS side, row_number() OVER (PARTITION BY deck_id, "group" ORDER BY pct DESC, seen DESC, slide DESC) AS rank FROM devs WHERE pct > 0)
  SELECT deck_id, "group", side, CAST(rank AS INTEGER) AS rank, slide, seconds, recommended, pct
  FROM (SELECT * FROM u UNION ALL SELECT * FROM o) WHERE rank <= 3""")
def _(spark, sf):
    return TM.top_deviations(TM.deviations(*_tables(spark, sf)))


@query("H6_extreme_alert", f"""
  WITH {_DEVS},
  r AS (SELECT *, row_number() OVER (PARTITION BY deck_id, "group" ORDER BY pct, seen, slide) AS lo,
    row_number() OVER (PARTITION BY deck_id, "group" ORDER BY pct DESC, seen DESC, slide DESC) AS hi FROM devs)
  SELECT deck_id, "group", slide, pct, 'Mayor déficit de tiempo en este grupo' AS alert FROM r WHERE lo = 1 AND pct < -15
  UNION ALL SELECT deck_id, "group", slide, pct, 'Mayor exceso de tiempo en este grupo' FROM r WHERE hi = 1 AND pct > 15""")
def _(spark, sf):
    return TM.extreme_alerts(TM.deviations(*_tables(spark, sf)))


@query("H7_group_summary", f"""
  WITH {_TICKS},
  deck AS (SELECT deck_id, CAST(sum(recommended) AS BIGINT) AS recommended_total, max(slide) AS total_slides FROM reference GROUP BY deck_id),
  g AS (SELECT t.deck_id, t."group", CAST(sum(seconds) AS BIGINT) AS real_total,
    count(*) FILTER (seconds > 0 AND r.slide IS NOT NULL) AS presented
    FROM times t LEFT JOIN reference r ON r.deck_id = t.deck_id AND r.slide = t.slide GROUP BY ALL),
  p AS (SELECT deck_id, "group", arg_max(planned, k) AS planned FROM numbered GROUP BY ALL)
  SELECT g.deck_id, g."group", planned, real_total, recommended_total, presented, total_slides,
    {_pct('real_total', 'recommended_total')} AS pct
  FROM g JOIN p ON p.deck_id = g.deck_id AND p."group" = g."group" JOIN deck ON deck.deck_id = g.deck_id""")
def _(spark, sf):
    return TM.group_summary(*_tables(spark, sf), _sessions(spark, sf))


@query("H8_group_report_totals", f"""
  WITH {_TICKS},
  g AS (SELECT t.deck_id, t."group", CAST(sum(seconds) AS BIGINT) AS real_total, CAST(coalesce(sum(recommended), 0) AS BIGINT) AS recommended_total
    FROM times t LEFT JOIN reference r ON r.deck_id = t.deck_id AND r.slide = t.slide GROUP BY ALL)
  SELECT *, {_pct('real_total', 'recommended_total')} AS pct FROM g""")
def _(spark, sf):
    return TM.group_report_totals(*_tables(spark, sf))


@query("H9_group_comparison", f"""
  WITH {_TICKS},
  gr AS (SELECT DISTINCT deck_id, "group" FROM times),
  top AS (SELECT deck_id, slide, max(seconds) AS top FROM times GROUP BY ALL),
  x AS (SELECT gr.deck_id, gr."group", r.slide, t.seconds AS real, r.recommended, greatest(r.recommended, coalesce(top.top, 0), 1) AS longest,
    CASE WHEN t.seconds IS NOT NULL THEN {_pct('t.seconds', 'r.recommended')} END AS pct
    FROM gr JOIN reference r ON r.deck_id = gr.deck_id
    LEFT JOIN times t ON t.deck_id = gr.deck_id AND t."group" = gr."group" AND t.slide = r.slide
    LEFT JOIN top ON top.deck_id = gr.deck_id AND top.slide = r.slide)
  SELECT deck_id, "group", slide, real, recommended, pct, {_status('pct')} AS status,
    coalesce(real / longest, 0) AS real_share, recommended / longest AS reference_share FROM x""")
def _(spark, sf):
    return TM.group_comparison(*_tables(spark, sf))


_TREND = f"""{_TICKS},
trend AS (SELECT g.deck_id, g."group", n.slide, coalesce(t.seconds, 0) AS real, coalesce(r.recommended, 0) AS recommended
  FROM (SELECT DISTINCT deck_id, "group" FROM times) g, (SELECT CAST(unnest(range(1, 21)) AS INTEGER) AS slide) n
  LEFT JOIN times t ON t.deck_id = g.deck_id AND t."group" = g."group" AND t.slide = n.slide
  LEFT JOIN reference r ON r.deck_id = g.deck_id AND r.slide = n.slide)"""


def _trend(spark, sf):
    times, reference = _tables(spark, sf)
    return TM.dense_trend(times, reference, times.select("deck_id").distinct().withColumn("total_slides", F.lit(20)))


@query("H10_dense_trend", f"WITH {_TREND} SELECT * FROM trend")
def _(spark, sf):
    return _trend(spark, sf)


@query("H10_trend_axis", f"""
  WITH {_TREND},
  top AS (SELECT deck_id, "group", greatest(max(real), max(recommended), 1) AS y_max FROM trend GROUP BY ALL)
  SELECT *, array_to_string(list_sort(list_distinct(list_transform(range(0, 5), lambda k: CAST(round_even(y_max * k / 4, 0) AS INTEGER)))), ',') AS ticks
  FROM top""")
def _(spark, sf):
    return TM.trend_axis(_trend(spark, sf)).withColumn("ticks", F.array_join("ticks", ","))


# --- live sessions ------------------------------------------------------------------------------------

_DWELL = f"""
  WITH {_TICKS} SELECT deck_id, "group", session, slide, count(*) AS seconds FROM ticks GROUP BY ALL"""


@query("I1_slide_dwell_batch", _DWELL)
def _(spark, sf):
    return L.slide_dwell(T.ticks(spark, sf)).drop("first_ts", "last_ts")


def _tick_stream(spark, sf):
    schema = T.table(spark, sf, "events").schema
    return T.as_ticks(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


@query("I1_slide_dwell_stream", _DWELL)
def _(spark, sf):
    folder = scratch_folder(spark)
    L.stream_slide_dwell(_tick_stream(spark, sf), folder, f"{folder}/checkpoint").awaitTermination()
    return L.read_slide_dwell(spark, folder).drop("first_ts", "last_ts")


@query("I1_slide_dwell_reconciled", _DWELL)
def _(spark, sf):
    """Counts of a stream by day, corrected by the log of all ticks."""
    folder = scratch_folder(spark)
    L.stream_slide_dwell(_tick_stream(spark, sf), folder, f"{folder}/checkpoint").awaitTermination()
    L.log_ticks(_tick_stream(spark, sf), folder, f"{folder}/checkpoint-log").awaitTermination()
    L.compact_dwell(spark, folder)
    L.reconcile_late(spark, folder)
    return L.read_daily_dwell(spark, folder).drop("first_ts", "last_ts")


_CHANGES = f"""
  WITH {_TICKS},
  spans AS (SELECT *, epoch_us(lead(ts) OVER (PARTITION BY deck_id, "group", session ORDER BY ts)) - epoch_us(ts) AS span FROM ticks)
  SELECT deck_id, "group", session, slide, CAST(coalesce(sum(span), 0) AS BIGINT) AS micros FROM spans GROUP BY ALL"""


@query("I2_page_change_dwell", _CHANGES)
def _(spark, sf):
    return L.page_change_dwell(T.ticks(spark, sf))


@query("I2_page_change_stream", _CHANGES)
def _(spark, sf):
    folder = scratch_folder(spark)
    L.stream_page_change_dwell(_tick_stream(spark, sf), folder, f"{folder}/checkpoint").awaitTermination()
    return L.read_page_change_dwell(spark, folder)


_OVERRUN = f"""
  WITH {_TICKS},
  n AS (SELECT t.*, row_number() OVER (PARTITION BY deck_id, "group", session ORDER BY ts) AS elapsed FROM ticks t)
  SELECT n.deck_id, n."group", n.session, max(elapsed) AS elapsed, max(planned) AS planned,
    max(planned) > 0 AND max(elapsed) > max(planned) AS overrun,
    CAST(min(ts) FILTER (planned > 0 AND elapsed > planned) AS VARCHAR) AS overrun_ts
  FROM n JOIN plans p ON p.deck_id = n.deck_id AND p."group" = n."group" AND p.session = n.session GROUP BY ALL"""


@query("I3_overrun_flag", _OVERRUN)
def _(spark, sf):
    ticks = T.ticks(spark, sf)
    return L.overrun(ticks, T.plans(ticks)).withColumn("overrun_ts", F.col("overrun_ts").cast("string"))


@query("I3_overrun_stream", f"""
  SELECT deck_id, "group", session, planned, overrun_ts FROM ({_OVERRUN}) WHERE overrun""")
def _(spark, sf):
    """The reports of a stream over all ticks."""
    folder = scratch_folder(spark)
    plans = T.plans(T.ticks(spark, sf))
    L.stream_overrun(_tick_stream(spark, sf), plans, folder, f"{folder}/checkpoint").awaitTermination()
    found = L.read_overruns(spark, folder)
    return found.select(*L.SESSION, "planned", F.col("overrun_ts").cast("string").alias("overrun_ts"))


_TOTALS = f"""
  WITH {_TICKS},
  s AS (SELECT t.deck_id, t."group", t.session, count(*) AS duration, arg_max(slide, ts) AS last_slide, max(planned) AS planned
    FROM ticks t JOIN plans p ON p.deck_id = t.deck_id AND p."group" = t."group" AND p.session = t.session GROUP BY ALL)
  SELECT deck_id, "group", CAST(sum(duration) AS BIGINT) AS total_seconds, count(*) AS sessions,
    arg_max(last_slide, session) AS last_slide, arg_max(planned, session) AS last_planned
  FROM s GROUP BY ALL"""


@query("I4_merge_session_report", _TOTALS)
def _(spark, sf):
    ticks = T.ticks(spark, sf)
    rows = L.session_rows(L.slide_dwell(ticks), T.plans(ticks))
    # Two merges, the second repeating a part of the first: the result must not change.
    stored = L.merge_sessions(None, rows.filter(F.col("deck_id") % 2 == 0)).drop("session_number")
    return L.group_totals(L.merge_sessions(stored, rows))


@query("I4_merge_from_stream", _TOTALS)
def _(spark, sf):
    folder = scratch_folder(spark)
    L.stream_slide_dwell(_tick_stream(spark, sf), folder, f"{folder}/checkpoint").awaitTermination()
    rows = L.session_rows(L.read_slide_dwell(spark, folder), T.plans(T.ticks(spark, sf)))
    return L.group_totals(L.merge_sessions(None, rows))


@query("I4_stored_report_slides", f"""
  WITH {_TICKS}
  SELECT deck_id, "group", slide, CAST(count(*) AS INTEGER) AS seconds FROM ticks GROUP BY ALL""")
def _(spark, sf):
    ticks = T.ticks(spark, sf)
    sessions = L.merge_sessions(None, L.session_rows(L.slide_dwell(ticks), T.plans(ticks)))
    reports = L.time_reports(sessions, L.slide_dwell(ticks).drop("first_ts", "last_ts"))
    return TM.report_times(TM.parse_time_reports(reports)).select("deck_id", "group", "slide", "seconds")


@query("I4_store_time_report", f"""
  WITH {_TICKS},
  t AS (SELECT deck_id, "group", slide, CAST(count(*) AS INTEGER) AS seconds, min(ts) AS seen FROM ticks GROUP BY ALL)
  SELECT deck_id || '/2' AS version_id, 'deck_' || deck_id || '.pptx' AS file_name, "group", slide, seconds,
    CAST(row_number() OVER (PARTITION BY deck_id, "group" ORDER BY seen, slide) - 1 AS INTEGER) AS place FROM t
  UNION ALL SELECT DISTINCT deck_id || '/1', NULL, NULL, NULL, NULL, NULL FROM ticks""")
def _(spark, sf):
    """Reports of all decks, stored at the newest of two versions and read back."""
    ticks = T.ticks(spark, sf)
    dwell = L.slide_dwell(ticks)
    sessions = L.merge_sessions(None, L.session_rows(dwell, T.plans(ticks)))
    decks = ticks.select("deck_id").distinct().withColumn(
        "file_name", F.concat(F.lit("deck_"), F.col("deck_id").cast("string"), F.lit(".pptx"))
    )
    versions = decks.select("deck_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version")).select(
        "deck_id", "version", F.concat_ws("/", F.col("deck_id").cast("string"), F.col("version").cast("string")).alias("version_id"),
        F.lit(None).cast("string").alias("time_report"),
    )
    reports = L.deck_reports(sessions, dwell, decks).join(C.latest_versions(versions, "version_id"), "deck_id")
    stored = C.update_time_reports(versions, reports)
    form = "archivo string, grupos map<string, struct<tiempos_por_slide: map<string, int>>>"
    groups = stored.select("version_id", F.from_json("time_report", form).alias("r")).select(
        "version_id", F.col("r.archivo").alias("file_name"), F.explode_outer("r.grupos").alias("group", "g")
    )
    return groups.select(
        "version_id", "file_name", "group", F.posexplode_outer("g.tiempos_por_slide").alias("place", "slide", "seconds")
    ).withColumn("slide", F.col("slide").cast("int"))


@query("I5_resume_position", f"""
  WITH {_TICKS},
  g AS (SELECT deck_id, "group", arg_max(slide, ts) AS last_slide FROM ticks GROUP BY ALL)
  SELECT deck_id, "group", CAST(least(greatest(0, last_slide - 1), 9 + deck_id) AS INTEGER) AS start_index FROM g""")
def _(spark, sf):
    ticks = T.ticks(spark, sf)
    groups = L.group_totals(L.merge_sessions(None, L.session_rows(L.slide_dwell(ticks), T.plans(ticks))))
    pages = ticks.select("deck_id").distinct().withColumn("pages", F.col("deck_id") + 10)
    return L.resume_position(groups, pages)


@query("I6_session_config_check", """
  WITH c AS (SELECT event_id, upper(trim(CASE WHEN event_id % 50 = 0 THEN '  ' WHEN event_id % 7 = 0 THEN ' ' || event_type || ' '
      WHEN event_id % 11 = 0 THEN 'a-' || event_id % 9 ELSE event_type END)) AS group_name,
    TRY_CAST(trim(CASE WHEN event_id % 13 = 0 THEN 'diez' ELSE ' ' || json_extract_string(props, '$.k') END) AS INTEGER) AS planned_minutes FROM events),
  r AS (SELECT *, CASE WHEN group_name = '' THEN 'empty_group' WHEN length(group_name) > 5 OR NOT regexp_matches(group_name, '^[A-Z0-9]+$') THEN 'bad_group'
    WHEN planned_minutes IS NULL THEN 'not_a_number' WHEN planned_minutes <= 0 OR planned_minutes > 90 THEN 'out_of_range' END AS reason FROM c)
  SELECT event_id, group_name, planned_minutes, reason, reason IS NULL AS valid FROM r""")
def _(spark, sf):
    n = F.col("event_id")
    rows = T.table(spark, sf, "events").select(
        "event_id",
        F.when(n % 50 == 0, F.lit("  ")).when(n % 7 == 0, F.concat(F.lit(" "), "event_type", F.lit(" ")))
        .when(n % 11 == 0, F.concat(F.lit("a-"), (n % 9).cast("string"))).otherwise(F.col("event_type")).alias("group"),
        F.when(n % 13 == 0, F.lit("diez")).otherwise(
            F.concat(F.lit(" "), F.get_json_object("props", "$.k"))
        ).alias("minutes"),
    )
    return L.check_session_config(rows).select("event_id", "group_name", "planned_minutes", "reason", "valid")
