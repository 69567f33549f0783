"""Live sessions: clock ticks and page changes, as batch jobs and as streams.

``ticks(deck_id, group, session, slide, ts)``: one row per second of class. The batch forms are
also the correction for late rows that a stream has dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import text as X
from decklens.operators import ordered as O
from decklens.operators.folded import fold_text, json_text
from decklens.session import staged
from decklens.streaming.keyed import Keyed, hash_part

SESSION = ["deck_id", "group", "session"]


# --- dwell from ticks ---------------------------------------------------------------------------


def slide_dwell(ticks: DataFrame) -> DataFrame:
    """Seconds per slide of each session, with its first and last tick; partial counts before the
    shuffle."""
    return ticks.groupBy(*SESSION, "slide").agg(
        F.count(F.lit(1)).alias("seconds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def _batch_folder(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"


def stream_slide_dwell(ticks: DataFrame, folder: str, checkpoint: str, late: str = "10 minutes"):
    """Count ticks as a stream; returns the running query.

    A day window in the key lets the watermark drop the state of past sessions. Changed counts
    are written per batch to a folder named after the batch, so a repeated batch replaces its own
    output; :func:`read_slide_dwell` keeps the highest count per key, since counts only grow.
    """
    counts = (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(*SESSION, "slide", F.window("ts", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("seconds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(*SESSION, "slide", F.col("day.start").alias("day"), "seconds", "first_ts", "last_ts")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_folder(f"{folder}/dwell", batch_id))

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_slide_dwell(spark, folder: str) -> DataFrame:
    """Seconds per slide and session from the stream's output, as :func:`slide_dwell` gives them."""
    return _by_day(_latest(spark.read.parquet(f"{folder}/dwell")))


def _latest(batches: DataFrame) -> DataFrame:
    """One row per session, slide and day: counts only grow, so the highest is the last."""
    return batches.groupBy(*SESSION, "slide", "day").agg(
        F.max("seconds").alias("seconds"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def _by_day(days: DataFrame) -> DataFrame:
    return days.groupBy(*SESSION, "slide").agg(
        F.sum("seconds").alias("seconds"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )


def _daily(spark, folder: str) -> Keyed:
    return Keyed(spark, f"{folder}/daily", [*SESSION, "day"], F.date_format("day", "yyyy-MM-dd"))


def log_ticks(ticks: DataFrame, folder: str, checkpoint: str):
    """A second stream over the same source that logs every tick as it arrives, late ones too; returns the query."""
    spark = ticks.sparkSession
    rows = ticks.select(*SESSION, "slide", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.date_trunc("day", "ts"))

    def step(batch: DataFrame, batch_id: int) -> None:
        _daily(spark, folder).append(batch, batch_id)

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def compact_dwell(spark, folder: str) -> None:
    """Bring the stream's counts into the table by day: one row per session, slide and day.

    Only batches that came since the last call are read, and only the days that occur in them are
    rewritten. Counts that :func:`reconcile_late` has set are higher than the stream's, and stay.
    """
    daily = _daily(spark, folder)
    done = daily.read("compacted")
    batches = spark.read.parquet(f"{folder}/dwell")
    if done is not None:
        batches = batches.filter(F.col("batch") > done.agg(F.max("upto")).first()[0])
    upto = batches.agg(F.max("batch")).first()[0]
    if upto is None:
        return
    fresh = _latest(batches.filter(F.col("batch") <= upto))
    touched = fresh.select(*SESSION, "day", daily.part.alias("part")).distinct()
    before = daily.read("dwell")
    if before is not None:
        same = before.join(touched.select(*SESSION, "day"), [*SESSION, "day"], "left_semi")
        fresh = _latest(fresh.unionByName(same.select(*fresh.columns)))
    daily.replace("dwell", fresh, staged(touched))
    spark.range(1).select(F.lit(upto).alias("upto")).write.mode("append").parquet(f"{folder}/daily/compacted")


def reconcile_late(spark, folder: str) -> DataFrame:
    """Count again what the stream's watermark has dropped; returns the keys that were corrected.

    Ticks of the log and seconds of the table are added up by session and day, from the days
    that have both; where they differ, and only there, the ticks are counted again, and only the
    days of those keys are replaced. A second run finds nothing.
    """
    daily = _daily(spark, folder)
    keys = [*SESSION, "day"]
    logged = daily.logged()
    if logged is None:
        raise ValueError(f"no ticks logged below {folder}")
    arrived = logged.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("arrived"))
    counted = daily.read("dwell")
    if counted is not None:
        sums = counted.groupBy(*keys).agg(F.sum("seconds").alias("counted"))
        arrived = arrived.join(sums, keys, "left").filter("counted is null or counted <> arrived")
    touched = staged(arrived.select(*keys, "part"))
    if not touched.isEmpty():
        fresh = daily.logged(touched).groupBy(*SESSION, "slide", "day").agg(
            F.count(F.lit(1)).alias("seconds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
        )
        daily.replace("dwell", fresh, touched)
    return touched.drop("part")


def read_daily_dwell(spark, folder: str) -> DataFrame:
    """Seconds per slide and session from the table by day."""
    return _by_day(_daily(spark, folder).read("dwell"))


# --- dwell from page changes ----------------------------------------------------------------------


def change_intervals(changes: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Each page change with the time of the next one in its session (null while it is open)."""
    return O.next_value(changes, SESSION, "ts", O.time_block("ts", block_seconds), "until")


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def page_change_dwell(changes: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Microseconds per slide and session between page changes; the open last page counts 0."""
    spans = change_intervals(changes, block_seconds).withColumn("span", _micros("until") - _micros("ts"))
    return spans.groupBy(*SESSION, "slide").agg(F.coalesce(F.sum("span"), F.lit(0)).alias("micros"))


def _sessions(spark, folder: str) -> Keyed:
    return Keyed(spark, folder, SESSION, hash_part(SESSION))


def stream_page_change_dwell(changes: DataFrame, folder: str, checkpoint: str, block_seconds: int = 3600):
    """The same as a stream; returns the running query.

    Changes are logged as they come, and the sessions that a batch touches are computed again from
    the log by :func:`page_change_dwell`. An interval that spans batches is closed by whichever batch
    brings its end, and a late change counts like any other. The blockwise operators apply, so a
    session with very many changes is not bound to one task, as it would be in a keyed state.
    """
    sessions = _sessions(changes.sparkSession, folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = staged(sessions.append(batch, batch_id))
        sessions.replace("dwell", page_change_dwell(sessions.logged(touched), block_seconds), touched)

    return (
        changes.select(*SESSION, "slide", "ts").writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )


def read_page_change_dwell(spark, folder: str) -> DataFrame:
    """Microseconds per slide and session over all batches, open pages included with 0."""
    return _sessions(spark, folder).read("dwell").select(*SESSION, "slide", "micros")


# --- overrun, merge, resume, validation --------------------------------------------------------------


def overrun(ticks: DataFrame, plans: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Elapsed seconds per session, whether they exceed a plan above 0, and since which tick.

    Totals come from a partial aggregate. The first tick beyond the plan is looked up by its
    number, so no join brings all ticks of a session together.
    """
    totals = ticks.groupBy(*SESSION).agg(F.count(F.lit(1)).alias("elapsed")).join(
        plans.select(*SESSION, "planned"), SESSION, "left"
    )
    judged = totals.select(
        *SESSION, "elapsed", F.coalesce("planned", F.lit(0)).alias("planned"),
        F.coalesce((F.col("planned") > 0) & (F.col("elapsed") > F.col("planned")), F.lit(False)).alias("overrun"),
    )
    numbered = O.dense_number(ticks.select(*SESSION, "ts"), SESSION, ["ts"], O.time_block("ts", block_seconds), "n")
    wanted = judged.filter("overrun").select(*SESSION, (F.col("planned") + 1).cast("bigint").alias("n"))
    first = numbered.join(wanted, [*SESSION, "n"]).select(*SESSION, F.col("ts").alias("overrun_ts"))
    return judged.join(first, SESSION, "left")


def stream_overrun(ticks: DataFrame, plans: DataFrame, folder: str, checkpoint: str, block_seconds: int = 3600):
    """Report every session that overruns its plan, once, while it runs; returns the running query.

    Ticks are logged as they come. A batch looks at the sessions it touches that have not been reported yet, joins
    them to the (static) plans, and appends those that have passed them with the first tick beyond the
    plan, as :func:`overrun` finds it among the ticks so far. A report is not taken back when late ticks
    move that point.
    """
    spark = ticks.sparkSession
    sessions = _sessions(spark, folder)
    alerts = f"{folder}/alerts"

    def step(batch: DataFrame, batch_id: int) -> None:
        touched = sessions.append(batch, batch_id)
        if batch_id > 0:
            told = read_overruns(spark, folder, batch_id)
            touched = touched.join(told.select(*SESSION), SESSION, "left_anti")
        found = overrun(sessions.logged(staged(touched)), plans, block_seconds).filter("overrun").drop("overrun")
        found.write.mode("overwrite").parquet(_batch_folder(alerts, batch_id))

    return (
        ticks.select(*SESSION, "slide", "ts").writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(step)
        .start()
    )


def read_overruns(spark, folder: str, before: int | None = None) -> DataFrame:
    """Reported overruns ``(deck_id, group, session, elapsed, planned, overrun_ts, batch)``, of batches below ``before``."""
    rows = spark.read.parquet(f"{folder}/alerts")
    return rows if before is None else rows.filter(F.col("batch") < before)


def session_rows(dwell: DataFrame, plans: DataFrame) -> DataFrame:
    """One row per session with time: duration, plan, start, last slide; from batch or stream dwell."""
    rows = dwell.groupBy(*SESSION).agg(
        F.sum("seconds").alias("duration"), F.min("first_ts").alias("start"), F.max_by("slide", "last_ts").alias("last_slide")
    )
    return rows.join(plans.select(*SESSION, "planned"), SESSION, "left").select(
        *SESSION, "duration", "start", "last_slide", F.coalesce("planned", F.lit(0)).alias("planned")
    )


def merge_sessions(stored: DataFrame | None, new: DataFrame, block_days: int = 30) -> DataFrame:
    """Stored and new session rows as one table, numbered by start within each deck and group.

    Keyed by session, so merging the same session again changes nothing; sessions without time
    are never stored.
    """
    fresh = new.filter("duration > 0")
    if stored is not None:
        fresh = fresh.join(stored.select(*SESSION), SESSION, "left_anti")
        fresh = stored.select(*fresh.columns).unionByName(fresh)
    return O.dense_number(
        fresh, ["deck_id", "group"], ["start", "session"], O.time_block("start", block_days * 86400), "session_number"
    )


def group_totals(sessions: DataFrame) -> DataFrame:
    """Group record over its merged sessions: total seconds, sessions, last slide, last plan."""
    return sessions.groupBy("deck_id", "group").agg(
        F.sum("duration").alias("total_seconds"),
        F.count(F.lit(1)).alias("sessions"),
        F.max_by("last_slide", "session_number").alias("last_slide"),
        F.max_by("planned", "session_number").alias("last_planned"),
    )


def _braced(text: str) -> Column:
    return F.concat(F.lit("{"), F.coalesce(text, F.lit("")), F.lit("}"))


def _seconds_text(dwell: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Seconds per slide as the fields of a JSON object, in the order of first visits."""
    entry = F.concat(F.lit('"'), F.col("slide").cast("string"), F.lit('":'), F.col("seconds").cast("string"))
    order = ["first_ts", "slide"] if "first_ts" in dwell.columns else ["slide"]
    return fold_text(dwell.select(*keys, *order, entry.alias("entry")), keys, order).select(*keys, F.col("text").alias(name))


def _group_texts(sessions: DataFrame, dwell: DataFrame) -> DataFrame:
    """``(deck_id, group, entry)``: the record of each group as one field of a JSON object."""
    keys = ["deck_id", "group"]
    slides = sessions.join(_seconds_text(dwell, SESSION, "slides"), SESSION)
    session = F.concat(
        F.lit('"'), F.col("session_number").cast("string"), F.lit('":{"planeado_seg":'), F.col("planned").cast("string"),
        F.lit(',"duracion_seg":'), F.col("duration").cast("string"), F.lit(',"tiempos_slide":'), _braced("slides"), F.lit("}"),
    )
    history = fold_text(slides.select(*keys, "session_number", session.alias("entry")), keys, ["session_number"])
    seen = [F.min("first_ts").alias("first_ts")] if "first_ts" in dwell.columns else []
    by_slide = _seconds_text(dwell.groupBy(*keys, "slide").agg(F.sum("seconds").alias("seconds"), *seen), keys, "times")
    whole = history.join(by_slide, keys).join(group_totals(sessions), keys)
    return whole.select(*keys, F.concat(
        json_text(F.col("group")), F.lit(':{"ultima_diapositiva":'), F.col("last_slide").cast("string"),
        F.lit(',"tiempo_total_seg":'), F.col("total_seconds").cast("string"), F.lit(',"tiempos_por_slide":'), _braced("times"),
        F.lit(',"historial_sesiones":'), _braced("text"), F.lit("}"),
    ).alias("entry"))


def deck_reports(sessions: DataFrame, dwell: DataFrame, decks: DataFrame) -> DataFrame:
    """``(deck_id, time_report)``: one report with all groups of the deck, as a version stores it.

    Sessions stand by number, groups by name, slides in the order of their first visit, so the same
    rows give the same text. ``decks`` brings ``file_name``. Every level is written from sorted rows by
    :func:`decklens.operators.folded.fold_text`; nothing gathers a deck's groups, sessions or slides.
    """
    files = decks.select("deck_id", F.concat(F.lit('{"archivo":'), json_text(F.col("file_name")), F.lit(',"grupos":')).alias("head"))
    texts = fold_text(_group_texts(sessions, dwell), ["deck_id"], ["group"], files).filter("n > 0 and head is not null")
    return texts.select("deck_id", F.concat("head", _braced("text"), F.lit("}")).alias("time_report"))


def time_reports(sessions: DataFrame, dwell: DataFrame) -> DataFrame:
    """The same per group: ``(deck_id, group, time_report)`` as JSON text, of any size."""
    return _group_texts(sessions, dwell).select(
        "deck_id", "group", F.concat(F.lit('{"grupos":{'), "entry", F.lit("}}")).alias("time_report")
    )


def resume_position(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Page index to start from: the last slide's, from 0, never beyond the last page."""
    joined = groups.join(pages.select("deck_id", "pages"), "deck_id")
    start = F.greatest(F.lit(0), F.coalesce("last_slide", F.lit(1)) - 1)
    return joined.select("deck_id", "group", F.least(start, F.col("pages") - 1).cast("int").alias("start_index"))


def check_session_config(rows: DataFrame, group: str = "group", minutes: str = "minutes") -> DataFrame:
    """Normalised group name and minutes, with ``valid`` and the reason when not.

    A group name has 1 to 5 letters or digits, minutes are a whole number from 1 to 90.
    """
    name = F.upper(X.strip(F.coalesce(group, F.lit(""))))
    time = X.strip(F.coalesce(F.col(minutes).cast("string"), F.lit(""))).try_cast("int")
    out = rows.withColumns({"group_name": name, "planned_minutes": time})
    reason = (
        F.when(F.col("group_name") == "", F.lit("empty_group"))
        .when(
            (F.length("group_name") > K.GROUP_MAX_CHARS) | ~F.col("group_name").rlike(r"^[\p{L}\p{N}]+$"),
            F.lit("bad_group"),
        )
        .when(F.col("planned_minutes").isNull(), F.lit("not_a_number"))
        .when((F.col("planned_minutes") <= 0) | (F.col("planned_minutes") > K.PLAN_MAX_MINUTES), F.lit("out_of_range"))
    )
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
