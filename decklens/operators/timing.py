"""Class time against recommended time.

Tables: ``times(deck_id, group, slide, seconds, seen)`` holds the real seconds per slide (``seen``
orders slides by first visit), ``reference(deck_id, slide, recommended)`` the recommended ones,
``sessions(deck_id, group, session, planned, duration)`` one row per class session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decklens import constants as K
from decklens import schemas as S
from decklens.functions import numeric as N

_GROUP = ["deck_id", "group"]


def parse_time_reports(reports: DataFrame, column: str = "time_report") -> DataFrame:
    """Stored report text as ``(deck_id, group, report)`` rows; broken text gives none."""
    parsed = reports.select("deck_id", F.from_json(column, S.TIME_REPORT).alias("r"))
    return parsed.select("deck_id", F.explode_outer("r.grupos").alias("group", "report")).filter(
        F.col("group").isNotNull()
    )


def report_times(groups: DataFrame) -> DataFrame:
    """Seconds per slide of parsed reports; keys that are no numbers are skipped."""
    flat = groups.select(
        *_GROUP, F.posexplode(F.map_entries("report.tiempos_por_slide")).alias("seen", "e")
    )
    return flat.select(
        *_GROUP, F.col("e.key").try_cast("int").alias("slide"), F.coalesce("e.value", F.lit(0)).alias("seconds"), "seen"
    ).filter(F.col("slide").isNotNull())


def report_sessions(groups: DataFrame) -> DataFrame:
    flat = groups.select(*_GROUP, F.explode("report.historial_sesiones").alias("session", "s"))
    return flat.select(
        *_GROUP, "session", F.col("s.planeado_seg").alias("planned"), F.col("s.duracion_seg").alias("duration")
    )


def report_totals(groups: DataFrame) -> DataFrame:
    """Stored totals, one row per group: a report in several parts repeats them in each."""
    return groups.groupBy(*_GROUP).agg(
        F.max("report.tiempo_total_seg").alias("stored_total"),
        F.max("report.planeado_seg").alias("group_planned"),
        F.max("report.ultima_diapositiva").alias("last_slide"),
    )


def planned_seconds(sessions: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Plan of the numerically last session of each group; else the group's own; else 0."""
    last = sessions.groupBy(*_GROUP).agg(
        F.max_by("planned", F.col("session").try_cast("int")).alias("planned")
    )
    if groups is None:
        return last.select(*_GROUP, F.coalesce("planned", F.lit(0)).alias("planned"))
    return groups.join(last, _GROUP, "left").select(
        *_GROUP, F.coalesce("planned", "group_planned", F.lit(0)).alias("planned")
    )


def deviations(times: DataFrame, reference: DataFrame, presented_only: bool = False) -> DataFrame:
    """Real against recommended seconds of slides known to the analysis, with percent and status.

    ``presented_only`` keeps slides with real time above 0 (the report); otherwise a visited
    slide with 0 seconds stays (the panel).
    """
    real = times.filter("seconds > 0") if presented_only else times
    joined = real.join(reference, ["deck_id", "slide"])
    pct = N.deviation_pct(F.col("seconds"), F.col("recommended"))
    return joined.withColumn("pct", pct).withColumn("status", N.deviation_status(F.col("pct")))


def top_deviations(devs: DataFrame, k: int = K.TOP_DEVIATIONS) -> DataFrame:
    """The ``k`` most negative and ``k`` most positive slides of each group.

    Equal percentages follow the order of first visit among the short ones and the reverse order
    among the long ones. The rank filter is applied before the shuffle as well, so a large group
    sends at most ``k`` rows per task.
    """
    window = Window.partitionBy(*_GROUP)

    def side(name: str, keep: Column, *order: Column) -> DataFrame:
        ranked = devs.filter(keep).withColumn("rank", F.row_number().over(window.orderBy(*order)))
        return ranked.filter(F.col("rank") <= k).withColumn("side", F.lit(name))

    under = side("under", F.col("pct") < 0, F.col("pct"), F.col("seen"), F.col("slide"))
    over = side("over", F.col("pct") > 0, F.desc("pct"), F.desc("seen"), F.desc("slide"))
    return under.unionByName(over).select(*_GROUP, "side", "rank", "slide", "seconds", "recommended", "pct")


def extreme_alerts(devs: DataFrame) -> DataFrame:
    """The group's shortest slide when below -15 %, its longest when above 15 %."""
    row = F.struct("pct", "seen", "slide")
    ends = devs.groupBy(*_GROUP).agg(F.min(row).alias("low"), F.max(row).alias("high"))
    rows = ends.select(*_GROUP, F.explode(F.array(
        F.struct(F.col("low").alias("d"), F.lit(K.ALERT_UNDER).alias("alert"), (F.col("low.pct") < -K.ALERT_LIMIT).alias("on")),
        F.struct(F.col("high").alias("d"), F.lit(K.ALERT_OVER).alias("alert"), (F.col("high.pct") > K.ALERT_LIMIT).alias("on")),
    )).alias("e"))
    return rows.filter("e.on").select(*_GROUP, "e.d.slide", "e.d.pct", "e.alert")


def group_summary(
    times: DataFrame, reference: DataFrame, sessions: DataFrame, totals: DataFrame | None = None,
    deck_totals: DataFrame | None = None,
) -> DataFrame:
    """Plan, real total, deviation from the deck's recommended total, and slides presented.

    ``totals`` may bring a stored total per group (used when not 0), ``deck_totals`` the deck's
    stored recommended seconds ``(deck_id, total_seconds)``.
    """
    known = times.join(reference.select("deck_id", "slide", F.lit(1).alias("known")), ["deck_id", "slide"], "left")
    real = known.groupBy(*_GROUP).agg(
        F.sum("seconds").alias("summed"),
        F.count(F.when((F.col("seconds") > 0) & (F.col("known") == 1), 1)).alias("presented"),
    )
    if totals is not None:
        real = real.join(totals.select(*_GROUP, "stored_total"), _GROUP, "left")
    else:
        real = real.withColumn("stored_total", F.lit(None).cast("bigint"))
    deck = reference.groupBy("deck_id").agg(
        F.sum("recommended").alias("ref_sum"), F.max("slide").alias("total_slides")
    )
    if deck_totals is not None:
        deck = deck.join(deck_totals.select("deck_id", "total_seconds"), "deck_id", "left").withColumn(
            "ref_sum", F.coalesce(F.nullif("total_seconds", F.lit(0)), "ref_sum")
        )
    # A group without sessions falls back on its own plan; a deck without an analysis keeps its groups.
    own = totals if totals is not None and "group_planned" in totals.columns else None
    joined = real.join(planned_seconds(sessions, own), _GROUP, "left").join(deck, "deck_id", "left")
    total = F.coalesce(F.nullif("stored_total", F.lit(0)), "summed")
    return joined.withColumn("real_total", total).select(
        *_GROUP, F.coalesce("planned", F.lit(0)).alias("planned"), "real_total",
        F.col("ref_sum").alias("recommended_total"), "presented", "total_slides",
        N.deviation_pct(F.col("real_total"), F.col("ref_sum")).alias("pct"),
    )


def group_report_totals(times: DataFrame, reference: DataFrame) -> DataFrame:
    """Totals of the deviation report: all real seconds against the recommended seconds of the
    group's own slides (a different base from :func:`group_summary`)."""
    joined = times.join(reference, ["deck_id", "slide"], "left")
    sums = joined.groupBy(*_GROUP).agg(
        F.sum("seconds").alias("real_total"), F.coalesce(F.sum("recommended"), F.lit(0)).alias("recommended_total")
    )
    return sums.withColumn("pct", N.deviation_pct(F.col("real_total"), F.col("recommended_total")))


def _grid(groups: DataFrame, decks: DataFrame) -> DataFrame:
    """Every slide 1..total for every group of the deck."""
    return groups.join(decks, "deck_id").select(
        *_GROUP, F.explode(F.when(
            F.col("total_slides") > 0, F.sequence(F.lit(1), F.col("total_slides").cast("int"))
        ).otherwise(F.array().cast("array<int>"))).alias("slide")
    )


def dense_trend(times: DataFrame, reference: DataFrame, decks: DataFrame) -> DataFrame:
    """Recommended and real seconds of every slide ``1..total_slides``, 0 where there are none.

    ``decks`` is ``(deck_id, total_slides)``. Only ordinary equi-joins on (deck, group, slide).
    """
    groups = times.select(*_GROUP).distinct()
    return (
        _grid(groups, decks)
        .join(times.select(*_GROUP, "slide", "seconds"), [*_GROUP, "slide"], "left")
        .join(reference, ["deck_id", "slide"], "left")
        .select(
            *_GROUP, "slide", F.coalesce("seconds", F.lit(0)).alias("real"),
            F.coalesce("recommended", F.lit(0)).alias("recommended"),
        )
    )


def trend_axis(trend: DataFrame, n: int = 4) -> DataFrame:
    """Axis maximum (at least 1) and its distinct tick values per group."""
    top = trend.groupBy(*_GROUP).agg(F.greatest(F.max("real"), F.max("recommended"), F.lit(1)).alias("y_max"))
    ticks = F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda k: F.rint(F.col("y_max") * k / n).cast("int")
    )))
    return top.withColumn("ticks", ticks)


def group_comparison(times: DataFrame, reference: DataFrame) -> DataFrame:
    """For each slide of the analysis and each group of the deck: real seconds (null when not
    shown), percent, status and the bar lengths as shares of the longest bar of the slide."""
    groups = times.select(*_GROUP).distinct()
    sizes = reference.groupBy("deck_id").agg(F.max("slide").alias("total_slides"))
    rows = (
        _grid(groups, sizes)
        .join(reference.select("deck_id", "slide", "recommended"), ["deck_id", "slide"])
        .join(times.select(*_GROUP, "slide", "seconds"), [*_GROUP, "slide"], "left")
    )
    longest = times.groupBy("deck_id", "slide").agg(F.max("seconds").alias("top"))
    scaled = rows.join(longest, ["deck_id", "slide"], "left").withColumn(
        "longest", F.greatest("recommended", F.coalesce("top", F.lit(0)), F.lit(1))
    )
    pct = F.when(F.col("seconds").isNotNull(), N.deviation_pct(F.col("seconds"), F.col("recommended")))
    return scaled.select(
        *_GROUP, "slide", F.col("seconds").alias("real"), "recommended", pct.alias("pct"),
        N.deviation_status(pct).alias("status"),
        F.coalesce(F.col("seconds") / F.col("longest"), F.lit(0.0)).alias("real_share"),
        (F.col("recommended") / F.col("longest")).alias("reference_share"),
    )
