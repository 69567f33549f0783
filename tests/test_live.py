"""Class time, batch against stream, and merging of sessions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from decklens.operators import timing as TM
from decklens.streaming import live as L

TICK = "deck_id string, group string, session string, slide int, ts timestamp"


@pytest.fixture(scope="module")
def ticks(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1, 8)
    rows = []
    for day in range(3):
        for group in ("A", "B"):
            at = start + dt.timedelta(days=day)
            for _ in range(200):
                at += dt.timedelta(seconds=rnd.randint(1, 90))
                rows.append(("d", group, f"s{day}", rnd.randint(1, 6), at))
    return spark.createDataFrame(rows, TICK), rows


def brute_dwell(rows):
    out = {}
    sessions = {}
    for r in sorted(rows, key=lambda r: r[4]):
        sessions.setdefault(r[:3], []).append(r)
    for key, rs in sessions.items():
        for a, b in zip(rs, rs[1:]):
            out[key + (a[3],)] = out.get(key + (a[3],), 0) + int((b[4] - a[4]).total_seconds() * 1e6)
        out.setdefault(key + (rs[-1][3],), 0)
    return out


def as_dict(df, value):
    return {(r.deck_id, r.group, r.session, r.slide): r[value] for r in df.collect()}


def split_files(rows, folder, spark, n=4):
    """The rows in time order, as ``n`` files that arrive one after the other."""
    ordered = sorted(rows, key=lambda r: r[4])
    size = -(-len(ordered) // n)
    for i in range(n):
        spark.createDataFrame(ordered[i * size:(i + 1) * size], TICK).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("block", [60, 3600, 10 ** 7])
def test_page_change_dwell_in_blocks(ticks, block):
    df, rows = ticks
    assert as_dict(L.page_change_dwell(df, block), "micros") == brute_dwell(rows)


def test_streams_equal_their_batch_form(spark, ticks, tmp_path):
    df, rows = ticks
    split_files(rows, tmp_path / "in", spark)
    L.stream_slide_dwell(stream(spark, tmp_path / "in"), str(tmp_path / "a"), str(tmp_path / "ca")).awaitTermination()
    assert as_dict(L.read_slide_dwell(spark, str(tmp_path / "a")), "seconds") == as_dict(L.slide_dwell(df), "seconds")
    L.stream_page_change_dwell(stream(spark, tmp_path / "in"), str(tmp_path / "b"), str(tmp_path / "cb")).awaitTermination()
    assert as_dict(L.read_page_change_dwell(spark, str(tmp_path / "b")), "micros") == brute_dwell(rows)


def plans(spark, seconds):
    return spark.createDataFrame([("d", g, f"s{d}", seconds) for g in "AB" for d in range(3)], "deck_id string, group string, session string, planned int")


def test_overrun(spark, ticks):
    df, rows = ticks
    got = L.overrun(df, plans(spark, 150), 60).collect()
    assert all(r.overrun and r.elapsed == 200 for r in got) and len(got) == 6
    first = sorted(r[4] for r in rows if r[1:3] == ("A", "s0"))[150]
    assert [r.overrun_ts for r in got if (r.group, r.session) == ("A", "s0")] == [first]
    assert not any(r.overrun for r in L.overrun(df, plans(spark, 200)).collect())
    assert not any(r.overrun for r in L.overrun(df, plans(spark, 0)).collect())


def test_merge_is_idempotent_and_round_trips(spark, ticks):
    df, rows = ticks
    new = L.session_rows(L.slide_dwell(df), plans(spark, 600))
    first = L.merge_sessions(None, new.filter("session = 's0'")).drop("session_number")
    merged = L.merge_sessions(first, new)
    assert sorted((r.group, r.session, r.session_number) for r in merged.collect()) == [(g, f"s{d}", d + 1) for g in "AB" for d in range(3)]
    totals = L.group_totals(merged)
    assert {(r.group, r.total_seconds, r.sessions) for r in totals.collect()} == {("A", 600, 3), ("B", 600, 3)}
    reports = L.time_reports(merged, L.slide_dwell(df))
    groups = TM.parse_time_reports(reports)
    times = {(r.group, r.slide): r.seconds for r in TM.report_times(groups).collect()}
    assert sum(times.values()) == 1200 and len(times) == 12
    assert {(r.group, r.planned) for r in TM.planned_seconds(TM.report_sessions(groups), TM.report_totals(groups)).collect()} == {("A", 600), ("B", 600)}
    stored = json.loads(reports.filter("group = 'A'").first().time_report)["grupos"]["A"]
    assert stored["tiempo_total_seg"] == 600 and set(stored["historial_sesiones"]) == {"1", "2", "3"}


def test_report_of_many_sessions(spark):
    """700 sessions of a group are one report, in the order of their numbers."""
    start = dt.datetime(2024, 1, 1, 8)
    rows = [("d", g, f"s{i:04d}", 1 + (i + k) % 30, start + dt.timedelta(days=i, seconds=k)) for g in ("A", 'B "x"') for i in range(700) for k in range(3)]
    dwell = L.slide_dwell(spark.createDataFrame(rows, TICK))
    merged = L.merge_sessions(None, L.session_rows(dwell, spark.createDataFrame([], "deck_id string, group string, session string, planned int")))
    decks = spark.createDataFrame([("d", "f.pptx"), ("none", "g.pptx")], "deck_id string, file_name string")
    (report,) = L.deck_reports(merged, dwell, decks).collect()
    groups = json.loads(report.time_report)["grupos"]
    assert list(groups) == ["A", 'B "x"']
    for g in groups.values():
        assert list(g["historial_sesiones"]) == [str(i) for i in range(1, 701)] and sum(g["tiempos_por_slide"].values()) == 2100
    parsed = TM.parse_time_reports(L.time_reports(merged, dwell))
    assert parsed.count() == 2 and TM.report_sessions(parsed).count() == 1400


def late_rows(rows):
    """Files with a change that crosses them, and rows of the first day that come last."""
    ordered = sorted(rows, key=lambda r: r[4])
    held = ordered[5:300:7]
    rest = [r for r in ordered if r not in held]
    return [rest[:300], rest[300:700], rest[700:], held]


def write_files(spark, files, folder):
    for i, f in enumerate(files):
        spark.createDataFrame(f, TICK).coalesce(1).write.mode("append").parquet(str(folder))


def folder_files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("part-*.parquet")}


def test_page_changes_with_late_rows(spark, ticks, tmp_path):
    _, rows = ticks
    write_files(spark, late_rows(rows), tmp_path / "in")
    L.stream_page_change_dwell(stream(spark, tmp_path / "in"), str(tmp_path / "b"), str(tmp_path / "cb"), 600).awaitTermination()
    assert len(list((tmp_path / "b" / "log").glob("batch=*"))) == 4
    assert as_dict(L.read_page_change_dwell(spark, str(tmp_path / "b")), "micros") == brute_dwell(rows)


def test_late_ticks_are_reconciled(spark, ticks, tmp_path):
    df, rows = ticks
    folder = tmp_path / "a"
    write_files(spark, late_rows(rows), tmp_path / "in")
    L.stream_slide_dwell(stream(spark, tmp_path / "in"), str(folder), str(tmp_path / "ca")).awaitTermination()
    L.log_ticks(stream(spark, tmp_path / "in"), str(folder), str(tmp_path / "cl")).awaitTermination()
    L.compact_dwell(spark, str(folder))
    want = as_dict(L.slide_dwell(df), "seconds")
    assert as_dict(L.read_daily_dwell(spark, str(folder)), "seconds") != want  # the watermark has dropped rows
    daily = folder / "daily" / "dwell"
    before = folder_files(daily)
    corrected = L.reconcile_late(spark, str(folder)).collect()
    assert {r.session for r in corrected} <= {"s0", "s1"} and corrected
    assert as_dict(L.read_daily_dwell(spark, str(folder)), "seconds") == want
    after = folder_files(daily)
    days = {f"{r.day:%Y-%m-%d}" for r in corrected}
    kept = {f: t for f, t in before.items() if not any(d in f for d in days)}
    assert kept and all(after.get(f) == t for f, t in kept.items())
    assert L.reconcile_late(spark, str(folder)).count() == 0 and folder_files(daily) == after
    L.compact_dwell(spark, str(folder))
    assert as_dict(L.read_daily_dwell(spark, str(folder)), "seconds") == want


def test_overrun_stream_reports_once(spark, ticks, tmp_path):
    df, rows = ticks
    split_files(rows, tmp_path / "in", spark, 6)
    plan = plans(spark, 150)
    L.stream_overrun(stream(spark, tmp_path / "in"), plan, str(tmp_path / "o"), str(tmp_path / "co"), 600).awaitTermination()
    got = L.read_overruns(spark, str(tmp_path / "o")).collect()
    want = {(r.group, r.session): r.overrun_ts for r in L.overrun(df, plan, 600).collect()}
    assert len(got) == 6 and {(r.group, r.session): r.overrun_ts for r in got} == want
    assert len({r.batch for r in got}) > 1


def test_resume(spark):
    groups = spark.createDataFrame([("d", "A", 5), ("d", "B", 99), ("d", "C", 1), ("d", "D", None)], "deck_id string, group string, last_slide int")
    pages = spark.createDataFrame([("d", 20)], "deck_id string, pages int")
    assert {(r.group, r.start_index) for r in L.resume_position(groups, pages).collect()} == {("A", 4), ("B", 19), ("C", 0), ("D", 0)}


def test_session_config(spark):
    rows = [(" 3cm1 ", "90", None), ("abcdef", "5", "bad_group"), ("a-b", "5", "bad_group"), ("  ", "5", "empty_group"), ("ñ1", " 1 ", None), ("a", "0", "out_of_range"), ("a", "91", "out_of_range"), ("a", "1.5", "not_a_number"), ("a", None, "not_a_number")]
    got = L.check_session_config(spark.createDataFrame(rows, "group string, minutes string, e string")).collect()
    assert [r.reason for r in got] == [r.e for r in got] and got[0].group_name == "3CM1"


# --- deviations ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def timing(spark):
    rnd = random.Random(5)
    times = [("d", g, s, rnd.choice([0, 5, 8, 10, 12, 20, 40]), i) for g in "AB" for i, s in enumerate(rnd.sample(range(1, 31), 25))]
    ref = [("d", s, 10 if s % 7 else 0) for s in range(1, 26)]
    return (
        spark.createDataFrame(times, "deck_id string, group string, slide int, seconds int, seen int"),
        spark.createDataFrame(ref, "deck_id string, slide int, recommended int"), times, {r[1]: r[2] for r in ref},
    )


def pct(real, ref):
    return round((real - ref) / ref * 100) if ref else 0


def test_top_deviations_and_alerts(timing):
    times, ref, rows, refs = timing
    devs = TM.deviations(times, ref)
    top = {(r.group, r.side, r["rank"]): r.slide for r in TM.top_deviations(devs).collect()}
    alerts = {(r.group, r.slide, r.alert[:13]) for r in TM.extreme_alerts(devs).collect()}
    for g in "AB":
        ordered = sorted(((pct(v, refs[s]), s) for _, gr, s, v, _ in rows if gr == g and s in refs), key=lambda x: x[0])
        under = [s for p, s in ordered if p < 0][:3]
        over = [s for p, s in reversed(ordered) if p > 0][:3]
        assert [top[g, "under", i + 1] for i in range(len(under))] == under
        assert [top[g, "over", i + 1] for i in range(len(over))] == over
        assert not set(under) & set(over)
        assert ((g, ordered[0][1], "Mayor déficit") in alerts) == (ordered[0][0] < -15)
        assert ((g, ordered[-1][1], "Mayor exceso ") in alerts) == (ordered[-1][0] > 15)


def test_totals(spark, timing):
    times, ref, rows, refs = timing
    sessions = spark.createDataFrame([("d", "A", "2", 300, 0), ("d", "A", "10", 900, 0), ("d", "B", "x", 1, 0)], "deck_id string, group string, session string, planned int, duration int")
    got = {r.group: r for r in TM.group_summary(times, ref, sessions).collect()}
    real = {g: sum(r[3] for r in rows if r[1] == g) for g in "AB"}
    total = sum(refs.values())
    assert got["A"].planned == 900 and got["A"].real_total == real["A"] and got["A"].pct == pct(real["A"], total)
    assert got["A"].presented == sum(1 for r in rows if r[1] == "A" and r[3] > 0 and r[2] in refs)
    own = {r.group: r for r in TM.group_report_totals(times, ref).collect()}
    assert own["B"].recommended_total == sum(refs.get(r[2], 0) for r in rows if r[1] == "B")


def test_dense_trend(spark, timing):
    times, ref, rows, refs = timing
    trend = TM.dense_trend(times, ref, spark.createDataFrame([("d", 30)], "deck_id string, total_slides int"))
    got = {(r.group, r.slide): (r.real, r.recommended) for r in trend.collect()}
    real = {(r[1], r[2]): r[3] for r in rows}
    assert got == {(g, s): (real.get((g, s), 0), refs.get(s, 0)) for g in "AB" for s in range(1, 31)}
    axis = TM.trend_axis(trend).first()
    assert axis.y_max == 40 and axis.ticks == [0, 10, 20, 30, 40]


def test_comparison(timing):
    times, ref, rows, refs = timing
    real = {(r[1], r[2]): r[3] for r in rows}
    for r in TM.group_comparison(times, ref).collect():
        own = real.get((r.group, r.slide))
        longest = max([refs[r.slide], 1] + [real.get((g, r.slide)) or 0 for g in "AB"])
        assert (r.real, r.real_share, r.reference_share) == (own, (own or 0) / longest, refs[r.slide] / longest)
        assert r.status == "Sin tiempo real" if own is None else r.pct == pct(own, refs[r.slide])
