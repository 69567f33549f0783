"""Keyed writes and loads with repeated keys; groups of decks without an analysis."""

from decklens.operators import catalog as C
from decklens.operators import judge as J
from decklens.operators import timing as TM
from decklens.sources import syllabus as SY
from decklens.streaming import live as L


def test_one_change_per_version(spark):
    versions = spark.createDataFrame([("v", 1.0, "a"), ("w", 2.0, "b")], "version_id string, score double, zone string")
    changes = spark.createDataFrame([("v", 5.0, "x"), ("v", 7.0, "y")], "version_id string, score double, zone string")
    assert sorted(map(tuple, C.update_versions(versions, changes, "score", "zone").collect())) == [("v", 7.0, "y"), ("w", 2.0, "b")]
    assert sorted(map(tuple, C.upsert(versions, changes, ["version_id"]).collect())) == [("v", 7.0, "y"), ("w", 2.0, "b")]


def test_subject_named_twice(spark):
    tree = "unidad_aprendizaje string, unidades array<struct<numero:int,nombre:string,temas:array<struct<numero:int,nombre:string,subtemas:array<struct<numero:int,nombre:string>>>>>>"
    nested = spark.createDataFrame([("S", [(1, "U", [(1, "T", [(1, "x")])])])] * 2, tree)
    tables = SY.load_syllabus(nested, spark.createDataFrame([], "name string"))
    assert [t.count() for t in tables] == [1, 1, 1, 1]


def test_topics_of_several_answers(spark):
    answer = '{"temas_presentacion": [{"unidad": "%s", "temas": []}]}'
    rows = spark.createDataFrame([("d", answer % "B"), ("d", answer % "A"), ("e", "no")], "deck_id string, response string")
    got = {r.deck_id: [u.unidad for u in r.temas_presentacion] for r in J.parse_topics(rows).collect()}
    assert got == {"d": ["A", "B"], "e": []}


def test_group_of_unanalysed_deck(spark):
    times = spark.createDataFrame([("d", "g", 1, 30)], "deck_id string, group string, slide int, seconds int")
    reference = spark.createDataFrame([], "deck_id string, slide int, recommended int")
    sessions = spark.createDataFrame([], "deck_id string, group string, session string, planned int, duration int")
    totals = spark.createDataFrame([("d", "g", 40, 700, 1)], "deck_id string, group string, stored_total int, group_planned int, last_slide int")
    (r,) = TM.group_summary(times, reference, sessions, totals).collect()
    assert (r.planned, r.real_total, r.recommended_total, r.presented) == (700, 40, None, 0)


def test_one_report_for_all_groups(spark):
    dwell = spark.createDataFrame(
        [("d", "h", "s", 1, 5, 3), ("d", "g", "s", 10, 7, 1), ("d", "g", "s", 2, 4, 2), ("d", "g", "t", 2, 6, 9)],
        "deck_id string, group string, session string, slide int, seconds int, first_ts int",
    )
    sessions = spark.createDataFrame(
        [("d", "h", "s", 5, 1, 60, 1), ("d", "g", "s", 11, 2, 0, 1), ("d", "g", "t", 6, 2, 30, 2)],
        "deck_id string, group string, session string, duration int, last_slide int, planned int, session_number int",
    )
    decks = spark.createDataFrame([("d", "f.pptx")], "deck_id string, file_name string")
    reports = L.deck_reports(sessions, dwell, decks)
    versions = spark.createDataFrame([("v", None)], "version_id string, time_report string")
    changes = reports.withColumnRenamed("deck_id", "version_id").replace("d", "v", "version_id")
    once = C.update_time_reports(versions, changes)
    (row,) = C.update_time_reports(once, changes).collect()
    assert row.time_report == (
        '{"archivo":"f.pptx","grupos":{"g":{"ultima_diapositiva":2,"tiempo_total_seg":17,"tiempos_por_slide":{"10":7,"2":10},'
        '"historial_sesiones":{"1":{"planeado_seg":0,"duracion_seg":11,"tiempos_slide":{"10":7,"2":4}},'
        '"2":{"planeado_seg":30,"duracion_seg":6,"tiempos_slide":{"2":6}}}},'
        '"h":{"ultima_diapositiva":1,"tiempo_total_seg":5,"tiempos_por_slide":{"1":5},'
        '"historial_sesiones":{"1":{"planeado_seg":60,"duracion_seg":5,"tiempos_slide":{"1":5}}}}}}'
    )
