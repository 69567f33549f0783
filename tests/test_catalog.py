"""Catalogue operations on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from decklens import schemas as S
from decklens.operators import catalog as C
from decklens.operators import ordered as O
from decklens.sources import analysis as AN
from decklens.sources import files as FI
from decklens.sources import slides as SL
from decklens.sources import syllabus as SY

FILES = "file_id bigint, arrival bigint, length bigint, hash string, total_slides int, subject_id string, file_name string"
MB = 1024 * 1024


@pytest.fixture(scope="module")
def t(spark):
    day = dt.date(2024, 1, 1)
    versions = [(f"v{d}{n}", d, n, 0, day, 5, f"h{d}{n}", f"{d}{n}.pptx", f"{d}{n}.png", None, None, None, None) for d, n in [("a", 1), ("a", 2), ("a", 3), ("b", 1)]]
    return {
        "subjects": spark.createDataFrame([("s1", "Cálculo", 1), ("s2", "Redes", 0)], S.SUBJECTS),
        "decks": spark.createDataFrame([("a", "s1", "a.pptx"), ("b", "s2", "b.pptx"), ("c", "s1", "c.pptx")], S.DECKS),
        "versions": spark.createDataFrame(versions, S.VERSIONS),
        "analyses": spark.createDataFrame([("va1", 0, "x"), ("vb1", 0, "y")], S.ANALYSES),
        "links": spark.createDataFrame([("a", "q"), ("b", "q")], "deck_id string, subtopic_id string"),
    }


def test_gate_order_and_copies(spark, t):
    rows = [
        (1, 1, 30 * MB, "new", 3, "s1", "x.tar.pptx"), (2, 2, 30 * MB + 1, "big", 3, "s1", "y.pptx"), (3, 3, 10, "ha2", 3, "s2", "z.pptx"),
        (4, 4, 10, "none", 0, "s1", "n.pptx"), (5, 5, 10, "none", 0, "s1", "n2.pptx"), (6, 6, 30 * MB, "new", 3, "s2", "x2.pptx"),
        (7, 7, 10, "other", 1, "s9", "o.pptx"),
    ]
    decks, versions, rejected = C.register_decks(spark.createDataFrame(rows, FILES), t["subjects"], t["versions"], F.lit("2024-05-05").cast("date"))
    assert {r.file_id: r.reason for r in rejected.collect()} == {2: "too_large", 3: "duplicate", 4: "no_slides", 5: "no_slides", 6: "duplicate", 7: "no_subject"}
    v = versions.collect()
    assert [(x.version, x.analysed, x.path, x.pdf_path, x.thumb_path) for x in v] == [
        (1, 0, "presentaciones/Cálculo/x.tar.pptx", "presentaciones/Cálculo/x.tar.pdf", "presentaciones/Cálculo/x.tar_thumb.png")]
    assert [r.file_name for r in decks.collect()] == ["x.tar.pptx"]


def test_append_versions_numbers_a_batch(spark, t):
    rows = [(i, i, 10, f"n{i}", 2, "a" if i % 2 else "b", f"f{i}.pptx") for i in range(1, 8)] + [(9, 9, 10, "q", 2, "c", "c.pptx"), (10, 10, 10, "hb1", 2, "a", "d.pptx")]
    files = spark.createDataFrame(rows, FILES.replace("subject_id", "deck_id"))
    new, rejected = C.append_versions(files, t["decks"], t["versions"], t["subjects"], F.lit("2024-05-05").cast("date"), block=2)
    got = sorted((r.deck_id, r.version, r.path) for r in new.collect())
    assert got == [("a", 4, "presentaciones/Cálculo/f1_v4.pptx"), ("a", 5, "presentaciones/Cálculo/f3_v5.pptx"), ("a", 6, "presentaciones/Cálculo/f5_v6.pptx"),
                   ("a", 7, "presentaciones/Cálculo/f7_v7.pptx"), ("b", 2, "presentaciones/Redes/f2_v2.pptx"), ("b", 3, "presentaciones/Redes/f4_v3.pptx"), ("b", 4, "presentaciones/Redes/f6_v4.pptx")]
    assert {r.file_id: r.reason for r in rejected.collect()} == {9: "no_deck", 10: "duplicate"}


def test_lookups(spark, t):
    assert [r.name for r in C.active_subjects(t["subjects"]).collect()] == ["Cálculo"]
    assert [r.name for r in C.available_subjects(t["subjects"]).collect()] == ["Redes"]
    assert [r.name for r in C.search_subjects(t["subjects"], "calculo").collect()] == ["Cálculo"]
    asked = spark.createDataFrame([("s1", "a.pptx"), ("s1", "c.pptx"), ("s2", "zz")], "subject_id string, file_name string")
    assert {(r.file_name, r.deck_id, r.version) for r in C.id_and_max_version(asked, t["decks"], t["versions"]).collect()} == {("a.pptx", "a", 3), ("c.pptx", None, 0), ("zz", None, 0)}
    assert {(r.file_name, r.path) for r in C.latest_by_subject(t["decks"], t["versions"]).collect()} == {("a.pptx", "a3.pptx"), ("b.pptx", "b1.pptx")}
    assert [r.version for r in C.version_history(t["decks"], t["versions"]).filter("deck_id = 'a'").collect()] == [3, 2, 1]
    assert C.subject_file_paths(t["decks"], t["versions"]).filter("subject_id = 's1'").count() == 6


def test_updates(spark, t):
    marked = C.mark_latest_analysed(t["versions"], t["decks"].filter("deck_id = 'a'"))
    assert {r.version_id for r in marked.filter("analysed = 1").collect()} == {"va3"}
    scores = spark.createDataFrame([("va1", 7.5, "bueno")], "version_id string, score double, zone string")
    assert {(r.version_id, r.score, r.zone) for r in C.update_scores(t["versions"], scores).filter("score is not null").collect()} == {("va1", 7.5, "bueno")}
    new = spark.createDataFrame([("va1", "new"), ("va2", "new")], "version_id string, result string")
    assert {(r.version_id, r.result) for r in C.upsert_analyses(t["analyses"], new).collect()} == {("va1", "new"), ("va2", "new"), ("vb1", "y")}
    assert C.add_column_if_missing(t["versions"]).columns == t["versions"].columns
    assert C.add_column_if_missing(t["versions"].drop("pdf_path")).columns[-1] == "pdf_path"


def test_cascades(spark, t):
    decks, versions, analyses, links, paths = C.delete_decks(t["decks"].filter("deck_id = 'a'").select("deck_id"), t["decks"], t["versions"], t["analyses"], t["links"])
    assert [x.count() for x in (decks, versions, analyses, links, paths)] == [2, 1, 1, 1, 6]
    subjects, decks, versions, analyses, links, _ = C.delete_subjects(["Cálculo"], t["subjects"], t["decks"], t["versions"], t["analyses"], t["links"])
    assert [x.count() for x in (decks, versions, analyses, links)] == [1, 1, 1, 1] and C.active_subjects(subjects).count() == 0


def test_syllabus_tree(spark):
    nested = spark.createDataFrame([
        ("Redes", [(2, "Datos", [(1, "Protocolos", [(2, "b"), (1, "a")]), (2, "Señales", [])]), (1, "Vacía", [])]), ("Vieja", [(1, "x", [])]),
    ], S.SYLLABUS)
    stored = spark.createDataFrame([("s", "Vieja", 1)], S.SUBJECTS)
    subjects, units, topics, subtopics = SY.load_syllabus(nested, stored)
    assert [x.count() for x in (subjects, units, topics, subtopics)] == [1, 2, 2, 2]
    labels = C.syllabus_labels(subjects, units, topics, subtopics)
    assert {(r.unit, r.topic, r.subtopic) for r in labels.collect()} == {
        ("Unidad Temática 1. Vacía", None, None), ("Unidad Temática 2. Datos", "2.1 Protocolos", "2.1.1 a"),
        ("Unidad Temática 2. Datos", "2.1 Protocolos", "2.1.2 b"), ("Unidad Temática 2. Datos", "2.2 Señales", None)}
    tree = {r.unit: r.topics for r in C.syllabus_tree(labels).collect()}
    assert tree["Unidad Temática 1. Vacía"] == []
    assert [(x.topic, x.subtopics) for x in tree["Unidad Temática 2. Datos"]] == [("2.1 Protocolos", ["2.1.1 a", "2.1.2 b"]), ("2.2 Señales", [])]


def test_syllabus_map(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"Unidad 1": {"1.1": "uno"}, "Unidad 2": {"2.2.1": "dos"}}, indent=2), encoding="utf-8")
    rows = SY.syllabus_map_rows(SY.read_syllabus_map(spark, str(tmp_path))).collect()
    assert {(r.unit, r.number, r.name, r.level) for r in rows} == {("Unidad 1", "1.1", "uno", 1), ("Unidad 2", "2.2.1", "dos", 2)}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_blocks_give_the_window_result(spark, block):
    rows = [("k" if i % 3 else "hot", i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    cut = F.floor(F.col("v") / block)
    n = {(r.k, r.v): r.number for r in O.dense_number(df, ["k"], ["v"], cut).collect()}
    after = {(r.k, r.v): r.next for r in O.next_value(df, ["k"], "v", cut).collect()}
    for key in ("k", "hot"):
        ordered = sorted(v for k, v in rows if k == key)
        assert [n[key, v] for v in ordered] == list(range(1, len(ordered) + 1))
        assert [after[key, v] for v in ordered] == ordered[1:] + [None]


def test_files(spark, tmp_path):
    sub = tmp_path / "a" / "b"
    sub.mkdir(parents=True)
    (sub / "x.pptx").write_bytes(b"abc")
    (tmp_path / "y.pptx").write_bytes(b"y")
    (tmp_path / "z.txt").write_bytes(b"no")
    assert {(r.path.split("/")[-1], r.length) for r in FI.scan_files(spark, str(tmp_path)).collect()} == {("x.pptx", 3), ("y.pptx", 1)}
    hashes = {r.path.split("/")[-1]: r.hash for r in FI.fingerprint_files(spark, str(tmp_path)).collect()}
    assert hashes["x.pptx"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    gate = FI.size_gate(spark.createDataFrame([(30 * MB,), (30 * MB + 1,), (31 * MB + MB // 2,)], "length bigint")).collect()
    assert [r.accepted for r in gate] == [True, False, False]
    assert gate[2].message == "El archivo es demasiado pesado (31.50MB). El límite es 30MB."


def test_deck_source_and_counts(spark, tmp_path):
    deck = {"deck_id": "d", "filename": "d.pptx", "total_slides": 2, "slides": [{"title": "T", "content": ["a"], "images": ["i"]}, {"slide_number": 2}]}
    (tmp_path / "d.json").write_text(json.dumps(deck), encoding="utf-8")
    slides = SL.read_slides(spark, str(tmp_path)).orderBy("slide_number").collect()
    assert [(s.slide_number, s.title, s.content, s.image_count) for s in slides] == [(1, "T", ["a"], 1), (2, "", [], 0)]
    decks = spark.createDataFrame([("d",), ("empty",)], "deck_id string")
    assert [r.deck_id for r in SL.without_slides(decks, SL.slide_count(SL.read_slides(spark, str(tmp_path)))).collect()] == ["empty"]


def test_broken_analysis_is_empty(spark):
    df = spark.createDataFrame([("a", "{broken"), ("b", None), ("c", '{"slides":[{"slide_number":1,"tipo":"contenido"}]}')], "deck_id string, result string")
    assert [r.deck_id for r in AN.stored_slides(df).collect()] == ["c"]


def test_document_adapter(spark):
    df = spark.createDataFrame([(1, "Título\na\n\n b \nc\nd\ne"), (2, " \n "), (3, " ".join(["w"] * 26)), (4, "x" * 181)], "doc_id int, text string")
    got = {(r.deck_id, r.slide_number): (r.title, r.content) for r in SL.slides_from_documents(df).collect()}
    assert got == {(1, 1): ("Título", ["a", "b"]), (1, 2): ("c", ["d", "e"]), (3, 1): ("", [" ".join(["w"] * 26)]), (4, 1): ("", ["x" * 181])}


def test_history_of_asked_decks(spark):
    decks = spark.createDataFrame([("a", "x"), ("b", "y")], "deck_id string, file_name string")
    versions = spark.createDataFrame(
        [("a", 1), ("b", 1), ("b", 2)], "deck_id string, version int"
    ).selectExpr("*", "date'2024-01-01' AS loaded", "3 AS total_slides", "0 AS analysed", "'p' AS pdf_path")
    asked = spark.createDataFrame([("b",), ("b",), ("z",)], "deck_id string")
    assert [(r.deck_id, r.version) for r in C.version_history(decks, versions, asked).collect()] == [("b", 2), ("b", 1)]
    assert C.version_history(decks, versions).count() == 3


def test_loaded_levels_are_not_broadcast(spark, tmp_path):
    from decklens import plans

    customers = [(k, f"C{k}", 1, "BUILDING") for k in range(1, 5)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    loaded = plans.QUERIES["A14_syllabus_load"](spark, str(tmp_path))
    inner = [line for line in loaded._jdf.queryExecution().executedPlan().toString().splitlines() if "Inner" in line]
    assert inner and all("SortMergeJoin" in line for line in inner)
    assert {r.subject for r in loaded.collect()} == {"C1", "C2", "C3", "C4"}
