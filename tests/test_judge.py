"""Judge exchange: parsing of good and broken answers, payloads, rewriting, coverage."""

import json

import pytest
from pyspark.sql import functions as F

from decklens.operators import judge as J
from decklens.operators import score as SC

SLIDE = "deck_id string, slide_number int, title string, content array<string>, image_count int, image_only boolean"


def responses(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "deck_id string, response string")


def entry(n, **more):
    return {"slide_number": n, "tipo": "contenido", **more}


def test_parse_judge(spark):
    good = json.dumps({"diapositivas": [entry(1, hss_score=8, tiempo_estimado_segundos=30), entry(2, hss_score="7.5"), entry(1, hss_score=3)],
                       "temas_presentacion": [{"unidad": "U", "temas": [{"tema": "T", "subtemas": ["S"]}]}]})
    raw = '{"diapositivas": [{"slide_number": 4, "tipo": "Visual", "hss_feedback": "a\tb\n\nc"}]}'
    df = responses(spark, good="Claro:\n" + good + "\nfin {no", raw=raw, cut=good[:60], none="nada", empty="", partial='{"diapositivas": []}')
    # text after the last brace is ignored, but an open brace after it is not part of the match
    got = {(r.deck_id, r.slide_number): r for r in J.parse_judge(df).collect()}
    assert set(got) == {("good", 1), ("good", 2), ("raw", 4)}
    assert (got["good", 1].hss_judged, got["good", 1].judged_seconds) == (3.0, None)
    assert got["good", 2].hss_judged == 7.5
    assert got["raw", 4].hss_feedback == "a b c"
    topics = {r.deck_id: r.temas_presentacion for r in J.parse_topics(df).collect()}
    assert topics["good"][0].temas[0].subtemas == ["S"] and topics["cut"] == [] and topics["none"] == []


def test_parse_restructure(spark):
    one = [{"slide_number": 1, "preguntas": ["p"], "datos_curiosos": [], "diapositivas_generadas": [{"titulo_sugerido": "t", "contenido_optimizado": "c"}]}]
    df = responses(spark, a="x [1] y " + json.dumps(one) + " z", b="[]", c=json.dumps(one + [{"slide_number": 1, "preguntas": ["q"]}]))
    got = {r.deck_id: r for r in J.parse_restructure(df).collect()}
    assert set(got) == {"a", "c"} or set(got) == {"c"}
    assert got["c"].questions == ["q"] and got["c"].generated is None


@pytest.fixture(scope="module")
def scored(spark):
    rows = [("d", 1, "Uno", [" ".join(["palabra"] * 20)], 0, False), ("d", 2, "Dos", ["corto"], 0, False), ("d", 3, "", [" ".join(["texto"] * 130)], 0, False)]
    return SC.score_slides(spark.createDataFrame(rows, SLIDE))


def test_enrich_and_recommend(spark, scored):
    gen = "array<struct<titulo_sugerido:string,contenido_optimizado:string,tipo_retorico_aplicado:string>>"
    material = spark.createDataFrame(
        [("d", 1, ["p"], None, [("a", "b", "x"), ("c", None, "x")]), ("d", 2, ["p"], ["f"], [("a", "b", "x")]), ("d", 3, None, None, [])],
        f"deck_id string, slide_number int, questions array<string>, facts array<string>, generated {gen}",
    )
    got = {r.slide_number: r for r in J.enrich_slides(scored, material).collect()}
    assert (got[1].questions, got[1].facts, len(got[1].generated)) == (["p"], [], 2)
    assert (got[2].questions, got[2].generated) == (None, None)
    assert (got[3].questions, got[3].generated) == ([], None)
    rec = J.recommendations(J.enrich_slides(scored, material)).orderBy("option").collect()
    assert [r.heading for r in rec] == ["Diapositiva 1: a", "Diapositiva 2: c"] and rec[0].advice.endswith("en 2 diapositivas:") and rec[1].body == ""
    shown = J.support_material(J.enrich_slides(scored, material), spark.createDataFrame([("d", 2)], "deck_id string, slide_number int")).collect()
    assert [(r.questions, r.facts) for r in shown] == [([], [])]


def test_payloads(spark, scored):
    batch = json.loads(J.restructure_payload(SC.combined_feedback(scored)).first().batch_data)
    assert [b["slide_number"] for b in batch] == [1, 3] and "WPS" in batch[1]["feedback_a_corregir"]
    syllabus = spark.createDataFrame([("d", '[{"unidad":"U"}]')], "deck_id string, temario string")
    row = J.judge_payload(scored.select("deck_id", "slide_number", "title", "content"), syllabus).first()
    told = json.loads(row.batch_data)
    assert [t["titulo"] for t in told] == ["Uno", "Dos", "[SIN TÍTULO]"] and row.temario == '[{"unidad":"U"}]'
    assert told[0]["hss_diagnostico"]["solapamiento_lexico"] == "Ninguno" and told[0]["nts_diagnostico"]["similitud_coseno"] == 1.0
    assert len(told[2]["contenido_truncado"]) == 403


def test_bands_and_time(spark, scored):
    got = {r.slide_number: (r.min_slides, r.max_slides) for r in J.restructure_band(scored).collect()}
    assert got[1] == (1, 1) and got[3] == (1, 4)
    df = spark.createDataFrame([("contenido", 130), ("portada", 130)], "t string, w int")
    assert [r.s for r in df.select(J.estimated_seconds(F.col("t"), F.col("w")).alias("s")).collect()] == [72, 10]


def test_generated_limits(spark):
    ok = "Una red conecta equipos para que compartan datos de manera segura. " * 3
    df = spark.createDataFrame([("Qué es una red", ok), ("Red", "La pedagogía. " + ok)], "title string, body string")
    a, b = J.check_generated(df).collect()
    assert (a.words_ok, a.sentences_ok, a.sentence_length_ok, a.title_ok, a.terms_ok) == (True,) * 5
    assert (b.title_ok, b.terms_ok) == (False, False)


def test_coverage(spark):
    official = spark.createDataFrame([("s", "U1", "T1", "S1"), ("s", "U1", "T2", None), ("s", "U2", None, None)], "subject_id string, unit string, topic string, subtopic string")
    covered = spark.createDataFrame([("d", "U1", "T1", "S1"), ("d", "U1", "T1", "S9"), ("d", "U1", "T2", None), ("d", "U2", None, None), ("d", "U9", None, None)], "deck_id string, unit string, topic string, subtopic string")
    decks = spark.createDataFrame([("d", "s")], "deck_id string, subject_id string")
    checked = J.check_coverage(covered, decks, official)
    assert {(r.unit, r.topic, r.subtopic): r.official for r in checked.collect()} == {
        ("U1", "T1", "S1"): True, ("U1", "T1", "S9"): False, ("U1", "T2", None): True, ("U2", None, None): True, ("U9", None, None): False}
    ratio = J.unit_coverage(checked, official).collect()
    assert [(r.unit, r.covered, r.topics, r.ratio) for r in ratio] == [("U1", 2, 2, 1.0)]


def test_callback_is_called_for_unsure_slides_only(spark):
    from decklens.operators import classify as CL

    # 22 words below a short title fire no rule
    rows = [("d", n, "Uno" if n % 2 else "Índice", [" ".join(["palabra"] * 22)], 0, False) for n in range(1, 101)]
    ruled = CL.classifier_rules(CL.classifier_features(spark.createDataFrame(rows, SLIDE).repartition(3)))
    unsure = {r.slide_number for r in ruled.filter("rule_confidence < 0.6").collect()}
    assert 10 < len(unsure) < 90
    calls, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def judge(batch):
        calls.add(1)
        asked.add(batch.num_rows)
        numbers = batch.column("slide_number").to_pylist()
        assert batch.schema.names == ["slide_number", "title"] and set(numbers) <= unsure
        if 50 in numbers or 51 in numbers:
            raise ConnectionError("no model")
        return ["cita" if n < 50 else "nonsense" for n in numbers]

    got = {r.slide_number: r for r in CL.classifier_callback(ruled, judge, ("slide_number", "title"), 1).collect()}
    assert calls.value == asked.value == len(unsure)
    judged = spark.createDataFrame([("d", n, "cita") for n in unsure if n < 50], "deck_id string, slide_number int, judged_type string")
    want = {r.slide_number: r for r in CL.classifier_decision(ruled, judged).collect()}
    for n, r in want.items():
        assert (got[n].type, got[n].confidence, got[n].method, got[n].excluded, got[n].rules_fired) == (r.type, r.confidence, r.method, r.excluded, r.rules_fired)
    failed = min(n for n in unsure if n >= 50)
    assert (got[failed].type, got[failed].confidence, got[failed].method) == ("contenido", 0.5, "fallback_contenido")
    # A call that fails or answers too little stands for its own slides only.
    short = CL.classifier_callback(ruled.coalesce(1), lambda b: ["cita"] * (b.num_rows - (b.num_rows < 7)), ("title",), 7).collect()
    methods = [r.method for r in short if r.slide_number in unsure]
    assert methods.count("fallback_contenido") == len(unsure) % 7
    assert CL.classifier_callback(ruled.limit(0), judge, ("slide_number", "title")).count() == 0


def test_border_pass_writes_borders_only(spark):
    """The pass for the borders of partitions wrote all texts, to be filtered later."""
    from pyspark.sql import functions as F

    from decklens.operators import folded

    rows = spark.range(400).select(F.expr("cast(id div 4 as string) k"), F.col("id").alias("o"), F.expr("cast(id as string) entry"))
    body = rows.select("k", "o", F.lit(None).cast("string").alias("head"), "entry", F.lit(1).cast("long").alias("n"))
    placed = body.repartitionByRange(4, "k", "o").sortWithinPartitions("k", "o")
    ends, rest = ([r.text for r in folded._pass(placed, ["k"], "+", b).collect()] for b in (True, False))
    assert 4 <= len(ends) <= 8 and sum(t.count("+") + 1 for t in ends + rest) == 400
    whole = {r.k: r.text for r in folded.fold_text(rows, ["k"], ["o"], separator="+").collect()}
    assert whole == {str(k): "+".join(str(4 * k + i) for i in range(4)) for k in range(100)}
