"""Metrics and scores at their thresholds."""

import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decklens.operators import calibrate as CAL
from decklens.operators import judge as J
from decklens.operators import metrics as M
from decklens.operators import score as SC
from decklens.operators import similarity as SIM

SLIDE = "deck_id string, slide_number int, title string, content array<string>, image_count int, image_only boolean"
JUDGED = (
    "deck_id string, slide_number int, judged_type string, hss_judged double, hss_feedback string, "
    "nts_judged double, nts_feedback string, judged_seconds int"
)


def slides(spark, rows):
    return spark.createDataFrame([(d, n, t, c, i, False) for d, n, t, c, i in rows], SLIDE)


def words(n):
    return " ".join(["palabra"] * n)


@pytest.fixture(scope="module")
def by_count(spark):
    counts = [0, 4, 5, 14, 15, 50, 51, 70, 71, 200, 300]
    df = SC.score_slides(slides(spark, [("d", n, "", [words(n)] if n else [], 0) for n in counts]))
    return {r.body_words: r for r in df.collect()}


def test_readability_needs_five_words(by_count):
    assert by_count[4].fsz is None and by_count[4].dl is None
    r = by_count[5]
    assert (r.words, r.syllables, r.sentences) == (5, 15, 1)
    assert r.fsz_raw == 206.835 - 62.3 * 3 - 5
    assert r.fsz == round(206.835 - 62.3 * 3 - 5, 2)
    assert r.cf == round((100 - (206.835 - 62.3 * 3 - 5)) / 100, 4)
    assert (r.dl, r.dln) == (100.0, 1.0)


def test_icd_needs_fifteen_words(by_count):
    assert by_count[14].icd is None and by_count[14].icd_status == "REVISAR"
    cf = round((100 - max(0, 206.835 - 62.3 * 3 - 15)) / 100, 4)
    assert by_count[15].icd == round((0.6 * cf + 0.4 * 1.0) * 10, 2)
    assert by_count[15].icd_zone == "muy complejo"


def test_wps_steps(by_count):
    assert [by_count[n].wps for n in (50, 51, 70, 71, 200, 300)] == [10.0, round(10 - 1 / 15, 2), round(10 - 20 / 15, 2), round(10 - 21 / 15, 2), 0.0, 0.0]
    assert [by_count[n].wps_zone for n in (50, 51, 70, 71)] == ["optima", "densa", "densa", "saturada"]
    assert by_count[50].wps_feedback is None and "(1 palabras de más)" in by_count[51].wps_feedback


def test_types_without_judge(by_count):
    assert by_count[4].slide_type == "sin_contenido" and by_count[4].hss is None
    assert by_count[5].slide_type == "contenido" and (by_count[5].hss, by_count[5].nts, by_count[5].seconds) == (5.0, 10.0, 10)


def test_score_counts_missing_icd_as_zero(by_count):
    expected = (0.0 * 0.30 + 10.0 * 0.30 + 5.0 * 0.25 + 10.0 * 0.15) / (0.30 + 0.30 + 0.25 + 0.15)
    assert by_count[14].slide_score == round(expected, 2)


def test_icd_normalised(spark):
    df = spark.createDataFrame([(x,) for x in (3.5, 3.49, 6.5, 6.51, 1.49, 8.51, 5.0, None)], "x double")
    got = [r.y for r in df.select(SC.icd_normalised(F.col("x")).alias("y")).collect()]
    assert got[:4] == [10.0, 10 - (3.5 - 3.49) * 5, 10.0, 10 - (6.51 - 6.5) * 5]
    assert got[4:] == [0.0, 0.0, 10.0, 0.0] or (got[4] < 0.0 + 1e-9 and got[5] < 1e-9 and got[6:] == [10.0, 0.0])


def test_icd_feedback_names_long_words(by_count, spark):
    text = by_count[15].icd_feedback
    assert text.startswith("El nivel de complejidad es alto (ICD: ") and "(por ejemplo: 'palabra')" in text
    easy = SC.score_slides(slides(spark, [("d", 1, "", ["el sol. " * 20], 0)])).first()
    assert easy.icd < 3.5 and easy.icd_feedback.startswith("El lenguaje utilizado es demasiado básico")


def test_type_gate_and_judge(spark):
    rows = [("d", 1, "", [words(14)], 1), ("d", 2, "", [words(15)], 1), ("d", 3, "", [words(4)], 0), ("d", 4, "T", [words(20)], 0), ("d", 5, "T", [words(20)], 0)]
    judged = spark.createDataFrame([
        ("d", 1, "contenido", 9.0, "x", 9.0, "x", 33), ("d", 2, "Portada", 9.0, "x", 9.0, "x", None),
        ("d", 4, None, 7.5, "bien", 4.0, None, 44), ("d", 5, "contenido", None, None, None, None, None),
    ], JUDGED)
    got = {r.slide_number: r for r in SC.score_slides(slides(spark, rows), judged).collect()}
    assert [got[n].slide_type for n in range(1, 6)] == ["visual", "portada", "sin_contenido", "contenido", "contenido"]
    assert [got[n].seconds for n in range(1, 6)] == [33, 10, 10, 44, 10]
    assert (got[1].hss, got[1].hss_label, got[2].nts_label) == (None, "no_aplica", "no_aplica")
    assert (got[4].hss, got[4].hss_label, got[4].hss_status, got[4].nts, got[4].nts_label, got[4].nts_status) == (7.5, "debil", "BIEN", 4.0, "debil", "MEJORAR")
    assert (got[5].hss, got[5].nts) == (5.0, 10.0)
    deck = SC.summarise_decks(SC.score_slides(slides(spark, rows), judged)).first()
    assert (deck.total_slides, deck.content_slides, deck.total_seconds, deck.total_time) == (5, 2, 107, "1m 47s")
    assert (deck.hss_avg, deck.hss_titled, deck.nts_avg) == (6.25, 2, 7.0)
    told = SC.combined_feedback(SC.score_slides(slides(spark, rows), judged).filter("slide_number = 4")).first().feedback
    assert told.startswith("ICD: El nivel") and told.endswith("| WPS: None | HSS: bien | NTS: ")


def test_deck_without_content(spark):
    deck = SC.summarise_decks(SC.score_slides(slides(spark, [("d", 1, "", ["hola"], 0)]))).first()
    assert (deck.deck_score, deck.deck_zone, deck.icd_avg, deck.hss_avg, deck.total_seconds) == (0.0, "deficiente", None, 0.0, 10)


def test_title_overlap(spark):
    got = M.title_overlap(slides(spark, [("d", 1, "Redes neuronales", ["las neuronales y redes"], 0), ("d", 2, "Otro", ["nada"], 0)])).orderBy("slide_number").collect()
    assert [r.overlap_text for r in got] == ["neuronales, redes", "Ninguno"]


def cosine(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    dot = sum(x[t] * y[t] for t in x)
    return dot / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values())) if dot else 0.0


def test_cosine(spark):
    texts = ["redes datos datos", "datos nube", "", "otra cosa", "otra cosa", "nube"]
    rows = [("a", i + 1, "", [t], 0) for i, t in enumerate(texts)] + [("b", 1, "datos", [], 0)]
    got = {(r.deck_id, r.slide_number): r for r in SIM.previous_similarity(slides(spark, rows)).collect()}
    assert len(got) == 7
    for i in range(1, 6):
        assert got["a", i + 1].sim_previous == round(cosine(texts[i - 1], texts[i]), 4)
    assert got["a", 1].sim_previous is None and got["a", 1].sim_average == 1.0 and got["b", 1].sim_average == 1.0
    assert got["a", 5].sim_previous == 1.0 and got["a", 3].sim_average == 0.0


@pytest.mark.parametrize("block,batch", [(1, 3), (4, 1), (4, 7), (64, 10_000)])
def test_cosine_over_blocks_and_batches(spark, block, batch):
    import random

    rng = random.Random(block * batch)
    rows = [(d, n, "", [" ".join(rng.choices(["red", "nube", "dato", "ñandú", "otra"], k=rng.randrange(6)))], 0) for d in ("a", "b", None) for n in range(-2, 40) if n != 17]
    rows.append(("a", 5, "", ["red"], 0))  # a number used twice is one slide
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {(r.deck_id, r.slide_number): r for r in SIM.previous_similarity(slides(spark, rows), block).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    texts = {}
    for d, n, _, (t,), _ in rows:
        texts[d, n] = (texts.get((d, n), "") + " " + t).strip()
    assert set(got) == set(texts)
    for (d, n), r in got.items():
        want = round(cosine(texts[d, n - 1], texts[d, n]), 4) if (d, n - 1) in texts else None
        assert r.sim_previous == want and r.sim_average == (1.0 if want is None else want), (d, n)


def test_cosine_shuffles_no_text(spark):
    """Exchanges carry hashed terms, and few slides are sent twice."""
    plan = SIM.previous_similarity(slides(spark, [("a", 1, "t", ["x"], 0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    below = plan.split("Exchange hashpartitioning")[0]
    assert "content" not in below and "title" not in below


def test_term_frequency(spark):
    got = {(r.slide_number, r.term): (r.n, r.tf) for r in SIM.term_frequency(slides(spark, [("a", 1, "Red red", ["de datos"], 0)])).collect()}
    assert got == {(1, "red"): (2, 2 / 3), (1, "datos"): (1, 1 / 3)}


def test_terms_are_counted_in_their_row(spark):
    """A task held the terms of all its slides; rows that share a number are still counted together."""
    rows = [("a", 1, "", ["uno dos uno"], 0), ("a", 1, "", ["uno tres"], 0), ("a", 2, "", ["dos dos"], 0), (None, 1, "", ["mesa"], 0), ("b", 1, "", ["de"], 0)]
    found = SIM.term_frequency(slides(spark, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "(rows#" in plan.split("Aggregate [")[1]
    assert {(r.deck_id, r.slide_number, r.term): (r.n, r.tf) for r in found.collect()} == {
        ("a", 1, "uno"): (3, 0.6), ("a", 1, "dos"): (1, 0.2), ("a", 1, "tres"): (1, 0.2), ("a", 2, "dos"): (2, 1.0), (None, 1, "mesa"): (1, 1.0)}


def parsed(documents):
    return {r.deck_id: json.loads(r.result) for r in documents.collect()}


def test_documents(spark):
    rows = [("d", n, 't "q" ñ', [words(20)], 0) for n in range(1, 8)] + [("e", 1, "", ["x"], 0)]
    docs = parsed(SC.deck_documents(SC.score_slides(slides(spark, rows))))
    assert set(docs) == {"d", "e"} and docs["e"]["slides"][0]["metricas"] is None and docs["e"]["slides"][0]["omitida"]
    d = docs["d"]
    assert [s["slide_number"] for s in d["slides"]] == list(range(1, 8)) and d["total_diapositivas"] == 7
    g = d["score_global_presentacion"]
    assert g["pesos"] == {"icd": 0.3, "wps": 0.3, "hss": 0.25, "nts": 0.15}
    assert g["desglose"] == {f"{k}_pond": round(v * g["pesos"][k], 3) for k, v in g["scores_metrica"].items()}
    assert g["score_global"] == round(sum(g["desglose"].values()), 2)


@pytest.mark.parametrize("partitions", [2, 7])
def test_a_large_deck_is_one_document(spark, partitions):
    """2,000 slides of one deck, over several partitions and between small decks."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = [("m", n, "t", [f"palabra número {n}"], 0) for n in range(1, 2001)] + [(f"{c}{i}", n, "t", ["x"], 0) for c in "az" for i in range(30) for n in (1, 2)]
        scored = SC.score_slides(slides(spark, rows))
        whole = SC.deck_documents(scored)
        assert "collect_list" not in whole._jdf.queryExecution().optimizedPlan().toString()
        docs = parsed(whole)
        assert len(docs) == 61 and [s["slide_number"] for s in docs["m"]["slides"]] == list(range(1, 2001))
        assert all(len(d["slides"]) == d["total_diapositivas"] for d in docs.values())
        payload = {r.deck_id: json.loads(r.batch_data) for r in J.judge_payload(slides(spark, rows)).collect()}
        assert len(payload) == 61 and [e["slide_number"] for e in payload["m"]] == list(range(1, 2001))
        trees = spark.createDataFrame([("m", "[1]"), ("none", "[2]")], "deck_id string, temario string")
        calls = J.judge_payload(slides(spark, rows), trees, call_slides=600).filter("deck_id = 'm'").orderBy("call").collect()
        assert [len(json.loads(r.batch_data)) for r in calls] == [600, 600, 600, 200] and {r.temario for r in calls} == {"[1]"}
        rewrite = J.restructure_payload(SC.combined_feedback(scored.withColumn("is_content", F.lit(True))))
        assert {r.deck_id: len(json.loads(r.batch_data)) for r in rewrite.collect()}["m"] == 2000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


@pytest.mark.parametrize("values", [[1.0, 2.0], [5.0, 1.0, 9.0], [1.5] * 7, [float(i * 37 % 5000) for i in range(4001)], [-300.25, 7.0, 7.01, 2000.0, 99999.5]])
def test_quartiles_equal_statistics_module(spark, values):
    import statistics

    df = spark.createDataFrame([("m", v) for v in values] + [("m", None), ("one", 1.0)], "metric string, v double")
    got = CAL.exclusive_quartiles(df, 100).collect()
    q = [round(x, 2) for x in statistics.quantiles(values, n=4)]
    assert len(got) == 1
    r = got[0]
    assert [r.q1, r.median, r.q3] == q and (r.lowest, r.highest, r.sample_size) == (min(values), max(values), len(values))


def test_kept_counts_equal_the_whole(spark):
    """Three batches and one delete, against quartiles over what is left."""
    from random import Random

    rng = Random(2)
    rows = [(d, m, rng.choice([None, round(rng.uniform(-50, 50), 2)])) for d in range(40) for m in "ab" for _ in range(30)]
    df = spark.createDataFrame(rows, "deck int, metric string, v double")
    state = CAL.value_counts(df.filter("deck < 10"), 100)
    for low in (10, 25):
        state = CAL.merged_counts(state, CAL.value_counts(df.filter(f"deck >= {low} and deck < {10 * low // 10 + 15}"), 100))
    gone = "deck in (3, 17, 39)"
    state = CAL.merged_counts(state, removed=CAL.value_counts(df.filter(gone), 100))
    want = CAL.exclusive_quartiles(df.filter(f"not ({gone})"), 100)
    assert sorted(CAL.quartiles_of_counts(state, 100).collect()) == sorted(want.collect())
    with pytest.raises(Exception, match="had not been counted"):
        CAL.merged_counts(state, removed=CAL.value_counts(df.filter("deck = 3"), 100)).count()


def test_scores_stay_in_range(spark):
    from decklens.plans import tables as T

    got = SC.score_slides(T.slides(spark, "/root/testdata/sf0.001")).agg(
        F.min("slide_score").alias("a"), F.max("slide_score").alias("b"), F.min("icd").alias("c"), F.max("icd").alias("d"),
        F.min("fsz").alias("e"), F.max("fsz").alias("f"),
    ).first()
    assert 0 <= got.a <= got.b <= 10 and 0 <= got.c <= got.d <= 10 and 0 <= got.e <= got.f <= 100


def test_sparse_numbers_lose_nothing(spark):
    rows = [("d", n, "t", [words(20)], 0) for n in (0, 1, 499, 500, 501, 70_000)] + [("e", 9_000_000, "t", [words(20)], 0)]
    docs = parsed(SC.deck_documents(SC.score_slides(slides(spark, rows))))
    assert sorted((d, s["slide_number"]) for d, r in docs.items() for s in r["slides"]) == sorted((r[0], r[1]) for r in rows)
    again = SIM.renumbered(slides(spark, rows)).select("deck_id", F.col("place").alias("slide_number"), "title", "content")
    sims = {(r.deck_id, r.slide_number): r.sim_previous for r in SIM.previous_similarity(again).collect()}
    assert sims == {("d", 1): None, **{("d", n): 1.0 for n in range(2, 7)}, ("e", 1): None}


def test_one_hot_deck_is_spread(spark):
    """A deck with a third of all slides: no partition of the text shuffle holds much more than its share."""
    df = spark.range(3000).select(
        F.when(F.col("id") < 1000, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("deck_id"),
        F.when(F.col("id") < 1000, F.col("id")).otherwise(F.floor(F.col("id") / 500)).cast("int").alias("slide_number"),
        F.lit("red datos").alias("title"), F.array(F.lit("nube")).alias("content"),
    )
    assert SIM.previous_similarity(df).count() == 3000
    placed = df.repartition(8, "deck_id", "slide_number").groupBy(F.spark_partition_id()).count()
    assert max(r[1] for r in placed.collect()) < 3000 / 8 * 1.5
