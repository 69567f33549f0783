"""Shape assembly and the rule classifier."""

from pyspark.sql import functions as F

from decklens.operators import assemble as A
from decklens.operators import classify as CL

SHAPE = (
    "shape_type string, is_title boolean, is_placeholder boolean, has_image boolean, name string, text string, "
    "top bigint, run_sizes array<int>"
)
ROW = f"deck_id string, slide_number int, slide_height bigint, shapes array<struct<{SHAPE.replace(' string', ':string').replace(' boolean', ':boolean').replace(' bigint', ':bigint').replace(' array', ':array')}>>"


def shape(text=None, top=500, kind="TEXT_BOX", title=False, name="box", sizes=(), placeholder=False, image=False):
    return (kind, title, placeholder, image, name, text, top, list(sizes))


def assemble(spark, *shapes):
    df = spark.createDataFrame([("d", 1, 1000, list(shapes))], ROW)
    return A.assemble_slides(df).first()


def test_title_placeholder_is_not_repeated(spark):
    r = assemble(spark, shape("Redes", 50, title=True), shape("Redes", 400), shape("a\n\n b ", 500), shape(" ", 500))
    assert (r.title, r.content, r.footer, r.image_count, r.image_only) == ("Redes", ["a \n b"], [], 0, False)


def test_best_candidate_becomes_title(spark):
    r = assemble(
        spark, shape("cuerpo", 600), shape("chico", 10, sizes=[12]), shape("grande abajo", 200, sizes=[None, 30]),
        shape("grande arriba", 100, sizes=[30]), shape("sin tamaño", 20),
    )
    assert r.title == "grande arriba"
    assert r.content == ["cuerpo", "grande abajo", "chico", "sin tamaño"]


def test_equal_candidates_keep_drawing_order(spark):
    r = assemble(spark, shape("uno", 100, sizes=[10]), shape("dos", 100, sizes=[10]))
    assert (r.title, r.content) == ("uno", ["dos"])


def test_long_candidate_is_content(spark):
    long = " ".join(["a"] * 26)
    r = assemble(spark, shape("x", 249), shape(long, 100, sizes=[40]))
    assert (r.title, r.content) == ("", [long, "x"])
    wide = "a" * 181
    assert assemble(spark, shape(wide, 100)).title == ""
    assert assemble(spark, shape("a" * 180, 100)).title == "a" * 180


def test_zone_limits(spark):
    r = assemble(spark, shape("al borde", 250), shape("arriba", 249))
    assert (r.title, r.content) == ("arriba", ["al borde"])
    six, seven = "uno dos tres cuatro cinco seis", "uno dos tres cuatro cinco seis siete"
    r = assemble(spark, shape("T", 10, title=True), shape(six, 749), shape(six, 750), shape(seven, 750), shape(seven, 850), shape(" ".join(["a"] * 26), 900))
    assert r.footer == [six, seven] and r.content == [six, seven, " ".join(["a"] * 26)]


def test_footer_metadata(spark):
    base = "aa bb cc dd ee ff gg "
    texts = {
        base + "Universidad": True, base + "ENERO": True, base + "12/3/2024": True, base + "CS101": True, base + "ACS10": False,
        base + "profesora": False, base + "universidades": False,
    }
    df = spark.createDataFrame([(t, e) for t, e in texts.items()], "t string, e boolean")
    got = df.select("e", A.is_footer(F.col("t"), F.lit(8), F.lit(0.8)).alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]
    assert not df.select(A.is_footer(F.lit("Universidad"), F.lit(16), F.lit(0.8)).alias("g")).first().g


def test_decorative_numbers(spark):
    cases = [("7", "box", 0.049, True), ("7", "box", 0.05, False), ("7", "box", 0.90, False), ("7", "box", 0.901, True),
             ("7", "Slide Number 3", 0.5, True), ("123", "PAGE", 0.5, True), ("1234", "page", 0.01, False), ("7a", "page", 0.01, False)]
    df = spark.createDataFrame(cases, "t string, n string, r double, e boolean")
    got = df.select("e", A.is_decorative_number(F.col("t"), F.col("n"), F.col("r")).alias("g")).collect()
    assert [r.g for r in got] == [r.e for r in got]
    r = assemble(spark, shape("12", 10, title=True), shape("otro", 300))
    assert (r.title, r.content) == ("", ["otro"])


def test_images(spark):
    r = assemble(spark, shape(kind="PICTURE", name="foto"), shape("celda", kind="TABLE", name=None), shape(kind="PLACEHOLDER", placeholder=True, image=True, name="p"))
    assert (r.images, r.image_count, r.image_only, r.content) == (["foto", "Tabla_o_Imagen", "p"], 3, True, [])


def test_groups_in_order(spark):
    leaf = SHAPE.replace(" string", ":string").replace(" boolean", ":boolean").replace(" bigint", ":bigint").replace(" array", ":array")
    schema = f"gs array<struct<{leaf},children:array<struct<{leaf},children:array<struct<{leaf}>>>>>>"
    inner = shape(kind="GROUP") + ([shape("c"), shape("d")],)
    df = spark.createDataFrame([([shape("a") + (None,), shape(kind="GROUP") + ([shape("b") + (None,), inner, shape("e") + (None,)],), shape("f") + (None,)],)], schema)
    got = df.select(F.transform(A.flatten_groups(F.col("gs"), 2), lambda s: s["text"]).alias("t")).first().t
    assert got == list("abcdef")
    flat = A.flatten_shapes(df, "gs").first().gs
    assert [s.text for s in flat] == list("abcdef")
    empty = spark.createDataFrame([([shape(kind="GROUP") + ([shape(kind="GROUP") + (None,)],), shape("x") + (None,)],)], schema)
    assert [s.text for s in A.flatten_shapes(empty, "gs").first().gs] == ["x"]


def test_leaf_rows_of_any_depth(spark):
    rows = [([1], "GROUP", None), ([1, 0], "GROUP", None), ([1, 0, 2], "TEXT_BOX", "b"), ([1, 0, 0, 0, 0], "TEXT_BOX", "a"), ([2], None, "c"), ([10], "TEXT_BOX", "d")]
    placed = spark.createDataFrame(
        [("d", 1, 100, p, *shape(t, kind=k)) for p, k, t in reversed(rows)],
        f"deck_id string, slide_number int, slide_height bigint, path array<int>, {SHAPE}",
    )
    got = A.gather_shapes(A.leaf_rows(placed)).first().shapes
    assert [s.text for s in got] == ["a", "b", "c", "d"]


# --- classifier -----------------------------------------------------------------------------------

SLIDE = "deck_id string, slide_number int, title string, content array<string>, image_only boolean"


def classify(spark, title, content, image_only=False, judged=None):
    df = spark.createDataFrame([("d", 1, title, content, image_only)], SLIDE)
    if judged is not None:
        judged = spark.createDataFrame([("d", 1, judged)], "deck_id string, slide_number int, judged_type string")
    return CL.classify_slides(df, judged).first()


def w(n):
    return " ".join(["palabra"] * n)


def test_equal_scores_go_to_the_type_that_fired_first(spark):
    r = classify(spark, "Referencias y gracias", [w(5), w(5)])
    assert r.rules_fired == ["R04", "R07", "R11", "R12"] and (r.type, r.confidence) == ("referencias", 0.92)
    r = classify(spark, "Índice de Referencias para todos los alumnos presentes aquí hoy", [w(18)])
    assert r.rules_fired == ["R05", "R07", "R18"] and r.type == "indice" and r.excluded


def test_highest_score_wins_over_first_rule(spark):
    r = classify(spark, "uno dos tres cuatro", [w(8), w(8)])
    assert r.rules_fired == ["R04", "R18"] and (r.type, r.confidence) == ("contenido", 0.72)


def test_image_only(spark):
    r = classify(spark, "", [], True)
    assert (r.type, r.confidence, r.method) == ("portada", 0.95, "reglas") and r.rules_fired == ["R01", "R02", "R04"]


def test_no_rule_fires(spark):
    long_lines = [w(21)]
    r = classify(spark, "a b c", long_lines)
    assert r.rules_fired == [] and (r.type, r.confidence, r.method, r.excluded) == ("contenido", 0.5, "fallback_contenido", False)
    assert (lambda x: (x.type, x.confidence, x.method))(classify(spark, "a b c", long_lines, judged="cita")) == ("cita", 0.7, "llm")
    assert (lambda x: (x.type, x.confidence, x.method))(classify(spark, "a b c", long_lines, judged="visual")) == ("contenido", 0.5, "fallback_contenido")


def test_weak_rule_keeps_its_type_without_judge(spark):
    r = classify(spark, "a b", ["• uno dos"] * 7)
    assert (r.type, r.confidence, r.method) == ("contenido", 0.76, "reglas")


def test_features(spark):
    df = spark.createDataFrame([("d", 1, " Tema 3 ", ["• a (1999)\n1. b c", "see WWW.x.org", " "], False), ("d", 2, "ÍNDICE general", ["«" + "x" * 60 + "»"], False)], SLIDE)
    a, b = CL.classifier_features(df).orderBy("slide_number").collect()
    assert (a.w, a.w_title, a.bullets, a.abw, a.yp, a.up, a.is_section, a.is_quote) == (8, 2, 2, 2.67, 0.33, 0.33, True, False)
    assert (b.kt_indice, b.is_quote, b.kt_cierre) == (True, True, False)


def test_a_page_is_read_once(spark, tmp_path):
    """A filter on the shapes held their expression, pages and all, once for each use inside it."""
    from decklens import plans

    page = "<h1>T</h1><nav>n</nav>" + "".join(f"<p>{i}</p>" for i in range(5))
    rows = [(1, page), (2, "<p>x</p>"), (3, "none"), (4, None), (None, "<li>y</li>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    flat = plans.QUERIES["A7_flatten_groups"](spark, str(tmp_path))
    assert flat._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {(r.deck_id, r.z, r.name) for r in flat.collect()} == {
        (1, 0, "h1 0"), (1, 1, None), *((1, i, f"p {i}") for i in range(2, 7)), (2, 0, "p 0"), (None, 0, "li 0")}
