"""Queries that assemble slides from shapes, and that classify slides by rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import text as X
from decklens.operators import assemble as A
from decklens.operators import classify as CL
from decklens.plans import judge_queries as JQ
from decklens.plans import sql as S
from decklens.plans import tables as T
from decklens.plans.registry import query

# Word edges in RE2 know ASCII letters only, so the SQL spells out what stands beside a word.
_EDGE = "[^\\p{L}\\p{N}_]"


def _word(pattern: str) -> str:
    return f"(?i)(?:^|{_EDGE})(?:{pattern})(?:{_EDGE}|$)"


_META = " OR ".join(
    f"regexp_matches(txt, '{p}')" for p in (
        _word(K.FOOTER_COURSE_WORDS), "\\d{1,2}[/-]\\d{1,2}[/-]\\d{2,4}", _word(K.FOOTER_MONTHS),
        f"(?:^|{_EDGE})[A-Z]{{2,6}}\\d{{3,4}}(?:{_EDGE}|$)",
        "^[A-ZÁÉÍÓÚ][a-záéíóú]+ [A-ZÁÉÍÓÚ][a-záéíóú]+ [A-ZÁÉÍÓÚ][a-záéíóú]+$",
    )
)
_FOOTER = f"ratio >= 0.75 AND ((ratio >= 0.85 AND words <= 25) OR words <= 6 OR (words <= 15 AND ({_META})))"
_NUMBER = (
    "regexp_matches(txt, '^\\d{1,3}$') AND (ratio < 0.05 OR ratio > 0.90 "
    "OR contains(lower(coalesce(name, '')), 'slide number') OR contains(lower(coalesce(name, '')), 'page'))"
)

_SHAPES = f"""
blocks AS (SELECT page_id AS deck_id, regexp_extract_all(html, '(?is)<(?:h1|p|li|footer|div|nav)\\b[^>]*>[^<]*') AS bs FROM pages),
raw AS (SELECT deck_id, len(bs) AS n, unnest(range(0, len(bs))) AS z, unnest(bs) AS b FROM blocks),
tagged AS (SELECT *, lower(regexp_extract(b, '^<(\\w+)', 1)) AS tag, regexp_extract(b, '(?s)>([^<]*)$', 1) AS t0 FROM raw),
shapes AS (SELECT deck_id, z, tag, CASE WHEN tag <> 'nav' THEN tag || ' ' || z END AS name,
    array_to_string({S.lines("replace(replace(t0, chr(13) || chr(10), chr(10)), chr(13), chr(10))")}, ' ' || chr(10) || ' ') AS txt,
    CAST(floor(z * 100 / n) AS BIGINT) AS top, CAST(floor(z * 100 / n) AS BIGINT) / 100 AS ratio,
    CASE WHEN tag = 'h1' THEN 32 WHEN tag = 'p' THEN z % 3 * 9 ELSE 0 END AS size,
    tag = 'h1' AND deck_id % 2 = 0 AS is_title FROM tagged),
worded AS (SELECT *, {S.plain_words('txt')} AS words FROM shapes)"""

_ROLES = f"""{_SHAPES},
owns AS (SELECT deck_id, arg_min(CASE WHEN {_NUMBER} THEN '' ELSE txt END, z) AS own FROM worded WHERE is_title GROUP BY deck_id),
roles AS (SELECT w.*, coalesce(own, '') AS own, CASE WHEN tag IN ('div', 'nav') THEN 'image'
    WHEN txt = '' OR txt = coalesce(own, '') THEN 'skip' WHEN {_NUMBER} THEN 'skip' WHEN {_FOOTER} THEN 'footer'
    WHEN coalesce(own, '') = '' AND ratio < 0.25 THEN 'candidate' ELSE 'content' END AS role
  FROM worded w LEFT JOIN owns USING (deck_id)),
ranked AS (SELECT *, CASE WHEN role = 'candidate' THEN row_number() OVER (PARTITION BY deck_id, role ORDER BY size DESC, top, z) END AS rk FROM roles),
best AS (SELECT deck_id, txt AS best, words <= 25 AND length(txt) <= 180 AS short FROM ranked WHERE rk = 1)"""


@query("A5_assemble_slides", f"""
  WITH {_ROLES},
  x AS (SELECT r.*, best, coalesce(short, false) AS short FROM ranked r LEFT JOIN best USING (deck_id))
  SELECT deck_id, CASE WHEN max(short) THEN max(best) ELSE max(own) END AS title,
    coalesce(string_agg(txt, '|' ORDER BY coalesce(rk, 0), z) FILTER (role = 'content' OR (role = 'candidate' AND NOT (short AND rk = 1))), '') AS content,
    coalesce(string_agg(txt, '|' ORDER BY z) FILTER (role = 'footer'), '') AS footer,
    coalesce(string_agg(coalesce(name, 'Tabla_o_Imagen'), '|' ORDER BY z) FILTER (role = 'image'), '') AS images,
    CAST(count(*) FILTER (role = 'image') AS INTEGER) AS image_count
  FROM x GROUP BY deck_id""")
def _(spark, sf):
    built = A.assemble_slides(T.page_shapes(spark, sf))
    return built.select(
        "deck_id", "title", F.array_join("content", "|").alias("content"), F.array_join("footer", "|").alias("footer"),
        F.array_join("images", "|").alias("images"), "image_count",
    )


@query("A5_assemble_from_rows", f"""
  WITH {_ROLES} SELECT deck_id, CAST(count(*) FILTER (role = 'content') + count(*) FILTER (role = 'candidate') AS INTEGER) AS blocks
  FROM roles GROUP BY deck_id""")
def _(spark, sf):
    rows = T.page_shapes(spark, sf).select(
        "deck_id", "slide_number", "slide_height", F.posexplode("shapes").alias("z", "s")
    ).select("deck_id", "slide_number", "slide_height", "z", "s.*")
    built = A.assemble_slides(A.gather_shapes(rows))
    taken = F.when((F.col("title") != "") & (F.col("deck_id") % 2 == 1), F.lit(1)).otherwise(F.lit(0))
    return built.select("deck_id", (F.size("content") + taken).alias("blocks"))


@query("A6_shape_role_image", f"""
  WITH {_SHAPES} SELECT deck_id, CAST(count(*) FILTER (tag IN ('div', 'nav')) AS INTEGER) AS image_count FROM shapes GROUP BY deck_id""")
def _(spark, sf):
    return T.page_shapes(spark, sf).select("deck_id", F.size(F.filter("shapes", A.is_image)).alias("image_count"))


@query("A7_flatten_groups", f"WITH {_SHAPES} SELECT deck_id, CAST(z AS INTEGER) AS z, name FROM shapes")
def _(spark, sf):
    none = F.lit(None).cast
    shapes = T.page_shapes(spark, sf)

    def group(start):
        leaves = F.slice("shapes", start, 4)
        return F.struct(
            F.lit("GROUP").alias("shape_type"), none("boolean").alias("is_title"), none("boolean").alias("is_placeholder"),
            none("boolean").alias("has_image"), F.lit("group").alias("name"), none("string").alias("text"),
            none("bigint").alias("top"), none("array<int>").alias("run_sizes"), leaves.alias("children"),
        )

    # A filter on the shapes, or the one that the plain explode adds, would build all shapes again for each group.
    grouped = F.when(F.size("shapes") > 0, F.transform(F.sequence(F.lit(1), F.size("shapes"), F.lit(4)), group))
    nested = shapes.select("deck_id", grouped.alias("gs"))
    flat = A.flatten_shapes(nested, "gs").select("deck_id", F.posexplode_outer("gs").alias("z", "s"))
    return flat.filter(F.col("z").isNotNull()).select("deck_id", "z", "s.name")


@query("A7_leaf_paths", f"WITH {_SHAPES} SELECT deck_id, CAST(z AS INTEGER) AS z, name FROM shapes")
def _(spark, sf):
    """Shape i lies in i % 4 groups, each of which has a row of its own; rows come unordered."""
    i = F.col("i")
    path = F.concat(F.array(i), F.array_repeat(F.lit(0), i % 4))
    paths = F.transform(F.sequence(F.lit(1), i % 4 + 1), lambda n: F.slice(path, F.lit(1), n))
    placed = T.page_shapes(spark, sf).select(
        "deck_id", "slide_number", "slide_height", F.posexplode("shapes").alias("i", "s")
    ).select("*", F.explode(paths).alias("path")).select(
        "deck_id", "slide_number", "slide_height", "path", F.col("s").withField(
            "shape_type", F.when(F.size("path") <= i % 4, F.lit("GROUP")).otherwise(F.col("s.shape_type"))
        ).alias("s"),
    ).select("deck_id", "slide_number", "slide_height", "path", "s.*")
    slides = A.gather_shapes(A.leaf_rows(placed))
    return slides.select("deck_id", F.posexplode("shapes").alias("z", "s")).select("deck_id", "z", "s.name")


_LINES = f"""
ls AS (SELECT doc_id, {S.lines('text')} AS l FROM documents),
rows AS (SELECT doc_id, unnest(l) AS txt, unnest(range(1, len(l) + 1)) AS i, len(l) AS n FROM ls),
placed AS (SELECT *, i / n AS ratio, {S.plain_words('txt')} AS words FROM rows)"""


def _lines(spark, sf):
    lined = T.documents(spark, sf).select("doc_id", X.text_lines(F.col("text")).alias("l"))
    rows = lined.select("doc_id", F.size("l").alias("n"), F.posexplode("l").alias("p", "txt"))
    return rows.select("doc_id", (F.col("p") + 1).cast("bigint").alias("i"), "txt", ((F.col("p") + 1) / F.col("n")).alias("ratio"))


@query("A9_decorative_number", f"""
  WITH {_LINES},
  r AS (SELECT doc_id, i, ratio, CAST(length(txt) AS VARCHAR) AS txt, CASE WHEN i % 5 = 0 THEN 'Page box' ELSE 'box' END AS name FROM placed)
  SELECT doc_id, i, {_NUMBER} AS decorative FROM r""")
def _(spark, sf):
    name = F.when(F.col("i") % 5 == 0, F.lit("Page box")).otherwise(F.lit("box"))
    return _lines(spark, sf).select("doc_id", "i", A.is_decorative_number(
        F.length("txt").cast("string"), name, F.col("ratio")
    ).alias("decorative"))


@query("A10_footer_test", f"WITH {_LINES} SELECT doc_id, i, {_FOOTER} AS footer FROM placed")
def _(spark, sf):
    rows = _lines(spark, sf).withColumn("words", X.plain_word_count(F.col("txt")))
    return rows.select("doc_id", "i", A.is_footer(F.col("txt"), F.col("words"), F.col("ratio")).alias("footer"))


@query("A11_first_font_size", """
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN 0 WHEN l_quantity > 25 THEN CAST(l_quantity AS INTEGER) ELSE 99 END AS size
  FROM lineitem""")
def _(spark, sf):
    q = F.col("l_quantity").cast("int")
    runs = F.when(F.col("l_linenumber") % 4 == 0, F.array(F.lit(None).cast("int"), F.lit(0))).otherwise(
        F.array(F.lit(None).cast("int"), F.when(q > 25, q).otherwise(F.lit(0)), F.lit(99))
    )
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", A.first_font_size(runs).alias("size"))


# --- classifier -------------------------------------------------------------------------------------

#: titles and bodies vary by rule, so that keywords, years, links, bullets and quotes occur; some slides
#: are followed by a short one under the negative number
_VARIED = f"""{S.SLIDES},
v0 AS (SELECT deck_id, slide_number, (deck_id * 5 + slide_number * 3) % 29 AS k, title, content FROM slides),
v1 AS (FROM v0 UNION ALL SELECT deck_id, -slide_number, k, title, ['Texto breve'] FROM v0 WHERE k IN (2, 4, 7, 8, 9, 11)),
v AS (SELECT deck_id, slide_number, k, CASE WHEN k = 1 THEN 'Índice general' WHEN k = 2 THEN 'Tema 3' WHEN k = 3 THEN 'REFERENCIAS Bibliográficas'
      WHEN k = 4 THEN '¿Preguntas?' WHEN k = 5 THEN 'Bienvenidos' WHEN k = 6 THEN 'Agendas' WHEN k IN (7, 11) THEN '' ELSE title END AS title,
    list_transform(content, lambda c: CASE WHEN k = 8 THEN c || ' (1999)' WHEN k = 9 THEN 'WWW.x.org ' || c WHEN k = 10 THEN '• ' || c
        WHEN k = 12 THEN '«' || c || '»' ELSE c END) AS content FROM v1),
f0 AS (SELECT *, list_filter(list_transform(string_split(array_to_string(content, chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM v),
f1 AS (SELECT *, {S.plain_words("array_to_string(ls, ' ')")} AS w, {S.plain_words('title')} AS w_title,
    len(list_filter(ls, lambda l: regexp_matches(l, '^\\s*([•\\-*]|\\d+[.)])\\s+'))) AS bullets,
    len(list_filter(ls, lambda l: regexp_matches(l, '\\((19|20)\\d{{2}}\\)'))) AS ys,
    len(list_filter(ls, lambda l: regexp_matches(l, '(?i)https?://|www\\.'))) AS us, len(ls) AS n FROM f0),
f AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE {S.rnd('w / n', 2)} END AS abw, CASE WHEN n = 0 THEN 0 ELSE {S.rnd('ys / n', 2)} END AS yp,
    CASE WHEN n = 0 THEN 0 ELSE {S.rnd('us / n', 2)} END AS up,
    regexp_matches(title || ' ' || array_to_string(content, ' '), '(?s)[«"“].{{60,}}[»"”]') AS is_quote,
    regexp_matches(trim(title), '(?i)^(Tema|Unidad|Cap[íi]tulo|Módulo)\\s+\\d') AS is_section,
    {", ".join(f"regexp_matches(title, '{_word(p)}') AS kt_{k}" for k, p in K.TITLE_WORDS.items())} FROM f1)"""


def _varied(spark, sf):
    k = (F.col("deck_id") * 5 + F.col("slide_number") * 3) % 29
    titles = {1: "Índice general", 2: "Tema 3", 3: "REFERENCIAS Bibliográficas", 4: "¿Preguntas?", 5: "Bienvenidos", 6: "Agendas", 7: "", 11: ""}
    title = F.when(F.lit(False), F.lit(""))
    for n, t in titles.items():
        title = title.when(k == n, F.lit(t))
    whole = F.struct("slide_number", "content", "image_only")
    short = F.struct(
        (-F.col("slide_number")).alias("slide_number"), F.array(F.lit("Texto breve")).alias("content"), F.lit(False).alias("image_only")
    )
    both = F.when(k.isin(2, 4, 7, 8, 9, 11), F.array(whole, short)).otherwise(F.array(whole))

    def changed(c):
        return (
            F.when(k == 8, F.concat(c, F.lit(" (1999)"))).when(k == 9, F.concat(F.lit("WWW.x.org "), c))
            .when(k == 10, F.concat(F.lit("• "), c)).when(k == 12, F.concat(F.lit("«"), c, F.lit("»"))).otherwise(c)
        )

    varied = T.slides(spark, sf).select(
        "deck_id", k.alias("k"), title.otherwise(F.col("title")).alias("title"), F.explode(both).alias("s")
    )
    k = F.col("k")
    return varied.select(
        "deck_id", "s.slide_number", "title", F.transform("s.content", changed).alias("content"), "s.image_only"
    )


@query("E1_classifier_features", f"""
  WITH {_VARIED}
  SELECT deck_id, slide_number, CAST(w AS INTEGER) AS w, CAST(w_title AS INTEGER) AS w_title, CAST(bullets AS INTEGER) AS bullets, abw, yp, up, is_quote, is_section, kt_portada, kt_indice, kt_referencias, kt_cierre FROM f""")
def _(spark, sf):
    return CL.classifier_features(_varied(spark, sf)).select("deck_id", "slide_number", *CL.FEATURES)


_RULES = f"""{_VARIED},
r AS (
  SELECT deck_id, slide_number, unnest([
    {{'i': 2, 'id': 'R02', 't': 'portada', 's': 0.90, 'on': w <= 5 AND bullets = 0 AND w_title <= 8}},
    {{'i': 3, 'id': 'R03', 't': 'portada', 's': 0.85, 'on': kt_portada}},
    {{'i': 4, 'id': 'R03b', 't': 'portada', 's': 0.85, 'on': is_section AND w <= 15}},
    {{'i': 5, 'id': 'R04', 't': 'portada', 's': 0.68, 'on': w <= 20 AND bullets <= 1 AND abw <= 8 AND w_title <= 8}},
    {{'i': 6, 'id': 'R05', 't': 'indice', 's': 0.92, 'on': kt_indice}},
    {{'i': 7, 'id': 'R06a', 't': 'indice', 's': 0.95, 'on': kt_indice AND bullets >= 2}},
    {{'i': 8, 'id': 'R06b', 't': 'indice', 's': 0.55, 'on': NOT kt_indice AND bullets >= 5 AND abw <= 3 AND w_title <= 3}},
    {{'i': 9, 'id': 'R07', 't': 'referencias', 's': 0.92, 'on': kt_referencias}},
    {{'i': 10, 'id': 'R08', 't': 'referencias', 's': 0.88, 'on': yp >= 0.40}},
    {{'i': 11, 'id': 'R09', 't': 'referencias', 's': 0.82, 'on': up >= 0.30}},
    {{'i': 12, 'id': 'R10', 't': 'referencias', 's': 0.78, 'on': yp >= 0.25 AND up >= 0.15}},
    {{'i': 13, 'id': 'R11', 't': 'cierre', 's': 0.92, 'on': kt_cierre AND w <= 20}},
    {{'i': 14, 'id': 'R12', 't': 'cierre', 's': 0.75, 'on': kt_cierre AND w <= 40}},
    {{'i': 15, 'id': 'R15', 't': 'cita', 's': 0.85, 'on': is_quote}},
    {{'i': 16, 'id': 'R16', 't': 'sin_contenido', 's': 0.80, 'on': w + w_title < 15 AND NOT kt_cierre}},
    {{'i': 17, 'id': 'R17', 't': 'contenido', 's': 0.82, 'on': w_title >= 12 AND w <= 5}},
    {{'i': 18, 'id': 'R13', 't': 'contenido', 's': 0.82, 'on': w >= 25 AND yp < 0.25 AND up < 0.20}},
    {{'i': 19, 'id': 'R14', 't': 'contenido', 's': 0.76, 'on': w >= 15 AND bullets >= 2 AND yp < 0.25}},
    {{'i': 20, 'id': 'R18', 't': 'contenido', 's': 0.72, 'on': w_title >= 4 AND w >= 8 AND w < 25 AND bullets = 0 AND yp < 0.25}},
    {{'i': 21, 'id': 'R19', 't': 'contenido', 's': 0.70, 'on': bullets >= 3 AND w_title >= 4 AND abw <= 6 AND w >= 8}}]) AS x
  FROM f),
hits AS (SELECT deck_id, slide_number, x.i AS i, x.id AS id, x.t AS t, x.s AS s FROM r WHERE x.on),
types AS (SELECT deck_id, slide_number, t, max(s) AS s, min(i) AS i FROM hits GROUP BY ALL),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY deck_id, slide_number ORDER BY s DESC, i) AS rk FROM types) WHERE rk = 1),
ids AS (SELECT deck_id, slide_number, string_agg(id, ',' ORDER BY i) AS rules FROM hits GROUP BY ALL),
ruled AS (SELECT v.deck_id, v.slide_number, won.t AS rule_type, CAST(coalesce(won.s, 0) AS DOUBLE) AS rule_confidence, coalesce(rules, '') AS rules
  FROM v LEFT JOIN won USING (deck_id, slide_number) LEFT JOIN ids USING (deck_id, slide_number))"""


@query("E2_classifier_rules", f"WITH {_RULES} SELECT * FROM ruled")
def _(spark, sf):
    return CL.classifier_rules(CL.classifier_features(_varied(spark, sf))).select(
        "deck_id", "slide_number", "rule_type", "rule_confidence", F.array_join("rules_fired", ",").alias("rules")
    )


_EXCLUDED = ", ".join(f"'{t}'" for t in K.EXCLUDED_TYPES)


@query("E3_classifier_decision", f"""
  WITH {_RULES}
  SELECT deck_id, slide_number, CASE WHEN rule_confidence < 0.6 THEN coalesce(rule_type, 'contenido') ELSE rule_type END AS type,
    CASE WHEN rule_confidence = 0 THEN 0.5 ELSE rule_confidence END AS confidence,
    CASE WHEN rule_confidence < 0.6 THEN 'fallback_contenido' ELSE 'reglas' END AS method
  FROM ruled""")
def _(spark, sf):
    return CL.classify_slides(_varied(spark, sf)).select("deck_id", "slide_number", "type", "confidence", "method")


@query("E3_classifier_decision_judged", f"""
  WITH {_RULES}, {JQ._JUDGED},
  d AS (SELECT r.*, judged_type IN ('portada', 'indice', 'referencias', 'cierre', 'contenido', 'cita') AS ok, judged_type
    FROM ruled r LEFT JOIN judged USING (deck_id, slide_number))
  SELECT deck_id, slide_number, CASE WHEN rule_confidence >= 0.6 THEN rule_type WHEN ok THEN judged_type ELSE 'contenido' END AS type,
    CASE WHEN rule_confidence >= 0.6 THEN rule_confidence WHEN ok THEN 0.7 ELSE 0.5 END AS confidence,
    CASE WHEN rule_confidence >= 0.6 THEN 'reglas' WHEN ok THEN 'llm' ELSE 'fallback_contenido' END AS method
  FROM d""")
def _(spark, sf):
    judged = JQ._judged(spark, sf).withColumn("judged_type", F.lower("judged_type"))
    return CL.classify_slides(_varied(spark, sf), judged).select("deck_id", "slide_number", "type", "confidence", "method")


_ANSWERS = ["portada", "Inventado", "cierre", "cita", "contenido"]


def _by_number(asked):
    """Stands for a model: the answer follows from the slide's place; the title shows that texts come along."""
    rows = asked.to_pylist()
    return [None if r["title"] is None else _ANSWERS[(r["deck_id"] * 3 + r["slide_number"]) % 5] for r in rows]


@query("E3_classifier_callback", f"""
  WITH {_RULES},
  d AS (SELECT *, {_ANSWERS}[(deck_id * 3 + slide_number) % 5 + 1] AS answer FROM ruled)
  SELECT deck_id, slide_number, CASE WHEN rule_confidence >= 0.6 THEN rule_type WHEN answer <> 'Inventado' THEN answer ELSE 'contenido' END AS type,
    CASE WHEN rule_confidence >= 0.6 THEN rule_confidence WHEN answer <> 'Inventado' THEN 0.7 ELSE 0.5 END AS confidence,
    CASE WHEN rule_confidence >= 0.6 THEN 'reglas' WHEN answer <> 'Inventado' THEN 'llm' ELSE 'fallback_contenido' END AS method
  FROM d""")
def _(spark, sf):
    ruled = CL.classifier_rules(CL.classifier_features(_varied(spark, sf)))
    decided = CL.classifier_callback(ruled, _by_number, ("deck_id", "slide_number", "title"))
    return decided.select("deck_id", "slide_number", "type", "confidence", "method")


@query("E4_classifier_exclude", f"""
  WITH {_RULES}
  SELECT deck_id, slide_number, coalesce(rule_type, 'contenido') IN ({_EXCLUDED}) AS excluded FROM ruled""")
def _(spark, sf):
    return CL.classify_slides(_varied(spark, sf)).select("deck_id", "slide_number", "excluded")
