"""Queries over the catalogue of subjects, decks and versions, and over course trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from decklens import schemas as SCH
from decklens.operators import catalog as C
from decklens.operators.hash_index import HashIndex
from decklens.plans import sql as S
from decklens.plans import tables as T
from decklens.plans.registry import query
from decklens.session import scratch_folder, staged
from decklens.sources import syllabus as SY
from decklens.sources.keyed_table import KeyedTable

_VERSIONS = """
versions AS (SELECT conv_id || '/' || turn AS version_id, conv_id AS deck_id, CAST(turn + 1 AS INTEGER) AS version,
    CAST((conv_id + turn) % 2 AS INTEGER) AS analysed, CAST('2024-01-01' AS DATE) + CAST(turn AS INTEGER) AS loaded,
    CAST(length(text) % 40 AS INTEGER) AS total_slides, sha256(text) AS hash,
    'p/' || conv_id || '_v' || (turn + 1) || '.pptx' AS path, 'p/' || conv_id || '_v' || (turn + 1) || '_thumb.png' AS thumb_path,
    CASE WHEN turn % 3 <> 0 THEN 'p/' || conv_id || '_v' || (turn + 1) || '.pdf' END AS pdf_path FROM conversations),
decks AS (SELECT DISTINCT conv_id AS deck_id, CAST(conv_id % 5 AS VARCHAR) AS subject_id,
    'conv_' || conv_id || '.pptx' AS file_name FROM conversations),
tops AS (SELECT deck_id, max(version) AS version FROM versions GROUP BY deck_id),
newest AS (SELECT v.* FROM versions v JOIN tops USING (deck_id, version))"""


def _subjects(spark, sf):
    """Customers as subjects: a long name list, a fifth of it switched off."""
    return T.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("subject_id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(0)).otherwise(F.lit(1)).alias("active"),
    )


@query("G1_active_subjects", "SELECT c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, sf):
    return C.active_subjects(_subjects(spark, sf))


@query("G1_available_subjects", "SELECT c_name AS name FROM customer WHERE c_custkey % 5 = 0")
def _(spark, sf):
    return C.available_subjects(_subjects(spark, sf))


@query("G2_subject_id_by_name", """
  SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS subject_id FROM nation""")
def _(spark, sf):
    nation = T.table(spark, sf, "nation")
    subjects = nation.filter("n_nationkey % 2 = 0").select(
        F.col("n_nationkey").cast("string").alias("subject_id"), F.col("n_name").alias("name")
    )
    return C.subject_ids(nation.select(F.col("n_name").alias("name")), subjects)


@query("G2_subject_name_by_id", """
  SELECT CAST(c_custkey AS VARCHAR) AS subject_id, n_name AS name FROM customer LEFT JOIN nation ON n_nationkey = c_custkey""")
def _(spark, sf):
    subjects = T.table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("subject_id"), F.col("n_name").alias("name")
    )
    asked = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"))
    return C.subject_names(asked, subjects)


@query("G3_duplicate_by_hash", """
  WITH k AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang = 'es' OR doc_id % 10 = 3)
  SELECT doc_id AS file_id, sha256(text) IN (SELECT hash FROM k) AS known FROM documents""")
def _(spark, sf):
    docs = T.documents(spark, sf).select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    known = docs.filter("lang = 'es' OR doc_id % 10 = 3")
    asked = docs.select(F.col("doc_id").alias("file_id"), "hash")
    return C.known_hash(asked, known).select("file_id", "known")


@query("G3_duplicate_by_index", """
  WITH k AS (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE lang = 'es' OR doc_id % 10 = 3)
  SELECT DISTINCT sha256(text) AS hash FROM documents WHERE sha256(text) IN (SELECT hash FROM k)""")
def _(spark, sf):
    """Known hashes by a stored index that was filled in two steps."""
    docs = T.documents(spark, sf).select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    index = HashIndex(spark, scratch_folder(spark)).create(docs.filter("lang = 'es'"), 16)
    index.add("third", docs.filter("doc_id % 10 = 3"))
    return index.known(docs.select("hash").filter("hash is not null").distinct())


_FILES = f"""
f AS (SELECT doc_id, n_chars, sha256(text) AS hash,
    CASE WHEN n_chars % 23 = 0 THEN 0 ELSE (len({S.lines('text')}) + 2) // 3 END AS total_slides FROM documents)"""


_REGISTERED = f"""
  WITH {_FILES},
  known AS (SELECT DISTINCT hash FROM f WHERE doc_id % 10 = 3),
  s AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS rn FROM f WHERE doc_id % 6 <> 5),
  o AS (SELECT doc_id, CASE WHEN n_chars / 1048576.0 > 0.005 THEN 'too_large'
    WHEN k.hash IS NOT NULL THEN 'duplicate' WHEN total_slides = 0 THEN 'no_slides'
    WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome
  FROM s LEFT JOIN known k ON k.hash = s.hash)
  SELECT doc_id AS file_id, outcome,
    CASE WHEN outcome = 'accepted' THEN 'presentaciones/' || r_name || '/doc_' || doc_id || '.pdf' END AS pdf_path
  FROM o JOIN region ON r_regionkey = doc_id % 6
  UNION ALL SELECT doc_id, 'no_subject', NULL FROM f WHERE doc_id % 6 = 5"""


@query("G4_register_decks", _REGISTERED)
def _(spark, sf):
    files = T.incoming_files(spark, sf)
    known = files.filter("file_id % 10 = 3").select("hash")
    return _registered(spark, sf, files, known)


@query("G4_register_decks_indexed", _REGISTERED)
def _(spark, sf):
    files = T.incoming_files(spark, sf)
    index = HashIndex(spark, scratch_folder(spark)).create(files.filter("file_id % 10 = 3"), 16)
    return _registered(spark, sf, files, None, index)


def _registered(spark, sf, files, known, index=None):
    subjects = T.course_tables(spark, sf)[0]
    decks, versions, rejected = C.register_decks(files, subjects, known, F.lit("2024-01-01").cast("date"), 0.005, index)
    number = F.regexp_extract("file_name", r"(\d+)", 1).cast("bigint").alias("file_id")
    stored = decks.join(versions, "deck_id").select(number, F.lit("accepted").alias("outcome"), "pdf_path")
    return stored.unionByName(rejected.select(
        "file_id", F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("pdf_path")
    ))


@query("G5_append_version", f"""
  WITH {_VERSIONS}, {_FILES},
  known AS (SELECT hash FROM versions),
  s AS (SELECT f.*, t.version, d.subject_id, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS rn
    FROM f JOIN tops t ON t.deck_id = doc_id % 120 JOIN decks d ON d.deck_id = t.deck_id),
  g AS (SELECT *, CASE WHEN n_chars / 1048576.0 > 30 THEN 'too_large' WHEN hash IN (SELECT hash FROM known) THEN 'duplicate'
    WHEN total_slides = 0 THEN 'no_slides' WHEN rn > 1 THEN 'duplicate' ELSE 'accepted' END AS outcome FROM s)
  SELECT doc_id AS file_id, outcome, doc_id % 120 AS deck_id, CAST(version + row_number() OVER (PARTITION BY doc_id % 120 ORDER BY doc_id) AS INTEGER) AS version,
    CAST(total_slides AS INTEGER) AS total_slides, 'presentaciones/' || r_name || '/doc_' || doc_id || '_v'
      || (version + row_number() OVER (PARTITION BY doc_id % 120 ORDER BY doc_id)) || '.pptx' AS path
  FROM g JOIN region ON CAST(r_regionkey AS VARCHAR) = subject_id WHERE outcome = 'accepted'
  UNION ALL SELECT doc_id, outcome, doc_id % 120, NULL, CAST(total_slides AS INTEGER), NULL FROM g WHERE outcome <> 'accepted'
  UNION ALL SELECT doc_id, 'no_deck', doc_id % 120, NULL, CAST(total_slides AS INTEGER), NULL FROM f
    WHERE doc_id % 120 NOT IN (SELECT deck_id FROM decks)""")
def _(spark, sf):
    files = T.incoming_files(spark, sf).drop("subject_id").withColumn("deck_id", F.col("file_id") % 120)
    new, rejected = C.append_versions(
        files, T.decks(spark, sf), T.versions(spark, sf), T.course_tables(spark, sf)[0],
        F.lit("2024-01-01").cast("date"), block=128,
    )
    number = F.regexp_extract("path", r"doc_(\d+)_v", 1).cast("bigint").alias("file_id")
    stored = new.select(number, F.lit("accepted").alias("outcome"), "deck_id", "version", "total_slides", "path")
    return stored.unionByName(
        rejected.select("file_id", F.col("reason").alias("outcome"), "deck_id", "total_slides"), allowMissingColumns=True
    )


@query("G6_latest_versions", f"""
  WITH {_VERSIONS}
  SELECT subject_id, file_name, path, thumb_path, analysed, pdf_path FROM decks JOIN newest USING (deck_id)""")
def _(spark, sf):
    return C.latest_by_subject(T.decks(spark, sf), T.versions(spark, sf))


@query("G7_current_version_id", f"""
  WITH {_VERSIONS} SELECT subject_id, file_name, version_id FROM decks JOIN newest USING (deck_id)""")
def _(spark, sf):
    return C.current_version_id(T.decks(spark, sf), T.versions(spark, sf))


@query("G8_deck_id_and_max_version", f"""
  WITH {_VERSIONS},
  asked AS (SELECT DISTINCT CAST(conv_id % 4 AS VARCHAR) AS subject_id, 'conv_' || conv_id || '.pptx' AS file_name FROM conversations)
  SELECT a.subject_id, a.file_name, d.deck_id, coalesce(t.version, 0) AS version
  FROM asked a LEFT JOIN decks d USING (subject_id, file_name) LEFT JOIN tops t ON t.deck_id = d.deck_id""")
def _(spark, sf):
    decks = T.decks(spark, sf)
    asked = decks.select((F.col("deck_id") % 4).cast("string").alias("subject_id"), "file_name")
    return C.id_and_max_version(asked, decks, T.versions(spark, sf))


@query("G9_version_history", f"""
  WITH {_VERSIONS}
  SELECT deck_id, file_name, version, CAST(loaded AS VARCHAR) AS loaded, total_slides, analysed, pdf_path
  FROM decks JOIN versions USING (deck_id) ORDER BY deck_id, version DESC""")
def _(spark, sf):
    return C.version_history(T.decks(spark, sf), T.versions(spark, sf)).withColumn("loaded", F.col("loaded").cast("string"))


_TREE = """
units AS (SELECT n_regionkey AS r, CAST(n_nationkey AS INTEGER) AS u, n_name FROM nation
  UNION ALL SELECT r_regionkey, CAST(r_regionkey + 100 AS INTEGER), r_name FROM region),
tops AS (SELECT DISTINCT c_nationkey, ascii(c_mktsegment) AS num, c_mktsegment FROM customer
  UNION ALL SELECT n_nationkey, 0, 'REPASO' FROM nation),
tree AS (SELECT CAST(r_regionkey AS VARCHAR) AS subject_id, r_name AS subject, u AS unit_number,
    num AS topic_number, c.c_custkey AS subtopic_number, 'Unidad Temática ' || u || '. ' || n_name AS unit,
    u || '.' || num || ' ' || t.c_mktsegment AS topic, u || '.' || num || '.' || c.c_custkey || ' ' || c.c_name AS subtopic
  FROM region JOIN units ON r = r_regionkey LEFT JOIN tops t ON t.c_nationkey = u
  LEFT JOIN customer c ON c.c_nationkey = u AND c.c_mktsegment = t.c_mktsegment)"""


@query("G10_syllabus_tree", f"WITH {_TREE} SELECT * FROM tree ORDER BY unit_number, topic_number, subtopic_number")
def _(spark, sf):
    return C.syllabus_labels(*T.course_tables(spark, sf)).orderBy("unit_number", "topic_number", "subtopic_number")


@query("G10_syllabus_nested", f"""
  WITH {_TREE}
  SELECT subject_id, unit, topic, CASE WHEN topic IS NOT NULL THEN coalesce(names, '') END AS subtopics
  FROM (SELECT subject_id, unit, topic,
      string_agg(subtopic, '|' ORDER BY subtopic_number) AS names FROM tree GROUP BY ALL)""")
def _(spark, sf):
    tree = C.syllabus_tree(C.syllabus_labels(*T.course_tables(spark, sf)))
    return tree.select("subject_id", "unit", F.explode_outer("topics").alias("t")).select(
        "subject_id", "unit", "t.topic", F.array_join("t.subtopics", "|").alias("subtopics")
    )


@query("G11_subject_file_paths", f"""
  WITH {_VERSIONS}, p AS (SELECT subject_id, path, thumb_path, pdf_path FROM decks JOIN versions USING (deck_id))
  SELECT subject_id, 'path' AS kind, path AS stored_path FROM p UNION ALL SELECT subject_id, 'thumb_path', thumb_path FROM p
  UNION ALL SELECT subject_id, 'pdf_path', pdf_path FROM p WHERE pdf_path IS NOT NULL""")
def _(spark, sf):
    return C.subject_file_paths(T.decks(spark, sf), T.versions(spark, sf))


@query("G12_stored_analysis", f"""
  WITH {_VERSIONS} SELECT version_id, CASE WHEN analysed = 1 THEN 'old ' || version_id END AS result FROM versions""")
def _(spark, sf):
    return C.stored_text(T.versions(spark, sf), T.analyses(spark, sf), "result")


_OLD = "old AS (SELECT version_id, 'old ' || version_id AS result FROM versions WHERE analysed = 1)"


@query("G13_upsert_analysis", f"""
  WITH {_VERSIONS}, {_OLD},
  new AS (SELECT version_id, 'new ' || version_id AS result FROM versions WHERE version % 3 = 0)
  SELECT version_id, 0 AS slide_number, result FROM new
  UNION ALL SELECT version_id, 0, result FROM old WHERE version_id NOT IN (SELECT version_id FROM new)""")
def _(spark, sf):
    new = T.versions(spark, sf).filter("version % 3 = 0").select(
        "version_id", F.concat(F.lit("new "), "version_id").alias("result")
    )
    return C.upsert_analyses(T.analyses(spark, sf), new)


def _stored(rows, bucket_by: str):
    return KeyedTable(rows.sparkSession, scratch_folder(rows.sparkSession)).create(rows, [bucket_by], 32)


@query("G13_upsert_stored", f"""
  WITH {_VERSIONS}, {_OLD},
  new AS (SELECT version_id, 'new ' || version_id AS result FROM versions WHERE version % 3 = 0)
  SELECT version_id, 0 AS slide_number, result FROM new
  UNION ALL SELECT version_id, 0, result FROM old WHERE version_id NOT IN (SELECT version_id FROM new)""")
def _(spark, sf):
    """Into the stored table; the second call brings the same batch again and changes nothing."""
    table = _stored(T.analyses(spark, sf), "version_id")
    new = T.versions(spark, sf).filter("version % 3 = 0").select(
        "version_id", F.lit(0).alias("slide_number"), F.concat(F.lit("new "), "version_id").alias("result")
    )
    table.upsert("batch 1", new, ["version_id"])
    table.upsert("batch 1", new.withColumn("result", F.lit("again")), ["version_id"])
    return table.read()


@query("G15_mark_latest_stored", f"""
  WITH {_VERSIONS}
  SELECT v.version_id, CASE WHEN n.version_id IS NOT NULL AND v.deck_id % 2 = 0 THEN 1 ELSE v.analysed END AS analysed
  FROM versions v LEFT JOIN newest n USING (version_id)""")
def _(spark, sf):
    """In a table laid out by deck: all versions of a touched deck are in its bucket."""
    table = _stored(T.versions(spark, sf), "deck_id")
    decks = staged(T.decks(spark, sf).filter("deck_id % 2 = 0"))
    table.change("mark", decks, lambda old: C.mark_latest_analysed(old, decks))
    return table.read().select("version_id", "analysed")


@query("G18_delete_stored", f"""
  WITH {_VERSIONS} SELECT version_id, deck_id, path FROM versions WHERE deck_id % 4 <> 1""")
def _(spark, sf):
    table = _stored(T.versions(spark, sf), "deck_id")
    table.delete("gone", T.decks(spark, sf).filter("deck_id % 4 = 1"), ["deck_id"])
    return table.read().select("version_id", "deck_id", "path")


@query("G14_update_version_score", f"""
  WITH {_VERSIONS} SELECT version_id, CASE WHEN version % 2 = 0 THEN total_slides / 4.0 END AS score,
    CASE WHEN version % 2 = 0 THEN 'bueno' END AS zone FROM versions""")
def _(spark, sf):
    versions = T.versions(spark, sf)
    scores = versions.filter("version % 2 = 0").select(
        "version_id", (F.col("total_slides") / 4.0).alias("score"), F.lit("bueno").alias("zone")
    )
    return C.update_scores(versions, scores).select("version_id", "score", "zone")


@query("G15_mark_latest_analysed", f"""
  WITH {_VERSIONS}
  SELECT v.version_id, CASE WHEN n.version_id IS NOT NULL AND v.deck_id % 2 = 0 THEN 1 ELSE v.analysed END AS analysed
  FROM versions v LEFT JOIN newest n USING (version_id)""")
def _(spark, sf):
    decks = T.decks(spark, sf).filter("deck_id % 2 = 0")
    return C.mark_latest_analysed(T.versions(spark, sf), decks).select("version_id", "analysed")


@query("G16_update_time_report", f"""
  WITH {_VERSIONS} SELECT version_id, CASE WHEN version = 1 THEN '{{"grupos":{{}}}}' END AS time_report FROM versions""")
def _(spark, sf):
    versions = T.versions(spark, sf)
    reports = versions.filter("version = 1").select("version_id", F.lit('{"grupos":{}}').alias("time_report"))
    return C.update_time_reports(versions, reports).select("version_id", "time_report")


@query("G17_toggle_subject", """
  SELECT c_custkey || '' AS subject_id, c_name AS name,
    CASE WHEN c_name IN ('Customer#000000001', 'Customer#000000007') THEN 0 WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS active
  FROM customer""")
def _(spark, sf):
    return C.toggle_subjects(_subjects(spark, sf), ["Customer#000000001", "Customer#000000007"], False)


def _rows(named):
    """What is left of several tables, as rows ``(part, id)``."""
    out = None
    for name, df, column in named:
        rows = df.select(F.lit(name).alias("part"), F.col(column).cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


_KEYS = ("deck_id", "version_id", "version_id", "deck_id")


@query("G18_delete_deck_cascade", f"""
  WITH {_VERSIONS}, gone AS (SELECT * FROM versions WHERE deck_id % 4 = 1)
  SELECT 'decks' AS part, CAST(deck_id AS VARCHAR) AS id FROM decks WHERE deck_id % 4 <> 1
  UNION ALL SELECT 'versions', version_id FROM versions WHERE deck_id % 4 <> 1
  UNION ALL SELECT 'analyses', version_id FROM versions WHERE deck_id % 4 <> 1 AND analysed = 1
  UNION ALL SELECT 'links', CAST(deck_id AS VARCHAR) FROM decks WHERE deck_id % 4 <> 1 AND deck_id % 3 = 0
  UNION ALL SELECT 'paths', path FROM gone UNION ALL SELECT 'paths', thumb_path FROM gone
  UNION ALL SELECT 'paths', pdf_path FROM gone WHERE pdf_path IS NOT NULL""")
def _(spark, sf):
    decks = T.decks(spark, sf)
    keys = decks.filter("deck_id % 4 = 1").select("deck_id")
    parts = C.delete_decks(keys, decks, T.versions(spark, sf), T.analyses(spark, sf), T.links(spark, sf))
    return _rows(zip(("decks", "versions", "analyses", "links", "paths"), parts, (*_KEYS, "stored_path")))


@query("G19_delete_subject_cascade", f"""
  WITH {_VERSIONS},
  gone AS (SELECT CAST(r_regionkey AS VARCHAR) AS subject_id FROM region WHERE r_name IN ('ASIA', 'EUROPE')),
  kept AS (SELECT * FROM decks WHERE subject_id NOT IN (SELECT subject_id FROM gone))
  SELECT 'active' AS part, r_name AS id FROM region WHERE r_regionkey % 2 = 1 AND r_name NOT IN ('ASIA', 'EUROPE')
  UNION ALL SELECT 'decks', CAST(deck_id AS VARCHAR) FROM kept
  UNION ALL SELECT 'versions', version_id FROM versions WHERE deck_id IN (SELECT deck_id FROM kept)
  UNION ALL SELECT 'analyses', version_id FROM versions WHERE deck_id IN (SELECT deck_id FROM kept) AND analysed = 1
  UNION ALL SELECT 'links', CAST(deck_id AS VARCHAR) FROM kept WHERE deck_id % 3 = 0""")
def _(spark, sf):
    subjects = T.course_tables(spark, sf)[0]
    parts = C.delete_subjects(
        ["ASIA", "EUROPE"], subjects, T.decks(spark, sf), T.versions(spark, sf), T.analyses(spark, sf), T.links(spark, sf)
    )
    named = zip(("decks", "versions", "analyses", "links"), parts[1:5], _KEYS)
    return _rows([("active", C.active_subjects(parts[0]), "name"), *named])


@query("G20_add_column_if_missing", f"""
  WITH {_VERSIONS} SELECT version_id, CAST(NULL AS VARCHAR) AS pdf_path FROM versions""")
def _(spark, sf):
    old = T.versions(spark, sf).drop("pdf_path")
    return C.add_column_if_missing(C.add_column_if_missing(old)).select("version_id", "pdf_path")


# --- course trees ------------------------------------------------------------------------------------


@query("A13_syllabus_json_source", """
  SELECT p_partkey, 'Unidad ' || p_size AS unit, '1.1' AS number, p_name AS name, 1 AS level FROM part
  UNION ALL SELECT p_partkey, 'Unidad ' || p_size, '1.1.' || p_size, p_type, 2 FROM part""")
def _(spark, sf):
    size = F.col("p_size").cast("string")
    entries = F.map_from_arrays(
        F.array(F.lit("1.1"), F.concat(F.lit("1.1."), size)), F.array("p_name", "p_type")
    )
    text = F.to_json(F.create_map(F.concat(F.lit("Unidad "), size), entries))
    maps = T.table(spark, sf, "part").select("p_partkey", F.from_json(text, SCH.SYLLABUS_MAP).alias("syllabus"))
    return SY.syllabus_map_rows(maps, "p_partkey")


@query("A14_syllabus_load", """
  WITH c AS (SELECT c_name, c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0),
  u AS (SELECT *, unnest(range(1, 2 + k % 3)) AS un FROM c),
  t AS (SELECT *, unnest(range(1, 1 + k % 4)) AS tn FROM u),
  s AS (SELECT *, unnest(range(1, 1 + k % 2)) AS sn FROM t)
  SELECT c_name AS subject, 'subject' AS level, CAST(NULL AS BIGINT) AS number, c_name AS name FROM c
  UNION ALL SELECT c_name, 'unit', un, 'Unidad ' || un FROM u
  UNION ALL SELECT c_name, 'topic', tn, 'Tema ' || tn FROM t
  UNION ALL SELECT c_name, 'subtopic', sn, 'Subtema ' || sn FROM s""")
def _(spark, sf):
    k = F.col("c_custkey").cast("int")

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def named(word, i, *more):
        return F.struct(i.alias("numero"), F.concat(F.lit(f"{word} "), i.cast("string")).alias("nombre"), *more)

    subtopics = F.transform(numbers(k % 2), lambda i: named("Subtema", i)).alias("subtemas")
    topics = F.transform(numbers(k % 4), lambda i: named("Tema", i, subtopics)).alias("temas")
    nested = T.table(spark, sf, "customer").select(
        F.col("c_name").alias("unidad_aprendizaje"),
        F.transform(numbers(1 + k % 3), lambda i: named("Unidad", i, topics)).alias("unidades"),
    )
    stored = _subjects(spark, sf).filter("active = 0")
    subjects, units, tops, subs = SY.load_syllabus(nested, stored)
    # Every level grows with the input, while its estimated size does not show the ids: merged, not broadcast.
    name = subjects.select("subject_id", F.col("name").alias("subject"))
    u = units.join(name.hint("merge"), "subject_id")
    t = tops.join(u.select("unit_id", "subject").hint("merge"), "unit_id")
    s = subs.join(t.select("topic_id", "subject").hint("merge"), "topic_id")

    def level(df, label, number):
        return df.select("subject", F.lit(label).alias("level"), number.cast("bigint").alias("number"), "name")

    return (
        level(subjects.withColumn("subject", F.col("name")), "subject", F.lit(None))
        .unionByName(level(u, "unit", F.col("number")))
        .unionByName(level(t, "topic", F.col("number")))
        .unionByName(level(s, "subtopic", F.col("number")))
    )
