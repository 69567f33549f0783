"""Catalogue of subjects, decks and versions.

Spark tables are not updated in place: every function returns the new table (or the rows to
append). Where a table format offers MERGE, the same keys serve as its condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import text as X
from decklens.operators import ordered as O
from decklens.operators.folded import fold_text, json_text
from decklens.operators.hash_index import HashIndex
from decklens.session import staged
from decklens.sources import files as FI

# --- subjects -------------------------------------------------------------------------------------


def active_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.filter(F.col("active") == 1).select("name")


def available_subjects(subjects: DataFrame) -> DataFrame:
    return subjects.filter(F.col("active") == 0).select("name")


def subject_ids(names: DataFrame, subjects: DataFrame) -> DataFrame:
    """Id per asked ``name``, null when there is none."""
    return names.join(subjects.select("name", "subject_id"), "name", "left")


def subject_names(ids: DataFrame, subjects: DataFrame) -> DataFrame:
    """Name per asked ``subject_id``, null when there is none."""
    return ids.join(subjects.select("subject_id", "name"), "subject_id", "left")


def toggle_subjects(subjects: DataFrame, names, active: bool) -> DataFrame:
    """Switch subjects on or off by name."""
    return subjects.withColumn(
        "active", F.when(F.col("name").isin(*names), F.lit(int(active))).otherwise(F.col("active"))
    )


# --- upload ---------------------------------------------------------------------------------------


def known_hash(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Add ``known``: whether any version of any subject has this hash.

    The known side is reduced to distinct hashes first. On the file side a hash with very many
    copies is split by the adaptive skew join, since nothing downstream needs the partitioning.
    """
    seen = versions.select("hash").filter(F.col("hash").isNotNull()).distinct().withColumn("known", F.lit(True))
    return files.join(seen, "hash", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def _outcomes(
    files: DataFrame, versions: DataFrame | None, limit_mb: float, index: HashIndex | None = None,
    barred: tuple[str, Column] | None = None,
) -> DataFrame:
    """``files`` with a ``reason`` for rejection, null if accepted; written once to the shared folder.

    The source is read once. Of the usable files one aggregate per hash finds the first, the known hashes are
    found among those, and one join takes both back to the files. Rows that are ``barred``
    (reason, condition) are out before the gates and stand in for no copy.
    """
    why, out = barred or ("", F.lit(False))
    large = F.coalesce(~FI.within_limit(F.col("length"), limit_mb), F.lit(False))
    batch = staged(files.withColumns({"_out": out, "_large": large}))
    arrived = F.struct("arrival", "file_id")
    usable = batch.filter("not _out and not _large and hash is not null")
    first = usable.groupBy("hash").agg(F.min(arrived).alias("_first"))
    if index is None:
        known = first.select("hash").join(versions.select("hash"), "hash", "left_semi")
    else:
        known = index.known(first.select("hash"))
    per_hash = first.join(known.withColumn("_known", F.lit(True)), "hash", "left")
    # A file without a hash is known to nobody and a copy of none.
    reason = (
        F.when(F.col("_out"), F.lit(why))
        .when(F.col("_large"), F.lit("too_large"))
        .when(F.col("_known"), F.lit("duplicate"))
        .when(F.coalesce("total_slides", F.lit(0)) <= 0, F.lit("no_slides"))
        .when(F.col("hash").isNotNull() & (arrived != F.col("_first")), F.lit("duplicate"))
    )
    told = batch.join(per_hash, "hash", "left").withColumn("reason", reason)
    return staged(told.select(*files.columns, "reason"))


def gate_files(
    files: DataFrame, versions: DataFrame | None, limit_mb: float = K.SIZE_LIMIT_MB, index: HashIndex | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split incoming ``files(file_id, arrival, length, hash, total_slides, ...)``.

    Returns ``(accepted, rejected)``; ``rejected`` has a ``reason``: too large, duplicate, or no
    slides, tested in this order. Of several copies in one batch the first to arrive is kept (copies
    have equally many slides: those of an empty file fail on the count, unless the hash was known before). One
    row per hash is picked by a partial aggregate, and only those rows meet the known hashes, so
    no task ever holds all copies of one file. Known hashes come from ``versions``, or from a stored ``index``.
    A file without a hash is neither known nor a copy.
    """
    told = _outcomes(files, versions, limit_mb, index)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null")


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _extension(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)


def _version_rows(files: DataFrame, version: Column, suffix: Column, loaded: Column) -> DataFrame:
    folder = F.concat(F.lit("presentaciones/"), F.col("subject"), F.lit("/"))
    stem = F.concat(folder, _stem(F.col("file_name")), suffix)
    return files.select(
        F.sha2(F.concat_ws("/", F.col("deck_id").cast("string"), version.cast("string")), 256).alias("version_id"),
        "deck_id",
        version.cast("int").alias("version"),
        F.lit(0).alias("analysed"),
        loaded.alias("loaded"),
        F.col("total_slides").cast("int").alias("total_slides"),
        "hash",
        F.concat(stem, _extension(F.col("file_name"))).alias("path"),
        F.concat(stem, F.lit("_thumb.png")).alias("thumb_path"),
        F.concat(stem, F.lit(".pdf")).alias("pdf_path"),
        F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("string").alias("zone"),
        F.lit(None).cast("string").alias("time_report"),
    )


def register_decks(
    files: DataFrame, subjects: DataFrame, versions: DataFrame | None, loaded: Column | None = None,
    limit_mb: float = K.SIZE_LIMIT_MB, index: HashIndex | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(decks, versions, rejected)`` to append for new files ``(..., subject_id, file_name)``.

    Ids are derived from the file, so a repeated run gives the same rows. Files of an unknown
    subject are rejected before the gates, so that they cannot stand in for a storable copy. Known
    hashes as in :func:`gate_files`.
    """
    named = subjects.select("subject_id", F.col("name").alias("subject"), F.lit(True).alias("_named"))
    placed = files.join(named, "subject_id", "left")
    told = _outcomes(placed, versions, limit_mb, index, ("no_subject", F.col("_named").isNull()))
    # Files without a hash may share a name, and are told apart by their own ids.
    content = F.coalesce("hash", F.concat(F.lit("file "), F.col("file_id").cast("string")))
    good = told.filter("reason is null").withColumn("deck_id", F.sha2(F.concat_ws("/", "subject_id", "file_name", content), 256))
    decks = good.select("deck_id", "subject_id", "file_name")
    rows = _version_rows(good, F.lit(1), F.lit(""), loaded if loaded is not None else F.current_date())
    return decks, rows, told.filter("reason is not null").select(*files.columns, "reason")


def append_versions(
    files: DataFrame, decks: DataFrame, versions: DataFrame, subjects: DataFrame,
    loaded: Column | None = None, limit_mb: float = K.SIZE_LIMIT_MB, block: int = 100_000, index: HashIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(versions, rejected)`` to append for files that update existing decks.

    Several files of one deck in a batch are numbered by arrival, blockwise (see
    :mod:`decklens.operators.ordered`), on top of the highest stored version. Known hashes as in
    :func:`gate_files`.
    """
    latest = versions.groupBy("deck_id").agg(F.max("version").alias("latest"))
    subject = subjects.select("subject_id", F.col("name").alias("subject"))
    target = (
        decks.select("deck_id", "subject_id").join(latest, "deck_id").join(subject, "subject_id")
        .select("deck_id", "latest", "subject")
    )
    told = _outcomes(files.join(target, "deck_id", "left"), versions, limit_mb, index, ("no_deck", F.col("latest").isNull()))
    numbered = O.dense_number(told.filter("reason is null"), ["deck_id"], ["arrival", "file_id"], F.floor(F.col("arrival") / block))
    version = F.col("latest") + F.col("number")
    rows = _version_rows(
        numbered, version, F.concat(F.lit("_v"), version.cast("string")),
        loaded if loaded is not None else F.current_date(),
    )
    return rows, told.filter("reason is not null").select(*files.columns, "reason")


# --- versions ---------------------------------------------------------------------------------------


def latest_versions(versions: DataFrame, *columns: str) -> DataFrame:
    """The newest version row of each deck (one partial aggregate, no window)."""
    columns = columns or tuple(c for c in versions.columns if c != "deck_id")
    return versions.groupBy("deck_id").agg(
        F.max_by(F.struct(*columns), F.col("version")).alias("v")
    ).select("deck_id", "v.*")


def latest_by_subject(decks: DataFrame, versions: DataFrame) -> DataFrame:
    """File name and paths of the newest version of every deck, with its subject."""
    newest = latest_versions(versions, "path", "thumb_path", "analysed", "pdf_path")
    return decks.join(newest, "deck_id").select(
        "subject_id", "file_name", "path", "thumb_path", "analysed", "pdf_path"
    )


def current_version_id(decks: DataFrame, versions: DataFrame) -> DataFrame:
    """Newest version id by (subject, file name)."""
    return decks.join(latest_versions(versions, "version_id"), "deck_id").select("subject_id", "file_name", "version_id")


def id_and_max_version(asked: DataFrame, decks: DataFrame, versions: DataFrame) -> DataFrame:
    """Deck id and highest version for asked ``(subject_id, file_name)``; null and 0 when absent."""
    top = versions.groupBy("deck_id").agg(F.max("version").alias("version"))
    found = decks.join(top, "deck_id")
    return asked.join(found, ["subject_id", "file_name"], "left").select(
        "subject_id", "file_name", "deck_id", F.coalesce("version", F.lit(0)).alias("version")
    )


def version_history(decks: DataFrame, versions: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """All versions of each deck, newest first; only of the decks in ``asked`` (``deck_id``) if given.

    The sort is a range shuffle, not one task.
    """
    if asked is not None:
        decks = decks.join(asked.select("deck_id"), "deck_id", "left_semi")
    return (
        decks.join(versions, "deck_id")
        .select("deck_id", "file_name", "version", "loaded", "total_slides", "analysed", "pdf_path")
        .orderBy("deck_id", F.desc("version"))
    )


def subject_file_paths(decks: DataFrame, versions: DataFrame) -> DataFrame:
    """Every stored path of a subject's files."""
    rows = decks.select("deck_id", "subject_id").join(
        versions.select("deck_id", "path", "thumb_path", "pdf_path"), "deck_id"
    )
    return rows.unpivot(
        ["subject_id"], ["path", "thumb_path", "pdf_path"], "kind", "stored_path"
    ).filter(F.col("stored_path").isNotNull())


def stored_text(asked: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """Stored text by ``version_id``, null when missing (analyses or time reports)."""
    return asked.select("version_id").join(stored.select("version_id", column), "version_id", "left")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` replaced or added by key.

    Of several changes of one key, the one with the greatest values, column by column, counts.
    """
    new = _one_per_key(changes.select(*table.columns), keys)
    kept = table.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new)


def _one_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    if not rest:
        return changes.distinct()
    return changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_new")).select(*keys, "_new.*")


def upsert_analyses(analyses: DataFrame, results: DataFrame) -> DataFrame:
    """Store the analysis of each version in ``results(version_id, result)``, one row per version.

    A new analysis replaces the stored one whole. The slide number is fixed to 0. Of several results
    for one version, the greatest text counts.
    """
    rows = _one_per_key(results.select("version_id", F.lit(0).alias("slide_number"), "result"), ["version_id", "slide_number"])
    kept = analyses.join(rows.select("version_id"), "version_id", "left_anti")
    return kept.unionByName(rows)


def update_versions(versions: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """Overwrite ``columns`` of the versions named in ``changes`` by ``version_id``.

    Of several changes of one version, the one with the greatest values, column by column, counts.
    """
    new = _one_per_key(changes.select("version_id", *columns), ["version_id"]).select(
        "version_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns]
    )
    joined = versions.join(new, "version_id", "left")
    return joined.select(*[
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in versions.columns
    ])


def update_scores(versions: DataFrame, scores: DataFrame) -> DataFrame:
    return update_versions(versions, scores, "score", "zone")


def update_time_reports(versions: DataFrame, reports: DataFrame) -> DataFrame:
    return update_versions(versions, reports, "time_report")


def mark_latest_analysed(versions: DataFrame, decks: DataFrame, state: int = 1) -> DataFrame:
    """Set the analysed flag on the newest version of the given decks only."""
    newest = latest_versions(versions, "version_id").join(decks.select("deck_id"), "deck_id", "left_semi")
    return update_versions(versions, newest.select("version_id", F.lit(state).alias("analysed")), "analysed")


def delete_decks(keys: DataFrame, decks: DataFrame, versions: DataFrame, analyses: DataFrame, links: DataFrame):
    """Remove decks with all that hangs on them: ``(decks, versions, analyses, links, paths)``.

    ``paths`` lists the files of all removed versions, so that none is left behind.
    """
    gone = versions.join(keys, "deck_id", "left_semi")
    paths = gone.unpivot(["version_id"], ["path", "thumb_path", "pdf_path"], "kind", "stored_path").filter(
        F.col("stored_path").isNotNull()
    )
    return (
        decks.join(keys, "deck_id", "left_anti"),
        versions.join(keys, "deck_id", "left_anti"),
        analyses.join(gone.select("version_id"), "version_id", "left_anti"),
        links.join(keys, "deck_id", "left_anti"),
        paths,
    )


def delete_subjects(names, subjects, decks, versions, analyses, links):
    """Remove all decks of the named subjects (links included) and switch the subjects off."""
    ids = subjects.filter(F.col("name").isin(*names)).select("subject_id")
    keys = decks.join(ids, "subject_id", "left_semi").select("deck_id")
    return (toggle_subjects(subjects, names, False), *delete_decks(keys, decks, versions, analyses, links))


def add_column_if_missing(df: DataFrame, name: str = "pdf_path", type_: str = "string") -> DataFrame:
    """The table with a (null) column ``name``; unchanged when it has one."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(type_))


# --- syllabus ----------------------------------------------------------------------------------------


def syllabus_rows(subjects: DataFrame, units: DataFrame, topics: DataFrame, subtopics: DataFrame) -> DataFrame:
    """Units of each subject with their topics and subtopics, where there are any.

    The outer joins are spelled as inner joins plus the entries without children: the adaptive
    skew join can split a very large topic in an inner join, but not on the right of an outer one.
    """
    u = subjects.select("subject_id", F.col("name").alias("subject")).join(
        units.select("unit_id", "subject_id", F.col("number").alias("unit_number"), F.col("name").alias("unit_name")),
        "subject_id",
    )
    t = topics.select("topic_id", "unit_id", F.col("number").alias("topic_number"), F.col("name").alias("topic_name"))
    s = subtopics.select("topic_id", F.col("number").alias("subtopic_number"), F.col("name").alias("subtopic_name"))
    with_topic = u.join(t, "unit_id")
    bare_units = u.join(t.select("unit_id").distinct(), "unit_id", "left_anti")
    bare_topics = with_topic.join(s.select("topic_id").distinct(), "topic_id", "left_anti")
    return (
        with_topic.join(s, "topic_id")
        .unionByName(bare_topics, allowMissingColumns=True)
        .unionByName(bare_units, allowMissingColumns=True)
    )


def syllabus_labels(subjects, units, topics, subtopics) -> DataFrame:
    """The course tree in flat form, with the official labels of each level."""
    n = {c: F.col(c).cast("string") for c in ("unit_number", "topic_number", "subtopic_number")}
    dot = F.lit(".")
    number_t = F.concat(n["unit_number"], dot, n["topic_number"])
    rows = syllabus_rows(subjects, units, topics, subtopics)
    return rows.select(
        "subject_id", "subject", "unit_number", "topic_number", "subtopic_number",
        F.concat(F.lit("Unidad Temática "), n["unit_number"], F.lit(". "), "unit_name").alias("unit"),
        F.when(F.col("topic_name") != "", F.concat(number_t, F.lit(" "), "topic_name")).alias("topic"),
        F.when(
            F.col("subtopic_name") != "",
            F.concat(number_t, dot, n["subtopic_number"], F.lit(" "), "subtopic_name"),
        ).alias("subtopic"),
    )


_TOPICS = "array<struct<topic:string,subtopics:array<string>>>"


def _unit_topics(labels: DataFrame) -> DataFrame:
    """``(subject_id, subject, unit_number, unit, n, text)``: topics of each unit as JSON entries, in order."""
    unit = ["subject_id", "subject", "unit_number", "unit"]
    topic = [*unit, "topic_number", "topic"]
    names = fold_text(
        labels.select(*topic, "subtopic_number", F.when(F.col("subtopic").isNotNull(), json_text(F.col("subtopic"))).alias("entry")),
        topic, ["subtopic_number"],
    )
    entry = F.concat(F.lit('{"topic":'), json_text(F.col("topic")), F.lit(',"subtopics":['), "text", F.lit("]}"))
    rows = names.select(*unit, "topic_number", F.when(F.col("topic").isNotNull(), entry).alias("entry"))
    return fold_text(rows, unit, ["topic_number"]).drop("head")


def syllabus_tree(labels: DataFrame) -> DataFrame:
    """Nested topics per unit: ``(subject_id, subject, unit_number, unit, topics[{topic, subtopics[]}])``.

    Lists of any length, in the order of the numbers. Units without topics keep an empty list.
    """
    topics = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), _TOPICS)
    return _unit_topics(labels).select("subject_id", "subject", "unit_number", "unit", topics.alias("topics"))


def syllabus_documents(labels: DataFrame) -> DataFrame:
    """``(subject_id, subject, temario)``: the whole course tree of a subject as one JSON text."""
    entry = F.concat(F.lit('{"unit":'), json_text(F.col("unit")), F.lit(',"topics":['), "text", F.lit("]}"))
    rows = _unit_topics(labels).select("subject_id", "subject", "unit_number", entry.alias("entry"))
    return fold_text(rows, ["subject_id", "subject"], ["unit_number"]).select(
        "subject_id", "subject", F.concat(F.lit("["), "text", F.lit("]")).alias("temario")
    )


def search_subjects(subjects: DataFrame, text: str) -> DataFrame:
    """Subjects whose name contains ``text``, accents and case ignored."""
    return subjects.filter(X.fold_contains(F.col("name"), text))
