"""Per-slide metrics: readability, lexical density, complexity (ICD), word load (WPS), slide type,
title coherence (HSS) and narrative thread (NTS).

Each function adds columns to a slide table. The steps are separate projections on purpose: a
long expression named several times by the next step then stays a computed column instead of
being repeated. Nothing here shuffles except the optional join with judged slides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N
from decklens.functions import text as X

JUDGE_COLUMNS = {
    "judged_type": "string", "hss_judged": "double", "hss_feedback": "string",
    "nts_judged": "double", "nts_feedback": "string", "judged_seconds": "int",
}


def with_text(slides: DataFrame) -> DataFrame:
    """``slide_text`` (title and body) and ``body_text``."""
    return slides.withColumns({
        "slide_text": X.slide_text(F.col("title"), F.col("content")),
        "body_text": X.body_text(F.col("content")),
    })


def with_counts(df: DataFrame) -> DataFrame:
    """All counts the metrics need, with as few passes over the text as possible."""
    text, title = F.col("slide_text"), F.coalesce("title", F.lit(""))
    listed = df.withColumns({
        "token_list": X.raw_tokens(text),
        "syllables": X.syllable_count(text),
        "sentences": F.greatest(X.sentence_count(text), F.lit(1)),
        "body_words": X.word_count(F.col("body_text")),
        "title_words": X.word_count(title),
    })
    return listed.withColumns({
        "words": F.col("title_words") + F.col("body_words"),
        "tokens": F.size("token_list"),
        "function_words": X.function_words(F.col("token_list")),
    }).drop("token_list", "title_words")


def with_readability(df: DataFrame) -> DataFrame:
    """Spanish reading ease (0..100) and its complexity factor; null below 5 words."""
    words = N.let(F.col("words"), lambda n: F.when(n >= K.READABILITY_MIN_WORDS, n))
    ratios = df.withColumn("words_read", words).withColumns({
        "syllables_per_word_raw": F.col("syllables") / F.col("words_read"),
        "words_per_sentence_raw": F.col("words_read") / F.col("sentences"),
    })
    ease = (
        F.lit(K.FSZ_BASE)
        - F.lit(K.FSZ_SYLLABLE_FACTOR) * F.col("syllables_per_word_raw")
        - F.col("words_per_sentence_raw")
    )
    return (
        ratios.withColumn("fsz_raw", ease)
        .withColumn("fsz_clamped", N.clamp(F.col("fsz_raw"), 0.0, 100.0))
        .withColumns({
            "syllables_per_word": N.py_round(F.col("syllables_per_word_raw"), 3),
            "words_per_sentence": N.py_round(F.col("words_per_sentence_raw"), 3),
            "fsz": N.py_round(F.col("fsz_clamped"), 2),
            "fsz_zone": N.label_from(F.col("fsz_clamped"), K.FSZ_ZONES, K.FSZ_ZONE_REST),
            "cf": N.py_round((100.0 - F.col("fsz_clamped")) / 100.0, 4),
        })
        .drop("words_read")
    )


def with_density(df: DataFrame) -> DataFrame:
    """Share of content words in percent (``dl``) and as a ratio (``dln``); null below 5 tokens."""
    tokens = N.let(F.col("tokens"), lambda n: F.when(n >= K.DENSITY_MIN_TOKENS, n))
    raw = df.withColumn("content_words", F.col("tokens") - F.col("function_words")).withColumn(
        "dl_raw", F.col("content_words") / tokens * 100
    )
    return raw.withColumns({
        "dl": N.py_round(F.col("dl_raw"), 2),
        "dln": N.py_round(F.col("dl_raw") / 100.0, 4),
    })


def with_icd(df: DataFrame) -> DataFrame:
    """Complexity index from the rounded factors; null when it cannot be computed.

    Both factors lie in 0..1, so the index lies in 0..10 by itself.
    """
    weighted = (
        F.lit(K.ICD_WEIGHT_READABILITY) * F.col("cf") + F.lit(K.ICD_WEIGHT_DENSITY) * F.col("dln")
    ) * 10
    return (
        df.withColumn("icd", F.when(F.col("words") >= K.ICD_MIN_WORDS, N.py_round(weighted, 2)))
        .withColumn("icd_zone", N.label_up_to(F.col("icd"), K.ICD_ZONES, K.ICD_ZONE_REST))
    )


def with_icd_feedback(df: DataFrame) -> DataFrame:
    """Advice when the index leaves 3.5..6.5, with up to three example words when it is high."""
    head, cause, open_, close, advice = (F.lit(p) for p in K.ICD_HIGH_MESSAGE)
    low_head, low_tail = (F.lit(p) for p in K.ICD_LOW_MESSAGE)
    examples = F.array_join(X.longest_words(F.col("slide_text")), ", ")
    quoted = N.let(examples, lambda e: F.when(e != "", F.concat(open_, e, close)).otherwise(F.lit("")))

    def message(icd: Column) -> Column:
        value = icd.cast("string")
        return F.when(icd > K.ICD_HIGH, F.concat(head, value, cause, quoted, advice)).when(
            icd < K.ICD_LOW, F.concat(low_head, value, low_tail)
        )

    return df.withColumn("icd_feedback", N.let(F.col("icd"), message))


def with_wps(df: DataFrame) -> DataFrame:
    """Word load of the body: 10 up to 50 words, then one point less per 15 words."""
    n = F.col("body_words")
    head, tail = (F.lit(p) for p in K.WPS_MESSAGE)
    zones = ((K.WPS_OPTIMUM, "optima"), (K.WPS_DENSE_UP_TO, "densa"))
    over = df.withColumns({
        "wps_excess": F.greatest(F.lit(0), n - K.WPS_OPTIMUM),
        "wps_deficit": F.lit(0),
        "wps_in_range": n <= K.WPS_OPTIMUM,
        "wps_zone": N.label_up_to(n, zones, "saturada"),
    })
    excess = F.col("wps_excess")
    score = F.greatest(F.lit(0.0), 10.0 - excess / K.WPS_WORDS_PER_POINT)
    return over.withColumns({
        "wps": N.py_round(score, 2),
        "wps_feedback": N.let(
            excess, lambda e: F.when(e > 0, F.concat(head, e.cast("string"), tail))
        ),
    })


def with_length_flags(df: DataFrame) -> DataFrame:
    """Whether a slide has a title, and whether title and body stay below the length limits of the
    slide types. Kept as flags, so that no text has to travel to where they are needed."""
    title = F.coalesce("title", F.lit(""))
    text = F.concat_ws(" ", title, "body_text")
    return df.withColumns({
        "has_title": X.has_text(title),
        "under_visual": ~X.has_words(text, K.VISUAL_BELOW_WORDS),
        "under_empty": ~X.has_words(text, K.EMPTY_BELOW_WORDS),
    })


def with_plain_words(df: DataFrame) -> DataFrame:
    """Plain words of title and body, and of the body alone, for rules that follow the judge: counted
    here, where the texts are, so that only the numbers go through its join."""
    return df.withColumns({
        "spoken_words": X.plain_word_count(F.concat_ws(" ", "title", "body_text")),
        "body_plain_words": X.plain_word_count(F.col("body_text")),
    })


def local_metrics(slides: DataFrame) -> DataFrame:
    """Everything that needs no judge."""
    return (
        slides.transform(with_text)
        .transform(with_counts)
        .transform(with_readability)
        .transform(with_density)
        .transform(with_icd)
        .transform(with_icd_feedback)
        .transform(with_wps)
        .transform(with_length_flags)
        .transform(with_plain_words)
    )


def with_judge(df: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Attach judged columns by deck and slide; all null without a judge.

    Both sides are keyed by (deck, slide), which no single deck can make hot.
    """
    if judged is None:
        return df.withColumns({c: F.lit(None).cast(t) for c, t in JUDGE_COLUMNS.items()})
    return df.join(judged.select("deck_id", "slide_number", *JUDGE_COLUMNS), ["deck_id", "slide_number"], "left")


def with_type(df: DataFrame) -> DataFrame:
    """Slide type, exposure seconds and whether the slide counts as content.

    Pictures with little text and near-empty slides are typed by rule and lose their judged
    scores, but keep the judged time.
    """
    ruled = F.when((F.col("image_count") > 0) & F.col("under_visual"), F.lit("visual")).when(
        F.col("under_empty"), F.lit("sin_contenido")
    )
    return df.withColumns({
        "slide_type": F.coalesce(ruled, F.lower("judged_type"), F.lit("contenido")),
        "seconds": F.coalesce("judged_seconds", F.lit(K.SECONDS_DEFAULT)),
    }).withColumn("is_content", F.col("slide_type") == "contenido")


def with_coherence(df: DataFrame) -> DataFrame:
    """Title coherence score and label of content slides."""
    content = F.col("is_content")
    return df.withColumns({
        "hss": F.when(content, F.coalesce("hss_judged", F.lit(K.HSS_DEFAULT))),
        "hss_text": F.when(content, F.coalesce("hss_feedback", F.lit(""))),
    }).withColumn(
        "hss_label",
        F.coalesce(N.label_from(F.col("hss"), K.HSS_LABELS, K.HSS_LABEL_REST), F.lit(K.NOT_APPLICABLE)),
    )


def with_narrative(df: DataFrame) -> DataFrame:
    """Narrative score and label of content slides."""
    content = F.col("is_content")
    return df.withColumns({
        "nts": F.when(content, F.coalesce("nts_judged", F.lit(K.NTS_DEFAULT))),
        "nts_text": F.when(content, F.coalesce("nts_feedback", F.lit(""))),
    }).withColumn(
        "nts_label",
        F.coalesce(N.label_from(F.col("nts"), K.NTS_LABELS, K.NTS_LABEL_REST), F.lit(K.NOT_APPLICABLE)),
    )


def title_overlap(slides: DataFrame) -> DataFrame:
    """Keywords shared by title and body (person names removed), sorted; and as payload text."""
    body = X.strip_person_names(X.body_text(F.col("content")))
    shared = F.array_sort(
        F.array_intersect(X.title_keywords(X.strip(F.col("title"))), X.title_keywords(body))
    )
    return slides.withColumn("overlap", shared).withColumn(
        "overlap_text",
        F.when(F.size("overlap") > 0, F.array_join("overlap", ", ")).otherwise(F.lit(K.NO_OVERLAP)),
    )
