"""Text helpers, Column -> Column, all on built-in expressions.

Whitespace, digit and letter classes are written out (see ``constants``) so that results equal
Python's Unicode-aware ``str`` methods. Counting is done with one regex pass per text wherever a
pass can express the rule; only rules that need a decision per line or per token use a
higher-order function. No rule explodes rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N

WS, LET, LETF = K.WS, K.LETTERS, K.LETTERS_FOLDED

_STRIPPED = f"(?s)[^{WS}](?:.*[^{WS}])?"
_STRIPPED_LINE = f"[^{WS}](?:[^\\r\\n]*[^{WS}])?"
_WORD = f"[^{WS}]+"
_TOKEN_END = f"(?![^{WS}])"
# Tokens that are not words: plain numbers, numbers with an inner separator (prefix is enough),
# capital codes ending in digits.
_NOT_A_WORD = (
    rf"\p{{Nd}}+{_TOKEN_END}|\p{{Nd}}+[.,/\-:]\p{{Nd}}|[A-Z]{{1,6}}\p{{Nd}}+{_TOKEN_END}"
)
_COUNTED_WORD = f"(?<![^{WS}])(?!{_NOT_A_WORD})[^{WS}]+"
_FINAL_Y = f"[yY](?![{LET}])"
# One match per syllable: a weak vowel swallows any vowel after it, a strong one swallows a weak
# one, a final y is a weak vowel; a run of letters without any of these counts once as well.
_SYLLABLE = (
    f"[{K.WEAK_VOWELS}](?:[{K.VOWELS}]|{_FINAL_Y})?"
    f"|[{K.STRONG_VOWELS}](?:[{K.WEAK_VOWELS}]|{_FINAL_Y})?"
    f"|{_FINAL_Y}"
    f"|(?<![{LET}])[{K.CONSONANTS}]*[{K.CONSONANTS_BUT_Y}](?![{LET}])"
)
_BULLET = rf"^[{WS}]*(?:[•\-*]|\p{{Nd}}+[.)])[{WS}]+"
_STOP_MARK = "[.!?;]"
_SENTENCE_RUN = f"[^.!?;{WS}][^.!?;]*"
_PERSON = (
    f"[A-ZÁÉÍÓÚ][a-záéíóú]{{2,}}[{WS}]+[A-ZÁÉÍÓÚ][a-záéíóú]{{2,}}[{WS}]+"
    f"[A-ZÁÉÍÓÚ][a-záéíóú]{{2,}}"
)


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_extract(c, _STRIPPED, 0)


def has_text(c: Column) -> Column:
    return c.rlike(f"[^{WS}]")


def text_lines(c: Column) -> Column:
    """Non-blank stripped lines as an array (empty for blank text)."""
    return F.regexp_extract_all(c, F.lit(_STRIPPED_LINE), F.lit(0))


def feed_lines(c: Column) -> Column:
    """As :func:`text_lines`, but lines end at a line feed only; a bare carriage return stays inside."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda line: line != "")


def clean_text(c: Column) -> Column:
    """Lines stripped, blank ones dropped, joined by ``" \\n "``."""
    return F.array_join(text_lines(c), " \n ")


def collapse_whitespace(c: Column) -> Column:
    """Each whitespace run becomes one space, ends stripped; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, f"[{WS}]+", " ")), F.lit(""))


def content_lines(content: Column) -> Column:
    """Non-blank stripped lines of an array of blocks."""
    return feed_lines(F.array_join(content, "\n"))


def _joined(title: Column, content: Column, separator: str) -> Column:
    blocks = F.concat(F.array(F.coalesce(title, F.lit(""))), F.coalesce(content, F.array().cast("array<string>")))
    return F.array_join(F.filter(F.transform(blocks, strip), lambda b: b != ""), separator)


def slide_text(title: Column, content: Column) -> Column:
    """Title and non-blank blocks, stripped, one per line; footers never enter."""
    return _joined(title, content, "\n")


def joined_text(title: Column, content: Column) -> Column:
    """As :func:`slide_text`, joined by a space."""
    return _joined(title, content, " ")


def body_text(content: Column) -> Column:
    return F.coalesce(F.array_join(content, " "), F.lit(""))


def plain_word_count(c: Column) -> Column:
    """Whitespace-separated tokens of any kind."""
    return F.regexp_count(c, F.lit(_WORD))


def has_words(c: Column, n: int) -> Column:
    """Whether there are at least ``n`` whitespace-separated tokens; stops reading at the n-th."""
    return c.rlike(f"^[{WS}]*+(?:[^{WS}]++[{WS}]++){{{n - 1}}}[^{WS}]")


def word_count(c: Column) -> Column:
    """Whitespace-separated tokens without numbers and number codes."""
    return F.regexp_count(c, F.lit(_COUNTED_WORD))


def syllable_count(c: Column) -> Column:
    """Spanish syllables, at least one per run of letters."""
    return F.regexp_count(c, F.lit(_SYLLABLE))


def sentence_count(c: Column) -> Column:
    """Number of sentences :func:`sentence_split` gives, without building them."""

    def in_line(line: Column) -> Column:
        words = plain_word_count(line)
        return (
            F.when(line.rlike(_BULLET), F.lit(1))
            .when(line.rlike(_STOP_MARK), F.regexp_count(line, F.lit(_SENTENCE_RUN)))
            .otherwise(F.ceil(words / K.SENTENCE_MAX_WORDS).cast("int"))
        )

    return F.aggregate(F.split(c, "\n"), F.lit(0), lambda n, line: n + in_line(line))


def sentence_split(c: Column) -> Column:
    """Sentences of a text, line by line.

    A bullet line is one sentence; a line with ``. ! ? ;`` is cut there; a longer line without
    them is cut every 20 words; any other line is one sentence.
    """

    def in_line(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))
        step = K.SENTENCE_MAX_WORDS
        pieces = F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step)),
            lambda start: F.array_join(F.slice(words, start, F.lit(step)), " "),
        )
        parts = F.filter(F.transform(F.split(line, _STOP_MARK), strip), lambda p: p != "")
        return (
            F.when(line.rlike(_BULLET), F.array(line))
            .when(line.rlike(_STOP_MARK), parts)
            .when(F.size(words) > step, pieces)
            .otherwise(F.array(line))
        )

    return F.flatten(F.transform(feed_lines(c), in_line))


def raw_tokens(c: Column) -> Column:
    """Runs of Spanish letters as written."""
    return F.regexp_extract_all(c, F.lit(f"[{LETF}]+"), F.lit(0))


def alpha_tokens(c: Column) -> Column:
    """Lower-cased runs of Spanish letters, in order."""
    return F.transform(raw_tokens(c), F.lower)


def function_words(tokens: Column) -> Column:
    """How many of the given tokens are function words."""
    return F.size(F.filter(tokens, lambda t: F.lower(t).isin(*K.DENSITY_STOP_WORDS)))


def _long_tokens(c: Column, at_least: int, drop) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(f"[{LETF}]{{{at_least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*drop))


def title_keywords(c: Column) -> Column:
    """Distinct tokens of 4+ letters, without stop words and academic filler."""
    return F.array_distinct(_long_tokens(c, 4, K.TITLE_STOP_WORDS + K.ACADEMIC_FILLER))


def narrative_terms(c: Column) -> Column:
    """Tokens of 3+ letters without stop words, repeated as often as they occur."""
    return _long_tokens(c, 3, K.NARRATIVE_STOP_WORDS)


def term_counts(terms: Column) -> Column:
    """Distinct terms of an array in order, each with its occurrences and their share: ``(term, n, tf)``."""

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (x != F.get(t, i - 1)), i)), lambda i: i.isNotNull())

        def run(s: Column, i: Column, k: Column) -> Column:
            n = F.coalesce(F.get(s, k + 1), F.size(t)) - i
            return F.struct(F.get(t, i).alias("term"), n.cast("long").alias("n"), (n / F.size(t)).alias("tf"))

        return N.let(starts, lambda s: F.transform(s, lambda i, k: run(s, i, k)))

    return N.let(F.sort_array(terms), runs)


def strip_person_names(c: Column) -> Column:
    """Remove every run of three capitalised words, then strip."""
    return strip(F.regexp_replace(c, _PERSON, ""))


def longest_words(c: Column, k: int = 3) -> Column:
    """Up to ``k`` longest distinct words of 6+ letters, function words left out.

    Equal lengths are listed alphabetically (the order is otherwise undefined).
    """
    words = F.array_distinct(_long_tokens(c, 6, K.DENSITY_STOP_WORDS))
    keyed = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(keyed, 1, k), lambda s: s["w"])


def truncate(c: Column, chars: int = K.PAYLOAD_CHARS, ellipsis: str = "...") -> Column:
    return F.when(
        F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit(ellipsis))
    ).otherwise(c)


def fold_contains(name: Column, query: Column | str) -> Column:
    """Substring test without regard to case and accents; a blank query matches everything."""
    query = F.lit(query) if isinstance(query, str) else query
    wanted = strip(query)
    return (wanted == "") | F.contains(
        F.collate(name, "UNICODE_CI_AI"), F.collate(wanted, "UNICODE_CI_AI")
    )


def is_bullet(line: Column) -> Column:
    return line.rlike(_BULLET)


def whole_word(pattern: str) -> str:
    """``pattern`` between word edges, for Unicode words, without case."""
    return rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{pattern})(?![\p{{L}}\p{{N}}_])"
