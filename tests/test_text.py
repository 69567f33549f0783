"""Text helpers against plain Python string methods on random and hand-made texts."""

import math
import random
import re

from pyspark.sql import functions as F

from decklens import constants as K
from decklens.functions import numeric as N
from decklens.functions import text as X

PIECES = [
    "la", "casa", "aéreo", "buey", "día", "ciudad", "y", "sst", "rey", "mayor", "Índice", "ÑANDÚ", "pingüino", "3", "192.168",
    "BD101", "TCP22x", "20/21", "0-1023", "7abc", "además", "Red.", "¿qué?", "fin;", "•", "-", "1.", "2)", "*", ".", "...",
    "ç", "à", "İstanbul", "Kelvin", "ſchule", "x" * 30, "Juan", "Pérez", "López", "María",
]
SPACES = [" ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", " ", " ", "\x1c", " ", " \n ", "　"]


def texts(n=400, seed=1):
    rnd = random.Random(seed)
    out = ["", " ", "\n", " ", "...", "1 2 3", "• uno\n• dos", " ".join(["palabra"] * 41)]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(0, 60)):
            parts += [rnd.choice(PIECES), rnd.choice(SPACES)]
        out.append("".join(parts))
    return out


def not_a_word(token):
    return bool(re.match(r"\d+$|\d+[.,/:-]\d|[A-Z]{1,6}\d+$", token))


def nuclei(word):
    """Syllables of a word: read its vowels pairwise, a pair counts once unless both are strong."""
    letters = word.lower()
    if letters.endswith("y"):
        letters = letters[:-1] + "i"
    total, rest = 0, letters
    while rest:
        if rest[0] not in "aeiouáéíóúü":
            rest = rest[1:]
            continue
        total += 1
        pair = rest[:2]
        both_strong = all(c in "aeoáéó" for c in pair)
        joined = len(pair) == 2 and pair[1] in "aeiouáéíóúü" and not both_strong
        rest = rest[2:] if joined else rest[1:]
    return max(total, 1)


def sentences(text):
    out = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        words = line.split()
        if re.match(r"([•*-]|\d+[.)])\s", line):
            out.append(line)
        elif re.search("[.!?;]", line):
            out += [p.strip() for p in re.split("[.!?;]", line) if p.strip()]
        elif len(words) > 20:
            out += [" ".join(words[i:i + 20]) for i in range(0, len(words), 20)]
        else:
            out.append(line)
    return out


def test_whitespace_helpers(apply):
    ts = texts()
    assert apply(X.strip, ts) == [t.strip() for t in ts]
    assert apply(X.has_text, ts) == [bool(t.strip()) for t in ts]
    assert apply(X.collapse_whitespace, ts) == [" ".join(t.split()) for t in ts]
    assert apply(X.collapse_whitespace, [None]) == [""]
    assert apply(X.plain_word_count, ts) == [len(t.split()) for t in ts]
    lines = [[s.strip() for s in re.split("\r\n|\r|\n", t) if s.strip()] for t in ts]
    assert apply(X.text_lines, ts) == lines
    assert apply(X.clean_text, ts) == [" \n ".join(x) for x in lines]
    for n in (5, 15):
        assert apply(lambda c: X.has_words(c, n), ts) == [len(t.split()) >= n for t in ts]


def test_word_count(apply):
    ts = texts(seed=2)
    assert apply(X.word_count, ts) == [sum(not not_a_word(w) for w in t.split()) for t in ts]


def test_syllables_of_known_words(apply):
    known = {"aéreo": 4, "buey": 2, "día": 1, "ciudad": 2, "y": 1, "sst": 1, "": 0, "123": 0, "rey": 1, "mayor": 2, "caos": 2}
    assert apply(X.syllable_count, list(known)) == list(known.values())


def test_syllables_brute_force(apply):
    ts = texts(seed=3)
    expected = [sum(nuclei(w) for w in re.findall("[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+", t)) for t in ts]
    assert apply(X.syllable_count, ts) == expected


def test_sentences_brute_force(apply):
    # single \r is cleaned before sentences are cut, so it does not occur here
    ts = [t.replace("\r", "") for t in texts(seed=4)]
    expected = [sentences(t) for t in ts]
    assert apply(X.sentence_split, ts) == expected
    assert apply(X.sentence_count, ts) == [len(e) for e in expected]


def test_long_line_is_cut_every_twenty_words(apply):
    assert apply(X.sentence_count, [" ".join(["a"] * n) for n in (1, 20, 21, 40, 41)]) == [1, 1, 2, 2, 3]


def test_tokens(apply):
    ts = texts(seed=5)
    found = [[w.lower() for w in re.findall("[a-záéíóúüñ]+", t, re.I)] for t in ts]
    assert apply(X.alpha_tokens, ts) == found
    stop = set(K.DENSITY_STOP_WORDS)
    assert apply(lambda c: X.function_words(X.raw_tokens(c)), ts) == [sum(w in stop for w in f) for f in found]


def test_keywords_and_terms(apply):
    got = apply(lambda c: F.array_sort(X.title_keywords(c)), ["El Análisis de la RED entre redes; ejemplo red casa casa"])
    assert got == [sorted({"análisis", "redes", "casa"})]
    assert apply(X.narrative_terms, ["La red y la Red de datos son datos"]) == [["red", "red", "datos", "datos"]]


def test_person_names(apply):
    assert apply(X.strip_person_names, ["Juan Pérez López da clase", "Ana Li Paz", " Ab Cde Fgh Ijk "]) == ["da clase", "Ana Li Paz", "Ab"]


def test_slide_text(spark):
    row = spark.createDataFrame([(" T ", [" a ", "", " ", "b\nc"])], "t string, c array<string>")
    out = row.select(X.slide_text(F.col("t"), F.col("c")).alias("s"), X.joined_text(F.col("t"), F.col("c")).alias("j")).first()
    assert (out.s, out.j) == ("T\na\nb\nc", "T a b\nc")


def test_longest_words_order(apply):
    assert apply(X.longest_words, ["entonces zapatos ciudades montañas ríos finalmente"]) == [["ciudades", "montañas", "zapatos"]]


def test_truncate(apply):
    assert apply(X.truncate, ["a" * 400, "a" * 401]) == ["a" * 400, "a" * 400 + "..."]


def test_fold_search(apply):
    names = ["Cálculo", "PROGRAMACIÓN", "Análisis", "Redes", ""]
    assert apply(lambda c: X.fold_contains(c, " calcu "), names) == [True, False, False, False, False]
    assert apply(lambda c: X.fold_contains(c, "ÁCION"), names) == [False, True, False, False, False]
    assert apply(lambda c: X.fold_contains(c, "  "), names) == [True] * 5


def test_round_like_python(apply):
    rnd = random.Random(7)
    xs = [2.675, 0.125, 0.375, 1.005, -2.675, 0.5, 1.5, 2.5] + [rnd.random() * 10 ** rnd.randint(0, 4) for _ in range(3000)]
    xs += [rnd.randint(0, 10 ** 6) / 2 ** rnd.randint(0, 10) for _ in range(2000)] + [rnd.randint(0, 10 ** 6) / 2000 for _ in range(2000)]
    for d in (0, 1, 2, 3, 4):
        assert apply(lambda c: N.py_round(c, d), xs, "double") == [round(x, d) for x in xs]


def test_clamp_and_labels(apply):
    assert apply(lambda c: N.clamp(c, 0.0, 10.0), [-1.0, 0.0, 5.5, 10.0, 11.0, None], "double") == [0.0, 0.0, 5.5, 10.0, 10.0, None]
    zones = apply(lambda c: N.label_up_to(c, K.SCORE_ZONES, K.SCORE_ZONE_REST), [4.0, 4.01, 6.0, 8.0, 8.01, None], "double")
    assert zones == ["deficiente", "regular", "regular", "bueno", "excelente", None]
    assert apply(lambda c: N.label_up_to(c, K.ICD_ZONES, K.ICD_ZONE_REST), [2.0, 3.5, 3.51, 6.5, 6.51, 8.01], "double") == [
        "muy simple", "simple", "apropiado", "apropiado", "complejo", "muy complejo"]
    fsz = apply(lambda c: N.label_from(c, K.FSZ_ZONES, K.FSZ_ZONE_REST), [80.0, 79.9, 65.0, 50.0, 35.0, 15.0, 14.9], "double")
    assert fsz == ["muy facil", "facil", "facil", "normal", "dificil", "muy dificil", "arido"]


def test_time_texts(apply):
    values = [None, 0.0, 59.4, 59.5, 60.0, 125.0, 180.0]
    assert apply(N.format_seconds, values, "double") == ["—", "0s", "59s", "1m 00s", "1m 00s", "2m 05s", "3m 00s"]
    assert apply(N.format_seconds_chart, values, "double") == ["0s", "0s", "59s", "1m", "1m", "2m05s", "3m"]
    assert apply(N.format_seconds_total, [0, 65, 3600], "int") == ["0m 0s", "1m 5s", "60m 0s"]
    assert apply(N.format_clock, [0, 65, 6000], "int") == ["00:00", "01:05", "100:00"]


def test_deviation(spark):
    rows = [(79, 100), (80, 100), (85, 100), (100, 100), (115, 100), (120, 100), (121, 100), (5, 0), (5, None), (0, 10), (1, 8)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a int, b int")
    pct = N.deviation_pct(F.col("a"), F.col("b"))
    got = df.select("i", pct.alias("p"), N.deviation_status(pct).alias("s")).orderBy("i").collect()
    assert [r.p for r in got] == [-21, -20, -15, 0, 15, 20, 21, 0, 0, -100, round(-87.5)]
    assert [r.s for r in got][:8] == ["Poco tiempo", *["En rango"] * 5, "Excedió tiempo", "En rango"]


def test_let_evaluates_once(apply):
    assert apply(lambda c: N.let(c + 1, lambda v: v * v), [1, 2], "int") == [4, 9]
    assert math.isclose(apply(lambda c: N.let(c / 3, lambda v: v + v), [1.0], "double")[0], 2 / 3)


def test_long_runs_take_linear_time(spark):
    import time

    n = 300_000
    rows = ["x" * n, "1" * n + "a", " " * n + "a" + " " * n, "a " * n, "." * n, "«" * n, "y" * n, "A" * n, "\n" * n, "Aa " * n]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    c = F.col("v")
    start = time.time()
    got = df.select(
        X.strip(c), X.word_count(c), X.syllable_count(c).alias("s"), X.sentence_count(c), X.clean_text(c), X.has_words(c, 26),
        F.size(X.raw_tokens(c)), X.strip_person_names(c), F.size(X.longest_words(c)), X.collapse_whitespace(c),
    ).collect()
    assert time.time() - start < 60
    assert got[0].s == 1 and got[3].s == n


def test_bare_carriage_return_ends_no_sentence(spark):
    rows = [("uno dos\rtres cuatro",), ("uno\r\ndos",), ("a\n \r \nb",), ("\r",), ("",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(
        X.sentence_split(F.col("t")).alias("s"), X.sentence_count(F.col("t")).alias("n"), X.content_lines(F.array("t")).alias("l")).collect()
    assert [r.s for r in got] == [["uno dos\rtres cuatro"], ["uno", "dos"], ["a", "b"], [], [], None]
    assert [r.n for r in got] == [1, 2, 2, 0, 0, None]
    assert [r.l for r in got[:5]] == [r.s for r in got[:5]]
