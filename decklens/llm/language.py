"""Language identification with a blended-spectrum string kernel.

A text is the set of its character 1- to 3-grams over a learned alphabet; the kernel of two texts is
the number of n-grams both have, divided by the geometric mean of their own numbers. Landmark texts
give a Nyström feature map, and one ridge regression per language against the rest scores it. A
batch of texts is a presence matrix; its kernel with all landmarks is one matrix product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklens.llm.common import as_texts, pieces

UNKNOWN = "und"
#: Bounds of the fitted sample: texts per language, landmarks per language. Every language is fitted.
TRAIN_TEXTS = 300
LANDMARKS = 40
#: Symbols: 0 blank, 1 other letter, then the most frequent letters. 6 bits each, so that an n-gram
#: is an exact number and the presence of all n-grams a table of 64 + 64**2 + 64**3 flags.
SYMBOLS = 64
SPECTRUM = 3
TABLE = sum(SYMBOLS**n for n in range(1, SPECTRUM + 1))
_OFFSET = (0, SYMBOLS, SYMBOLS + SYMBOLS**2)
#: Texts scored by one matrix product.
BATCH = 256


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def learn_alphabet(texts: list[str]) -> np.ndarray:
    """Code point -> symbol: letters by frequency in ``texts``; all other letters share symbol 1."""
    seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
    table = np.zeros(0x110000, np.uint8)
    for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 2]):
        table[ord(c)] = i + 2
    return table


def symbols(points: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, bool]:
    """The text as symbols, runs of non-letters as one blank; whether it has a letter at all."""
    out = alphabet[points]
    other = (out == 0) & (points > 127)
    if other.any():
        distinct, at = np.unique(points[other], return_inverse=True)
        out[other] = np.array([chr(p).isalpha() for p in distinct], np.uint8)[at]
    low = (out == 0) & (points < 128)
    out[low & (((points | 32) >= 97) & ((points | 32) <= 122))] = 1
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return np.concatenate([[0], out[keep], [0]]).astype(np.int32), bool(out.any())


def grams(s: np.ndarray) -> list[np.ndarray]:
    """Table places of the 1-, 2- and 3-grams of a symbol sequence."""
    two = s[:-1] * SYMBOLS + s[1:]
    three = two[:-1] * SYMBOLS + s[2:]
    return [s, two + _OFFSET[1], three + _OFFSET[2]]


def presence(s: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Distinct n-grams of a symbol sequence; ``flags`` is a cleared table that is left cleared."""
    for g in grams(s):
        flags[g] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    alphabet: np.ndarray
    column: np.ndarray  # n-gram -> column of ``landmarks``, -1 if no landmark has it
    landmarks: np.ndarray  # landmark x n-gram, 1 where present, divided by the root of its count
    weights: np.ndarray  # landmark x language: Nyström map and ridge solution in one
    bias: np.ndarray

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        """Text x language, for a batch of n-gram sets."""
        x = np.zeros((len(found), self.landmarks.shape[1]), np.float32)
        for row, f in zip(x, found):
            at = self.column[f]
            row[at[at >= 0]] = 1 / np.sqrt(len(f))
        kernel = x @ self.landmarks.T
        return kernel @ self.weights + self.bias


def fit(texts: list[str], langs: list[str], ridge: float = 1e-2) -> Model:
    """Fit on a sample that is small by construction; its order decides nothing but ties."""
    languages = sorted(set(langs))
    alphabet = learn_alphabet(texts)
    flags = np.zeros(TABLE, bool)
    found = [presence(symbols(letters(t), alphabet)[0], flags) for t in texts]
    y = np.array(langs, object)[:, None] == np.array(languages, object)[None, :]
    chosen = [i for lang in languages for i in [j for j, v in enumerate(langs) if v == lang][:LANDMARKS]]
    known = np.unique(np.concatenate([found[i] for i in chosen])) if chosen else np.zeros(0, int)
    column = np.full(TABLE, -1, np.int32)
    column[known] = np.arange(len(known))
    landmarks = np.zeros((len(chosen), len(known)), np.float32)
    for row, i in zip(landmarks, chosen):
        row[column[found[i]]] = 1 / np.sqrt(len(found[i]))
    empty = Model(languages, alphabet, column, landmarks, np.eye(len(chosen)), np.zeros(1))
    kernel = np.concatenate([empty.scores(found[i : i + BATCH]) for i in range(0, len(found), BATCH)]) if found else np.zeros((0, 0))
    # Nyström: features k(x, landmarks) K^-1/2, with the small eigenvalues left out.
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float)) if chosen else (np.zeros(0), np.zeros((0, 0)))
    good = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    z = kernel @ root
    target = np.where(y, 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    weight = (1 / np.maximum(y.sum(0), 1))[np.argmax(y, 1)][:, None] if len(y) else np.zeros((0, 1))
    total = max(weight.sum(), 1e-12)
    mean_z, mean_t = (z * weight).sum(0) / total, (target * weight).sum(0) / total
    zc = z - mean_z
    solution = np.linalg.solve(zc.T @ (zc * weight) / total + ridge * np.eye(zc.shape[1]), zc.T @ ((target - mean_t) * weight) / total)
    return Model(languages, alphabet, column, landmarks, root @ solution, mean_t - mean_z @ solution)


def training_rows(docs: DataFrame):
    """Documents outside the held-out fold that have a language."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text is a multiple of 5 (null doc_id: held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_language: int = TRAIN_TEXTS) -> Model:
    """Fit on up to ``per_language`` texts of each language, those with the lowest hash.

    The counts by language bound the hash first, so that about that many rows leave the scan. Languages
    with fewer texts give all of them; texts of any length are in the sample, whole.
    """
    rows = training_rows(docs).select("lang", "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    counts = rows.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return fit([], [])
    bound = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int((1 << 30) * min(1.0, (1.5 * per_language + 30) / r["count"]))))])
    got = rows.filter(F.col("h") <= bound[F.col("lang")]).select("lang", "h", "doc_id", "text").collect()
    texts, langs = [], []
    taken: Counter = Counter()
    for r in sorted(got, key=lambda r: (r["lang"], r["h"], r["doc_id"], r["text"])):
        if taken[r["lang"]] < per_language:
            taken[r["lang"]] += 1
            texts.append(r["text"])
            langs.append(r["lang"])
    return fit(texts, langs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, from the text alone, without a shuffle.

    lang_pred is the language with the highest ridge score and ``score`` its softmax share; a null
    text or one without letters is ``und`` with score 0, as is every text if the model knows no
    language. Rows are judged each for itself; an empty table gives an empty result; input columns
    with these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def label(text: pa.Array) -> pa.Array:
        flags = np.zeros(TABLE, bool)
        langs, scores = [], []

        def flush(rows: list[tuple[np.ndarray, bool]]) -> None:
            if not model.languages:
                langs.extend([UNKNOWN] * len(rows))
                scores.extend([0.0] * len(rows))
                return
            s = model.scores([f for f, _ in rows])
            p = np.exp(4 * (s - s.max(1, keepdims=True)))
            p /= p.sum(1, keepdims=True)
            best = s.argmax(1)
            langs.extend(model.languages[b] if ok else UNKNOWN for b, (_, ok) in zip(best, rows))
            scores.extend(float(p[i, b]) if ok else 0.0 for i, (b, (_, ok)) in enumerate(zip(best, rows)))

        held: list[tuple[np.ndarray, bool]] = []
        for piece in pieces(text):
            for t in as_texts(piece):
                s, has_letter = symbols(letters(t), model.alphabet)
                held.append((presence(s, flags), has_letter))
                if len(held) == BATCH:
                    flush(held)
                    held = []
        if held:
            flush(held)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.withColumn("_label", label(F.col("_row")["text"])).select(*[F.col("_row")[c].alias(c) for c in names], "_label.*")
