"""Phrase collocations by Toivonen's method.

A sample of the texts' pieces proposes phrases: those that are frequent in it at a lowered threshold. One
pass over all documents counts the proposals and their negative border exactly; the border is every
phrase met that is no proposal but whose two parts without the last and without the first word are
(of single words: all). A border phrase that turns out frequent is a failure: it joins the proposals,
and another pass counts what it adds to the border, until a pass finds no more failures. By then every
frequent phrase has been counted, whatever the sample was: proposals decide what work is done, not
what is found.

Proposals are tested against a bitmap of their hashes, whose size is fixed (FILTER_BITS) and which alone
is broadcast. A phrase that it lets through in error is counted for nothing. Counts are kept by 96-bit
hashes of language and words, added up in tasks, packed, and added up by ranges of hashes; a phrase of no words
stands for all words of its language. Texts are sent for frequent phrases only, by the pass after the one that found
them. Mining the sample is the same search, begun without proposals.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest as digest

from decklens.llm.common import as_bytes, packed, slices, staged, unpacked

#: Words of a phrase at most, occurrences of a frequent phrase at least, phrases reported of each language.
WORDS, LEAST, TOP = 5, 100, 2000
#: The sample: one piece in SAMPLED; a phrase is proposed by this many occurrences in it.
SAMPLED, SAMPLE_LEAST = 8, 3
#: Bits of the filter of proposals, as a power of two (16 MB). Raise it for corpora with many frequent phrases.
FILTER_BITS = 27
#: Hashes that a task holds before it passes their counts on, and phrases that it remembers to have sent.
HELD, TOLD = 2_000_000, 1_000_000
#: Bytes of text that are hashed together.
PORTION = 1 << 19
#: Rows of a result batch.
TOGETHER = 100_000
#: Text bytes of the corpus for each range of keys that is added up in one task.
RANGE_BYTES = 16 << 20

_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Proposals:
    """A bitmap of the first bits of keys: True for each key that it was made of, and for few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words) * 64).bit_length() + 1)

    @classmethod
    def of(cls, keys: DataFrame | None) -> Proposals:
        words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        if keys is not None:
            place = F.shiftrightunsigned("key", 64 - FILTER_BITS)
            one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))")
            # At most one row for each word of the bitmap.
            rows = keys.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
            words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
        return cls(words.view(np.uint64))

    # Only the words that hold bits travel.
    def __getstate__(self) -> tuple[int, np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.words)
        return len(self.words), at.astype(np.int32), self.words[at]

    def __setstate__(self, state: tuple[int, np.ndarray, np.ndarray]) -> None:
        words = np.zeros(state[0], np.uint64)
        words[state[1]] = state[2]
        self.__init__(words)

    def __or__(self, other: Proposals) -> Proposals:
        return Proposals(self.words | other.words)

    def have(self, keys: np.ndarray) -> np.ndarray:
        place = keys >> self.shift
        return ((self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


_BYTES = np.random.default_rng(12).integers(0, 2**64, (2, 256), np.uint64)
_BASES = (0x5851F42D4C957F2D, 0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of both bases and of their inverses, modulo 2**64."""
    def row(base: int) -> np.ndarray:
        steps = np.full(n, base % 2**64, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    return np.array([row(b) for b in _BASES]), np.array([row(pow(b, -1, 2**64)) for b in _BASES])


def portions(texts: list[bytes], most: int = PORTION) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Texts, mapped, in buffers of about ``most`` bytes: (buffer, starts of the texts in it, their numbers).

    A line feed ends a piece. A longer text is cut between pieces, where no phrase crosses.
    """
    held, starts, numbers, size = [], [], [], 0
    for i, text in enumerate(texts):
        rest = text.translate(_TABLE)
        while True:
            cut = len(rest)
            if cut > most:
                cut = rest.rfind(b"\n", 0, most) + 1 or rest.find(b"\n", most) + 1 or len(rest)
            held.append(rest[:cut])
            starts.append(size)
            numbers.append(i)
            size += cut + 1
            rest = rest[cut:]
            if size > most:
                yield b"\n".join(held), np.array(starts), np.array(numbers)
                held, starts, numbers, size = [], [], [], 0
            if not rest:
                break
    if held:
        yield b"\n".join(held), np.array(starts), np.array(numbers)


class Grams:
    """Phrases of some texts, level by level: those whose parts are proposals.

    A word's code is a sum over its bytes, taken as a difference of running sums over the whole buffer.
    """

    def __init__(self, buffer: bytes, starts: np.ndarray, langs: list[str]):
        self.buffer = buffer
        a = np.frombuffer(buffer, np.uint8)
        broken = a == 10
        gap = np.concatenate([[True], broken | (a == 32), [True]])
        self.first = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        self.last = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
        n = len(self.first)
        self.names = list(dict.fromkeys(langs))
        number = {name: i for i, name in enumerate(self.names)}
        of_text = np.array([number[x] for x in langs], np.int64)
        self.lang = of_text[np.searchsorted(starts, self.first, "right") - 1]
        seeds = [digest(b"\0lang\0" + name.encode()) for name in self.names]
        self.seeds = np.array([[s >> 64 for s in seeds], [s & 0xFFFFFFFFFFFFFFFF for s in seeds]], np.uint64)
        # Words from each place to the end of its piece.
        piece = np.cumsum(broken, dtype=np.int32)[self.first]
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, n) if n else np.zeros(0, np.int64)
        self.left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
        powers, inverses = _powers(max(2 * PORTION, 1 << len(a).bit_length()))
        codes = []
        for lane in range(2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[lane][a] * powers[lane][: len(a)], dtype=np.uint64)])
            codes.append(_mixed((sums[self.last] - sums[self.first]) * inverses[lane][self.first] + (self.last - self.first).astype(np.uint64)))
        self.high, self.low = codes

    def phrase(self, at: int, length: int) -> str:
        return b" ".join(self.buffer[self.first[at] : self.last[at + length - 1]].split()).decode()

    def levels(self, before: Proposals | None, added: Proposals) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, places, keys, checks, new, in added) of the phrases whose parts are in ``before`` or ``added``;
        new are those whose parts are not all in ``before``."""
        n = len(self.first)
        key, check = self.seeds[0][self.lang], self.seeds[1][self.lang]
        now, was = np.ones(n + 1, bool), np.full(n + 1, before is not None)
        for length in range(1, WORDS + 1):
            at = np.flatnonzero((self.left >= length) & now[:-1] & now[1:])
            if not len(at):
                return
            key[at] = _mixed(key[at] * _FIRST + self.high[at + length - 1])
            check[at] = _mixed(check[at] * _SECOND + self.low[at + length - 1])
            counted = was[at] & was[at + 1]
            inside = added.have(key[at])
            kept = before.have(key[at]) if before is not None else np.zeros(len(at), bool)
            yield length, at, key[at], (check[at] >> np.uint64(32)).astype(np.uint32).view(np.int32), ~counted, inside
            now, was = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            now[at], was[at] = inside | kept, counted & kept


def _summed(key: np.ndarray, check: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, check) with the sums of their neighbours in ``order``."""
    key, check = key[order], check[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))
    return key[first], check[first], np.add.reduceat(n[order], first)


def _added_up(ranges: DataFrame, bits: int, least: int) -> DataFrame:
    """(key, check, n) of at least ``least`` from packed counts (range, keys, checks, counts), a range of keys in a task."""

    def of(table: pa.Table) -> pa.Table:
        first = np.uint64(table.column("range")[0].as_py() << (64 - bits)) if bits else np.uint64(0)
        key = np.concatenate([np.cumsum(unpacked(x), dtype=np.uint64) + first for x in table.column("keys").to_pylist()])
        check, n = (np.concatenate([unpacked(x) for x in table.column(c).to_pylist()]) for c in ("checks", "counts"))
        key, check, n = _summed(key, check, n, np.lexsort((check, key)))
        kept = n >= least
        columns = [pa.array(key[kept].view(np.int64)), pa.array(check[kept].astype(np.uint32).view(np.int32)), pa.array(n[kept].view(np.int64))]
        return pa.Table.from_arrays(columns, ["key", "check", "n"])

    return ranges.groupBy("range").applyInArrow(of, "key long, check int, n long")


def counted(rows: DataFrame, sent: Broadcast, telling: bool, least: int, bits: int) -> DataFrame:
    """(key, check, n) of the phrases of ``rows`` (lang, text) that ``added`` brings, if frequent; with ``telling``
    also lang and phrase, and rows for the phrases in ``added`` that have them. ``sent`` holds (before, added).

    Without ``telling``, counts travel packed, by the first ``bits`` bits of their keys: a pass that
    counts for the first time has very many.
    """
    held_most, told_most, together = HELD, TOLD, TOGETHER

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, added = sent.value
        told, held, size = set(), [], 0

        def passed() -> Iterator[pa.RecordBatch]:
            key, check, n = map(np.concatenate, zip(*held))
            # A key with several checks may give several rows for one of them here, but not in the end.
            key, check, n = _summed(key, check, n, np.argsort(key))
            if not telling:
                starts = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
                cuts = np.append(np.searchsorted(key, starts), len(key)).tolist()
                found = [
                    (r, packed(np.diff(key[i:j], prepend=starts[r])), packed(check[i:j].view(np.uint32)), packed(n[i:j]))
                    for r, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j
                ]
                kinds = [pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["range", "keys", "checks", "counts"])
                return
            for i in range(0, len(key), together):
                part = slice(i, i + together)
                columns = [pa.array(key[part].view(np.int64)), pa.array(check[part]), pa.array(n[part])]
                yield batch(columns, [None] * len(columns[0]), [None] * len(columns[0]))

        def batch(columns: list[pa.Array], langs: list, phrases: list) -> pa.RecordBatch:
            texts = [pa.array(langs, pa.string()), pa.array(phrases, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, *texts], ["key", "check", "n", "lang", "phrase"])

        def grams_of() -> Iterator[Grams]:
            for b in slices(batches):
                langs = b.column("lang").to_pylist()
                for buffer, starts, numbers in portions(as_bytes(b.column("text"))):
                    yield Grams(buffer, starts, [langs[i] for i in numbers.tolist()])

        for grams in grams_of():
            if len(told) > told_most:
                told.clear()
            tell = []

            def told_of(keys, checks, langs, phrases):
                """Phrases that this task has not sent yet; the latter two are asked for by number."""
                for j in np.unique(keys, return_index=True)[1].tolist():
                    if (k := int(keys[j])) not in told:
                        told.add(k)
                        tell.append((k, int(checks[j]), grams.names[langs(j)], phrases(j)))

            totals = np.bincount(grams.lang, minlength=len(grams.names))
            all_words = (grams.seeds[0], (grams.seeds[1] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            if before is None:
                held.append((*all_words, totals))
            if telling and len(grams.names):
                wanted = np.flatnonzero(added.have(all_words[0]))
                told_of(all_words[0][wanted], all_words[1][wanted], lambda j: int(wanted[j]), lambda j: "")
            for length, at, keys, checks, new, inside in grams.levels(before, added):
                if new.any():
                    held.append((keys[new], checks[new], np.ones(int(new.sum()), np.int64)))
                    size += len(held[-1][0])
                if telling and inside.any():
                    place = at[inside]
                    told_of(
                        keys[inside], checks[inside], lambda j: int(grams.lang[place[j]]),
                        lambda j: grams.phrase(int(place[j]), length))
            for i in range(0, len(tell), together):
                keys, checks, langs, phrases = zip(*tell[i : i + together])
                none = np.zeros(len(keys), np.int64)
                yield batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(checks, pa.int32()), pa.array(none)], list(langs), list(phrases))
            if size > held_most:
                yield from passed()
                held, size = [], 0
        if held:
            yield from passed()

    if not telling:
        packs = rows.select("lang", "text").mapInArrow(of, "range int, keys binary, checks binary, counts binary")
        return _added_up(packs, bits, least)
    parts = rows.select("lang", "text").mapInArrow(of, "key long, check int, n long, lang string, phrase string")
    sums = parts.groupBy("key", "check").agg(F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("phrase").alias("phrase"))
    return sums.filter((F.col("n") >= least) | F.col("phrase").isNotNull())


def closed(rows: DataFrame, least: int, proposed: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(key, check, lang, phrase, n) of all phrases that occur ``least`` times in ``rows`` (lang, text), and
    the number of passes. ``proposed`` (key, check, lang, phrase) is any set that holds the parts of its phrases."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (-(-int(size) // RANGE_BYTES) - 1).bit_length())
    before, added = None, Proposals.of(proposed)
    counts, texts, failures, passes = [], [] if proposed is None else [proposed.select("key", "check", "lang", "phrase")], None, 0
    while True:
        passes += 1
        sent = rows.sparkSession.sparkContext.broadcast((before, added))
        got = staged(counted(rows, sent, failures is not None, least, bits))
        sent.destroy()
        if failures is not None:
            found = got.filter("phrase is not null").select("key", "check", "lang", "phrase")
            texts.append(found.join(failures, ["key", "check"], "left_semi"))
        frequent = got.filter(F.col("n") >= least).select("key", "check", "n")
        counts.append(frequent)
        failures = frequent.select("key", "check")
        if proposed is not None:
            failures = staged(failures.join(proposed, ["key", "check"], "left_anti"))
        if failures.isEmpty():
            break
        before, added = added if before is None else before | added, Proposals.of(failures)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    if not texts:
        return counts[0].select("key", "check", F.lit("").alias("lang"), F.lit("").alias("phrase"), "n"), passes
    return staged(union(counts).join(union(texts), ["key", "check"])), passes


def sample(rows: DataFrame, sampled: int) -> DataFrame:
    """(lang, text): one piece in ``sampled`` of each text of ``rows`` (lang, text, h), by a hash of h and its place.

    Pieces are drawn each for itself, so that what one document repeats is in the sample in proportion.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.uint64((2**64 - 1) // sampled)
        for b in slices(batches):
            texts = []
            for text, h in zip(as_bytes(b.column("text")), b.column("h").to_numpy().view(np.uint64)):
                parts = text.translate(_TABLE).split(b"\n")
                drawn = _mixed(_mixed(h + np.arange(len(parts), dtype=np.uint64) * _FIRST) * _SECOND) <= below
                texts.append(b"\n".join([parts[k] for k in np.flatnonzero(drawn)]))
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("lang"), column], ["lang", "text"]).filter(pc.greater(pc.binary_length(column), 0))

    return rows.select("lang", "text", "h").mapInArrow(of, "lang string, text string")


def frequent(docs: DataFrame, least: int = LEAST, sampled: int = SAMPLED, sample_least: int = SAMPLE_LEAST) -> tuple[DataFrame, int]:
    """(lang, phrase, n) of every phrase of at most WORDS words that occurs ``least`` times in its language, the
    phrase of no words included, and the number of passes over all documents."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    proposed, _ = closed(staged(sample(rows, sampled)), sample_least)
    found, passes = closed(rows.select("lang", "text"), least, proposed)
    return found.select("lang", "phrase", "n"), passes


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sampled: int = SAMPLED, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase of a words' score is the lowest, over its cuts into two parts that occur l and r times, of
    floor(1000 a n / (l r)), n being all words of the language; ties go to the cut after fewer words.
    A phrase that lies inside a longer one just as frequent is left out. Order: score, a (both falling),
    phrase by its bytes. A null language is ``und``, a null text is empty; a repeated row counts as often
    as it occurs; texts are read whole. Other columns than doc_id, lang and text are not read. An
    empty table, or one without frequent phrases, gives an empty result.
    """
    found = staged(frequent(docs, least, sampled, sample_least)[0].withColumn("words", F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))))
    parts = found.filter(F.size("words") < WORDS).select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    candidates = found.filter(F.size("words") >= 2).select("lang", "phrase", "words", F.col("n").alias("a"))
    totals = found.filter("phrase = ''").select("lang", "n")

    def side(name: str, frequency: str) -> DataFrame:
        return parts.select("lang", F.col("part").alias(name), F.col("f").alias(frequency))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"({wide('a')} * {wide('n')} * 1000) div ({wide('l')} * {wide('r')})")
    scored = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = candidates.withColumn("size", F.explode(F.filter(F.sequence(F.lit(2), F.lit(WORDS)), lambda s: s < F.size("words"))))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)))
    longer = inner.groupBy("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    alone = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a")))

    flat = alone.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = flat.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
