"""LM scoring by cross-entropy difference.

Two n-gram models, one of a target set and one of all documents as background, share a vocabulary
and the smoothing; background counts are scaled to the target's number of tokens, so that smoothing
weighs the same in both. A document's score is the mean over its tokens of target loss less
background loss (nats): the lower, the more it reads like the target.

Every word and every bigram of the corpus is modelled: the counts grow with the input and are never
whole in one place. Documents are packed into blocks by running bytes of text. A block's distinct
n-grams are sorted by their 64-bit codes and cut into ranges of codes; a range of a block is one row, which
holds the codes as packed differences, and their counts. A task adds up one range of all blocks and answers
each block with the sums in the order of its codes, so that no code travels back: the block finds
its n-grams again in the same order. A frequent n-gram costs each block some bits. How often a word
precedes another is its count less the texts that end with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest as digest

from decklens.llm.common import as_texts, measured, packed, pieces, staged, unpacked

#: Text bytes of a block of documents (or one longer text), and of the corpus for each range of codes.
BLOCK_BYTES = 2 << 20
RANGE_BYTES = 16 << 20
#: zstd level of the rows of a block.
ROWS_LEVEL = 6
#: Smoothing: additive for words, Dirichlet weight of the word model for bigrams.
ALPHA = 0.5
MU = 50.0
#: Words whose codes a task remembers.
KNOWN = 300_000
_FIRST, _SECOND = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def tokens(text: str) -> list[str]:
    return text.lower().split()


class Codes(dict):
    """64-bit codes of words; only those met first are remembered."""

    def __missing__(self, word: str) -> int:
        code = digest(word.encode())
        if len(self) < KNOWN:
            self[word] = code
        return code


@dataclass(frozen=True)
class Grams:
    """The n-grams of some texts: codes of words, and of the bigrams that end at ``at``."""

    text: np.ndarray  # number of the text that a token is in
    words: np.ndarray
    at: np.ndarray  # places of tokens that have a predecessor in their text
    ends: np.ndarray  # places of tokens that end their text

    @classmethod
    def of(cls, texts: list[str], codes: Codes) -> Grams:
        rows = [tokens(t) for t in texts]
        get = codes.__getitem__
        words = np.fromiter((get(w) for row in rows for w in row), np.uint64, sum(map(len, rows)))
        text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        new = text[1:] != text[:-1]
        return cls(text, words, np.flatnonzero(~new) + 1, np.append(np.flatnonzero(new), len(words) - 1)[: len(words)])

    @property
    def pairs(self) -> np.ndarray:
        return self.words[self.at - 1] * _FIRST + self.words[self.at] * _SECOND


class Block:
    """The n-grams of a block in the order of their codes."""

    def __init__(self, column: pa.Array, codes: Codes):
        self.pieces = list(pieces(column))
        self.grams = [Grams.of(as_texts(p), codes) for p in self.pieces]
        self.words, self.word_counts = self._distinct([g.words for g in self.grams])
        self.pairs, self.pair_counts = self._distinct([g.pairs for g in self.grams])
        ends = [np.searchsorted(self.words, g.words[g.ends]) for g in self.grams]
        self.ends = np.bincount(np.concatenate(ends), minlength=len(self.words)) if len(self.words) else self.word_counts

    @staticmethod
    def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)


def sealed(rows: pa.StructArray) -> bytes:
    """Rows as one compressed Arrow stream, read by :func:`opened`."""
    batch = pa.RecordBatch.from_arrays([rows], ["row"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", ROWS_LEVEL))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(raw: bytes) -> pa.StructArray:
    return pa.concat_arrays([b.column("row") for b in pa.ipc.open_stream(raw)])


def blocked(docs: DataFrame) -> DataFrame:
    """(block, bytes, rows), staged: neighbouring documents of about BLOCK_BYTES of text together, as one sealed
    value, which is stored and travels in less room than rows do in Spark's own compression."""
    most = BLOCK_BYTES

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, block = [], 0, TaskContext.get().partitionId() << 33

        def full() -> pa.RecordBatch:
            rows = pa.concat_arrays(held)
            size = pc.sum(pc.binary_length(rows.field("text"))).as_py() or 0
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([sealed(rows)], pa.binary())], ["block", "bytes", "rows"])

        for b in batches:
            row = b.column("row")
            lengths = pc.fill_null(pc.binary_length(row.field("text")), 0).to_numpy(zero_copy_only=False) + 64
            start = 0
            for i, n in enumerate(lengths.tolist()):
                if size and size + n > most:
                    if i > start:
                        held.append(row.slice(start, i - start))
                    yield full()
                    held, size, start, block = [], 0, i, block + 1
                size += n
            if len(row) > start:
                held.append(row.slice(start))
        if held:
            yield full()

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return staged(rows.mapInArrow(of, "block long, bytes long, rows binary"))


_SENT = ["words", "word_counts", "ends", "pairs", "pair_counts"]
_BACK = ["word_docs", "word_target", "end_docs", "end_target", "pair_docs", "pair_target"]


def gram_ranges(blocks: DataFrame, target: bool, bits: int) -> DataFrame:
    """(range, block, target, words, word_counts, ends, pairs, pair_counts): the n-grams of each block by
    the first ``bits`` bits of their codes, packed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        starts = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
        for b in batches:
            for block, rows in zip(b.column("block").to_pylist(), b.column("rows")):
                own = Block(opened(rows.as_py()).field("text"), codes)
                word_cuts = np.append(np.searchsorted(own.words, starts), len(own.words)).tolist()
                pair_cuts = np.append(np.searchsorted(own.pairs, starts), len(own.pairs)).tolist()
                out = []
                for r in range(1 << bits):
                    w, p = slice(word_cuts[r], word_cuts[r + 1]), slice(pair_cuts[r], pair_cuts[r + 1])
                    if w.start == w.stop and p.start == p.stop:
                        continue
                    first = starts[r : r + 1]
                    parts = (np.diff(own.words[w], prepend=first), own.word_counts[w], own.ends[w], np.diff(own.pairs[p], prepend=first), own.pair_counts[p])
                    out.append((r, *map(packed, parts)))
                if out:
                    ranges, *columns = zip(*out)
                    n = len(out)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ranges, pa.int32()), pa.array([block] * n, pa.int64()), pa.array([target] * n), *(pa.array(c, pa.binary()) for c in columns)],
                        ["range", "block", "target", *_SENT])

    return blocks.select("block", "rows").mapInArrow(of, "range int, block long, target boolean, " + ", ".join(f"{c} binary" for c in _SENT))


def range_sums(ranges: DataFrame, bits: int) -> DataFrame:
    """Sums over all blocks, in the order of each block's codes: (block, range, word_docs, ..., pair_target).

    One more row per range, of block -1, has the number of different words (size) and of tokens in the
    documents and the target (total, wanted), and the sums of its words.
    """

    def of(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        first = np.uint64(r << (64 - bits)) if bits else np.uint64(0)
        target = table.column("target").to_numpy(zero_copy_only=False).astype(bool)
        block = table.column("block").to_pylist()
        back: dict[str, list] = {c: [] for c in _BACK}

        def summed(keys: str, counts: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
            """Per row the places of its codes among the different ones, and the sums of each count (documents, target)."""
            codes = [np.cumsum(unpacked(x), dtype=np.uint64) + first for x in table.column(keys).to_pylist()]
            sizes = [len(c) for c in codes]
            distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
            of_target = np.repeat(target, sizes)
            sums = []
            for c in counts:
                n = np.concatenate([unpacked(x) for x in table.column(c).to_pylist()]).astype(float)
                for mine in (~of_target, of_target):
                    sums.append(np.bincount(place[mine], n[mine], len(distinct)).astype(np.int64))
            return np.split(place, np.cumsum(sizes)[:-1]), distinct, sums

        word_places, distinct, word_sums = summed("words", ["word_counts", "ends"])
        pair_places, _, pair_sums = summed("pairs", ["pair_counts"])
        answered = np.flatnonzero(~target)
        for k in answered.tolist():
            for c, sums, places in zip(_BACK, [*word_sums, *pair_sums], [word_places] * 4 + [pair_places] * 2):
                back[c].append(packed(sums[places[k]]))
        n = len(answered)
        zeros = [0] * n
        whole = [len(distinct), int(word_sums[0].sum()), int(word_sums[1].sum())]
        columns = {"block": [*(block[k] for k in answered), -1], "range": [r] * (n + 1)}
        own = [packed(word_sums[0]), packed(word_sums[1]), *[None] * 4]
        kinds = {"block": pa.int64(), "range": pa.int32()}
        arrays = {c: pa.array(v, kinds[c]) for c, v in columns.items()}
        arrays |= {c: pa.array([*back[c], x], pa.binary()) for c, x in zip(_BACK, own)}
        arrays |= {c: pa.array([*zeros, x], pa.int64()) for c, x in zip(("size", "total", "wanted"), whole)}
        return pa.table(arrays)

    schema = "block long, range int, " + ", ".join(f"{c} binary" for c in _BACK) + ", size long, total long, wanted long"
    return staged(ranges.groupBy("range").applyInArrow(of, schema))


@dataclass(frozen=True)
class Rates:
    """Smoothed losses of one corpus from counts of n-grams."""

    tokens: float  # after scaling
    size: int  # of the vocabulary
    scale: float

    def word(self, n: np.ndarray) -> np.ndarray:
        return (n * self.scale + ALPHA) / (self.tokens + ALPHA * self.size)

    def losses(self, words: np.ndarray, at: np.ndarray, before: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Loss of every token by the bigram it ends; of the first of a text by the word alone."""
        p = self.word(words)
        q = p.copy()
        q[at] = (pairs * self.scale + MU * p[at]) / (before * self.scale + MU)
        return -np.log(q)


@dataclass(frozen=True)
class Model:
    """One corpus: its rates, and its counts of words by range."""

    rates: Rates
    counts: DataFrame
    column: str

    @property
    def word_loss(self) -> np.ndarray:
        """Losses of all words, for a look at small corpora: they are collected."""
        rows = self.counts.filter("block = -1").select(self.column).collect()
        return -np.log(self.rates.word(np.concatenate([unpacked(r[0]) for r in rows]).astype(float)))


def train(docs: DataFrame, target: DataFrame) -> tuple[DataFrame, Model, Model]:
    """Sums of the n-grams by block, and the models of ``target`` and of all ``docs``."""
    return _trained(blocked(docs), target)


def _trained(blocks: DataFrame, target: DataFrame) -> tuple[DataFrame, Model, Model]:
    wanted_blocks = blocked(target.select("text"))
    size = lambda rows: rows.agg(F.sum("bytes")).first()[0] or 0
    bits = max(0, (-(-int(size(blocks) + size(wanted_blocks)) // RANGE_BYTES) - 1).bit_length())
    sums = range_sums(gram_ranges(blocks, False, bits).unionAll(gram_ranges(wanted_blocks, True, bits)), bits)
    got = sums.filter("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("size", "total", "wanted")]).first()
    size, total, wanted = got
    scale = wanted / total if total else 1.0
    return sums, Model(Rates(float(wanted), size, 1.0), sums, "word_target"), Model(Rates(total * scale, size, scale), sums, "word_docs")


def score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``docs`` with n_tokens, target_loss, background_loss and score (their difference, per token).

    A null or blank text has no tokens and null losses. Each row is scored by its own text; repeated
    rows count as often as they occur in the background. Without a target both models know only the
    vocabulary's size, and scores are still defined. An empty table gives an empty result; input
    columns with these names are replaced.
    """
    blocks = blocked(docs)
    sums, target_model, background = _trained(blocks, target)
    models = ((target_model.rates, 1), (background.rates, 0))
    names = ["n_tokens", "target_loss", "background_loss", "score"]
    kept = [c for c in docs.columns if c not in names]
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    fields += [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names[1:])]

    def losses(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = pa.concat_arrays([opened(x.as_py()) for x in left.column("rows")])
        own = Block(rows.field("text"), Codes())
        order = np.argsort(right.column("range").to_numpy())

        def answer(column: str) -> np.ndarray:
            parts = right.column(column).to_pylist()
            return np.concatenate([np.zeros(0, np.uint64), *(unpacked(parts[k]) for k in order)]).astype(float)

        words, ends, pairs = ([answer(f"{x}_{y}") for y in ("docs", "target")] for x in ("word", "end", "pair"))
        found = []
        for piece, g in zip(own.pieces, own.grams):
            word, pair = np.searchsorted(own.words, g.words), np.searchsorted(own.pairs, g.pairs)
            n = np.bincount(g.text, minlength=len(piece))
            loss = []
            for rates, k in models:
                first = word[g.at - 1]
                each = rates.losses(words[k][word], g.at, words[k][first] - ends[k][first], pairs[k][pair])
                loss.append(np.bincount(g.text, each, len(piece)) / np.maximum(n, 1))
            found.append((n, *loss))
        n, *means = (np.concatenate([f[k] for f in found]) for k in range(3))
        results = [pa.array(n.astype(np.int64)), *(pa.array(x, mask=n == 0) for x in (*means, means[0] - means[1]))]
        return pa.Table.from_arrays([*(rows.field(c) for c in kept), *results], [*(f"c{i}" for i in range(len(kept))), *names])

    sent = sums.filter("block >= 0").select("block", "range", *_BACK)
    scored = blocks.select("block", "rows").groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(losses, T.StructType(fields))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], *names)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The target set: documents labelled good (quality 1) and by no label bad or toxic."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = good.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    return docs.join(measured(good, 16), "doc_id", "left_semi")
