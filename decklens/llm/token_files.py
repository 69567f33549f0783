"""Token ids in binary files: patched frame-of-reference blocks, written and read back.

A file is a Parquet table of segments in ascending order of doc_id. A segment holds the ids of
consecutive whole documents as one ``payload``:

    magic "PFR1", block length (u32), number of values (u64), number of blocks (u32)
    block starts: offsets into the block area (u64 each, and the end)
    blocks: minimum (u32), width (u8), number of exceptions (u16),
            value - minimum in ``width`` bits each, least significant bit first,
            exceptions: places (u16 each), then whole differences (u32 each)

The width of a block is the bit length of that percentile of its differences which makes the block
smallest; larger differences are exceptions. All numbers are little-endian.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decklens.llm.common import as_texts, measured, slices
from decklens.session import scratch_folder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
BLOCK = 4096
SEGMENT_VALUES = 1 << 20
PERCENTILES = (75, 90, 97, 99.5, 100)
MAGIC = b"PFR1"


# --- blocks -------------------------------------------------------------------------------------------


def _pack(values: np.ndarray, width: int) -> bytes:
    if width == 0:
        return b""
    if width in (16, 32):
        return values.astype(f"<u{width // 8}").tobytes()
    kind = "<u2" if width <= 16 else "<u4"
    raw = values.astype(kind).view(np.uint8).reshape(len(values), -1)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :width].ravel(), bitorder="little").tobytes()


def _unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, np.uint32)
    if width in (16, 32):
        return np.frombuffer(packed, f"<u{width // 8}").astype(np.uint32)
    size = 16 if width <= 16 else 32
    bits = np.zeros((n, size), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits.ravel(), bitorder="little").view(f"<u{size // 8}").astype(np.uint32)


def encode_block(values: np.ndarray) -> bytes:
    base = values.min()
    diff = (values - base).astype(np.uint32)
    ordered = np.sort(diff)
    best = None
    for p in PERCENTILES:
        width = int(ordered[min(len(ordered) - 1, int(np.ceil(p / 100 * len(ordered))) - 1)]).bit_length()
        exceptions = len(ordered) - int(np.searchsorted(ordered, 1 << width))
        cost = -(-len(diff) * width // 8) + 6 * exceptions
        if best is None or cost < best[0]:
            best = (cost, width)
    width = best[1]
    out = np.flatnonzero(diff >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    return (struct.pack("<IBH", int(base), width, len(out)) + _pack(diff & np.uint32((1 << width) - 1), width)
            + out.astype("<u2").tobytes() + diff[out].astype("<u4").tobytes())


def decode_block(block: bytes, n: int) -> np.ndarray:
    base, width, n_out = struct.unpack_from("<IBH", block)
    end = 7 + -(-n * width // 8)
    diff = _unpack(block[7:end], n, width)
    places = np.frombuffer(block, "<u2", n_out, end)
    diff[places] = np.frombuffer(block, "<u4", n_out, end + 2 * n_out)
    return diff + np.uint32(base)


def encode_segment(values: np.ndarray, block: int = BLOCK) -> bytes:
    blocks = [encode_block(values[i : i + block]) for i in range(0, len(values), block)]
    starts = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return b"".join([MAGIC, struct.pack("<IQI", block, len(values), len(blocks)), starts.tobytes(), *blocks])


def decode_segment(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Values ``start`` to ``stop`` of a segment; only the blocks that hold them are unpacked."""
    if payload[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    block, n, n_blocks = struct.unpack_from("<IQI", payload, 4)
    starts = np.frombuffer(payload, "<u8", n_blocks + 1, 20)
    area = 20 + 8 * (n_blocks + 1)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    parts = [decode_block(payload[area + int(starts[b]) : area + int(starts[b + 1])], min(block, n - b * block)) for b in range(first, last + 1)]
    return np.concatenate(parts)[start - first * block : stop - first * block]


# --- encoding of texts ----------------------------------------------------------------------------------


class UnitEncoder:
    """Ids of whole texts from the tokenizers library, with the ids of frequent units remembered.

    The byte-level pre-tokeniser knows white space, letters, numbers and other characters. Its pieces are
    runs of one kind, which may follow one space, and an apostrophe with letters. So a text may be cut where
    two kinds meet, but neither after white space, which looks at what follows, nor between an apostrophe
    and a letter: the units between cuts encode for themselves. All units of a list of texts are cut and
    told apart in whole arrays, and each different one is encoded once. The memory is bounded, holds the
    units met first, among them all frequent ones, and only saves time. Texts are encoded whole if the
    tokenizer has another pre-tokeniser or a normaliser.
    """

    MAX_UNITS = 900_000
    MAX_BYTES = 40
    #: Units handed to the library at once.
    TOGETHER = 128
    #: Characters of a part of a long text.
    PART = 1 << 20
    _UNSEEN, _SPACE, _LETTER, _NUMBER, _OTHER = range(5)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Tokens added to the vocabulary, such as <|endoftext|>: the library finds them before it cuts pieces.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex and not cutter.add_prefix_space
        self.feed = np.frombuffer(self._bytes(["\n"])[0], "<u4")[0]
        #: Kinds of all code points, asked of the pre-tokeniser when one is met first.
        self.kinds = np.full(0x110000, self._UNSEEN, np.uint8)
        #: White space among them, and the end of a unit.
        self.spaces = {""}
        self.known: dict[bytes, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(texts), self.TOGETHER):
            out.extend(array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + self.TOGETHER], add_special_tokens=False))
        return out

    def _kind(self, char: str) -> int:
        for kind, like in ((self._LETTER, "a"), (self._NUMBER, "1"), (self._OTHER, "!")):
            if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(like + char + like)) == 1:
                return kind
        self.spaces.add(char)
        return self._SPACE

    def _begins(self, codes: np.ndarray) -> np.ndarray:
        """For each code point but the first, whether a unit begins there."""
        kinds = self.kinds[codes]
        unseen = codes[kinds == self._UNSEEN]
        if len(unseen):
            for c in np.unique(unseen).tolist():
                self.kinds[c] = self._kind(chr(c))
            kinds = self.kinds[codes]
        before, after = kinds[:-1], kinds[1:]
        return (before != after) & (before != self._SPACE) & ((codes[:-1] != ord("'")) | (after != self._LETTER))

    def _parts(self, text: str) -> list[str]:
        """A text in parts of about PART characters, each of whole units."""
        parts, start, size = [], 0, self.PART
        while len(text) - start > size:
            places = np.flatnonzero(self._begins(_codes(text[start : start + size])))
            if len(places):
                stop = start + int(places[-1]) + 1
                parts.append(text[start:stop])
                start, size = stop, self.PART
            else:
                size *= 2
        return [*parts, text[start:]]

    def _new(self, units: list[str]) -> list[bytes]:
        """Ids of units that are not known, many in one text: between line feeds, each of which is a piece.

        A feed would take white space into its piece, other than one space before the unit's first character.
        """
        spaces = self.spaces
        alone = [(u[1:2] if u[0] == " " else u[0]) in spaces for u in units]
        rest = [u for u, a in zip(units, alone) if not a]
        found: list[bytes] = []
        for k in range(0, len(rest), self.TOGETHER):
            some = rest[k : k + self.TOGETHER]
            raw = self._bytes(["\n".join(some)])[0]
            feeds = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.feed)).tolist()
            found.extend([raw[a:b] for _, a, b in zip(some, [0, *[f + 4 for f in feeds]], [*feeds, len(raw)], strict=True)])
        if len(rest) == len(units):
            return found
        of_rest, of_alone = iter(found), iter(self._bytes([u for u, a in zip(units, alone) if a]))
        return [next(of_alone if a else of_rest) for a in alone]

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of different units."""
        found = list(map(self.known.get, units))
        gaps = [k for k, v in enumerate(found) if v is None]
        if not gaps:
            return found
        fresh = [units[k] for k in gaps]
        new = self._new([u.decode() for u in fresh])
        for k, ids in zip(gaps, new):
            found[k] = ids
        room = self.MAX_UNITS - len(self.known)
        if room > 0:
            self.known.update([(u, ids) for u, ids in zip(fresh[:room], new) if len(u) <= self.MAX_BYTES])
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; texts that hold an added token are encoded whole."""
        holds = [not self.cuts or any([a in t for a in self.added]) for t in texts]
        whole = iter(self._bytes([t for t, h in zip(texts, holds) if h]))
        others = self._by_units([t for t, h in zip(texts, holds) if not h])
        return [next(whole if h else others) for h in holds]

    def _by_units(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; long texts are taken part by part, others together."""
        together: list[str] = []
        for t in texts:
            if len(t) <= self.PART:
                together.append(t)
                continue
            yield from self._encode(together)
            together = []
            yield b"".join([ids for part in self._parts(t) for ids in self._encode([part])])
        yield from self._encode(together)

    def _encode(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes, edges = _codes(joined), np.cumsum([0, *map(len, texts)])
        begins = np.concatenate([[True], self._begins(codes), [True]])
        begins[edges] = True
        places = np.flatnonzero(begins)
        # Bytes of UTF-8 before each place: one for each character, and those that some have more.
        more = (codes > 0x7F).view(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        offsets = places.astype(np.int64)
        offsets[1:] += np.cumsum(more, dtype=np.int32)[places[1:] - 1]
        units = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(joined.encode())])
        coded = units.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, starts, data = ids.buffers()
        stops = np.frombuffer(starts, np.int64)[np.searchsorted(places, edges)].tolist()
        return [data[a:b].to_pybytes() for a, b in zip(stops, stops[1:])]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


@lru_cache(maxsize=1)
def unit_encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


# --- files ----------------------------------------------------------------------------------------------

_SEGMENT = "shard int, segment int, n_values long, doc_ids array<long>, lengths array<long>, payload binary"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID,
                 segment_values: int = SEGMENT_VALUES) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ``folder`` in ascending doc_id order.

    A null or empty text is the end id alone. Null ids come first; rows of one doc_id are ordered by
    text and all written. An empty table writes an empty file. Other columns are not read. Ranges of
    doc_id are dealt to tasks; a task works on a few megabytes of text and one segment at a time.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = TaskContext.get().partitionId(), 0
        encoder = unit_encoder(tokenizer)
        gc.disable()  # millions of short strings and no cycles: its passes take a tenth of the time
        end = np.array([end_id], "<u4").tobytes()
        ids, held, size = [], [], 0

        def row():
            values = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "segment": number, "n_values": len(values), "doc_ids": ids,
                "lengths": [len(h) // 4 for h in held], "payload": encode_segment(values)}], schema=schema)

        for b in slices(batches, size=2 << 20):
            for doc_id, data in zip(b.column("doc_id").to_pylist(), encoder(as_texts(b.column("text")))):
                ids.append(doc_id)
                held.append(data + end)
                size += len(data) // 4 + 1
                if size >= segment_values:
                    yield row()
                    ids, held, size, number = [], [], 0, number + 1
        if held:
            yield row()

    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_values", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(segments, _SEGMENT).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, ids: bool = True, crc: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens: the documents of the file.

    With ``ids`` an array<int> of the ids, with ``crc`` ids_crc32: the unsigned CRC-32 of the ids read,
    as little-endian unsigned 32-bit integers. A segment's start is the sum of the shards and segments
    before it; only these counts are added up, over one row per shard and, within a shard, one row
    per segment.
    """
    rows = spark.read.schema(_SEGMENT).parquet(folder)
    counts = rows.select("shard", "segment", "n_values")
    earlier = lambda w: F.coalesce(F.sum("n_values").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = counts.groupBy("shard").agg(F.sum("n_values").alias("n_values"))
    shards = shards.select("shard", earlier(Window.orderBy("shard")).alias("_shard_start"))
    inner = counts.select("shard", "segment", earlier(Window.partitionBy("shard").orderBy("segment")).alias("_inner_start"))
    starts = inner.join(shards, "shard").select("shard", "segment", (F.col("_shard_start") + F.col("_inner_start")).alias("start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                lengths = np.array(one.column("lengths")[0].as_py(), np.int64)
                ends = np.cumsum([0, *lengths])
                values = decode_segment(one.column("payload")[0].as_py()).astype("<u4", copy=False)
                out = [one.column("doc_ids").flatten(), pa.array(one.column("start")[0].as_py() + ends[:-1]), pa.array(lengths)]
                if ids:
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int32))))
                if crc:
                    out.append(pa.array([zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.int64()))
                yield pa.RecordBatch.from_arrays(out, names)

    kinds = ["doc_id long", "start long", "n_tokens long", *["ids array<int>"] * ids, *["ids_crc32 long"] * crc]
    names = [k.split()[0] for k in kinds]
    met = rows.join(measured(starts, 32), ["shard", "segment"]).select("doc_ids", "lengths", "payload", "start")
    return met.mapInArrow(documents, ", ".join(kinds))


def stored(docs: DataFrame, ids: bool = True, crc: bool = False) -> DataFrame:
    """Write ``docs`` to a new file in the shared folder and read it back."""
    folder = scratch_folder(docs.sparkSession)
    write_tokens(docs, folder)
    return read_tokens(docs.sparkSession, folder, ids, crc)
