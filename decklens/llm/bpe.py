"""Byte-level BPE: encoding by overlapping chunks, and decoding.

The pre-tokenising pattern has no look-behind, so two scans of a text that both begin a piece at one
place agree from there on. A long text is cut into overlapping chunks that are pre-tokenised in
parallel; a chunk's scan may start inside a piece, and is joined to its predecessor's at the first
place in the overlap where both begin a piece. The spans between joints are then encoded piece by
piece. Where two chunks share no such place (a run of letters longer than the overlap), they are
joined and encoded as one span.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from decklens.llm.common import as_texts, pieces

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a chunk, and of its overlap with the next one.
CHUNK = 32_768
OVERLAP = 512
#: A piece is certain if so many characters follow it: "'re" may be cut to "'" by the chunk's end.
LOOKAHEAD = 3


@lru_cache(maxsize=2)
def encoding(ranks_path: str = RANKS) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str = RANKS) -> list[bytes]:
    enc = encoding(ranks_path)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def boundaries(chunk: str, low: int, high: int, is_last: bool) -> list[int]:
    """Where pieces of ``chunk`` begin, among the places low..high-1, as far as they are certain.

    The place right after a certain piece counts too, since the next one begins there.
    """
    found, end = [0] if low <= 0 < high else [], len(chunk) if is_last else len(chunk) - LOOKAHEAD
    for m in regex.finditer(public_tokenizers.PATTERN, chunk):
        if m.end() > end or m.end() >= high:
            break
        if m.end() >= low:
            found.append(m.end())
    return found


def _encode_udf(ranks_path: str):
    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        enc, rows = encoding(ranks_path), []
        for piece in pieces(text):
            ids = [enc.encode_to_numpy(t, disallowed_special=()) for t in as_texts(piece)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids).astype(np.int32)
            rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)))
        return pa.concat_arrays(rows) if rows else pa.array([], pa.list_(pa.int32()))

    # Spark would otherwise run the encoder again inside each later function of its ids.
    return encode.asNondeterministic()


def encode(docs: DataFrame, ranks_path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with n_tokens (long) and ids (array<int>) of the whole text; no special tokens.

    A null text is encoded as the empty one (no ids). Rows are encoded each for itself, so repeated
    rows and ids stay; an empty table gives an empty result. Input columns named n_tokens or ids
    are replaced. Texts of one chunk (nearly all) are encoded where they are read; of longer ones
    the chunks are dealt out to all tasks and only their ids meet again.
    """
    ids = _encode_udf(ranks_path)
    names = [c for c in docs.columns if c not in ("n_tokens", "ids")]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    text = F.coalesce(F.col("_row")["text"], F.lit(""))
    # A row's length is known before its text is sent anywhere.
    short = row.filter(F.length(text) <= chunk).withColumn("_ids", ids(text))
    long = row.filter(F.length(text) > chunk)
    spans = long_spans(long.select(F.struct(F.col("_row")["doc_id"].alias("id"), F.xxhash64(text).alias("key")).alias("_doc"), text.alias("text")), chunk, overlap)
    encoded = (
        spans.select("_doc", "_span", ids(F.col("text")).alias("_part"))
        .groupBy("_doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_span", "_part"))), lambda s: s["_part"])).alias("_ids"))
        .select(F.col("_doc.id").alias("_id"), F.col("_doc.key").alias("_key"), "_ids")
    )
    met = long.join(encoded, F.col("_row")["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key"))).select("_row", "_ids")
    return short.unionByName(met).select(
        *[F.col("_row")[c].alias(c) for c in names], F.size("_ids").cast("long").alias("n_tokens"), F.col("_ids").alias("ids"))


def long_spans(texts: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(_doc, _span, text): disjoint spans of each (_doc, text), in order, that begin and end with pieces.

    Rows equal in _doc are one text. Each chunk reports where pieces begin in the overlap before
    and after it; the first place both neighbours report is the joint. A chunk that finds no joint
    goes on in its predecessor's span.
    """
    size = F.length("text")
    last = F.floor((size - 1) / chunk).cast("int")
    cut = (
        texts.dropDuplicates(["_doc"])
        .select("_doc", "text", last.alias("_last"), F.explode(F.sequence(F.lit(0), last)).alias("_k"))
        .select("_doc", "_k", (F.col("_k") == F.col("_last")).alias("_is_last"),
                F.substring(F.col("text"), F.col("_k") * chunk + 1, F.lit(chunk + overlap + LOOKAHEAD)).alias("text"))
        .repartition("_doc", "_k")
    )

    @F.arrow_udf("struct<head:array<int>,tail:array<int>>")
    def joints(text: pa.Array, is_last: pa.Array) -> pa.Array:
        found = []
        for t, ends in zip(as_texts(text), is_last.to_pylist()):
            found.append({"head": boundaries(t, 0, overlap, ends), "tail": [b - chunk for b in boundaries(t, chunk, chunk + overlap, ends)]})
        return pa.array(found, pa.struct([("head", pa.list_(pa.int32())), ("tail", pa.list_(pa.int32()))]))

    order = Window.partitionBy("_doc").orderBy("_k")
    marked = cut.withColumn("_j", joints(F.col("text"), F.col("_is_last")))
    joint = F.array_min(F.array_intersect(F.lag("_j.tail").over(order), F.col("_j.head")))
    marked = marked.withColumn("_from", F.when(F.col("_k") == 0, 0).otherwise(joint))
    # A chunk ends where the next joined chunk begins; unjoined ones belong to the span before them.
    span = F.max(F.when(F.col("_from").isNotNull(), F.col("_k"))).over(order)
    next_from = F.lead("_from").over(order)
    body = F.substring(
        F.col("text"), F.coalesce(F.col("_from"), F.lit(0)) + 1,
        F.lit(chunk) + F.coalesce(next_from, F.lit(0)) - F.coalesce(F.col("_from"), F.lit(0)))
    return (
        marked.select("_doc", "_k", span.alias("_span"), body.alias("text"))
        .groupBy("_doc", "_span")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda c: c["text"]), "").alias("text"))
    )


def decode(ids: str | Column, ranks_path: str = RANKS) -> Column:
    """The bytes of an array of ids (null: null): raw bytes joined, not always whole characters."""

    @F.arrow_udf("binary")
    def raw(column: pa.Array) -> pa.Array:
        word = vocabulary(ranks_path).__getitem__
        return pa.array([None if x is None else b"".join(map(word, x)) for x in _lists(column)], pa.binary())

    return raw(F.col(ids) if isinstance(ids, str) else ids)


@lru_cache(maxsize=1)
def _decimals(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def ids_digest(ids: str | Column, ranks_path: str = RANKS) -> Column:
    """SHA-256 (lowercase hex) of the decimal ids joined by one space (null: null)."""

    @F.arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        decimal = _decimals(len(vocabulary(ranks_path))).__getitem__
        return pa.array([None if x is None else hashlib.sha256(b" ".join(map(decimal, x))).hexdigest() for x in _lists(column)], pa.string())

    return digest(F.col(ids) if isinstance(ids, str) else ids)


def _lists(column: pa.ListArray) -> Iterator[list[int] | None]:
    """The rows of a list column, one at a time."""
    ends, flat, nulls = column.offsets.to_numpy(), column.values.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield None if nulls[i] else flat[ends[i] : ends[i + 1]].tolist()
