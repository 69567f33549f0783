"""Line dedup by log templates.

Every line goes down a tree of fixed depth: the number of its tokens, then its first DEPTH tokens,
where a token with a digit stands for any value. Two lines of a leaf share a template if they agree
in at least SIMILARITY of their places; the places where they differ are its variable fields. A line
that shares a template with a line of an earlier document, or equals one, recurs, and its document
loses it. So a line that recurs in some documents recurs in any larger set of them.

Lines that may differ in k places are found by keys of the places kept: with few choices of k later
places, by one key for each choice, where equal keys are the proof; else by k + 1 blocks of the
later places, of which two such lines share one, and their tokens are compared. Keys are aggregated
over distinct lines, so neither a frequent line nor a crowded leaf meets in one task; lines of a
block that nothing earlier has matched yet are compared with the earlier ones inside tasks, which return a
row per line at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as digest

from decklens.llm.common import as_bytes, measured, slices, staged

DEPTH = 4
SIMILARITY = 0.8
#: A line has a key for each choice of differing places up to so many choices, and keys of blocks beyond.
MAX_CHOICES = 64
#: Lines of a block that one task compares with as many others.
BLOCK = 1000
_WORD = (1 << 64) - 1
_DIGIT = re.compile(rb"[0-9]")


def _masked(token: bytes) -> bytes:
    """A token with a digit is a variable field."""
    return b"<*>" if _DIGIT.search(token) else token


def parse(line: bytes, depth: int = DEPTH) -> tuple[int, int, list[bytes]] | None:
    """(leaf, line code, masked tokens) of a line; None if it has no token.

    A line of variable fields only has no template text: it stands for itself.
    """
    tokens = line.split()
    if not tokens:
        return None
    masked = [_masked(t) for t in tokens] if _DIGIT.search(line) else tokens
    if all(t == b"<*>" for t in masked):
        masked = tokens
    leaf = digest(b" ".join([b"%d" % len(masked), *masked[:depth]])) - (1 << 63)
    return leaf, digest(b" ".join(masked), seed=1) - (1 << 63), masked


def line_codes(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_key, place, leaf, line) for every line with a token; texts go no further."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, places, leaves, codes = [], [], [], []
            for i, text in enumerate(as_bytes(b.column("text"))):
                for k, line in enumerate(text.split(b"\n")):
                    if (p := parse(line, depth)) is not None:
                        at.append(i)
                        places.append(k)
                        leaves.append(p[0])
                        codes.append(p[1])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(places, pa.int32()), pa.array(leaves, pa.int64()), pa.array(codes, pa.int64())],
                ["doc_id", "text_key", "place", "leaf", "line"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {kind}, text_key long, place int, leaf long, line long")


def differing(size: int, similarity: float) -> int:
    """In how many places lines of ``size`` tokens may differ."""
    return size - math.ceil(size * similarity - 1e-9)


def keys_of(leaf: int, values: list[int], k: int) -> tuple[bool, list[int]]:
    """(whether equal keys prove it, keys) such that lines of a leaf that differ in ``k`` places share a key.

    ``values`` has a code for each later place and its token; a key is the sum of those it keeps.
    """
    n, total = len(values), leaf + sum(values)
    if k >= n or math.comb(n, k) <= MAX_CHOICES:
        return True, [(total - sum(c)) & _WORD for c in combinations(values, min(k, n))]
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return False, [(leaf + sum(values[i:j])) & _WORD for i, j in zip(cuts, cuts[1:])]


def line_keys(rows: DataFrame, wanted: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, leaf, line, exact, keys, tokens) of the lines ``wanted``, taken from their first documents.

    ``wanted`` has (doc_id, text_key, places): one document to take each line from. ``tokens`` are the
    codes of the later tokens, 64 bits each; null where equal keys are the proof.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, leaves, codes, exact, keys, tokens = [], [], [], [], [], []
            for i, (text, chosen) in enumerate(zip(as_bytes(b.column("text")), b.column("places").to_pylist())):
                lines = text.split(b"\n")
                for place in chosen:
                    leaf, code, masked = parse(lines[place], depth)
                    k = differing(len(masked), similarity)
                    if not k or len(masked) <= depth:
                        continue
                    values = [digest(t, seed=p) for p, t in enumerate(masked[depth:], depth)]
                    proof, own = keys_of(leaf, values, k)
                    at.append(i)
                    leaves.append(leaf)
                    codes.append(code)
                    exact.append(proof)
                    keys.append(np.array(own, np.uint64).view(np.int64))
                    tokens.append(None if proof else np.array(values, np.uint64).tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(take), b.column("text_key").take(take), pa.array(leaves, pa.int64()), pa.array(codes, pa.int64()),
                 pa.array(exact, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                ["doc_id", "text_key", "leaf", "line", "exact", "keys", "tokens"])

    met = rows.join(wanted, (rows["text_key"] == wanted["_key"]) & rows["doc_id"].eqNullSafe(wanted["_id"]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.select("doc_id", "text_key", "text", "places").mapInArrow(
        of, f"doc_id {kind}, text_key long, leaf long, line long, exact boolean, keys array<long>, tokens binary")


def agreeing(pairs: DataFrame, tokens: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line) of the ``pairs`` (leaf, line, other) that agree in enough places."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for x, y in zip(b.column("tokens").to_pylist(), b.column("other_tokens").to_pylist()):
                n = int((np.frombuffer(x, np.uint64) != np.frombuffer(y, np.uint64)).sum()) if len(x) == len(y) else len(x)
                hits.append(n <= differing(len(x) // 8 + depth, similarity))
            yield pa.RecordBatch.from_arrays([b.column("leaf"), b.column("line")], ["leaf", "line"]).filter(pa.array(hits, pa.bool_()))

    other = tokens.select("leaf", F.col("line").alias("other"), F.col("tokens").alias("other_tokens"))
    met = pairs.join(tokens, ["leaf", "line"]).join(other, ["leaf", "other"])
    return met.select("leaf", "line", "tokens", "other_tokens").mapInArrow(of, "leaf long, line long").distinct()


def agreeing_in_blocks(members: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line) of the open members (leaf, key, cuts, line, doc, open, tokens) of a block that agree in enough
    places with a member of an earlier document.

    Members are compared inside the tasks, and a task returns a line once at most. A block with many
    lines is cut by the hash of the line, and each pair of cuts is a task's work.
    """
    own = F.pmod(F.xxhash64("line"), F.col("cuts")).cast("int")
    dealt = (
        members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select("leaf", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "line", "doc", "open", "tokens")
    )

    def of(block: pa.Table) -> pa.Table:
        lines, own = block.column("line").to_numpy(), block.column("own").to_numpy()
        asks = block.column("open").to_numpy(zero_copy_only=False)
        docs = [(d["none"], d["id"], d["key"]) for d in block.column("doc").to_pylist()]
        rank, places = np.zeros(len(docs), np.int64), sorted(range(len(docs)), key=docs.__getitem__)
        for n, (x, y) in enumerate(zip(places[1:], places), 1):
            rank[x] = rank[y] if docs[x] == docs[y] else n
        raw = block.column("tokens").to_pylist()
        # All lines of a leaf have the same number of tokens.
        size = len(raw[0])
        alike = np.array([len(x) == size for x in raw])
        tokens = np.frombuffer(b"".join(x if len(x) == size else bytes(size) for x in raw), np.uint64).reshape(len(raw), -1)
        most = differing(size // 8 + depth, similarity)
        across = block.column("i")[0].as_py() != block.column("j")[0].as_py()
        hits = []
        for x in np.flatnonzero(asks & alike):
            others = np.flatnonzero((rank < rank[x]) & alike & ((own != own[x]) if across else True))
            if ((tokens[others] != tokens[x]).sum(1) <= most).any():
                hits.append(x)
        take = pa.array(hits, pa.int64())
        return block.select(["leaf", "line"]).take(take)

    return dealt.groupBy("leaf", "key", "i", "j").applyInArrow(of, "leaf long, line long").distinct()


def settled_lines(rows: DataFrame, wanted: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line) of the distinct lines that share a template with a line of a document before their first."""
    keyed = staged(line_keys(rows, wanted, depth, similarity).dropDuplicates(["leaf", "line"]))
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    spread = keyed.select("leaf", "line", "exact", who.alias("doc"), F.explode("keys").alias("key"))
    first = spread.groupBy("leaf", "key").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = staged(spread.join(first.filter("n > 1"), ["leaf", "key"]).filter("first.doc < doc"))
    proved = later.filter("exact").select("leaf", "line").distinct()
    # Without proof: first with the first line of each block, then, where that differs, with all earlier ones.
    tokens = keyed.filter("not exact").select("leaf", "line", "tokens")
    pairs = later.filter("not exact").select("leaf", "line", F.col("first.line").alias("other")).distinct()
    alike = staged(agreeing(pairs, tokens, depth, similarity))
    open_ = staged(later.filter("not exact").join(alike, ["leaf", "line"], "left_anti").select("leaf", "key", "line", "n"))
    cuts = open_.groupBy("leaf", "key").agg(F.ceil(F.max("n") / BLOCK).cast("int").alias("cuts"))
    members = (
        spread.filter("not exact").join(cuts, ["leaf", "key"])
        .join(open_.select("leaf", "key", "line", F.lit(True).alias("open")), ["leaf", "key", "line"], "left")
        .withColumn("open", F.coalesce("open", F.lit(False))).join(tokens, ["leaf", "line"])
    )
    return proved.unionAll(alike).unionAll(agreeing_in_blocks(members, depth, similarity)).distinct()


def dropped_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, places): the line numbers that recurring templates lose, per document."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text").filter(F.col("text").isNotNull())
    codes = staged(line_codes(rows, depth))
    # One row per distinct line. Documents are ordered by doc_id, nulls last, then by text_key.
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    lines = codes.groupBy("leaf", "line").agg(
        F.min(F.struct(who.alias("doc"), F.col("place").alias("place"))).alias("first"), F.max(who).alias("last"))
    crowded = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("leaf", F.lit(True).alias("crowded"))
    # A line of one document, alone in its leaf, recurs nowhere.
    lines = staged(lines.join(crowded, "leaf", "left").filter("crowded or first.doc <> last"))
    wanted = (
        lines.filter("crowded").groupBy(F.col("first.doc.id").alias("_id"), F.col("first.doc.key").alias("_key"))
        .agg(F.collect_set("first.place").alias("places"))
    )
    settled = settled_lines(rows, measured(wanted, F.size("places") * 4 + 32), depth, similarity)
    # A line with an earlier one goes from all documents, any other from all but its first.
    known = lines.join(settled.withColumn("settled", F.lit(True)), ["leaf", "line"], "left")
    recurring = known.filter("settled or first.doc <> last").select(
        "leaf", "line", F.coalesce("settled", F.lit(False)).alias("settled"), F.col("first.doc").alias("kept_doc"))
    # Where these are few enough, codes of a very frequent line stay where they are.
    lost = codes.join(measured(recurring, F.octet_length(F.to_json("kept_doc")) + 32), ["leaf", "line"]).filter(F.col("settled") | (who != F.col("kept_doc")))
    return lost.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


def dedup_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, n_lines (before) and n_dropped.

    A document is a row, known by doc_id and text: equal rows are one document and lose the same
    lines; rows with one doc_id and different texts, or without doc_id, are documents of their own.
    The first document (lowest doc_id, nulls last) keeps a template's lines, repeats and variants
    inside it included. Lines without a token are never dropped; of a null or empty text nothing is. A text
    of which all lines are dropped becomes empty. An empty table gives an empty result; input
    columns named n_lines or n_dropped are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = dropped_lines(docs, depth, similarity).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "places")
    lost = measured(lost, F.size("places") * 4 + 32)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.xxhash64("doc_id", "text").alias("text_key"))
    met = row.join(lost, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text = F.col("_row")["text"]

    @F.arrow_udf("string")
    def without(texts: pa.Array, places: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts.to_pylist(), places.to_pylist()):
            if t is None:
                out.append(None)
                continue
            gone = set(p)
            out.append("\n".join([line for k, line in enumerate(t.split("\n")) if k not in gone]))
        return pa.array(out, pa.string())

    # Only texts that lose a line are sent to Python.
    cut = without(F.when(F.col("places").isNotNull(), text), F.col("places"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    return met.withColumn("_cut", cut).select(
        *[(F.coalesce("_cut", text) if c == "text" else F.col("_row")[c]).alias(c) for c in names],
        n_lines.alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"))
