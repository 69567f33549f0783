"""Near-duplicates by ProbMinHash: weighted word shingles, banding, exact verification.

A text is a bag of shingles of five words, weighted by how often they occur. Every shingle is a
Poisson process of its weight as rate, whose arrivals fall on the components of the signature; a
component takes the shingle that arrives first, so two texts agree in it with their probability
Jaccard similarity. Arrivals are drawn until none can come before the last component's: most
shingles need one draw. Texts that share a band of components are candidates; a link needs an exact
similarity of 0.8 or more.

Equal texts are one node. Candidates of a bucket are first paired with one node of the bucket. Where
a bucket still holds several components after that, all its members are compared in blocks by a
longer signature, and those of different components that can be similar enough are verified there; a
block returns the links that join components, fewer than it has members. So every candidate pair is
verified, connected already, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as digest

from decklens.llm.common import as_texts, measured, slices, staged
from decklens.llm.components import components

WORDS = 5
SIMILARITY = 0.8
#: 28 bands of 4 components: a pair of similarity 0.8 is missed with probability 4e-7.
BANDS, ROWS = 28, 4
#: Components of the longer signature, one byte each, and the share of equal ones below which a pair
#: cannot be linked: 0.8 less 4.75 standard deviations, so that one pair in a million is missed.
SKETCH = 1024
SKETCH_MARGIN = 4.75
#: Bytes of text whose shingles a task holds at once.
SLICE = 1 << 20
#: Texts whose longer signatures a task draws at once (16 KB each while drawn).
SKETCHED = 512
#: Members of a bucket that one block compares with as many others.
BLOCK = 1000
#: Bytes of their bags, at most, unless a single one has more.
BLOCK_BYTES = 32 << 20


# --- one text -----------------------------------------------------------------------------------------


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bags(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle code, count) of each distinct shingle, sorted; codes do not depend on the batch.

    Words are lower-cased and split at white space; a text with fewer words than a shingle is one
    shingle, a text without words has none.
    """
    tokens = [t.lower().split() for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    codes = np.fromiter(map(digest, chain.from_iterable(tokens)), np.uint64, int(sizes.sum()))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    n = max(0, len(codes) - words + 1)
    code = np.full(n, words, np.uint64)
    for k in range(words):
        code = code * _ODD + codes[k : k + n]
    inside = text_of[:n] == text_of[words - 1 :]
    code, text = code[inside], text_of[:n][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    starts = np.cumsum(sizes) - sizes
    if len(short):
        rest = np.zeros(len(short), np.uint64)
        for j, i in enumerate(short):
            value = int(sizes[i])
            for c in codes[starts[i] : starts[i] + sizes[i]].tolist():
                value = (value * int(_ODD) + c) % 2**64
            rest[j] = value
        code, text = np.concatenate([code, rest]), np.concatenate([text, short])
    code = _mixed(code)
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], code[first], np.diff(np.append(first, len(code)))


def signatures(text: np.ndarray, codes: np.ndarray, weights: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Text x component: the code that arrives first. Texts without shingles stay 0.

    All shingles of all texts draw their next arrival together; a shingle stops once its clock has
    passed the last component of its text.
    """
    first = np.full(n_texts * size, np.inf)
    found = np.zeros(n_texts * size, np.uint64)
    clock = np.zeros(len(codes))
    turn = 0
    while len(codes):
        turn += 1
        raw = _mixed(codes + np.uint64(turn * int(_ODD) % 2**64))
        clock = clock - np.log(((raw >> np.uint64(11)).astype(float) + 0.5) / 2**53) / weights
        place = text * size + (_mixed(raw ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
        near = np.flatnonzero(clock < first[place])
        np.minimum.at(first, place[near], clock[near])
        won = near[clock[near] == first[place[near]]]
        found[place[won]] = codes[won]
        on = clock < first.reshape(n_texts, size).max(1)[text]
        text, codes, weights, clock = text[on], codes[on], weights[on], clock[on]
    return found.reshape(n_texts, size)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over the common codes d of 1 / sum over all e of max(wa[e] / wa[d], wb[e] / wb[d]).

    ``a`` and ``b`` are sorted. If all counts are equal, this is common codes over all codes.
    """
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    ia = np.flatnonzero(b[at] == a)
    ib = at[ia]
    if wa.max() == wa.min() and wb.max() == wb.min():
        return len(ia) / (len(a) + len(b) - len(ia))
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    ratio = x / y
    order = np.argsort(ratio)
    r = ratio[order]
    # For d with ratio t: sum of max(x, t y) / x_d; codes of one text only count on its side.
    below_y = np.concatenate([[0.0], np.cumsum(y[order])])
    above_x = x.sum() - np.concatenate([[0.0], np.cumsum(x[order])])
    at = np.searchsorted(r, ratio)
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    total = above_x[at] + only_x + ratio * (below_y[at] + only_y)
    return float((x / total).sum())


# --- tables -------------------------------------------------------------------------------------------


def signed(rows: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(doc_id, node, keys): one key per band; no keys for a text without words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE):
            text, codes, weights = bags(as_texts(b.column("text")))
            parts = signatures(text, codes, weights, b.num_rows, bands * per_band).reshape(-1, bands, per_band)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (b.num_rows, 1))
            for k in range(per_band):
                key = _mixed(key * _ODD + parts[:, :, k])
            filled = np.bincount(text, minlength=b.num_rows) > 0
            ends = np.cumsum([0, *np.where(filled, bands, 0)])
            keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[filled].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), keys], ["doc_id", "node", "keys"])

    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node long, keys array<long>")


def shingled(rows: DataFrame) -> DataFrame:
    """(node, codes, weights, sketch) of (node, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, size=SLICE, rows=SKETCHED):
            text, codes, weights = bags(as_texts(b.column("text")))
            ends = pa.array(np.searchsorted(text, np.arange(b.num_rows + 1)), pa.int32())
            sketch = signatures(text, codes, weights, b.num_rows, SKETCH).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                b.column("node"), pa.ListArray.from_arrays(ends, pa.array(codes.view(np.int64))),
                pa.ListArray.from_arrays(ends, pa.array(weights.astype(np.int32))),
                pa.array([r.tobytes() for r in sketch], pa.binary())], ["node", "codes", "weights", "sketch"])

    return rows.mapInArrow(of, "node long, codes array<long>, weights array<int>, sketch binary")


def linked_in_blocks(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between members (bucket, band, cuts, node, component, keys, sketch, codes, weights) of a bucket.

    Pairs of different components whose sketches allow the similarity are verified where they meet.
    A link that is found joins its two components for the rest of the block, so a block gives
    fewer links than it has members, and these connect all that its links connect. A pair is looked at in the bucket of the
    first band that it shares only. A large bucket is cut into blocks by the hash of the node, and
    each pair of blocks is a task's work.
    """
    least = similarity - SKETCH_MARGIN * np.sqrt(similarity * (1 - similarity) / SKETCH)
    own = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int")
    dealt = (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            "bucket", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "band", "node", "component", "keys",
            "sketch", "codes", "weights")
    )

    def of(block: pa.Table) -> pa.Table:
        nodes, parts, own = (block.column(c).to_numpy() for c in ("node", "component", "_own"))
        sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), SKETCH)
        i, j, band = (block.column(c)[0].as_py() for c in ("i", "j", "band"))
        keys = block.column("keys").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)[:, :band]
        codes, weights = (_rows(block.column(c).combine_chunks()) for c in ("codes", "weights"))
        part = np.unique(parts, return_inverse=True)[1]
        right = np.flatnonzero(own == j)
        links = []
        for x in np.flatnonzero(own == i):
            others = right[(part[right] != part[x]) & ((nodes[right] < nodes[x]) if i == j else True)]
            if not len(others):
                continue
            share = (sketches[others] == sketches[x]).mean(1)
            others = others[share >= least]
            for y in others[~(keys[others] == keys[x]).any(1)]:
                if part[x] != part[y] and probability_jaccard(codes[x].view(np.uint64), weights[x], codes[y].view(np.uint64), weights[y]) >= similarity:
                    links.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
                    part[part == part[y]] = part[x]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(of, "a long, b long")


def _rows(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1], ends[1:])]


def verified(pairs: DataFrame, shingle_bags: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are similar enough."""

    @F.arrow_udf("double")
    def similar(a: pa.Array, wa: pa.Array, b: pa.Array, wb: pa.Array) -> pa.Array:
        rows = zip(*map(_rows, (a, wa, b, wb)))
        return pa.array([probability_jaccard(x.view(np.uint64), u, y.view(np.uint64), v) for x, u, y, v in rows], pa.float64())

    of = lambda side: shingle_bags.select(F.col("node").alias(side), F.col("codes").alias(f"c{side}"), F.col("weights").alias(f"w{side}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    return met.select("a", "b", similar("ca", "wa", "cb", "wb").alias("similarity")).filter(F.col("similarity") >= similarity)


def _connected(docs: DataFrame, similarity: float, bands: int, per_band: int) -> DataFrame:
    """(doc_id, node, component): one row per document, staged."""
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", node.alias("node"), "text")
    table = staged(signed(rows, bands, per_band))
    nodes = table.groupBy("node").agg(F.first("keys").alias("keys"))
    dealt = nodes.select("node", F.posexplode("keys").alias("band", "bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot <> last").select("bucket", "pivot")
    members = staged(dealt.join(shared, "bucket"))
    shingle_bags = staged(shingled(rows.join(measured(members.select("node").distinct(), 32), "node", "left_semi").select("node", "text").dropDuplicates(["node"])))

    # Round 0: each node with the smallest pivot of its buckets.
    pairs = members.filter("node <> pivot").groupBy(F.col("node").alias("a")).agg(F.min("pivot").alias("b"))
    links = staged(verified(pairs, shingle_bags, similarity))
    parts = staged(components(links))

    def apart(turn: int, *sums: Column) -> DataFrame:
        """Members of buckets that hold several components."""
        placed = members.join(parts, "node", "left").select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
        if sums:
            placed = placed.join(shingle_bags.select("node", (F.size("codes") * 12 + SKETCH).cast("long").alias("bytes")), "node")
        mixed = placed.groupBy("bucket").agg(
            F.min("component").alias("low"), F.max("component").alias("high"),
            F.min_by("node", F.struct("component", F.xxhash64("node", F.lit(turn)))).alias("pivot"), *sums,
        ).filter("low <> high").drop("high")
        return placed.join(mixed, "bucket")

    # Round 1: the nodes of other components with another node of the smallest one.
    pairs = apart(1).filter("component <> low").select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b"))
    pairs = pairs.distinct().join(links.select("a", "b"), ["a", "b"], "left_anti")
    links = links.select("a", "b").unionByName(staged(verified(pairs, shingle_bags, similarity)).select("a", "b"))
    parts = staged(components(links))
    # Then all that are still apart, in blocks.
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("cuts")
    whole = shingle_bags.join(nodes.select("node", "keys"), "node")
    links = links.unionByName(staged(linked_in_blocks(apart(2, cuts).drop("low", "pivot", "bytes").join(whole, "node"), similarity)))
    parts = staged(components(links))

    of_node = nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return staged(table.select("doc_id", "node").join(of_node, "node"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """(doc_id, text_key, class_id): one row per document; class_id is the smallest doc_id of its class.

    A class is what links of ``similarity`` or more connect; equal texts are one class. Texts
    without words (null, empty or blank) are alike only if equal, null and empty being equal. Rows
    that repeat stay. Null doc_ids are classed like others and name a class only if it has no other
    doc_id (class_id null). Other columns are not read. An empty table gives an empty result.
    """
    rows = _connected(docs, similarity, bands, per_band)
    smallest = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    return rows.join(smallest, "component").select("doc_id", F.col("node").alias("text_key"), "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its own columns: the one with the smallest doc_id.

    A class without any doc_id keeps a row of its smallest text (by hash). Of several texts under
    the doc_id that stays, the one with the smallest hash stays, and of rows that repeat it, one: that
    whose other columns have the smallest hash.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in others]))) if others else F.lit(0)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_node"), rest.alias("_rest"))
    found = _connected(docs, similarity, BANDS, ROWS).withColumn("nameless", F.col("doc_id").isNull())
    first = F.min(F.struct("nameless", "doc_id", "node"))
    chosen = found.groupBy("component").agg(first.alias("f")).select("component", F.col("f.doc_id").alias("_id"), F.col("f.node").alias("_key"))
    met = keyed.join(chosen, (F.col("_node") == F.col("_key")) & F.col("_doc").eqNullSafe(F.col("_id")))
    return met.groupBy("component").agg(F.min_by("_row", "_rest").alias("_row")).select("_row.*")
