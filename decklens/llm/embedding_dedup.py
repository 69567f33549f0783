"""Embedding near-dedup: subspace pigeonhole join.

Unit vectors of cosine c are 2 - 2c apart in squared distance. After a rotation, the coordinates are
split into blocks; two vectors within a squared distance t are, in at least one block, within the
block's share of t (in proportion to its coordinates).

What travels for the range-joins of the blocks is a vector's code, a byte for each rotated coordinate,
many rows to a binary value. A block of one label is one cell; beyond CELL vectors it is cut along its
coordinates, at medians of a sample, and a vector within range of a cut is in both cells. Inside a
task rows of a cell meet on the same terms, in smaller sets. Codes that are near enough in the block,
and over all coordinates, for the vectors to be so are candidates; a task returns a spanning forest of them.

The vectors themselves travel only if they have a candidate, once, to the others that candidates
reach, and are compared exactly there. A crowded set is cut into parts and each pair of parts is a
task's work; a task returns one row per vector (its links there and one link of a spanning forest),
never its pairs. Equal vectors are one node with a number of copies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decklens.llm.common import measured, staged
from decklens.llm.components import components

COSINE = 0.98
BLOCKS = 8
#: Bytes of codes that a cell of a block is meant to hold; labels beyond it are cut.
CELL = 1 << 26
#: Vectors that are seen for each cell of such a label. They place the cuts, and change no result.
SEEN = 256
#: Vectors of small labels, or of small sets of candidates, that one call works on.
PACK = 8192
#: Coordinates that one part of a crowded set holds.
PART = 1 << 20
#: Coordinates are rounded to this many bits, which makes block distances exact integers.
BITS = 20
#: Steps of a code in the spread of a coordinate.
FINE = 16
#: Vectors that are seen to place a cut inside a task.
SOME = 64
#: Pairs whose distances, and pairs whose vectors, are looked at together.
CHUNK, PAIRS = 1 << 19, 1 << 16

#: A cell in so many parts, or (axis, cut, what lies below, what lies above or within range of the cut).
Plan = int | tuple[int, float, "Plan", "Plan"]


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def rotated(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit @ rotation(unit.shape[1]) * 2**BITS)


def blocks(dim: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), min(BLOCKS, dim))


def budget(cosine: float, block: np.ndarray, dim: int) -> float:
    """The block's share of the squared distance, in rounded coordinates, with room for rounding."""
    return (2 - 2 * cosine) * len(block) / dim * 4**BITS * (1 + 1e-6) + 4 * len(block) * 2**BITS


def steps(dim: int) -> float:
    """Steps of a code in a rounded coordinate."""
    return FINE * dim**0.5 / 2**BITS


def codes(place: np.ndarray) -> np.ndarray:
    """Rotated coordinates in steps. Limits bring no two vectors further apart, rounding by a step at most."""
    return np.rint(np.clip(np.nan_to_num(place * steps(place.shape[1])), -127, 127)).astype(np.int8)


def bound(cosine: float, block: np.ndarray, dim: int) -> float:
    """The budget of a block in codes, with room for their rounding."""
    return (budget(cosine, block, dim) ** 0.5 * steps(dim) + len(block) ** 0.5) ** 2


def cut(x: np.ndarray, each: float, reach: float, most: int, gain: float) -> Plan:
    """How rows, which stand for ``each`` as many, are cut to ``most``; where a cut would leave more
    than ``gain`` of the pairs, into parts."""
    if len(x) * each <= most:
        return 1
    best = (gain * len(x) ** 2, 0, 0.0)
    for axis in range(x.shape[1]):
        at = float(np.partition(x[:, axis], len(x) // 2)[len(x) // 2])
        above = int((x[:, axis] >= at).sum())
        best = min(best, ((len(x) - above) ** 2 + int((x[:, axis] >= at - reach).sum()) ** 2, axis, at))
    pairs, axis, at = best
    if pairs >= gain * len(x) ** 2:
        return int(np.ceil(len(x) * each / most))
    return axis, at, *(cut(x[side], each, reach, most, gain) for side in (x[:, axis] < at, x[:, axis] >= at - reach))


def walk(plan: Plan, x: np.ndarray, rows: np.ndarray, reach: float, path: int = 1) -> Iterator[tuple[int, int, np.ndarray]]:
    """(number, parts, rows) of each cell that has rows; two rows within ``reach`` share a cell."""
    if not len(rows):
        return
    if isinstance(plan, int):
        yield path, plan, rows
        return
    axis, at, below, above = plan
    v = x[rows, axis]
    yield from walk(below, x, rows[v < at], reach, 2 * path)
    yield from walk(above, x, rows[v >= at - reach], reach, 2 * path + 1)


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``a`` and ``b``; each row's root stays the smallest row of its tree."""
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root[:] = root[root]


def _vectors(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of as many coordinates each, some 4 MB of them as doubles."""
    for batch in batches:
        dims = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            of_dim = batch.filter(pa.array(dims == dim))
            rows = max(1, (1 << 19) // int(dim))
            for start in range(0, of_dim.num_rows, rows):
                yield int(dim), of_dim.slice(start, rows)


def _plans(vectors: DataFrame, large: dict[int, int], cosine: float) -> dict[int, list[Plan]]:
    """How the blocks of each large label are cut: what the driver gets is a few numbers per cell."""

    def of(part: pa.Table) -> pa.Table:
        _, first = np.unique(part.column("node").to_numpy(), return_index=True)
        embedding = part.column("embedding").combine_chunks().take(pa.array(first))
        dim = len(embedding[0])
        place, label = rotated(units(_vectors(embedding, dim))), part.column("label_code")[0].as_py()
        plan = [cut(place[:, b], large[label] / len(place), budget(cosine, b, dim) ** 0.5, max(1, CELL // dim), 0.8) for b in blocks(dim)]
        return pa.table({"label_code": [label], "plan": [json.dumps(plan)]})

    if not large:
        return {}
    one_in = F.greatest(F.lit(1), F.floor(F.lit(CELL // SEEN) / F.size("embedding")))
    seen = vectors.filter(F.col("label_code").isin(list(large)) & (F.pmod(F.xxhash64("node", F.lit(2)), one_in) == 0))
    return {r.label_code: json.loads(r.plan) for r in seen.groupBy("label_code").applyInArrow(of, "label_code long, plan string").collect()}


def _dealt(vectors: DataFrame, cosine: float, plans: dict[int, list[Plan]], packs: int) -> DataFrame:
    """(key, block, dim, label_code, node, code): the codes of many vectors in each row. Labels without
    a plan have one cell for each block, and a key holds several of them."""

    def mixed(*values: np.ndarray | int) -> int:
        code = 0
        for v in values:
            code = (code ^ (int(v) % 2**64)) * 0xBF58476D1CE4E5B9 % 2**64
            code ^= code >> 29
        return code - 2**63

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in _by_dim(batches):
            node, first = np.unique(batch.column("node").to_numpy(), return_index=True)
            batch = batch.take(pa.array(first))
            label = batch.column("label_code").to_numpy()
            place = rotated(units(_vectors(batch.column("embedding"), dim)))
            code, cut_up, out = codes(place), blocks(dim), []

            def row(rows: np.ndarray) -> tuple[bytes, bytes, bytes]:
                rows = rows[np.argsort(label[rows], kind="stable")]
                return zstandard.compress(label[rows].tobytes(), 1), node[rows].tobytes(), zstandard.compress(code[rows].tobytes(), 1)

            large = np.isin(label, np.array(list(plans), np.int64))
            pack = label % packs
            for p in np.unique(pack[~large]):
                held = row(np.flatnonzero(~large & (pack == p)))
                out += [(int(p), k, *held) for k in range(len(cut_up))]
            for one in np.unique(label[large]):
                own = np.flatnonzero(label == one)
                for k, block in enumerate(cut_up):
                    for cell, parts, rows in walk(plans[int(one)][k], place[:, block], own, budget(cosine, block, dim) ** 0.5):
                        part = node[rows].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                        part = (part % np.uint64(parts)).astype(int)
                        for i in range(parts):
                            for j in range(i, parts):
                                if (here := (part == i) | (part == j)).any():
                                    out.append((mixed(one, cell, i, j), k, *row(rows[here])))
            for start in range(0, len(out), 64):
                key, k, *held = zip(*out[start : start + 64], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(k, pa.int32()), pa.array([dim] * len(key), pa.int32()), *(pa.array(h, pa.binary()) for h in held)],
                    ["key", "block", "dim", "label_code", "node", "code"])

    return vectors.mapInArrow(of, "key long, block int, dim int, label_code binary, node binary, code binary")


def candidates(part: pa.Table, cosine: float) -> pa.Table:
    """(node, root): a spanning forest of those that may be linked, of all labels of this key."""
    k, found = part.column("block")[0].as_py(), [(np.zeros(0, np.int64),) * 2]
    dims = part.column("dim").to_numpy()
    for dim in np.unique(dims):
        of_dim = part.filter(pa.array(dims == dim))
        label, node = (np.concatenate([np.frombuffer(raw, np.int64) for raw in raws]) for raws in (
            map(zstandard.decompress, of_dim.column("label_code").to_pylist()), of_dim.column("node").to_pylist()))
        code = np.concatenate([np.frombuffer(zstandard.decompress(raw), np.int8) for raw in of_dim.column("code").to_pylist()]).reshape(-1, dim)
        node, first = np.unique(node, return_index=True)
        label, code = label[first], code[first]
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            root = forest(code[rows], blocks(int(dim))[k], cosine)
            below = np.flatnonzero(root != np.arange(len(root)))
            found.append((node[rows[below]], node[rows[root[below]]]))
    nodes, roots = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"node": nodes, "root": roots})


def _below(v: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    return (v < at) & (v >= at - reach)


def _above(v: np.ndarray, at: np.ndarray, reach: float) -> np.ndarray:
    return (v >= at) & (v <= at + reach)


def meetings(x: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and others so that any two rows within ``reach`` on each axis meet; some rows are their own others."""
    rows = np.arange(len(x))
    todo = [(rows, rows)]
    while todo:
        a, b = todo.pop()
        if len(a) * len(b) <= CHUNK:
            if len(a) and len(b):
                yield a, b
            continue
        # Some rows show where a cut, at their median on one axis, leaves the fewest pairs.
        p, q = (x[r[:: -(-len(r) // SOME)]] for r in (a, b))
        at = np.sort(np.concatenate((p, q)), axis=0)[(len(p) + len(q)) // 2]
        share = np.zeros(x.shape[1])
        for one, other in ((p < at, q < at), (p >= at, q >= at), (_below(p, at, reach), _above(q, at, reach)), (_above(p, at, reach), _below(q, at, reach))):
            share += one.mean(0) * other.mean(0)
        axis = int(share.argmin())
        if share[axis] > 0.9:
            yield a, b
            continue
        at, v, w = at[axis], x[a, axis], x[b, axis]
        below, above = a[v < at], a[v >= at]
        todo += [(below, below), (above, above)] if a is b else [(below, b[w < at]), (above, b[w >= at])]
        todo.append((a[_below(v, at, reach)], b[_above(w, at, reach)]))
        if a is not b:
            todo.append((a[_above(v, at, reach)], b[_below(w, at, reach)]))


def forest(code: np.ndarray, block: np.ndarray, cosine: float) -> np.ndarray:
    """The root of each row: rows are joined whose codes are within the bounds, in the block and over all."""
    dim = code.shape[1]
    x = code[:, block].astype(np.float32)
    square, one = (x * x).sum(1), np.ones(len(x), np.float32)
    # One product gives squared distances, which are exact: they are small whole numbers.
    left, right = np.column_stack((-2 * x, square, one)), np.column_stack((x, one, square))
    within, over_all = bound(cosine, block, dim), bound(cosine, np.arange(dim), dim)
    root, found, held = np.arange(len(code)), [], 0
    for rows, others in meetings(x, budget(cosine, block, dim) ** 0.5 * steps(dim) + 1):
        start = 0
        while start < len(rows):
            meet = others[start:] if rows is others else others
            some = rows[start : start + max(1, CHUNK // len(meet))]
            start += len(some)
            # Rows of one tree need not meet.
            if (root[some] == root[some[0]]).all():
                meet = meet[root[meet] != root[some[0]]]
            if not len(meet):
                continue
            a, b = divmod(np.flatnonzero(left[some] @ right[meet].T <= within), len(meet))
            a, b = some[a], meet[b]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
            for s in range(0, len(a), PAIRS):
                c, d = a[s : s + PAIRS], b[s : s + PAIRS]
                gap = code[c].astype(np.int32) - code[d]
                near_by = np.einsum("ij,ij->i", gap, gap) <= over_all
                found.append((c[near_by], d[near_by]))
                held += len(found[-1][0])
                # Joining passes over all rows, so it waits for a share of them.
                if held > len(root) >> 3:
                    merge(root, *(np.concatenate(x) for x in zip(*found, strict=True)))
                    found, held = [], 0
    if found:
        merge(root, *(np.concatenate(x) for x in zip(*found, strict=True)))
    return root


def compare(part: pa.Table, cosine: float) -> pa.Table:
    """(node, links, root) of the nodes that are linked in these sets of candidates, or pair of parts of one."""
    i, j = (part.column(c)[0].as_py() for c in ("i", "j"))
    node, first = np.unique(part.column("node").to_numpy(), return_index=True)
    copies, own, group = (part.column(c).to_numpy()[first] for c in ("copies", "own", "component"))
    embedding = part.column("embedding").combine_chunks().take(pa.array(first))
    dims = pc.list_value_length(embedding).to_numpy(zero_copy_only=False)
    found = [(np.zeros(0, np.int64),) * 3]
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        rows = rows[np.lexsort((own[rows], group[rows]))]
        unit, copied, of = units(_vectors(embedding.take(pa.array(rows)), int(dim))), copies[rows], group[rows]
        ends = np.searchsorted(of, of, "right")
        # Rows of one set meet those after them; of two parts, rows of the one meet rows of the other.
        across = int((own[rows] == i).sum()) if i != j else 0
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        start, last = 0, across or len(rows)
        while start < last:
            stop = min(last, start + max(1, min(256, 2 * CHUNK // (ends[start] - start))))
            begin, end = across or start, int(ends[stop - 1])
            dot = unit[start:stop] @ unit[begin:end].T
            linked = dot >= cosine + 1e-9
            a, b = np.nonzero(abs(dot - cosine) <= 1e-9)
            linked[a, b] = np.einsum("ij,ij->i", unit[a + start], unit[b + begin]) >= cosine
            linked &= of[start:stop, None] == of[None, begin:end]
            if not across:
                linked &= np.arange(start, stop)[:, None] < np.arange(begin, end)[None]
            links[start:stop] += linked @ copied[begin:end]
            links[begin:end] += copied[start:stop] @ linked
            a, b = np.nonzero(linked)
            for s in range(0, len(a), PAIRS):
                merge(root, a[s : s + PAIRS] + start, b[s : s + PAIRS] + begin)
            start = stop
        some = np.flatnonzero(links)
        found.append((node[rows[some]], links[some], node[rows[root[some]]]))
    nodes, links, roots = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table({"node": nodes, "links": links, "root": roots})


def valid(embedding: str = "embedding") -> Column:
    """Not null, without null or non-finite components, not zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, label, n_links, component_id, kept: one row per row of (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, they are as long as each other and their
    cosine in double precision is at least ``cosine``. n_links counts the other rows linked directly,
    copies included; component_id is the smallest vec_id that links reach, the row's own included;
    kept says that it is the row's own. Null, zero and non-finite vectors link with nothing. Rows that
    repeat a vec_id count each; a null vec_id never names a component that has another. An empty
    table gives an empty result; other columns are not read. ``vectors`` is read several times.
    """
    # Hashes and group keys take -0.0 as 0.0.
    node, label_code = F.xxhash64("label", "embedding"), F.xxhash64("label", F.size("embedding"))
    rows = vectors.select("vec_id", "label", "embedding")
    usable = F.col("label").isNotNull() & valid()
    named = rows.select("vec_id", "embedding", node.alias("node"), label_code.alias("label_code"), usable.alias("usable")).filter("usable")
    keyed = staged(rows.select("vec_id", "label", F.when(usable, node).alias("_node"), F.when(usable, label_code).alias("label_code"), F.size("embedding").alias("dim")))
    nodes = staged(keyed.filter(F.col("_node").isNotNull()).groupBy(F.col("_node").alias("node"), "label_code", "dim").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id")))
    sizes = nodes.groupBy("label_code").agg(F.count(F.lit(1)).alias("n"), F.min("dim").alias("dim"))
    large = {r.label_code: r.n for r in sizes.filter(F.col("n") * F.col("dim") > CELL).collect()}
    dealt = _dealt(named.select("node", "label_code", "embedding"), cosine, _plans(named, large, cosine), -(-nodes.count() // PACK) or 1)
    reached = staged(components(staged(dealt.groupBy("key", "block").applyInArrow(lambda t: candidates(t, cosine), "node long, root long")), "node", "root"))
    # A set of candidates with more coordinates than a part is cut by the hash of the node; small ones are packed.
    packs = -(-reached.count() // PACK) or 1
    sets = reached.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.ceil(F.col("n") * F.col("dim") / PART).cast("int").alias("cuts")
    drawn = measured(reached.join(sets, "component").join(nodes, "node").select("node", "component", "copies", F.col("first_id").alias("_first"), cuts), 40)
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("cuts")).cast("int")
    met = (
        named.join(drawn, "node").filter(F.col("vec_id").eqNullSafe(F.col("_first"))).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
        .withColumn("pack", F.when(F.col("cuts") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(packs))))
        .select("pack", "i", "j", "own", "component", "node", "copies", "embedding")
    )
    found = staged(met.groupBy("pack", "i", "j").applyInArrow(lambda t: compare(t, cosine), "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = staged(components(found, "node", "root"))
    linked = nodes.join(parts, "node")
    smallest = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_linked = linked.join(smallest, "component").join(links, "node").select("node", "component_id", "links")
    of_node = nodes.join(of_linked, "node", "left").select(
        "node", F.when(F.col("links").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.join(of_node, F.col("_node") == F.col("node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
