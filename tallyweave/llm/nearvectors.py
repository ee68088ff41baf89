"""Near duplicates among vectors of one label, by cosine, through products of int8 tiles.

A vector u of length 1 is s * q + e, where q has whole numbers from -127 to 127 and e is what rounding left. With |e| known
exactly, the cosine of two vectors differs from s * s' * (q . q') by |e| + |e'| + |e| * |e'| at most. Tiles of some thousand
vectors are multiplied in int8; a pair whose bound stays below the threshold is out, one whose bound stays above it is in, and
only those between are computed again in double precision.

Equal vectors are one class first. The classes of a label are dealt to tiles, and each two tiles of a label are a row that
Spark may send to any task: what a task holds is two tiles, whatever the label's size. A task gives out sums of links by vector
and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.shared import components, passing, written

#: Cosine from which two vectors link.
THRESHOLD = 0.93
#: Vectors in a tile on average, and the bytes of a tile's vectors that they may not exceed.
TILE, TILE_BYTES = 2048, 4 << 20
#: Products computed at once.
STRIP = 512
#: Over 1024 products of int8 the sum might leave the whole numbers that float32 has.
EXACT = 1024
#: Rounding errors of double precision are far below this.
SLACK = 1e-9

_TILE_TYPE = "label string, dim int, tile int, tiles int, ids binary, times binary, q binary, s binary, e binary, u binary"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; no overflow or underflow whatever the scale."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 q, scale s and the length of what rounding left, of rows of length 1."""
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    left = u - q * s[:, None]
    return q.astype(np.int8), s, np.sqrt(np.einsum("ij,ij->i", left, left)) + SLACK


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q . r of int8 rows, exact: sums of at most EXACT products are whole in float32."""
    if q.shape[1] <= EXACT:
        return q.astype(np.float32) @ r.astype(np.float32).T
    return sum((q[:, k : k + EXACT].astype(np.float32) @ r[:, k : k + EXACT].astype(np.float32).T).astype(np.float64) for k in range(0, q.shape[1], EXACT))


def linked(a: tuple, b: tuple, threshold: float) -> np.ndarray:
    """Which rows of a link with which of b; both are (q, s, e, u)."""
    (q, s, e, u), (r, t, f, v) = a, b
    about = products(q, r) * s[:, None] * t[None, :]
    error = e[:, None] + f[None, :] + e[:, None] * f[None, :] + SLACK
    out = about - error >= threshold
    i, j = np.nonzero(~out & (about + error >= threshold))
    for k in range(0, len(i), 1 << 16):
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[x, y] = np.einsum("ij,ij->i", u[x], v[y]) >= threshold
    return out


def _tiles(key: tuple, table: pa.Table) -> pa.Table:
    """One row for the classes of a tile."""
    label, dim, tile = (x.as_py() for x in key)
    vectors = np.stack([np.asarray(x, np.float64) for x in table["vector"].to_pylist()])
    u = unit(vectors)
    q, s, e = quantised(u)
    ids, times = (table[c].to_numpy().astype(np.int64) for c in ("id", "times"))
    row = [label, dim, tile, table["tiles"][0].as_py()] + [x.tobytes() for x in (ids, times, q, s, e, u)]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32()] + [pa.binary()] * 6
    return pa.table([pa.array([x], t) for x, t in zip(row, types, strict=True)], names="label dim tile tiles ids times q s e u".split())


def _forest(roots: dict[int, int], a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Those of the edges that join two parts of the forest."""

    def root(x: int) -> int:
        while (up := roots.setdefault(x, x)) != x:
            roots[x] = x = roots.setdefault(up, up)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            roots[max(x, y)] = min(x, y)
            yield x, y


def _compared(threshold: float):
    """For rows of two tiles: (id, links, other), the sums of links within the two, and edges of a forest (links 0)."""

    def read(row: dict, at: str, dim: int) -> tuple:
        ids, times = (np.frombuffer(row[f"{c}{at}"], np.int64) for c in ("ids", "times"))
        shape = (len(ids), dim)
        return ids, times, np.frombuffer(row[f"q{at}"], np.int8).reshape(shape), np.frombuffer(row[f"s{at}"]), np.frombuffer(row[f"e{at}"]), np.frombuffer(row[f"u{at}"]).reshape(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                a, b, own = read(row, "", row["dim"]), read(row, "2", row["dim"]), row["tile"] == row["tile2"]
                links, back, roots, edges = np.zeros(len(a[0]), np.int64), np.zeros(len(b[0]), np.int64), {}, []
                for start in range(0, len(a[0]), STRIP):
                    strip = slice(start, start + STRIP)
                    hit = linked(tuple(x[strip] for x in a[2:]), b[2:], threshold)
                    if own:  # each two of a tile are compared twice, and the same both times
                        at = np.arange(start, start + len(hit))
                        hit[np.arange(len(hit)), at] = False
                    links[strip] += hit @ b[1]
                    if not own:
                        back += a[1][strip] @ hit
                    i, j = np.nonzero(hit)
                    edges += _forest(roots, a[0][strip][i], b[0][j])
                found = [(a[0], links)] + ([] if own else [(b[0], back)])
                ids = np.concatenate([x[n > 0] for x, n in found] + [np.array([x for x, _ in edges], np.int64)])
                counts = np.concatenate([n[n > 0] for _, n in found] + [np.zeros(len(edges), np.int64)])
                others = pa.array([None] * (len(ids) - len(edges)) + [y for _, y in edges], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), others], ["id", "links", "other"])

    return run


def _classes(rows: DataFrame) -> DataFrame:
    """(label, vector, times, id) of rows (label, vector): equal vectors of a label are one class."""
    return rows.groupBy("label", "vector").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id())


def _tiled(classes: DataFrame, size: int) -> DataFrame:
    """Tiles of about `size` classes, fewer if the vectors are long; one row each."""
    classes = classes.withColumn("dim", F.size("vector"))
    counts = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    fit = F.greatest(F.lit(1), F.least(F.lit(size), F.floor(TILE_BYTES / (F.col("dim") * 9))))
    rows = classes.join(counts, ["label", "dim"]).withColumn("tiles", F.ceil(F.col("n") / fit).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    return rows.groupBy("label", "dim", "tile").applyInArrow(_tiles, _TILE_TYPE)


def near_links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: the other rows that its vector links with directly, the smallest
    vec_id that links reach, and whether that is its own.

    Rows link if their labels are equal and their cosine, in double precision, is threshold or more. A vector that is null, empty or
    zero, or has null or non-finite components, links with nothing, and neither does a row without label, nor vectors of two
    lengths. Every row counts, also repeated ones: equal vectors link with each other. Ids may be of any type that sorts, and may
    repeat; a row without id links like others, but names no component unless all of its component have none; its kept is false.
    No rows give none. Other columns aren't read, whatever their names. Vectors may have any length; a tile holds fewer long ones.
    """
    given = vectors.select(F.col(f"`{id_column}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), F.col(f"`{label}`").cast("string").alias("label"))
    good = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull(), F.lit(False))
    with passing(vectors.sparkSession) as keep:
        classes = keep(written(_classes(given.where(good).select("label", "vector"))))
        tiles = written(_tiled(classes, tile))
        names = ["ids", "times", "q", "s", "e", "u"]
        # a row for each two tiles of a label: each tile goes to its partners
        first = tiles.withColumn("tile2", F.explode(F.sequence("tile", F.col("tiles") - 1))).drop("tiles")
        second = tiles.select("label", "dim", F.col("tile").alias("tile2"), F.explode(F.sequence(F.lit(0), "tile")).alias("tile"), *(F.col(c).alias(f"{c}2") for c in names))
        found = written(first.join(second, ["label", "dim", "tile", "tile2"]).mapInArrow(_compared(threshold), "id long, links long, other long"))
        links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
        groups = keep(written(components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))))
        of_class = classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
        of_class = of_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
        of_class = written(of_class)
        rows = written(given.withColumn("vector", F.when(good, F.col("vector"))).join(of_class, ["label", "vector"], "left").select("vec_id", "n_links", "component"))
        least = keep(written(rows.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))))
        rows = keep(rows)
    out = rows.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
