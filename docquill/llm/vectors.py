"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, no pair at the threshold lost.

1. Equal vectors of a label collapse to one representative with a multiplicity.
2. A label of more than ``CELL`` vectors splits into cells, twice as many for twice as many vectors. Spherical
   k-means on a bounded sample of all labels gives the centroids of each number of cells. A vector's home is the
   nearest one. Let two unit vectors x and y reach the threshold t, so |x - y| <= r = sqrt(2 - 2t), and let c be
   y's home, h that of x. As y is nearer to c than to h, x . (h - c) <= r |h - c|; the same holds the other way
   round. So each x also visits those cells c < h for which that holds, and of every pair the one with the larger
   home meets the other in its home. This is exact, however poor the centroids are.
3. Homes and visitors of a cell split into blocks of about ``TILE`` vectors; two blocks are a tile, one product in
   bounded memory. A hot cell only has more tiles. A tile returns a count for each vector and, instead of pairs,
   the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquill.llm.common import bounded_batches, connected_components, result, saved, shared_dir

SAMPLE_ROWS, CELL, MOST_CELLS, ROUNDS, TILE, SALTS, BROADCAST_LABELS = 20_000, 4_000, 4_096, 8, 2_500, 8, 200_000


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def cells_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home of each row, whether it visits each cell)."""
    dots = x @ centres.T
    home = dots.argmax(1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    lead = dots[np.arange(len(x)), home][:, None] - dots
    near = lead <= np.sqrt(2 - 2 * threshold) * apart[home] + 1e-9
    return home, near & (np.arange(len(centres)) < home[:, None])


def _unit(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision; scaled first, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assigner(centres: dict[tuple[int, int], np.ndarray], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, many = np.array(batch["dim"]), np.array(batch["cells"])
            home, visits = np.zeros(len(batch), np.int32), [np.empty(0, np.int32)] * len(batch)
            for dim, k in {*zip(dims.tolist(), many.tolist(), strict=True)}:
                own = np.flatnonzero((dims == dim) & (many == k)) if k > 1 else ()
                for low in range(0, len(own), 4096):
                    part = own[low : low + 4096]
                    home[part], near = cells_of(_unit(batch["vec"].take(pa.array(part))), centres[dim, k], threshold)
                    for r, row in zip(part, near, strict=True):
                        visits[r] = np.flatnonzero(row).astype(np.int32)
            sizes = np.fromiter(map(len, visits), np.int64, len(visits))
            flat = pa.array(np.concatenate([np.empty(0, np.int32), *visits]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.record_batch([*(batch[c] for c in ("label", "dim", "rep", "m", "vec")), pa.array(home), pa.ListArray.from_arrays(offsets, flat)], names=["label", "dim", "rep", "m", "vec", "home", "visits"])

    return run


def _forest(a: np.ndarray, b: np.ndarray, link: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the parts of a link matrix: first partners, then first partners in other parts until none is left."""
    parent = np.arange(len(a) + len(b))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    edges, open_links = [], link
    while open_links.any():
        i, j = np.flatnonzero(open_links.any(1)), np.flatnonzero(open_links.any(0))
        first = [*zip(i, open_links[i].argmax(1), strict=True), *zip(open_links[:, j].argmax(0), j, strict=True)]
        for x, y in first:
            u, v = find(x), find(len(a) + y)
            if u != v:
                parent[max(u, v)] = min(u, v)
                edges.append((int(a[x]), int(b[y])))
        part = np.array([find(x) for x in range(len(parent))])
        open_links = link & (part[: len(a), None] != part[None, len(a) :])
    return edges


def _tile(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, alone = np.array(table["side"]), table["i"][0].as_py() == table["j"][0].as_py()
        left, right = table.filter(pa.array(side)), table.filter(pa.array(~side))
        if not len(left) or not (alone or len(right)):
            return pa.table({"rep": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "peer": pa.array([], pa.int64())})
        a, m, x = np.array(left["rep"]), np.array(left["m"]), _unit(left["vec"].combine_chunks())
        if alone:  # a block with itself
            b, link = a, x @ x.T >= threshold
            link |= link.T
            np.fill_diagonal(link, False)
            counted = [(a, link @ m)]
        else:
            b = np.array(right["rep"])
            link = x @ _unit(right["vec"].combine_chunks()).T >= threshold
            counted = [(a, link @ np.array(right["m"])), (b, m @ link)]
        edges = _forest(a, b, link)
        rep, n = (np.concatenate(c) for c in zip(*((r[k > 0], k[k > 0]) for r, k in counted), strict=True))
        u, v = zip(*edges, strict=True) if edges else ((), ())
        return pa.table({"rep": pa.array([*rep, *u], pa.int64()), "n": pa.array([*n, *[0] * len(u)], pa.int64()), "peer": pa.array([*[None] * len(rep), *v], pa.int64())})

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, sample_rows: int = SAMPLE_ROWS, cell: int = CELL,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Links join vectors of equal, non-null label and equal length with a cosine of at least threshold, in
    double precision. component_id is the smallest id reachable over links, kept marks it. Vectors that
    are null, zero, empty or hold a null or non-finite component link with nothing. Rows that repeat an id
    or a vector are vectors of their own, linked with each other; a row without an id links with nothing,
    its component_id is null and it is kept. Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    work = shared_dir(spark)
    kind = "float" if dict(vectors.dtypes)[vec_col] == "array<float>" else "double"  # floats move as floats
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))  # one zero
    rows = rows.select("id", "label", F.when(usable, F.col("vec")).alias("vec"))
    keyed = rows.select("id", "label", "vec", F.xxhash64("label", "vec").alias("h1"), F.xxhash64(F.lit("second"), "vec", "label").alias("h2"))
    good = keyed.where("vec is not null")
    reps = good.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    reps = saved(reps.withColumn("dim", F.size("vec")), f"{work}/reps")
    # only labels beyond one cell are listed, at most one for each CELL vectors
    cells = F.least(F.lit(MOST_CELLS), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / cell))).cast("int"))
    large = saved(reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).select("label", "dim", cells.alias("cells")), f"{work}/large")
    centres = {}
    for dim in [r.dim for r in large.select("dim").distinct().orderBy("dim").collect()]:  # the lengths that vectors have
        sample = reps.where(F.col("dim") == dim).select("vec", F.xxhash64("rep").alias("o"), "rep").orderBy("o", "rep").limit(sample_rows).toArrow()
        x = _unit(sample["vec"].combine_chunks())
        for k in [r.cells for r in large.where(F.col("dim") == dim).select("cells").distinct().orderBy("cells").collect()]:  # powers of 2
            centres[dim, k] = spherical_kmeans(x, min(k, len(x)))
    many = large.count()
    placed = reps.select("label", "dim", "rep", "m", "vec").join(F.broadcast(large) if many <= BROADCAST_LABELS else large, ["label", "dim"], "left")
    placed = placed.select("label", "dim", "rep", "m", "vec", F.coalesce("cells", F.lit(1)).alias("cells"))
    placed = saved(placed.mapInArrow(_assigner(centres, threshold), f"label string, dim int, rep bigint, m bigint, vec array<{kind}>, home int, visits array<int>"), f"{work}/placed")
    # blocks of each cell: those of its homes and those of its visitors
    key = ["label", "dim", "cell"]
    both = placed.select("label", "dim", F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(True).alias("at_home"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("at_home"))))).alias("p"), "rep", "m", "vec")
    both = both.select("label", "dim", "p.cell", "p.at_home", "rep", "m", "vec")
    counts = both.groupBy(*key).agg(F.sum(F.col("at_home").cast("int")).alias("homes"), F.sum((~F.col("at_home")).cast("int")).alias("guests"))
    blocks = saved(counts.where("homes > 0").select(*key, F.ceil(F.col("homes") / tile).cast("int").alias("homes"), F.ceil(F.col("guests") / tile).cast("int").alias("guests")), f"{work}/blocks")
    # a row per cell: few are sent to every task, more are joined by shuffle, where AQE parts a hot cell
    both = both.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_LABELS else blocks, key)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("at_home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    others = F.sequence(F.lit(0), F.col("homes") - 1)
    at_home = F.transform(others, lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), (own <= j).alias("side")))  # block pairs i <= j
    met = F.transform(F.when(F.col("guests") > 0, F.sequence(F.lit(0), F.col("guests") - 1)).otherwise(F.array().cast("array<int>")), lambda g: F.struct(own.alias("i"), (F.col("homes") + g).alias("j"), F.lit(True).alias("side")))
    guest = F.transform(others, lambda i: F.struct(i.alias("i"), (F.col("homes") + own).alias("j"), F.lit(False).alias("side")))
    tiles = both.select(*key, F.explode(F.when(F.col("at_home"), F.concat(at_home, met)).otherwise(guest)).alias("t"), "rep", "m", "vec").select(*key, "t.*", "rep", "m", "vec")
    found = saved(tiles.groupBy(*key, "i", "j").applyInArrow(_tile(threshold), "rep bigint, n bigint, peer bigint"), f"{work}/found")
    links = found.groupBy("rep").agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("peer is not null").select(F.col("rep").alias("u"), F.col("peer").alias("v")), work)
    by_rep = reps.select("h1", "h2", "rep", "m").join(links, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    by_rep = by_rep.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"), salts.alias("salt"))
    out = keyed.select("id", F.col("vec").isNotNull().alias("good"), "h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    out = out.join(by_rep, ["h1", "h2", "salt"], "left")
    part = F.when(F.col("good"), F.col("component")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("bigint").alias("n_links"), part.alias("component_id"))
    return result(out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))), work)
