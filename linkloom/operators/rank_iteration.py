"""Weighted PageRank as an iterative Spark job: both directions, any number of weightings at once.

With uniform teleport and the rank of dead ends spread evenly, both terms add one equal amount to every page. The
rank vector is therefore the solution of ``x = 1 + d * A'x`` (A: row-stochastic link shares, dead ends
empty) divided by its own sum, and a step needs no global number.

Layout. Pages are numbered and dealt over segments. Links are laid out as a grid of tiles (direction, segment of the source,
group of target segments) and stay there; a row holds ``links_per_row`` of them as arrays of positions and shares, so a hub is
many rows. Forward and reverse rank are two directions of the grid, and a row holds its weights under every weighting
(scenario), so all of them advance in one pass over the links. A segment's values are turned into what the page passes on for a weight of
one, and sent to its tiles once, ahead of the links; a step adds up weights times values there and sums the tiles' results by
segment. What moves is values a tile, so it grows with the pages, not the links. Vectors are rows of bounded length, pieces of a segment.

Convergence. A round starts with the exact residual of the present vector, in double precision. The steps after it
move changes only, in single precision, which is enough for them: the next round begins with an exact residual again. The change of least
residual in the space of a round's changes (GMRES) gives the next start; the changes meet piece by piece, and only their Gram
matrix, a few sums a piece, reaches the driver. There is one reliable checkpoint a round; a lost executor costs the steps since then.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.ordering import dense_index
from linkloom.storage import cut_lineage, package_on_workers, sql_settings

# Ranks are rounded to this many decimals of the average rank, so pages that are equal by
# symmetry get equal ranks whatever the summation order was.
RELATIVE_DECIMALS = 8
FORWARD, REVERSE = 0, 1
#: Rounding error of a Gram matrix with ones on its diagonal.
GRAM_ERROR = 1e-12
#: Rounding error of changes, of which the first of a round is the largest.
CHANGE_ERROR = 1e-7
#: Extrapolation weights that add up to more, signs aside, would magnify rounding errors.
LARGEST_WEIGHTS = 1e3
#: Values in one segment, and in one tile's sums, at most.
SEGMENT_VALUES, TILE_VALUES = 8_000_000, 12_000_000
#: Values in one row of a vector. Longer rows take several times their size of an executor's heap.
PIECE_VALUES = 125_000
#: Values sent in single precision may be scaled by factors from this one to its inverse.
LEAST_RATE = 1e-12
#: Page numbers may leave this many gaps a page or link before pages are numbered anew.
GAPS = 4

#: As types, not dtypes: a dtype that was sent to a worker is a copy, for which NumPy's fast loops (``add.at``) are not used.
EXACT, CHANGE = np.float64, np.float32
VALUES = "key int, segment int, place int, values binary"


@dataclass(frozen=True)
class RankOptions:
    damping: float = 0.85
    tolerance: float = 1e-10
    max_iterations: int = 200
    steps_per_check: int = 8
    links_per_partition: int = 100_000
    links_per_row: int = 200_000


@dataclass(frozen=True)
class Grid:
    """Pages 0, 1, ... ``numbers - 1`` (the last one stands for null) dealt over ``segments``, the targets over ``groups`` of segments."""

    numbers: int
    segments: int
    groups: int
    count: int
    keys: tuple[int, ...]  # one per tile, each of which Spark hashes into a partition of its own
    piece: int = PIECE_VALUES

    @property
    def length(self) -> int:
        return -(-self.numbers // self.segments)

    @property
    def per_group(self) -> int:
        return self.segments // self.groups

    def tile(self, direction, source, target):
        return (direction * self.segments + source % self.segments) * self.groups + target % self.segments % self.groups

    def place(self, target):
        """Position in a tile's sums."""
        return target % self.segments // self.groups * self.length + target // self.segments

    def targets(self, tile: int) -> list[int]:
        """Segments of a tile's sums, in their order."""
        direction, group = tile // (self.segments * self.groups), tile % self.groups
        return [direction * self.segments + group + self.groups * k for k in range(self.per_group)]

    def key(self, segment: int) -> int:
        return self.keys[segment * self.groups]

    def opposite(self, segment: int) -> int:
        return (segment + self.segments) % (2 * self.segments)

    @property
    def pieces(self) -> int:
        return -(-self.length // self.piece)

    @property
    def places(self) -> int:
        """Pieces of a segment under every weighting; those of one piece follow each other."""
        return self.count * self.pieces

    def at(self, place: int) -> tuple[int, slice]:
        """The weighting of a place, and where its values are in the segment."""
        piece, k = divmod(place, self.count)
        return k, slice(piece * self.piece, min(self.length, (piece + 1) * self.piece))


def _names(prefix: str, count: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(count)]


def _keys(spark: SparkSession, partitions: int) -> tuple[int, ...]:
    """A whole number for each partition that Spark's hash puts there, so that tiles don't share partitions."""
    number = F.col("id").cast("int")
    found = spark.range(64 * partitions).groupBy(F.pmod(F.hash(number), F.lit(partitions)).alias("p")).agg(F.min(number).alias("key"))
    by_partition = {row["p"]: row["key"] for row in found.collect()}
    return tuple(by_partition.get(p, -1 - p) for p in range(partitions))


def make_grid(spark: SparkSession, numbers: int, link_count: int, count: int, options: RankOptions) -> Grid:
    """At most as many tiles as cores, or as ``links_per_partition`` links each allow; more if their vectors would be too long.

    A step moves ``segments + groups`` values a page, so a second, half empty round of tasks would save no time and move more.
    """
    wanted = min(spark.sparkContext.defaultParallelism, math.ceil(2 * link_count / options.links_per_partition))
    groups = max(1, math.floor(math.sqrt(wanted / 2)), math.ceil(numbers * count / TILE_VALUES))
    segments = groups * max(1, math.floor(wanted / 2 / groups**2), math.ceil(numbers * count / SEGMENT_VALUES / groups))
    return Grid(numbers, segments, groups, count, _keys(spark, 2 * segments * groups), PIECE_VALUES)


def _array(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _blob(values: np.ndarray) -> pa.Array:
    """One binary value; contiguous numbers aren't copied."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, values.nbytes], np.int32)), pa.py_buffer(values)])


def _row(names: list[str], numbers: list[int], blobs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array([n], pa.int32()) for n in numbers], *map(_blob, blobs)], names=names)


def _value_row(grid: Grid, segment: int, place: int, values: np.ndarray) -> pa.RecordBatch:
    return _row(["key", "segment", "place", "values"], [grid.key(segment), segment, place], [values])


def _by_key(rows: DataFrame, grid: Grid) -> DataFrame:
    return rows.repartition(len(grid.keys), "key")


def numbered(nodes: DataFrame, links: DataFrame, link_count: int, node_count: int) -> tuple[DataFrame, int, Callable[[DataFrame], DataFrame]]:
    """Links with ``u, v`` as page numbers from 0, how many numbers there are, and what turns a ``number`` back into ``page_id``.

    Ids that are nearly dense are shifted; others are numbered in their order. The last number stands for null.
    """
    ends = [F.col("source").cast("long"), F.col("target").cast("long")]
    low, high = links.agg(F.min(F.least(*ends)), F.max(F.greatest(*ends))).first()
    if low is None:  # null at both ends
        low, high = 0, 0
    if high - low <= GAPS * (link_count + node_count):
        last = high - low + 1
        shifted = [F.coalesce(end - F.lit(low), F.lit(last)).alias(name) for end, name in zip(ends, "uv", strict=True)]
        page = F.when(F.col("number") < last, F.col("number") + F.lit(low)).alias("page_id")
        return links.select("*", *shifted), last + 1, lambda rows: rows.withColumn("page_id", page)
    pages = links.select(F.explode(F.array(*ends)).alias("page_id")).where("page_id is not null").distinct()
    pages = cut_lineage(dense_index(pages, [F.col("page_id")], "number", start=0))
    last = pages.count()
    joined = links
    for end, name in zip(ends, "uv", strict=True):
        joined = joined.join(pages.select(F.col("page_id").alias("_id"), F.col("number").alias(name)), F.col("_id") == end, "left").drop("_id")
        joined = joined.withColumn(name, F.coalesce(name, F.lit(last)))
    return joined, last + 1, lambda rows: rows.join(pages, "number", "left")


def _gaps(places: np.ndarray) -> np.ndarray:
    """Rising places as the first one, in four bytes, and the steps to the others, in as few bytes each as the widest needs."""
    steps = np.diff(places)
    narrow = np.min_scalar_type(steps.max()) if len(steps) else np.dtype(np.uint8)
    return np.concatenate([places[:1].astype(np.int32).view(np.uint8), steps.astype(narrow).view(np.uint8)])


def _places(gaps: pa.Scalar, count: int) -> np.ndarray:
    """The ``count`` places of ``_gaps``."""
    held = _array(gaps, np.dtype(np.uint8))
    places = np.empty(count, np.int64)
    places[0] = held[:4].view(np.int32)[0]
    if count > 1:
        places[1:] = np.frombuffer(held[4:], f"u{(len(held) - 4) // (count - 1)}")
    return np.cumsum(places, out=places)


def _narrowed(weights: np.ndarray) -> np.ndarray:
    """In single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        narrow = weights.astype(CHANGE)
    return narrow if np.array_equal(narrow, weights, equal_nan=True) else weights


def _numbers(value: pa.Scalar, length: int) -> np.ndarray:
    """Numbers of either precision, as the size tells."""
    held = value.as_buffer()
    return np.frombuffer(held, EXACT if held.size == length * 8 else CHANGE)


LINKS = ["key", "tile", "source", "target", "w"]
LINK_ROWS = "key int, tile int, source binary, target binary, w binary"


def link_tiles(links: DataFrame, grid: Grid, options: RankOptions) -> DataFrame:
    """(key, tile, source, target, w): rows of many links of a tile, both ways, by target; w holds the weights, one weighting after another.

    A task holds ``links_per_row`` links a direction and a row more; then the fullest tile makes a row.
    """
    names = _names("w", grid.count)

    def pack(batches):
        held: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}

        def row(tile: int) -> pa.RecordBatch:
            source, target, weights = (np.concatenate(parts, axis=-1) for parts in zip(*held.pop(tile), strict=True))
            del sizes[tile]
            order = np.argsort(target, kind="stable")
            return _row(LINKS, [grid.keys[tile], tile], [source[order], _gaps(target[order]), _narrowed(weights[:, order])])

        for batch in batches:
            ends = [batch.column(name).to_numpy() for name in ("u", "v")]
            weights = np.stack([batch.column(name).to_numpy() for name in names])
            for direction in (FORWARD, REVERSE):
                source, target = ends[direction], ends[1 - direction]
                tiles = grid.tile(direction, source, target)
                order = np.argsort(tiles, kind="stable")
                present, starts = np.unique(tiles[order], return_index=True)
                for tile, part in zip(present.tolist(), np.split(order, starts[1:]), strict=True):
                    packed = (source[part] // grid.segments).astype(np.int32), grid.place(target[part]).astype(np.int32), weights[:, part]
                    held.setdefault(tile, []).append(packed)
                    sizes[tile] = sizes.get(tile, 0) + len(part)
            while sizes and (max(sizes.values()) >= options.links_per_row or sum(sizes.values()) >= 4 * options.links_per_row):
                yield row(max(sizes, key=sizes.get))
        for tile in list(held):
            yield row(tile)

    few = links.coalesce(2 * links.sparkSession.sparkContext.defaultParallelism)  # so that a task fills rows
    return few.select("u", "v", *names).mapInArrow(pack, LINK_ROWS)


def _headed(tiles: DataFrame, grid: Grid) -> DataFrame:
    """``tiles`` by key, behind one row without links a tile, to which the values are joined (their place is in ``target`` then).

    Both are laid out by key, so Spark puts their partitions together one by one, in this order; ``_tile_sums`` fails if the values come late.
    """
    nothing = F.lit(b"").alias("_")
    keys = F.array(*[F.lit(key) for key in grid.keys])
    heads = tiles.sparkSession.range(len(grid.keys)).select(F.col("id").cast("int").alias("tile"), nothing)
    heads = heads.select(F.element_at(keys, F.col("tile") + 1).alias("key"), "tile", *[F.col("_").alias(name) for name in LINKS[2:]])
    return _by_key(heads, grid).unionByName(_by_key(tiles, grid))


def _tile_sums(rows: DataFrame, grid: Grid, out: type, share: type = EXACT, valued: bool = True) -> DataFrame:
    """Per tile and segment of its targets: the links' weights, times the value at their source (as numbers of type ``share``), summed.

    A tile's values come with its first row. Not ``valued``: the weights alone.
    """

    def multiply(batches):
        sums: dict[int, np.ndarray] = {}
        held: dict[int, np.ndarray] = {}
        come: dict[int, int] = {}
        for row in _rows(batches):
            tile, count = row["tile"].as_py(), row["source"].as_buffer().size // 4
            if tile not in sums:
                sums[tile] = np.zeros((grid.count, grid.per_group * grid.length))
            if row["values"].is_valid:
                k, part = grid.at(int(row["target"].as_py()))
                values = _numbers(row["values"], part.stop - part.start)
                if tile not in held:
                    held[tile] = np.zeros((grid.count, grid.length), values.dtype)
                held[tile] = held[tile].astype(np.result_type(held[tile], values), copy=False)
                held[tile][k, part] = values
                come[tile] = come.get(tile, 0) + 1
            if not count:
                continue
            if valued and come.get(tile) != grid.places:
                raise RuntimeError(f"links of tile {tile} came before their values")
            source, target = _array(row["source"], np.int32), _places(row["target"], count)
            for k, weights in enumerate(_numbers(row["w"], grid.count * count).reshape(grid.count, count)):
                if valued:
                    weights = weights.astype(share, copy=False) if weights.dtype == CHANGE else weights
                    weights = weights * held[tile][k].take(source)
                np.add.at(sums[tile][k], target, weights.astype(EXACT, copy=False))
        held.clear()
        for tile in list(sums):
            of_tile = sums.pop(tile).reshape(grid.count, grid.per_group, grid.length)
            for number, segment in enumerate(grid.targets(tile)):
                for place in range(grid.places):
                    k, part = grid.at(place)
                    yield _value_row(grid, segment, place, of_tile[k, number, part].astype(out))

    return rows.mapInArrow(multiply, VALUES)


def _segment_sums(parts: DataFrame, grid: Grid, out: type, rates: DataFrame | None = None, plus: float = 0.0) -> DataFrame:
    """One row a segment and place: the sum of its rows, and with ``rates`` (by key) in ``scaled`` what the pages pass on of it (and of ``plus``).

    Rates and parts are both laid out by key, so a segment's meet in one task without being moved.
    """
    kept = [F.lit(False).alias("is_rate"), *(F.col(name) for name in ("segment", "place", "values"))]
    rows, rated = _by_key(parts, grid).select("key", *kept), rates is not None
    if rated:
        rows = rates.select("key", F.lit(True).alias("is_rate"), *kept[1:]).unionByName(rows)

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        held: dict[tuple[int, int], np.ndarray] = {}
        for row in _rows(batches):
            here = row["segment"].as_py(), row["place"].as_py()
            _, part = grid.at(here[1])
            values = _numbers(row["values"], part.stop - part.start)
            if row["is_rate"].as_py():
                held[here] = values
            elif here in sums:
                sums[here] += values
            else:
                sums[here] = values.astype(EXACT)
        for here in sorted(sums):
            of_place, (segment, place) = sums.pop(here), here
            if not rated:
                yield _value_row(grid, segment, place, of_place.astype(out, copy=False))
                continue
            if here not in held:
                raise RuntimeError(f"the rates of segment {segment} are not where its values are")
            blobs = [of_place.astype(out), _scaled(of_place, held.pop(here), plus, out)]
            yield _row(["key", "segment", "place", "values", "scaled"], [grid.key(segment), segment, place], blobs)

    return rows.mapInArrow(add, VALUES + ", scaled binary" if rated else VALUES)


def _scaled(values: np.ndarray, rate: np.ndarray, plus: float, kind: type) -> np.ndarray:
    """Values (and ``plus``) times rates; in double precision where rates would take them out of the range of ``kind``."""
    if kind == CHANGE:
        sizes = rate[rate > 0]
        kind = kind if not len(sizes) or LEAST_RATE <= sizes.min() and sizes.max() <= 1 / LEAST_RATE else EXACT
    values += plus
    values *= rate
    return values.astype(kind, copy=False)


def _changed(vectors: DataFrame, grid: Grid, change: Callable[[np.ndarray], np.ndarray], turned: bool = False) -> DataFrame:
    """``change`` of values in double precision; ``turned`` gives them to the same pages in the other direction."""

    def each(batches):
        for row in _rows(batches):
            segment, place, values = row["segment"].as_py(), row["place"].as_py(), _array(row["values"], EXACT)
            if turned:
                values = _without_null(values, grid, segment, place)
            yield _value_row(grid, grid.opposite(segment) if turned else segment, place, change(values))

    return vectors.mapInArrow(each, VALUES)


def _without_null(values: np.ndarray, grid: Grid, segment: int, place: int) -> np.ndarray:
    """Nothing for the page that stands for null."""
    last = grid.numbers - 1
    _, part = grid.at(place)
    if segment % grid.segments == last % grid.segments and part.start <= last // grid.segments < part.stop:
        values = values.copy()
        values[last // grid.segments - part.start] = 0.0
    return values


def _at_tiles(tiles: DataFrame, vectors: DataFrame, grid: Grid) -> DataFrame:
    """Rows of links, of which those without links have the values of the tile's source segment; links stay where they are."""
    keys = F.slice(F.array(*[F.lit(key) for key in grid.keys]), F.col("segment") * F.lit(grid.groups) + 1, grid.groups)
    sent = vectors.select(F.explode(keys).alias("_to"), F.col("place").cast("string").cast("binary").alias("_place"), "values")
    to_head = (F.col("key") == F.col("_to")) & (F.length("source") == 0)
    place = F.coalesce("_place", "target").alias("target")
    return tiles.join(sent.hint("shuffle_hash"), to_head, "left").select("key", "tile", "source", place, "w", "values")


def page_rates(totals: DataFrame, grid: Grid, damping: float) -> DataFrame:
    """What a page passes on, damped, for a weight of one, by key. A page whose weights add up to nothing is dangling.

    What a page passes on in one direction is what reaches it in the other.
    """

    def rate(total: np.ndarray) -> np.ndarray:
        return np.divide(damping, total, out=np.zeros_like(total), where=total > 0)

    return _by_key(_changed(totals, grid, rate, turned=True), grid)


CHANGES = "key int, segment int, place int, values binary, changes binary"


def _gathered(vector: DataFrame, changes: list[DataFrame], grid: Grid) -> DataFrame:
    """A round's table: pieces of the vector, each with the same piece of every change, one after another."""
    steps, columns = len(changes), ["key", "segment", "place", "values"]
    parts = vector.select(*columns, F.lit(-1).alias("step"))
    for step, change in enumerate(changes):
        parts = parts.unionByName(change.select(*columns, F.lit(step).alias("step")))

    def gather(batches):
        at, blobs = None, []
        for row in _rows(batches):
            here = [row[name].as_py() for name in ("key", "segment", "place")]
            if row["step"].as_py() != len(blobs) - 1 or blobs and here != at:
                raise RuntimeError(f"step {row['step'].as_py()} of {here} is out of its order")
            at = here
            blobs.append(_array(row["values"], CHANGE if blobs else EXACT))
            if len(blobs) == steps + 1:
                yield _row(["key", "segment", "place", "values", "changes"], at, [blobs[0], np.concatenate(blobs[1:])])
                blobs = []

    return _by_key(parts, grid).sortWithinPartitions("segment", "place", "step").mapInArrow(gather, CHANGES)


def _gram(table: DataFrame, grid: Grid, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per direction and weighting: products of a round's changes, the sums of their sizes, the sum of the vector after them."""

    def products(batches):
        for row in _rows(batches):
            changes = _array(row["changes"], CHANGE).reshape(steps, -1).astype(EXACT)
            sums = [*(changes @ changes.T).ravel(), *np.abs(changes).sum(axis=1), _array(row["values"], EXACT).sum() + changes.sum()]
            columns = [pa.array([n], pa.int32()) for n in (row["segment"].as_py() // grid.segments, grid.at(row["place"].as_py())[0])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sums], pa.list_(pa.float64()))], names=["direction", "k", "sums"])

    found = np.zeros((2, grid.count, steps * steps + steps + 1))
    for row in table.mapInArrow(products, "direction int, k int, sums array<double>").collect():  # one a piece
        found[row["direction"], row["k"]] += row["sums"]
    gram, moved, total = np.split(found, [steps * steps, steps * steps + steps], axis=2)
    return gram.reshape(2, grid.count, steps, steps), moved, total[..., 0]


def _coefficients(gram: np.ndarray) -> np.ndarray:
    """Weights of a round's changes in the change to the next start.

    c makes the residual ``d_0 - sum(c_j * (d_j - d_(j+1)))`` smallest; a plain step is added. Columns are scaled to one length first,
    and a nearly singular matrix is shifted by its rounding error instead of cut.
    """
    steps = len(gram)
    plain = np.ones(steps)
    between = np.eye(steps, steps - 1) - np.eye(steps, steps - 1, -1)
    matrix, right = between.T @ gram @ between, between.T @ gram[:, 0]
    size = np.sqrt(np.maximum(np.diag(matrix), 0.0))
    if not (size > 0).all():  # it stands still
        return plain
    scaled = matrix / np.outer(size, size) + GRAM_ERROR * np.eye(steps - 1)
    weights = np.linalg.solve(scaled, right / size) / size
    if not np.isfinite(weights).all() or np.abs(weights).sum() > LARGEST_WEIGHTS:
        return plain
    return np.concatenate([[1.0], weights])


def _moved(table: DataFrame, grid: Grid, steps: int, weights: np.ndarray) -> DataFrame:
    """The vector plus the weighted changes, per direction and weighting."""

    def combine(batches):
        for row in _rows(batches):
            segment, place = row["segment"].as_py(), row["place"].as_py()
            values = _array(row["values"], EXACT).copy()
            for step, change in enumerate(_array(row["changes"], CHANGE).reshape(steps, -1)):
                values += weights[segment // grid.segments, grid.at(place)[0], step] * change.astype(EXACT)
            yield _value_row(grid, segment, place, values)

    return table.mapInArrow(combine, VALUES)


def _round(tiles: DataFrame, rates: DataFrame, vector: DataFrame, grid: Grid, steps: int) -> list[DataFrame]:
    """``steps`` steps: the residual of the vector (x - 1 of the pages), and what becomes of it step by step."""

    def sent(vectors: DataFrame) -> DataFrame:
        return _at_tiles(tiles, vectors.select("segment", "place", F.col("scaled").alias("values")), grid)

    less = _changed(vector.select("key", "segment", "place", "values"), grid, np.negative)
    changes = [_segment_sums(_tile_sums(sent(vector), grid, EXACT).unionByName(less), grid, CHANGE, rates).persist()]
    for _ in range(1, steps):
        changes.append(_segment_sums(_tile_sums(sent(changes[-1]), grid, CHANGE, share=CHANGE), grid, CHANGE, rates).persist())
    return changes


def _iterate(tiles: DataFrame, rates: DataFrame, start: DataFrame, grid: Grid, node_count: int, options: RankOptions) -> tuple[DataFrame, np.ndarray]:
    """The vectors (x - 1), and their sums per direction and weighting."""

    def settled(values: DataFrame) -> DataFrame:
        return cut_lineage(_segment_sums(values, grid, EXACT, rates, plus=1.0))

    done, vector = 0, settled(start)
    steps, before, trusted = max(2, options.steps_per_check), math.inf, True
    while True:
        changes = _round(tiles, rates, vector, grid, steps)
        table = _gathered(vector, changes, grid).persist()
        try:
            gram, moved, totals = _gram(table, grid, steps)
            done += steps
            change = float(((moved[..., -1] + CHANGE_ERROR * moved[..., 0]) / (node_count + totals)).max())
            ended = change < options.tolerance or done >= options.max_iterations
            if ended and change >= options.tolerance > 0:  # a tolerance of 0 asks for a fixed number of steps
                raise RuntimeError(f"ranks still change by {change:.3g} after {done} steps; raise max_iterations or tolerance")
            trusted = trusted and change <= before  # else plain steps, which always converge
            before = change
            plain = np.ones((2, grid.count, steps))
            weights = plain if ended or not trusted else np.array([[_coefficients(g) for g in row] for row in gram])
            vector = settled(_moved(table, grid, steps, weights))
        finally:
            for held in (table, *changes):
                held.unpersist()
        if ended:
            return vector, totals


def rank_graphs(nodes: DataFrame, links: DataFrame, variants: list[str], options: RankOptions = RankOptions()) -> DataFrame:
    """(page_id, forward_<variant>, reverse_<variant>, ...) for every node; each score column sums to 1.

    ``nodes`` has ``page_id``; ``links`` has ``source, target`` and a weight column per variant, ``w0, w1, ...`` in
    their order (null: no such link). Weights of parallel links add up.
    """
    count, node_count = len(variants), nodes.count()
    named = {(FORWARD, k): f"forward_{name}" for k, name in enumerate(variants)} | {(REVERSE, k): f"reverse_{name}" for k, name in enumerate(variants)}
    weights = [F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias(w) for w in _names("w", count)]
    links = links.select("source", "target", *weights).persist()
    held = [links]
    package_on_workers(nodes.sparkSession)
    try:
        link_count = links.count()
        if node_count == 0 or link_count == 0:
            return nodes.select("page_id", *[F.lit(1.0 / max(node_count, 1)).alias(name) for name in named.values()])
        with_numbers, numbers, page_of = numbered(nodes, links, link_count, node_count)
        grid = make_grid(nodes.sparkSession, numbers, link_count, count, options)
        # The layout is fixed by hand here, so the loop neither re-plans nor broadcasts on its own. A row is large.
        settings = {
            "spark.sql.shuffle.partitions": str(len(grid.keys)),
            "spark.sql.adaptive.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.unionOutputPartitioning": "true",
        }
        one_row = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
        with sql_settings(nodes.sparkSession, settings):
            tiles = _headed(link_tiles(with_numbers, grid, options), grid).persist()
            held.append(tiles)
            tiles.count()
            links.unpersist()
            with sql_settings(nodes.sparkSession, one_row):
                nothing = F.lit(None).cast("binary").alias("values")
                totals = _segment_sums(_tile_sums(tiles.select("*", nothing), grid, EXACT, valued=False), grid, EXACT).persist()
                held.append(totals)
                rates = page_rates(totals, grid, options.damping).persist()
                held.append(rates)
                rates.count()
                beyond_one = 1.0 / (1.0 - options.damping) - 1.0
                start = _changed(totals, grid, lambda reached: np.where(reached > 0, beyond_one, 0.0))
                vector, sums = _iterate(tiles, rates, start, grid, node_count, options)
        return _scores(nodes, page_of(page_values(vector, grid)), named, node_count, sums)
    finally:
        for table in held:
            table.unpersist()


def page_values(vector: DataFrame, grid: Grid) -> DataFrame:
    """(number, direction, y0, y1, ...) of the pages that anything reaches."""
    names = _names("y", grid.count)

    def spread(batches):
        held: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for row in _rows(batches):
            k, part = grid.at(row["place"].as_py())
            here = row["segment"].as_py(), part.start
            of_piece = held.setdefault(here, {})
            of_piece[k] = _array(row["values"], EXACT)
            if len(of_piece) < grid.count:
                continue
            direction, segment = divmod(here[0], grid.segments)
            values = np.stack([of_piece[k] for k in range(grid.count)])
            del held[here]
            places = np.flatnonzero(values.any(axis=0))
            columns = [pa.array((part.start + places) * grid.segments + segment), pa.array(np.full(len(places), direction, np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(of_page[places]) for of_page in values]], names=["number", "direction", *names])

    return vector.mapInArrow(spread, "number long, direction int, " + ", ".join(f"{y} double" for y in names))


def _scores(nodes: DataFrame, vector: DataFrame, named: dict[tuple[int, int], str], node_count: int, totals: np.ndarray) -> DataFrame:
    spread = vector.groupBy("page_id").agg(
        *[F.max(F.when(F.col("direction") == d, F.col(f"y{k}"))).alias(name) for (d, k), name in named.items()]
    )

    def score(direction: int, k: int, name: str) -> Column:
        total = float(node_count) + float(totals[direction, k])
        of_average = (F.coalesce(F.col(name), F.lit(0.0)) + F.lit(1.0)) / F.lit(total / node_count)
        return (F.round(of_average, RELATIVE_DECIMALS) / F.lit(float(node_count))).alias(name)

    return nodes.join(spread, "page_id", "left").select("page_id", *[score(d, k, name) for (d, k), name in named.items()])


def weight_columns(weights: Iterable[Column]) -> list[Column]:
    """Sums of weight expressions under the names that ``rank_graphs`` reads."""
    return [F.sum(weight).alias(f"w{k}") for k, weight in enumerate(weights)]
