"""Near-duplicate vectors by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webweave.operators.graph import connected
from webweave.session import materialize

#: Independent codes, blocks per code, words per block, and how far below a vector's best direction it still
#: enters: in standard deviations of a direction's cosine between vectors that just link.
CODES, BLOCKS, WORDS, REACH = 3, 2, 256, 3.0
#: Bits of the sign sketch, and differing bits from which two single vectors are not compared.
SKETCH, SKETCH_MOST = 128, 42
#: Members of a core that are compared in one block: a bound of memory only.
BLOCK_ROWS = 500
#: Slack of angles against rounding.
_EPS = 1e-7


@cache
def _code(dim: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """A rotation of the padded space and unit words per block: direction (i, j, …) joins one word of each."""
    rng = np.random.default_rng([dim, number])
    width = -(-dim // BLOCKS)
    rotation = np.linalg.qr(rng.standard_normal((width * BLOCKS, width * BLOCKS)))[0][:dim]
    words = rng.standard_normal((BLOCKS, WORDS, width))
    return rotation, words / np.linalg.norm(words, axis=2, keepdims=True)


@cache
def _sketch_planes(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 1_000]).standard_normal((dim, SKETCH))


def scores(unit: np.ndarray, number: int) -> np.ndarray:
    """(row, block, word): a direction's cosine is the sum over blocks."""
    rotation, words = _code(unit.shape[1], number)
    parts = (unit @ rotation).reshape(len(unit), BLOCKS, -1)
    return np.einsum("nmd,mbd->nmb", parts, words) / np.sqrt(BLOCKS)


def reach(best: np.ndarray, dim: int, least: float) -> np.ndarray:
    """How far below its best cosine a vector is entered: a linked vector strays by this from where it is stored."""
    return REACH * np.sqrt((1 - least**2) * np.maximum(1 - best**2, 0) / max(dim - 1, 1))


def list_decode(score: np.ndarray, least: float) -> np.ndarray:
    """Numbers of all directions whose summed score is at least ``least``, block by block."""
    rest = np.append(np.cumsum(score.max(1)[::-1])[::-1], 0)
    number, total = np.zeros(1, np.int64), np.zeros(1)
    for block, own in enumerate(score):
        sums = total[:, None] + own[None, :]
        a, b = np.nonzero(sums + rest[block + 1] >= least)
        number, total = number[a] * len(own) + b, sums[a, b]
    return number


def _unit(cells: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Rows that have a direction, and that direction in double precision."""
    at, units = [], []
    for i, cell in enumerate(cells.to_pylist()):
        if not cell or any(x is None for x in cell):
            continue
        vector = np.asarray(cell, np.float64)
        most = np.abs(vector).max()
        if np.isfinite(most) and most > 0:
            vector = vector / most
            at.append(i)
            units.append(vector / np.sqrt(vector @ vector))
    return at, units


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(uid, vec_id, dim, unit, place, low, high): a row per vector; ``unit`` is null if it has no direction.

    ``place``: the best direction in the first code. ``low``, ``high``: the sign sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            at, units = _unit(batch.column("vector"))
            n = batch.num_rows
            cols: dict[str, list] = {c: [None] * n for c in ("dim", "unit", "place", "low", "high")}
            dims = np.array([len(u) for u in units])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                unit = np.stack([units[k] for k in own])
                best = scores(unit, 0).argmax(2)
                place = best @ (WORDS ** np.arange(BLOCKS - 1, -1, -1))
                signs = np.packbits(unit @ _sketch_planes(int(dim)) > 0, axis=1).view(">i8").astype(np.int64)
                for k, row in enumerate(own):
                    values = int(dim), units[row].tobytes(), int(place[k]), int(signs[k, 0]), int(signs[k, 1])
                    for c, value in zip(cols, values):
                        cols[c][at[row]] = value
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + n)), batch.column("vec_id"), *(pa.array(x, k) for x, k in zip(cols.values(), kinds))],
                ["uid", "vec_id", *cols],
            )
            uid += n

    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return named.mapInArrow(run, "uid long, vec_id long, dim int, unit binary, place long, low long, high long")


def _angles(a: pa.Array, b: pa.Array) -> np.ndarray:
    dots = [np.frombuffer(x.as_py()) @ np.frombuffer(y.as_py()) for x, y in zip(a, b)]
    return np.arccos(np.clip(np.array(dots), -1, 1))


def _with_angle(pairs: DataFrame) -> DataFrame:
    """The columns of ``pairs`` without the vectors ``a`` and ``b``, and the angle between these."""
    kept = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f.name) for f in kept] + [pa.array(_angles(batch.column("a"), batch.column("b")))]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "angle"])

    return pairs.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), "angle double"]))


def _centres(members: DataFrame) -> DataFrame:
    """(core, centre): the direction of each core's sum; every partition adds up its own members first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for core, part in zip(batch.column("core").to_pylist(), batch.column("part").to_pylist()):
                vector = np.frombuffer(part)
                sums[core] = sums[core] + vector if core in sums else vector
        yield pa.RecordBatch.from_pydict({
            "core": pa.array(list(sums), pa.int64()), "part": pa.array([v.tobytes() for v in sums.values()], pa.binary())
        })

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [np.sum([np.frombuffer(x) for x in parts], axis=0) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("core"), pa.array([(v / np.linalg.norm(v)).tobytes() for v in total], pa.binary())], ["core", "centre"]
            )

    partial = members.mapInArrow(add, "core long, part binary")
    return partial.groupBy("core").agg(F.collect_list("part").alias("parts")).mapInArrow(end, "core long, centre binary")


def _cores(rows: DataFrame, angle: float) -> tuple[DataFrame, DataFrame]:
    """(uid, entity) of core members, and (entity, centre, radius, size): groups that link throughout.

    Vectors with the same best direction that link with the first of them are tried: those within
    half the angle of their mean direction are within the whole angle of each other.
    """
    leaders = materialize(
        rows.groupBy("dim", "place").agg(F.min("uid").alias("core"), F.count("*").alias("many")).where("many > 1")
        .drop("many").join(rows.select(F.col("uid").alias("core"), F.col("unit").alias("b")), "core")
    )
    near = materialize(
        _with_angle(rows.join(leaders, ["dim", "place"]).select("uid", "core", F.col("unit").alias("a"), "b"))
        .where(F.col("angle") <= angle).select("uid", "core")
    )
    units = rows.select("uid", "unit")
    centres = materialize(_centres(near.join(units, "uid").select("core", F.col("unit").alias("part"))))
    inner = materialize(
        _with_angle(near.join(units, "uid").join(centres, "core").select("uid", "core", F.col("unit").alias("a"), F.col("centre").alias("b")))
        .where(F.col("angle") <= angle / 2 - _EPS)
    )
    sizes = inner.groupBy("core").agg(F.max("angle").alias("radius"), F.count("*").alias("size")).where("size > 1")
    cores = materialize(sizes.join(centres, "core").select(F.col("core").alias("entity"), "centre", "radius", "size"))
    members = inner.join(cores.select(F.col("entity").alias("core")), "core").select("uid", F.col("core").alias("entity"))
    return materialize(members), cores


def _entries(rows: DataFrame, least: float) -> DataFrame:
    """(key, stored, dim, entity, low, high): a row per direction that a vector exceeds; ``stored`` at its best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                unit = np.stack([np.frombuffer(x) for x in part.column("unit").to_pylist()])
                for number in range(CODES):
                    score = scores(unit, number)
                    best = score.max(2).sum(1)
                    place = score.argmax(2) @ (WORDS ** np.arange(BLOCKS - 1, -1, -1))
                    found = [list_decode(s, low) for s, low in zip(score, best - reach(best, int(dim), least))]
                    row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                    key = np.concatenate(found)
                    taken = part.select(["dim", "entity", "low", "high"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key + (number << 48)), pa.array(key == place[row]), *taken.columns],
                        ["key", "stored", "dim", "entity", "low", "high"],
                    )

    return rows.select("dim", "entity", "low", "high", "unit").mapInArrow(
        run, "key long, stored boolean, dim int, entity long, low long, high long"
    )


def _compared(pairs: DataFrame, least: float) -> DataFrame:
    """(x, y, side, uid, links) per member with links, of the pairs of blocks (x, y, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for x, y, a, b in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "a", "b"))):
                linked = np.stack([np.frombuffer(m["unit"]) for m in a]) @ np.stack([np.frombuffer(m["unit"]) for m in b]).T >= least
                for members, counts in ((a, linked.sum(1)), (b, linked.sum(0))):
                    out += [(x, y, m["uid"], int(c)) for m, c in zip(members, counts) if c]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int64()) for v in (zip(*out) if out else ([],) * 4)], ["x", "y", "uid", "links"]
            )

    return pairs.select("x", "y", "a", "b").mapInArrow(run, "x long, y long, uid long, links long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Two vectors link when their cosine, in double precision, is at least ``least``.

    1. Groups around a mean direction, all within half the angle of it, are cores: their members
       link with each other without being compared, whatever their number.
    2. In each of several random product codes a vector is list-decoded to all directions that it
       exceeds by its best one's cosine less a ``reach``, and is stored at its best one. Cores and
       single vectors that meet at a direction where one is stored are candidates. For a pair at
       cosine 0.95 in 64 dimensions a code misses one in 2,000, all three together one in 10^10;
       nearer pairs are missed less. Single vectors are first compared by sketch (128 sign bits; a
       linked pair differs in 42 or more with a chance below 10^-13).
    3. Candidates are verified: whole cores by their centres and radii where these decide, otherwise
       member by member in blocks of bounded size.

    Null or empty vectors, zero vectors and those with null or non-finite components link with
    nothing; so do vectors of different lengths. Equal vectors link. Null ids stay null and do not
    name a component. Rows that repeat an id are vectors of their own. Empty table: no rows.
    """
    angle = acos(least)
    rows = materialize(_rows(vectors, id_col, vector_col))
    valid = rows.where("unit IS NOT NULL")
    members, cores = _cores(valid, angle)
    placed = materialize(
        valid.join(members, "uid", "left").withColumn("single", F.col("entity").isNull())
        .withColumns({
            "entity": F.coalesce("entity", "uid"), "low": F.when(F.col("single"), F.col("low")),
            "high": F.when(F.col("single"), F.col("high")),
        })
    )
    fields = ["key", "stored", "dim", "entity", "low", "high"]
    entries = _entries(placed.where("single"), least).unionByName(_entries(placed.where("NOT single"), least).select(fields).distinct())
    entries = materialize(entries)
    asking = entries.select("key", "dim", F.col("entity").alias("_e"), F.col("low").alias("_l"), F.col("high").alias("_h"))
    differ = F.bit_count(F.col("low").bitwiseXOR(F.col("_l"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("_h")))
    met = materialize(
        entries.where("stored").join(asking, ["key", "dim"])
        .where((F.col("entity") != F.col("_e")) & (F.coalesce(differ, F.lit(0)) < SKETCH_MOST))
        .select(F.least("entity", "_e").alias("x"), F.greatest("entity", "_e").alias("y")).distinct()
    )
    info = materialize(cores.unionByName(placed.where("single").select(
        "entity", F.col("unit").alias("centre"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("size")
    )))

    def of(end: str, vector: str) -> DataFrame:
        return info.select(F.col("entity").alias(end), F.col("centre").alias(vector), F.col("radius").alias(f"r_{end}"), F.col("size").alias(f"n_{end}"))

    measured = materialize(
        _with_angle(met.join(of("x", "a"), "x").join(of("y", "b"), "y"))
        .where(F.col("angle") - F.col("r_x") - F.col("r_y") <= angle + _EPS)
        .withColumn("whole", F.col("angle") + F.col("r_x") + F.col("r_y") < angle - _EPS)
    )
    blocks = materialize(
        placed.join(info.select("entity", "size"), "entity")
        .groupBy("entity", F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / BLOCK_ROWS)).alias("block"))
        .agg(F.collect_list(F.struct("uid", "unit")).alias("members")).drop("block")
    )
    to_compare = (
        measured.where("NOT whole").select("x", "y")
        .join(blocks.select(F.col("entity").alias("x"), F.col("members").alias("a")), "x")
        .join(blocks.select(F.col("entity").alias("y"), F.col("members").alias("b")), "y")
    )
    compared = materialize(_compared(to_compare, least))
    wholes = measured.where("whole")
    per_entity = (
        wholes.select(F.col("x").alias("entity"), F.col("n_y").alias("n"))
        .unionByName(wholes.select(F.col("y").alias("entity"), F.col("n_x").alias("n")))
        .unionByName(cores.select("entity", (F.col("size") - 1).alias("n")))
        .groupBy("entity").agg(F.sum("n").alias("n_entity"))
    )
    edges = wholes.select(F.col("x").alias("src"), F.col("y").alias("dst")).unionByName(
        compared.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    )
    entities = info.select(F.col("entity").alias("domain"))
    roots = materialize(connected(entities, edges).select(F.col("domain").alias("entity"), "root"))
    known = materialize(
        placed.select("uid", "vec_id", "entity")
        .join(materialize(per_entity.join(roots, "entity", "right")), "entity")
        .join(compared.groupBy("uid").agg(F.sum("links").alias("n_own")), "uid", "left")
        .select("uid", "vec_id", "root", (F.coalesce("n_entity", F.lit(0)) + F.coalesce("n_own", F.lit(0))).alias("n_links"))
    )
    names = materialize(known.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    named = known.join(names, "root").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
