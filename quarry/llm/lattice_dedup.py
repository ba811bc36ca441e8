"""Near-duplicate vectors by lattice hashing.

Every unit vector is projected at random to 8 dimensions, TABLES times independently, and decoded to the
nearest point of the E8 lattice: that point is its cell in the table. Each vector also probes the PROBES
lattice points that come next nearest. Two vectors are candidates if in some table one's cell is its
own or a probed cell of the other; candidates are verified by cosine in double precision.

Bitwise equal vectors are one node with a count from the start. The nodes at home in a cell meet those that probe it in
blocks of SIDE by SIDE, so no task holds a whole large cell. They meet twice: first by a sketch of 64 signs of random
projections, a few bytes a row, which leaves only nodes that have a partner within so many signs that MISSED of the pairs at the threshold at most differ in more (at cosine 0.95 six or seven
differ on average, and 20 are allowed); only these nodes are then sent their
vectors and verified, with pairs tested in slices of HELD, so memory is bounded whatever the cell. A pair counts in the first table that finds it,
which a task tells from the codes of both, so no list of all pairs is made: tasks return counts of links
for each node and only the links that join components.

Bitwise equal vectors are told by a 64-bit hash: among n different vectors two share one, and are then taken for equal, with a chance of about n^2 / 4e19.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their own component.
Vectors are scaled by their largest component before their norm is taken, so no finite one overflows.
Vectors of different lengths don't link. Repeated rows (same id and vector) count as separate vectors; a tie at exactly the threshold
links. An empty table gives no rows. Extra columns are ignored, whatever their names. A component whose ids are all null has a null id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import connected, cut, drop_cut, table

TABLES = 10
PROBES = 6
#: Factor of the projection: vectors at cosine 0.95 then lie 0.9 apart on average, against lattice points 1.4 apart.
SCALE = 1.0
SIDE = 1024
#: Rows, and pairs, that a verifying task holds at once, about.
HELD = 16_384
#: Part of the pairs at the threshold whose sketches may differ too much to be verified.
MISSED = 1e-6
THRESHOLD = 0.95
SEED = 20_240_101


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points of the rows of x, doubled so that they are whole numbers (Conway and Sloane, 1982)."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.rint(2 * np.where(nearer[:, None], whole, half)).astype(np.int64)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and if odd move the worst coordinate the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - near[odd]
        worst = np.abs(off).argmax(1)
        near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest nonzero vectors, doubled: by the lattice's definition."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([1 if bits >> k & 1 else -1 for k in range(8)])
        if v.sum() % 4 == 0:
            out.append(v)
    return np.array(out)


_MINIMAL = _minimal_vectors()
_planes: dict[tuple[int, int], np.ndarray] = {}


def _projections(dim: int, salt: int = 0, maps: int = TABLES * 8) -> np.ndarray:
    """Random maps from dim to one dimension each, the same everywhere."""
    if (dim, salt) not in _planes:
        _planes[dim, salt] = np.random.default_rng([SEED, dim, salt][: 2 + (salt > 0)]).standard_normal((dim, maps)) * SCALE
    return _planes[dim, salt]


def most_different(threshold: float) -> int:
    """Signs of 64 that may differ: each does with a chance of angle / pi."""
    p, left, most = math.acos(max(-1.0, min(1.0, threshold))) / math.pi, 1.0, -1
    while left > MISSED and most < 64:
        most += 1
        left -= math.comb(64, most) * p**most * (1 - p) ** (64 - most)
    return most


def sketches(unit: np.ndarray) -> np.ndarray:
    """64 signs of random projections of each vector as one number."""
    signs = unit @ _projections(unit.shape[1], 1, 64) > 0
    return np.packbits(signs, axis=1).view(np.int64)[:, 0]


def codes(unit: np.ndarray) -> np.ndarray:
    """Hashes of each vector's own and probed cells: (vectors, TABLES, 1 + PROBES)."""
    n, dim = unit.shape
    out = np.empty((n, TABLES, 1 + PROBES), np.int64)
    weight = np.random.default_rng(SEED).integers(1, 1 << 62, 8, dtype=np.int64) | 1
    places = (unit @ _projections(dim)).reshape(n, TABLES, 8)
    for t in range(TABLES):
        home = decode_e8(places[:, t])
        off = places[:, t] - home / 2
        near = np.argpartition(((off[:, None, :] - _MINIMAL[None] / 2) ** 2).sum(2) if n < 64 else 2 - (off @ _MINIMAL.T), PROBES, axis=1)[:, :PROBES]
        cells = np.concatenate([home[:, None, :], home[:, None, :] + _MINIMAL[near]], axis=1)
        with np.errstate(over="ignore"):
            h = (cells * weight).sum(2) + (t + 1) * 0x9E3779B97F4A7C1 + dim
            h ^= (h >> 29) & 0x7FFFFFFFF
            out[:, t] = h * 0x5851F42D4C957F2D
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column whose lists have one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_length(column: pa.Array):
    """(places, list column) of each length of vector."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size:
            yield at, column.take(pa.array(at))


def _code_rows(batches):
    """(cell, node, sketch, table, home) of every vector's own and probed cells."""
    for batch in batches:
        vectors = batch.column(1)
        nodes = batch.column(0).to_numpy()
        for at, same in _by_length(vectors):
            for i in range(0, len(at), 4096):
                part = at[i : i + 4096]
                unit = _unit(same.slice(i, 4096))
                shape = (len(part), TABLES, 1 + PROBES)
                role = np.arange(TABLES, dtype=np.int8)[:, None] * 2 + (np.arange(1 + PROBES) > 0).astype(np.int8)
                spread = lambda x, to: pa.array(np.broadcast_to(x, to).ravel())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes(unit).ravel()), spread(nodes[part][:, None, None], shape), spread(sketches(unit)[:, None, None], shape), spread(role[None], shape)],
                    names=["cell", "node", "sketch", "role"],
                )


def _meetings(rows: pa.Table, *names: str):
    """Of each meeting: the places of its rows at home and of those that probe; and the named columns."""
    task, role = rows["task"].to_numpy(), rows["role"].to_numpy()
    order = np.lexsort((role & 1, task))
    borders = np.flatnonzero(np.concatenate([[True], np.diff(task[order]) != 0, [True]])) if len(order) else np.zeros(1, int)

    def each():
        for a, b in zip(borders[:-1], borders[1:], strict=True):
            mine = order[a:b]
            split = int(np.searchsorted(role[mine] & 1, 1))
            if 0 < split < len(mine):
                yield mine[:split], mine[split:]

    return each(), *(rows[n].to_numpy() for n in names)


def _near_sketches(most: int):
    def run(rows: pa.Table) -> pa.Table:
        """The rows that have a partner with a near sketch in their meeting; a node is no partner of its own."""
        rows = rows.combine_chunks()
        meetings, node, sketch = _meetings(rows, "node", "sketch")
        sketch = sketch.view(np.uint64)  # of a negative number, bitwise_count has the bits of its absolute value
        keep = np.zeros(len(rows), bool)
        for h, p in meetings:
            step = max(1, HELD // len(p))
            for i in range(0, len(h), step):
                part = h[i : i + step]
                near = np.bitwise_count(sketch[part][:, None] ^ sketch[p][None, :]) <= most
                near &= node[part][:, None] != node[p][None, :]
                keep[part] |= near.any(1)
                keep[p] |= near.any(0)
        return rows.select(["task", "node", "role"]).filter(pa.array(keep))

    return run


def _count_links(threshold: float):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        meetings, node, mult, role = _meetings(rows, "node", "mult", "role")
        names, first, which = np.unique(node, return_index=True, return_inverse=True)
        mult = mult[first]
        vectors = rows["vector"].chunk(0).take(pa.array(first)) if rows["vector"].num_chunks else pa.array([], pa.list_(pa.float64()))
        length = np.diff(vectors.offsets.to_numpy())
        unit: dict[int, np.ndarray] = {}
        code: dict[int, np.ndarray] = {}
        local = np.zeros(len(first), np.int64)
        for at, same in _by_length(vectors):
            size = int(length[at[0]])
            unit[size] = _unit(same)
            code[size] = codes(unit[size])
            local[at] = np.arange(len(at))
        links = np.zeros(len(first), np.int64)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        def count(x: np.ndarray, y: np.ndarray, size: int, table_: int) -> None:
            cx, cy = code[size][local[x]], code[size][local[y]]
            one = (cx[:, :, :1] == cy).any(2)  # x's cell is y's own or probed
            two = (cy[:, :, :1] == cx).any(2)
            new = ~(one[:, :table_] | two[:, :table_]).any(1) & ((x < y) | ~two[:, table_])
            x, y = x[new], y[new]
            np.add.at(links, x, mult[y])
            np.add.at(links, y, mult[x])
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    up[max(u, v)] = min(u, v)

        for home, probing in meetings:
            table_ = int(role[home[0]]) >> 1
            h, p = which[home], which[probing]
            size = int(length[h[0]])
            step = max(1, 16 * HELD // len(p))
            for a in range(0, len(h), step):
                i, j = np.nonzero(unit[size][local[h[a : a + step]]] @ unit[size][local[p]].T >= threshold)
                x, y = h[a + i], p[j]
                differ = x != y
                x, y = x[differ], y[differ]
                for b in range(0, len(x), HELD):
                    count(x[b : b + HELD], y[b : b + HELD], size, table_)
        some = np.flatnonzero(links)
        joined = np.array([[k, top(k)] for k in up], np.int64).reshape(-1, 2)
        none = pa.nulls(len(joined), pa.int64())
        return pa.table(
            {
                "node": pa.concat_arrays([pa.array(names[some]), pa.array(names[joined[:, 0]])]),
                "links": pa.concat_arrays([pa.array(links[some]), none]),
                "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(names[joined[:, 1]])]),
            }
        )

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    wide = dict(vectors.dtypes).get(vector_col) != "array<float>"  # floats become doubles where they are multiplied
    v = F.col(f"`{vector_col}`").cast("array<double>") if wide else F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0.0).cast("double" if wide else "float"))  # no -0.0
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.when(F.coalesce(usable, F.lit(False)), plain).alias("vector"))
    rows = cut(rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("vector"))), "vectors")
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("mult"), F.min("vec_id").alias("least_id")), "nodes")
    cells = cut(nodes.select("node", "vector").mapInArrow(_code_rows, "cell long, node long, sketch long, role byte"), "codes")
    sizes = cells.groupBy("cell").agg(F.count_if(F.expr("role % 2 = 0")).alias("homes"), F.count("*").alias("all"))
    sizes = sizes.where("homes > 0 and all > 1").select("cell", F.ceil(F.col("homes") / SIDE).alias("bh"), F.ceil(F.col("all") / SIDE).alias("bp"))
    met = cells.join(sizes, "cell")
    spread = lambda blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
    # a row at home meets as such, and among those that probe, as two nodes at home in a cell meet too
    home = F.col("role") % 2 == 0
    where = F.pmod(F.xxhash64("node"), F.col("bh")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("bp"))
    both = F.concat(
        F.when(home, F.transform(spread(F.col("bp")), lambda j: F.struct(where[0].alias("i"), j.alias("j"), F.col("role").alias("role")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint,role:tinyint>>")),
        F.transform(spread(F.col("bh")), lambda i: F.struct(i.alias("i"), where[1].alias("j"), F.col("role").bitwiseOR(F.lit(1)).cast("byte").alias("role"))),
    )
    meeting = met.select("cell", "node", "sketch", F.explode(both).alias("m")).select(F.xxhash64("cell", "m.i", "m.j").alias("task"), "node", "sketch", "m.role")
    groups = max(1, -(-nodes.count() * TABLES * (2 + PROBES) // HELD))
    group = F.pmod("task", F.lit(groups)).alias("group")
    near = cut(meeting.groupBy(group).applyInArrow(_near_sketches(most_different(threshold)), "task long, node long, role byte"), "meetings")
    drop_cut(cells)
    left = max(1, -(-near.count() // HELD))
    dealt = near.join(nodes.select("node", "vector", "mult"), "node").withColumn("group", F.pmod("task", F.lit(left)))
    found = cut(dealt.groupBy("group").applyInArrow(_count_links(threshold), "node long, links long, other long"), "links")
    drop_cut(near)
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.select("node", "mult", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").join(counts, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    out = rows.drop("vector").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
