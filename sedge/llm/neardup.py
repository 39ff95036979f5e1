"""Embedding near-duplicates by cover-tree dual traversal: all pairs with a cosine of at least a threshold, exactly.

On the unit sphere a cosine of at least c is a distance of at most tau = sqrt(2 - 2c). A cover tree has nested levels of
centres whose radii halve. Two trees are walked together, level by level: a pair of nodes farther apart than tau plus both
covering radii holds no link and is pruned; one whose every pair must be within tau is counted whole; the rest goes down
a level, and at the points the cosine itself decides, in double precision.

Equal vectors of a label are one point with a multiplicity. A label with more points than one task should hold is dealt
into cells around centres, a level of its tree: the smallest radius whose cover of a sample has few enough centres. A point
has its home in the cell of the nearest centre (within the radius, or beyond it), and is a guest of every cell that holds a
point within tau, as told by its distance from the centre and by the least and greatest distance of the cell's points. So
points in small clusters stay in one cell. Cells, and guests, beyond a task's bound are cut by hash, and every pair of
parts of one cell is a task of bounded size. A label of which most vectors are far from all others has no such cover: it is
cut into blocks, and every pair of blocks is a task, in which the links of both are counted. Links are counted, not listed; what connects points is a star for each task
and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import batch, cut, small_batches
from sedge.llm.components import components, lookup, stars

SLACK = 1e-7
PAIRED = -1  # as a cell: a pair of blocks of a label without a cover
RADII = (2.0, 1.0, 0.5, 0.25, 0.125)
PAIRS = 1 << 16  # pairs of vectors that are compared at a time
COVERS = (0.4, 0.55, 0.75, 1.0)  # radii of cells that are tried


class CoverTree:
    """Levels of (centre of each node, children by offsets, covering radius); the last level's children are points."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit, self.levels = unit, []
        groups = [(0, np.arange(n))]  # centre and points of each node, the centre among them
        for depth in range(len(RADII)):
            centres = np.array([c for c, _ in groups], np.int64)
            cover = np.array([np.sqrt(np.maximum(0, 2 - 2 * (unit[p] @ unit[c])).max()) if len(p) > 1 else 0.0 for c, p in groups])
            inner, counts = [], []
            for c, points in groups:
                if len(points) == 1:
                    own = [(int(points[0]), points)]
                elif depth == len(RADII) - 1:
                    own = [(int(p), points[i : i + 1]) for i, p in enumerate(points)]
                else:
                    own = self._cover(c, points, RADII[depth + 1])
                    if 2 * len(own) > len(points) and depth + 2 < len(RADII):  # few and loose: a radius that gathers little only blurs
                        own = self._cover(c, points, RADII[depth + 2])
                inner += own
                counts.append(len(own))
            self.levels.append((centres, np.r_[0, np.cumsum(counts)], cover))
            groups = inner
        self.points = np.array([c for c, _ in groups], np.int64)
        self.sizes = []  # points below each node, as ranges of self.points
        ends = np.arange(len(self.points) + 1)
        for _, offsets, _ in reversed(self.levels):
            ends = ends[offsets]
            self.sizes.append(ends)
        self.sizes.reverse()

    def _cover(self, centre: int, points: np.ndarray, radius: float) -> list[tuple[int, np.ndarray]]:
        """Centres farther than radius from one another that cover the points; the node's own centre is the first."""
        out, left, asked = [], points, np.array([centre])
        bound = 1 - radius * radius / 2
        while len(left):  # a centre is asked for, then the first of those left, many at a time
            near = self.unit[asked] @ self.unit[left].T >= bound
            free = np.ones(len(left), bool)
            for i, c in enumerate(asked.tolist()):
                at = i if len(out) else int(np.flatnonzero(left == c)[0])
                if free[at]:
                    near[i, at] = True
                    own = np.flatnonzero(near[i] & free)
                    free[own] = False
                    out.append((c, left[own]))
            left = left[free]
            asked = left[:256]
        return out


def traverse(a: CoverTree, b: CoverTree, cosine: float, exact) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Yields (points of a, points of b, whole): whole: all pairs of the two link; else the two run in parallel, a link each.

    exact(points of a, points of b): their cosines, pair by pair. Two nodes of a point each need no further level."""
    tau = np.sqrt(max(0.0, 2 - 2 * cosine))
    pairs = {0: np.array([0])} if len(a.points) and len(b.points) else {}

    def linked(p: np.ndarray, q: np.ndarray):
        for at in range(0, len(p), PAIRS):
            x, y = p[at : at + PAIRS], q[at : at + PAIRS]
            keep = exact(x, y) >= cosine
            if keep.any():
                yield x[keep], y[keep], False

    for depth in range(len(RADII)):
        last = depth == len(RADII) - 1
        (_, oa, _), (_, ob, _) = a.levels[depth], b.levels[depth]
        following: dict[int, list] = {}
        for i, js in pairs.items():
            own = np.arange(oa[i], oa[i + 1])
            other = np.concatenate([np.arange(ob[j], ob[j + 1]) for j in js])
            if last:
                yield from linked(a.points[np.repeat(own, len(other))], b.points[np.tile(other, len(own))])
                continue
            ea, eb = a.sizes[depth + 1], b.sizes[depth + 1]
            for x, y, d, reach in _near(a, b, depth + 1, own, other, tau):
                one = (ea[x + 1] - ea[x] == 1) & (eb[y + 1] - eb[y] == 1)
                yield from linked(a.points[ea[x[one]]], b.points[eb[y[one]]])
                whole = (d + reach <= tau - SLACK) & ~one
                for u, v in zip(x[whole].tolist(), y[whole].tolist(), strict=True):
                    yield a.points[ea[u] : ea[u + 1]], b.points[eb[v] : eb[v + 1]], True
                left = np.flatnonzero(~whole & ~one)
                left = left[np.argsort(x[left], kind="stable")]
                for at in np.split(left, np.flatnonzero(np.diff(x[left])) + 1) if len(left) else ():
                    following.setdefault(int(x[at[0]]), []).append(y[at])
        pairs = {i: np.concatenate(js) for i, js in following.items()}


def _near(a: CoverTree, b: CoverTree, depth: int, own: np.ndarray, other: np.ndarray, tau: float) -> Iterator[tuple]:
    """Nodes of a and b of this level that may hold a link, the distances of their centres, the sums of their radii.

    Single precision, with a margin for its rounding, rules out most; double precision decides. Nodes of b are taken by
    their radii, so that a few large ones don't make the rest look near."""
    (ca, _, ra), (cb, _, rb) = a.levels[depth], b.levels[depth]
    margin = 1e-6 + 2.5e-7 * a.unit.shape[1]
    kind = np.searchsorted([0.0, *RADII[::-1]], rb[other], "left")
    for k in np.unique(kind):
        some = other[kind == k]
        most = rb[some].max()
        theirs = b.unit[cb[some]].astype(np.float32).T
        for at in np.split(own, range(step := max(1, PAIRS * 16 // len(some)), len(own), step)):
            least = (1 - (tau + SLACK + ra[at] + most) ** 2 / 2 - margin).astype(np.float32)
            least[tau + SLACK + ra[at] + most >= 2] = -2
            x, y = np.nonzero(a.unit[ca[at]].astype(np.float32) @ theirs >= least[:, None])
            for first in range(0, len(x), PAIRS):
                u, v = at[x[first : first + PAIRS]], some[y[first : first + PAIRS]]
                d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.unit[ca[u]], b.unit[cb[v]])))
                reach = ra[u] + rb[v]
                keep = d - reach <= tau + SLACK
                yield u[keep], v[keep], d[keep], reach[keep]


def join(home: tuple, guest: tuple, cosine: float, both: bool = False) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """home, guest: (ids, multiplicities, vectors). Links of each home point with other points, and (id, id) that connect what is linked.

    both: no point is home and guest, and the links of the guests follow those of the homes."""
    (ha, hn, hv), (ga, gn, gv) = home, guest
    if not len(ha) or not len(ga):
        return np.zeros(len(ha) + len(ga) * both, np.int64), []
    hl, gl = np.linalg.norm(hv, axis=1), np.linalg.norm(gv, axis=1)
    same = ha is ga
    ta = CoverTree(hv / hl[:, None])
    tb = ta if same else CoverTree(gv / gl[:, None])
    links, back = np.zeros(len(ha), np.int64), np.zeros(len(ga), np.int64)
    found, n = [(ha[:0], ha[:0])], 0
    for p, q, whole in traverse(ta, tb, cosine, lambda p, q: np.einsum("ij,ij->i", hv[p], gv[q]) / (hl[p] * gl[q])):
        if whole:
            links[p] += gn[q].sum()
            back[q] += hn[p].sum()
            found += [(ha[p], np.broadcast_to(ga[q[0]], len(p))), (ga[q], np.broadcast_to(ga[q[0]], len(q)))]
        else:
            np.add.at(links, p, gn[q])
            np.add.at(back, q, hn[p])
            found.append((ha[p], ga[q]))
        n += len(p) + len(q)
        if n > 1 << 20:
            found, n = [stars(*map(np.concatenate, zip(*found, strict=True)))], 0
    nodes, least = stars(*map(np.concatenate, zip(*found, strict=True)))
    if both:
        links = np.concatenate([links, back])
    else:
        links -= hn * np.isin(ha, ga)  # a point is its own guest somewhere, and cosines with itself may fall short by rounding
    return links, list(zip(nodes.tolist(), least.tolist(), strict=True))


def _matrix(column) -> np.ndarray:
    """Rows times a power of two each, which changes no cosine, so that squares neither overflow nor vanish."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def link(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", task_points: int = 4096, max_centres: int = 4096, sample: int = 16_384, bits: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors without a label, null or empty ones, those with a null or non-finite component or of length 0 link with
    nothing: n_links 0, component_id their own id, kept. Vectors of different dimensions don't link. Rows with equal
    vectors and labels link (a cosine of 1); rows that share an id are vectors of their own. A null id counts as a link,
    and is kept if it is the only one. Extra columns are ignored; an empty table gives no rows.

    task_points: points of a label, or of a cell, that one task holds; max_centres, sample: centres, and points that they
    are chosen from, of all larger labels together (each has one at least). They shape the tasks, not the result.
    bits: of the first hash that names a vector, fewer in tests; vectors in which it is equal are named by the second."""
    small_batches(vectors.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable &= F.exists(v, lambda x: x != 0)
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.when(F.coalesce(usable, F.lit(False)), F.concat_ws(":", F.size(vector_col).cast("string"), F.col(label_col).cast("string"))).alias("g"))
    rows = raw.withColumns({"uid": F.when(F.col("g").isNotNull(), F.shiftrightunsigned(F.xxhash64("g", "v"), 64 - bits) if bits < 64 else F.xxhash64("g", "v")), "check": F.when(F.col("g").isNotNull(), F.xxhash64("v", "g"))})

    def named(rows: DataFrame) -> DataFrame:
        return cut(rows.where("g is not null").groupBy("uid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("g").alias("g"), F.first("v").alias("v"), F.min("check").alias("lo"), F.max("check").alias("hi")), "neardup-classes")

    classes = named(rows)
    clash = [r["uid"] for r in classes.where("lo <> hi").select("uid").collect()]  # of n vectors about n * n / 2**65
    if clash:
        rows = rows.withColumn("uid", F.when(F.col("uid").isin(clash), F.col("check")).otherwise(F.col("uid")))
        classes = named(rows)
        if not classes.where("lo <> hi").isEmpty():
            raise RuntimeError("two different vectors have one 128-bit hash")
    points = classes.select("uid", "n", "g", F.col("v").cast("array<double>").alias("v"))
    sizes = cut(points.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > task_points), "neardup-sizes")
    large = {r["g"]: r["size"] for r in sizes.collect()}  # at most a label for each task_points points
    ddl = "g string, cell int, part int, block int, uid long, n long, v array<double>, home boolean, guest boolean"
    here = [F.lit(0).alias(x) for x in ("cell", "part", "block")]
    small = lookup(points, sizes, "g").where("size is null")
    dealt = small.select("g", *here, "uid", "n", "v", F.lit(True).alias("home"), F.lit(True).alias("guest"))
    if large:
        dealt = dealt.unionByName(_cells(lookup(points, sizes, "g", "inner"), large, cosine, task_points, max_centres, sample, ddl))
    fields = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def solve(table: pa.Table) -> pa.Table:
        ids, n, x = table["uid"].to_numpy(), table["n"].to_numpy(), _matrix(table["v"])
        home, guest = (np.asarray(table[k].to_numpy(zero_copy_only=False), bool) for k in ("home", "guest"))
        every = (ids, n, x)
        own = every if home.all() and guest.all() else (ids[home], n[home], x[home])
        both = not (home & guest).any() and table["cell"][0].as_py() == PAIRED
        links, edges = join(own, every if own is every else (ids[guest], n[guest], x[guest]), cosine, both)
        counted = np.concatenate([own[0], ids[guest]]) if both else own[0]
        return pa.table([pa.array([*counted, *(e[0] for e in edges)], pa.int64()), pa.array([*links, *[None] * len(edges)], pa.int64()), pa.array([*[None] * len(links), *(e[1] for e in edges)], pa.int64())], schema=fields)

    found = cut(dealt.groupBy("g", "cell", "part", "block").applyInArrow(solve, "uid long, links long, to long"), "neardup-links")
    counted = found.where("to is null").groupBy("uid").agg(F.sum("links").alias("links"))
    linked = components(found.where("to is not null").select(F.col("uid").alias("a"), F.col("to").alias("b")))
    named = linked.withColumnRenamed("node", "uid").join(classes.select("uid", "rep"), "uid")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of = lookup(linked, least, "root", "inner").select(F.col("node").alias("uid"), "component_id")
    all_of = cut(classes.select("uid", "rep", "n").join(counted, "uid", "left").join(of, "uid", "left").select(
        "uid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")), "neardup-components")
    out = lookup(rows.select("vec_id", "uid"), all_of, "uid")
    component = F.when(F.col("uid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def cover(unit: np.ndarray, most: int) -> tuple[np.ndarray, float] | None:
    """Centres of a cover of these unit vectors, of the smallest radius that needs at most so many, and the radius; None if there is none."""
    for radius in COVERS:
        left, centres = np.arange(len(unit)), []
        while len(left) and len(centres) < most:
            centres.append(left[0])
            left = left[unit[left] @ unit[left[0]] < 1 - radius * radius / 2]
        if not len(left):
            return unit[centres], radius
    return None


def _cells(points: DataFrame, large: dict[str, int], cosine: float, task_points: int, max_centres: int, sample: int, ddl: str) -> DataFrame:
    """Tasks of the labels with too many points for one. Cell 2c holds the points near centre c, cell 2c + 1 those farther that have no nearer centre.

    Where no cover has few enough centres, or its cells need more rows, a label is cut into blocks by hash, and each pair of them is a task."""
    tau, total = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-6, sum(large.values())
    spark = points.sparkSession
    buckets = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(sample / total)))
    picked = points.withColumn("bucket", F.pmod(F.xxhash64("uid", F.lit(3)), buckets)).groupBy("g", "bucket").agg(F.min_by("v", F.xxhash64("uid", F.lit(4))).alias("v"))
    found: dict[str, list] = {}
    for r in picked.orderBy("g", "bucket").collect():  # `sample` at most, and one for each large label
        found.setdefault(r["g"], []).append(r["v"])
    tried = {g: cover((m := np.array(c, float)) / np.linalg.norm(m, axis=1)[:, None], max(1, int(max_centres * large[g] / total))) for g, c in found.items()}
    covers = {g: c for g, c in tried.items() if c}
    paired = {g: -(-n // max(task_points, min(4 * task_points, (1 << 21) // int(g.split(":")[0])))) for g, n in large.items()}  # blocks of a label
    shared = spark.sparkContext.broadcast(covers)

    def near(got: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """By label: rows of the batch, their distances from the centres, their home cells."""
        labels = np.array(got.column("g").to_pylist(), object)
        for g in dict.fromkeys(labels.tolist()):
            if g not in shared.value:
                continue
            rows = np.flatnonzero(labels == g)
            centres, radius = shared.value[g]
            for at in np.split(rows, range(512, len(rows), 512)):
                x = _matrix(got.column("v").take(pa.array(at)))
                d = np.sqrt(np.maximum(0, 2 - 2 * (x / np.linalg.norm(x, axis=1)[:, None]) @ centres.T))
                c = d.argmin(1)
                yield g, at, d, 2 * c + (d[np.arange(len(at)), c] > radius)

    stat = pa.schema([("g", pa.string()), ("cell", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64())])

    def homes(batches):
        for got in batches:
            for g, at, d, cell in near(got):
                own = d[np.arange(len(at)), cell // 2]
                cells, which = np.unique(cell, return_inverse=True)
                lo, hi = np.full(len(cells), np.inf), np.zeros(len(cells))
                np.minimum.at(lo, which, own)
                np.maximum.at(hi, which, own)
                yield batch(stat, [[g] * len(cells), cells.astype(np.int32), lo, hi, np.bincount(which)])

    columns = points.select("g", "v")
    stats = columns.mapInArrow(homes, "g string, cell int, lo double, hi double, n long").groupBy("g", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    lows, highs, counts = ({g: np.full(2 * len(c), x) for g, (c, _) in covers.items()} for x in (np.inf, -np.inf, 0))
    for r in stats:  # two for each centre at most
        lows[r["g"]][r["cell"]], highs[r["g"]][r["cell"]], counts[r["g"]][r["cell"]] = r["lo"], r["hi"], r["n"]
    bounds = spark.sparkContext.broadcast((lows, highs))

    def inside(g: str, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells of which they are guests, their own among them."""
        low, high = (x[g] for x in bounds.value)
        both = np.repeat(d, 2, 1)
        return np.nonzero((both >= low - tau) & (both <= high + tau))

    def guests(batches):
        for got in batches:
            for g, _, d, _ in near(got):
                n = np.bincount(inside(g, d)[1])
                cells = np.flatnonzero(n)
                none = [None] * len(cells)
                yield batch(stat, [[g] * len(cells), cells.astype(np.int32), none, none, n[cells]])

    parts = {g: np.maximum(1, -(-n.astype(np.int64) // task_points)) for g, n in counts.items()}
    blocks = {g: np.ones(len(n), np.int64) for g, n in counts.items()}
    rows_of_cells = dict.fromkeys(counts, 0)
    for r in columns.mapInArrow(guests, "g string, cell int, lo double, hi double, n long").groupBy("g", "cell").agg(F.sum("n").alias("n")).collect():
        blocks[r["g"]][r["cell"]] = max(1, -(-r["n"] // (2 * task_points)))
        rows_of_cells[r["g"]] += r["n"] * int(parts[r["g"]][r["cell"]])
    for g, n in rows_of_cells.items():
        if n + int((counts[g] * (blocks[g] - 1)).sum()) <= large[g] * paired[g]:
            del paired[g]  # it is dealt into cells
    told = spark.sparkContext.broadcast((parts, blocks, paired))
    out = pa.schema([("g", pa.string()), ("cell", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("uid", pa.int64()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("home", pa.bool_()), ("guest", pa.bool_())])

    def pairs(got: pa.RecordBatch, ids: np.ndarray) -> Iterator[tuple]:
        """Each point for every pair of blocks its own is in: home in the first, guest in the second."""
        labels = np.array(got.column("g").to_pylist(), object)
        for g in dict.fromkeys(labels.tolist()):
            if k := told.value[2].get(g):
                every = np.flatnonzero(labels == g)
                for at in np.split(every, range(step := max(1, 16_384 // k), len(every), step)):
                    own = (((ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.uint64(k)).astype(np.int32).repeat(k)
                    other = np.tile(np.arange(k, dtype=np.int32), len(at))
                    yield g, at.repeat(k), np.minimum(own, other), np.maximum(own, other), own <= other, own >= other

    def deal(batches):
        for got in batches:
            ids, n, v = got.column("uid").to_numpy(), got.column("n").to_numpy(), got.column("v").cast(pa.list_(pa.float64()))
            for g, rows, part, block, home, guest in pairs(got, ids):
                yield batch(out, [pa.array([g] * len(rows)), np.full(len(rows), PAIRED, np.int32), part, block, ids[rows], n[rows], v.take(pa.array(rows)), home, guest])
            for g, at, d, home in near(got):
                if g in told.value[2]:
                    continue
                parts, blocks = (x[g] for x in told.value[:2])
                h = (ids[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
                i, j = inside(g, d)
                own = j == home[i]
                part, block = (h[i] >> np.uint64(12)).astype(np.int64) % parts[j], h[i].astype(np.int64) % blocks[j]
                # as a guest in each part of a cell; as a home in each block of its own
                k = np.repeat(np.arange(len(i)), parts[j])
                p = np.arange(len(k)) - np.repeat(np.cumsum(parts[j]) - parts[j], parts[j])
                at_home = own[k] & (p == part[k])
                x = np.flatnonzero(own)
                e = np.repeat(x, blocks[j[x]])
                b = np.arange(len(e)) - np.repeat(np.cumsum(blocks[j[x]]) - blocks[j[x]], blocks[j[x]])
                e, b = e[b != block[e]], b[b != block[e]]
                both = np.concatenate([k, e])
                rows = at[i[both]]
                yield batch(out, [pa.array([g] * len(rows)), j[both].astype(np.int32), np.concatenate([p, part[e]]).astype(np.int32), np.concatenate([block[k], b]).astype(np.int32), ids[rows], n[rows], v.take(pa.array(rows)),
                                  np.concatenate([at_home, np.ones(len(e), bool)]), np.concatenate([np.ones(len(k), bool), np.zeros(len(e), bool)])])

    return points.select("g", "uid", "n", "v").mapInArrow(deal, ddl)
