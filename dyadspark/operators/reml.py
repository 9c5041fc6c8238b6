"""Restricted maximum likelihood of the mixed model from sums of products, by Spark.

The model is y = X b + Z u + G v + e: Z the memberships of the main factor, G the group intercepts, any number of levels each. With
K = W'W for W = [Z, G], D the variance ratios of the levels and B = W'[X, y], the criterion needs B'(D^-1 + K)^-1 B and
log det(I + D K). Both are sums over the connected components of the levels (two levels are connected when they meet in a row):

- Components of up to ``WHOLE`` levels are solved whole, in tasks. They are written once, a row each; a round of the search is one
  pass over them that answers a batch of variance ratios. Its eigenvalues for one ratio of the two variances serve every size of both.
- Larger ones share a block Krylov basis of K, scaled by that ratio, grown from B and from ``probes`` columns of random signs. A step is
  one join of the meeting levels with the newest columns and one aggregation per level; the basis is a row per level, orthogonalised twice by
  small matrices that come from sums over the rows. There is a basis for each ratio; where the large components have ``FEW`` groups at most,
  these are dense start columns instead and one basis serves all ratios. B' f(K) B follows from the projection, the trace too: exactly when
  the basis spans all levels, beyond that as the mean over the random signs, whose diagonal part has no error.

The driver sees sums and projections only. Degrees of freedom follow Satterthwaite: twice the squared variance of a contrast over the
variance of that variance, from the inverse information of the variance components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dyadspark.session import fan_out, materialise, release, small_batches

PROBES, MAX_STEPS, TOLERANCE = 24, 24, 1e-9
#: Levels of a component that is solved whole, and groups of the larger ones that are dense columns.
WHOLE, FEW = 512, 32
#: Rounds of spreading component labels; what is not settled by then counts as large.
LABEL_ROUNDS = 16
#: Bases that grow at the same time.
BASES = 3
#: Cells of the matrices a task solves together, at most, where one component has fewer.
CELLS = 1 << 20
#: Directions of sums of products below this share of the largest one are rounding.
ROUNDING = 1e-12


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _sum_products(rows: DataFrame, left: Callable, right: Callable, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of left(row) x right(row), aggregated per task and then per cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += left(batch).T @ right(batch)
        yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "value": total.ravel()})

    out = np.zeros(shape[0] * shape[1])
    sums = rows.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    return out.reshape(shape)


def _basis_of(batch) -> np.ndarray:
    return _matrix(batch.column("q"))


def _image_of(batch) -> np.ndarray:
    return _matrix(batch.column("w"))


def _root(gram: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(F, R) with gram = R'R and F turning the columns into orthonormal ones; directions up to ``least`` or rounding are left out."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    on = values > max(least, ROUNDING * values.max())
    half = np.sqrt(values[on])
    return vectors[:, on] / half, half[:, None] * vectors[:, on].T


@dataclass
class Projection:
    """A on its Krylov basis: eigenvalues, the start columns in that basis, and the number of levels."""

    values: np.ndarray
    start: np.ndarray  # eigenvectors' coordinates of the start columns, one column each
    levels: int
    columns: int  # start columns that are not probes

    def quadratic(self, f: Callable) -> np.ndarray:
        """B' f(A) B."""
        b = self.start[:, : self.columns]
        return b.T @ (f(self.values)[:, None] * b)

    def trace(self, f: Callable) -> float:
        if len(self.values) >= self.levels:
            return float(f(self.values).sum())
        g = self.start[:, self.columns :]
        return float((f(self.values)[:, None] * g * g).sum() / g.shape[1])


def _signs(seed: int, n: int) -> list[Column]:
    return [F.when(F.xxhash64(F.lit(seed), F.lit(i), "level") % 2 == 0, 1.0).otherwise(-1.0) for i in range(n)]


def _further(rows: DataFrame, cross: np.ndarray, norm: float) -> Callable | None:
    """A function of a batch that gives orthonormal columns which span what the basis q lacks of w; None if it lacks nothing.

    ``cross``: q'w, ``norm``: sum of squares of w. The columns are measured once more after they are scaled up: what was rounding has no
    length of 1 then and is left out, and the others are corrected.
    """
    size, width = cross.shape

    def rest(b: pa.RecordBatch) -> np.ndarray:
        return _image_of(b) - _basis_of(b) @ cross

    whole = _sum_products(rows, lambda b: np.hstack([_basis_of(b), rest(b)]), rest, (size + width, width))
    left = whole[:size]
    turn, _ = _root(whole[size:] - left.T @ left, TOLERANCE**2 * max(norm, 1e-300))
    if not turn.shape[1]:
        return None
    taken, width = cross + left, turn.shape[1]

    def scaled(b: pa.RecordBatch) -> np.ndarray:
        return (_image_of(b) - _basis_of(b) @ taken) @ turn

    whole = _sum_products(rows, lambda b: np.hstack([_basis_of(b), scaled(b)]), scaled, (size + width, width))
    again = whole[:size]
    fix, _ = _root(whole[size:] - again.T @ again, 0.5)
    if not fix.shape[1]:
        return None
    return lambda b: (scaled(b) - _basis_of(b) @ again) @ fix


def krylov(
    start: DataFrame, edges: DataFrame, columns: list[str], seed: int = 1, probes: int = PROBES
) -> Iterator[Projection]:
    """Projections of A on bases that grow by a step each, until the basis is whole or ``MAX_STEPS`` are done.

    ``start``: level, n (diagonal of A) and the columns B; ``edges``: level, level_b, w, each meeting both ways round.
    """
    width = len(columns) + probes
    first = materialise(start.select("level", "n", F.array(*[F.col(c) for c in columns], *_signs(seed, probes)).alias("q")))
    levels = first.count()
    gram = _sum_products(first, _basis_of, _basis_of, (width, width))
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    turn, back = _root(gram / np.outer(scale, scale), 0.0)
    turn, back = turn / scale[:, None], back * scale
    again = _sum_products(first, lambda b: _basis_of(b) @ turn, lambda b: _basis_of(b) @ turn, (turn.shape[1],) * 2)
    fix, more = _root(again, 0.5)
    turn, back = turn @ fix, more @ back

    def turned(by: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _with_basis(batch, _basis_of(batch) @ by)

        return run

    shape = "level string, n double, q array<double>"
    basis = materialise(first.mapInArrow(turned(turn), shape))
    release(first)
    edges = materialise(edges)
    size, newest = turn.shape[1], turn.shape[1]
    projection = np.zeros((size, size))
    rows = None
    try:
        for step in range(MAX_STEPS):
            at = size - newest
            newest_of = basis.select(F.col("level").alias("level_b"), F.slice("q", at + 1, newest).alias("q"))
            met = edges.join(newest_of, "level_b").select("level", "w", "q").unionByName(  # the diagonal is a meeting with oneself
                basis.select("level", F.col("n").alias("w"), F.slice("q", at + 1, newest).alias("q")))
            image = met.repartition("level").sortWithinPartitions("level").mapInArrow(_weighted_sums, "level string, w array<double>")
            rows = materialise(basis.join(image, "level"))
            whole = _sum_products(rows, lambda b: np.hstack([_basis_of(b), _image_of(b)]), _image_of, (size + newest, newest))
            cross, norm = whole[:size], float(np.trace(whole[size:]))
            projection[:, at:] = cross
            projection[at:, :] = cross.T
            values, vectors = np.linalg.eigh((projection + projection.T) / 2)
            yield Projection(np.maximum(values, 0.0), vectors[: len(back)].T @ back, levels, len(columns))
            if size >= levels or step == MAX_STEPS - 1:
                break

            found, seen = _further(rows, cross, norm), rows
            if found is None:  # A maps the basis into itself: other random signs lead to the levels it does not reach
                width = min(width, levels - size)
                seen = rows.withColumn("w", F.array(*_signs(seed + 1 + step, width)))
                found = _further(seen, _sum_products(seen, _basis_of, _image_of, (size, width)), float(levels * width))
                if found is None:
                    break

            def extend(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    q = _basis_of(batch)
                    yield _with_basis(batch, np.hstack([q, found(batch)]) if batch.num_rows else q)

            wider = materialise(seen.mapInArrow(extend, shape))
            release(rows, basis)
            basis, newest = wider, wider.select(F.size("q")).first()[0] - size
            grown = np.zeros((size + newest,) * 2)
            grown[:size, :size] = projection
            projection, size = grown, size + newest
    finally:  # also where no further step is asked for
        release(*[x for x in (rows, basis, edges) if x is not None])


def _with_basis(batch: pa.RecordBatch, q: np.ndarray) -> pa.RecordBatch:
    n, width = len(batch.column("level")), q.shape[1] if q.ndim == 2 else 0
    arrays = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(q).ravel()))
    return pa.RecordBatch.from_arrays([batch.column("level"), batch.column("n"), arrays], names=["level", "n", "q"])


def _weighted_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of w times the array q of each level; rows come sorted by level."""
    level, total = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column("q")) * batch.column("w").to_numpy()[:, None]
        names = batch.column("level").to_pylist()
        starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
        sums = np.add.reduceat(values, starts, axis=0)
        if names[0] == level:
            sums[0] += total
        elif level is not None:
            sums, starts = np.vstack([total, sums]), [-1, *starts]
        out = [level if i < 0 else names[i] for i in starts]
        level, total = out[-1], sums[-1].copy()
        yield _sums_of(out[:-1], sums[:-1])
    if level is not None:
        yield _sums_of([level], total[None, :])


def _sums_of(levels: list[str], sums: np.ndarray) -> pa.RecordBatch:
    arrays = pa.ListArray.from_arrays(
        pa.array(np.arange(len(levels) + 1) * sums.shape[1], pa.int32()), pa.array(np.ascontiguousarray(sums).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(levels, pa.string()), arrays], names=["level", "w"])


# ---------------------------------------------------------------------------
# Components

Point = tuple[float, float]  # variances of the main factor and of the groups, as ratios to the residual variance
Parts = dict[Point, tuple[np.ndarray, float]]  # B'(D^-1 + K)^-1 B and log det(I + D K)


def ratio_of(point: Point) -> float | None:
    """Group variance to main variance; None if the main variance is 0. Rounded, so that equal ratios share their work."""
    return None if point[0] == 0 else float(f"{point[1] / point[0]:.12g}")


def component_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label, closed``: nodes of one label are linked; where ``closed``, none of them is linked to one of another label.

    ``links``: a, b, each both ways round. Labels are least nodes, spread along links and then along labels, until they rest
    or ``LABEL_ROUNDS`` are done: long chains may not have met by then and their labels stay open.
    """
    links = materialise(links.select("a", "b"))
    labels = materialise(nodes.select("node", F.col("node").alias("label")))
    for _ in range(LABEL_ROUNDS):
        near = links.join(labels, links["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels["node"] == near["a"], "left").select(
            "node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        met = materialise(met)
        jump = met.select(F.col("node").alias("label"), F.col("label").alias("further"))
        wider = materialise(met.join(jump, "label", "left").select(
            "node", "before", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = wider.where(F.col("label") != F.col("before")).limit(1).count()
        release(labels, met)
        labels = wider
        if not changed:
            break
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b")
    open_labels = ends.where(F.col("own") != F.col("other")).select(F.col("own").alias("label")).distinct()
    out = materialise(labels.select("node", "label").join(open_labels.withColumn("open", F.lit(True)), "label", "left").select(
        "node", "label", F.col("open").isNull().alias("closed")))
    release(labels, links)
    return out


def whole_components(levels: DataFrame, edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, rest): a row per closed component of at most ``WHOLE`` levels, and the nodes of the others.

    ``levels``: node, grouped, n, b (array); ``edges``: node, node_b, w, each meeting both ways round. A component's row has its levels'
    grouped, n and b, in order, and i, j, w of its meetings, i and j being places in that order.
    """
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.every("closed").alias("closed"))
    small = F.col("closed") & (F.col("size") <= WHOLE)
    sized = materialise(labels.select("node", "label").join(sizes, "label").select("node", "label", small.alias("small")))
    rest = sized.where(~F.col("small")).select("node")
    # ranked in the component: no more than WHOLE rows a label
    placed = materialise(sized.where("small").select(
        "node", "label", (F.row_number().over(W.partitionBy("label").orderBy("node")) - 1).alias("place")))
    members = levels.join(placed, "node").groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("place", "grouped", "n", "b"))).alias("m"))
    half = edges.where(F.col("node") <= F.col("node_b")).join(placed, "node").select(
        "label", F.col("place").alias("i"), "node_b", "w").join(
        placed.select(F.col("node").alias("node_b"), F.col("place").alias("j")), "node_b")
    meetings = half.groupBy("label").agg(F.collect_list(F.struct("i", "j", "w")).alias("e"))
    rows = members.join(meetings, "label", "left").select(
        "label", F.col("m.grouped").alias("grouped"), F.col("m.n").alias("n"), F.flatten("m.b").alias("b"), *[
            F.coalesce(F.col(f"e.{c}"), F.array().cast(f"array<{kind}>")).alias(c) for c, kind in (("i", "int"), ("j", "int"), ("w", "double"))])
    # each pass solves them anew, which takes longer than reading them: dealt by a stated number
    out = materialise(rows.repartition(fan_out(rows.sparkSession), "label").drop("label"))
    rest = materialise(rest)
    release(placed, sized)
    return out, rest


def _stacked(batch: pa.RecordBatch, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(grouped, K, B) of components of about the same size, stacked; a smaller one is filled up with levels of no rows."""

    def cells(name):
        column = batch.column(name)
        return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)

    (at, grouped), (_, n), (_, b) = cells("grouped"), cells("n"), cells("b")
    (met, i), (_, j), (_, w) = cells("i"), cells("j"), cells("w")
    sizes, b = np.diff(at), b.reshape(-1, columns)
    order = np.argsort(sizes, kind="stable")
    first = 0
    while first < len(order):
        last = first + 1  # sorted by size: the newest one is the largest
        while last < len(order) and (last + 1 - first) * int(sizes[order[last]]) ** 2 <= CELLS:
            last += 1
        taken, width = order[first:last], int(sizes[order[last - 1]])
        k = np.zeros((len(taken), width, width))
        g, x = np.zeros((len(taken), width), bool), np.zeros((len(taken), width, columns))
        for c, row in enumerate(taken):
            own, links = slice(at[row], at[row + 1]), slice(met[row], met[row + 1])
            size = own.stop - own.start
            k[c, i[links], j[links]] = w[links]
            k[c, j[links], i[links]] = w[links]
            k[c, np.arange(size), np.arange(size)] += n[own]  # a level may meet itself
            g[c, :size], x[c, :size] = grouped[own], b[own]
        yield g, k, x
        first = last


def _solved(g: np.ndarray, k: np.ndarray, x: np.ndarray, points: Sequence[Point]) -> np.ndarray:
    """Per point the sums over stacked components: cells of B'(D^-1 + K)^-1 B, then log det(I + D K)."""
    columns = x.shape[2]
    out = np.zeros((len(points), columns * columns + 1))
    by_ratio: dict[float | None, list[int]] = {}
    for at, point in enumerate(points):
        by_ratio.setdefault(ratio_of(point), []).append(at)
    for ratio, where in by_ratio.items():
        if ratio is None:  # groups alone: no two of them meet
            size = np.array([points[at][1] for at in where])
            values, turned = np.diagonal(k, axis1=1, axis2=2)[g], x[g]
        else:
            size = np.array([points[at][0] for at in where])
            scale = np.where(g, np.sqrt(ratio), 1.0)
            values, vectors = np.linalg.eigh(k * scale[:, :, None] * scale[:, None, :])
            turned = (vectors.transpose(0, 2, 1) @ (x * scale[:, :, None])).reshape(-1, columns)
            values = np.maximum(values, 0.0).ravel()
        grown = size[:, None] * values[None, :]
        squares = (turned[:, :, None] * turned[:, None, :]).reshape(len(turned), -1)
        out[where, :-1] = (size[:, None] / (1 + grown)) @ squares
        out[where, -1] = np.log1p(grown).sum(axis=1)
    return out


def solve_components(rows: DataFrame, columns: int, points: Sequence[Point]) -> Parts:
    """The parts of the criterion at several points, summed over the components in one pass."""
    points = list(points)
    small_batches(rows.sparkSession)  # a row may be a component of 512 levels that all meet

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for stack in _stacked(batch, columns):
                part = _solved(*stack, points)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cell": np.arange(total.size), "value": total.ravel()})

    out = np.zeros(len(points) * (columns * columns + 1))
    sums = rows.mapInArrow(partial, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out[sums.column("cell").to_numpy()] = sums.column("value").to_numpy()
    out = out.reshape(len(points), -1)
    return {p: (v[:-1].reshape(columns, columns), float(v[-1])) for p, v in zip(points, out)}


class Large:
    """Levels of the components that no task solves whole: a Krylov basis for each ratio, or one with few groups as columns.

    ``levels``: node, grouped, n, b; ``edges``: node, node_b, w. ``judge`` gives the criterion's value at a point from the parts: a basis grows
    until the parts at its best point stand still.
    """

    def __init__(self, levels: DataFrame, edges: DataFrame, columns: int):
        self.levels, self.edges, self.columns = materialise(levels), materialise(edges), columns
        self.bases: dict[float, Projection] = {}
        count = self.levels.groupBy().agg(F.count_if("grouped"), F.count_if(~F.col("grouped"))).first()
        self.groups, self.members = count[0], count[1]

    def solve(self, points: Sequence[Point], judge: Callable) -> Parts:
        alone = [p for p in points if ratio_of(p) is None]
        out = self._groups_alone(alone) if alone else {}
        by_ratio: dict[float, list[Point]] = {}
        for p in points:
            if p not in out:
                by_ratio.setdefault(ratio_of(p), []).append(p)
        if self.groups <= FEW and self.members and by_ratio:
            return out | self._few_groups([p for own in by_ratio.values() for p in own], judge)
        new = [r for r in by_ratio if r not in self.bases]
        with ThreadPoolExecutor(BASES) as pool:  # a step is many short jobs: some bases grow side by side
            grown = pool.map(lambda r: self._grown(self._scaled(r), lambda basis: _projected(basis, by_ratio[r]), judge), new)
            self.bases |= dict(zip(new, grown))
        for ratio, own in by_ratio.items():
            out |= _projected(self.bases[ratio], own)
        return out

    def _groups_alone(self, points: list[Point]) -> Parts:
        rows = self.levels.where("grouped").select(F.array(F.lit(True)).alias("grouped"), F.array("n").alias("n"), "b", *[
            F.array().cast(f"array<{kind}>").alias(c) for c, kind in (("i", "int"), ("j", "int"), ("w", "double"))])
        return solve_components(rows, self.columns, points)

    def _scaled(self, ratio: float) -> Iterator[Projection]:
        levels, edges = self.levels, self.edges
        if ratio == 0:
            levels = levels.where(~F.col("grouped"))
        scale = F.when(F.col("grouped"), float(np.sqrt(ratio))).otherwise(1.0)
        start = levels.select(
            F.col("node").alias("level"), (F.col("n") * scale * scale).alias("n"),
            *[(F.col("b")[i] * scale).alias(f"b{i}") for i in range(self.columns)])
        own = levels.select("node", scale.alias("s"))
        other = own.select(F.col("node").alias("node_b"), F.col("s").alias("t"))
        met = edges.join(own, "node").join(other, "node_b").select(
            F.col("node").alias("level"), F.col("node_b").alias("level_b"), (F.col("w") * F.col("s") * F.col("t")).alias("w"))
        return krylov(start, met, [f"b{i}" for i in range(self.columns)])

    def _few_groups(self, points: list[Point], judge: Callable) -> Parts:
        """Groups as dense columns of the basis of the members: the groups' own part is solved on the driver."""
        p = self.columns
        if not hasattr(self, "few"):
            rows = self.levels.where("grouped").orderBy("node").collect()  # FEW at most
            self.few, names = None, [r["node"] for r in rows]
            self.own = np.diag([r["n"] for r in rows]) if rows else np.zeros((0, 0))
            self.cross = np.array([r["b"] for r in rows]).reshape(len(rows), p).T
            members = self.levels.where(~F.col("grouped"))
            met = self.edges.where(F.col("node_b").isin(names)).groupBy("node").agg(*[
                F.sum(F.when(F.col("node_b") == v, F.col("w")).otherwise(0.0)).alias(f"g{i}") for i, v in enumerate(names)]
                ) if names else members.select("node")
            start = members.join(met, "node", "left").fillna(0.0, [f"g{i}" for i in range(len(names))]).select(
                F.col("node").alias("level"), "n", *[F.col("b")[i].alias(f"b{i}") for i in range(p)], *[f"g{i}" for i in range(len(names))])
            within = members.select("node")
            edges = self.edges.join(within, "node", "left_semi").join(
                within.select(F.col("node").alias("node_b")), "node_b", "left_semi").select(
                F.col("node").alias("level"), F.col("node_b").alias("level_b"), "w")
            bases = krylov(start, edges, [*[f"b{i}" for i in range(p)], *[f"g{i}" for i in range(len(names))]])
            self.few = self._grown(bases, lambda basis: self._with_groups(basis, points), judge)
        return self._with_groups(self.few, points)

    def _with_groups(self, basis: Projection, points: list[Point]) -> Parts:
        out, p = {}, self.columns
        for main, group in points:
            taken = basis.quadratic(lambda v: main / (1 + main * v))
            part, logdet = taken[:p, :p], basis.trace(lambda v: np.log1p(main * v))
            if len(self.own) and group > 0:
                left = self.cross - taken[:p, p:]
                inner = np.eye(len(self.own)) + group * (self.own - taken[p:, p:])
                part = part + group * left @ np.linalg.solve(inner, left.T)
                logdet += float(np.linalg.slogdet(inner)[1])
            out[main, group] = (part, logdet)
        return out

    @staticmethod
    def _grown(bases: Iterator[Projection], parts_of: Callable, judge: Callable) -> Projection:
        before = None
        for basis in bases:
            parts = parts_of(basis)
            best = min(parts, key=lambda p: judge(p, parts[p]))
            if before is not None and best in before:
                (a, la), (b, lb) = before[best], parts[best]
                size = np.sqrt(np.maximum(np.outer(np.diag(b), np.diag(b)), 1e-300))
                if (np.abs(a - b) <= STILL * size).all() and abs(la - lb) <= STILL * max(abs(lb), 1e-300):
                    break
            before = parts
        bases.close()
        return basis

    def release(self) -> None:
        release(self.levels, self.edges)


#: A basis is long enough when a further step changes no part by more than this share.
STILL = 1e-8


def _projected(basis: Projection, points: list[Point]) -> Parts:
    return {
        (m, g): (basis.quadratic(lambda v: m / (1 + m * v)), basis.trace(lambda v: np.log1p(m * v))) for m, g in points}


class Criterion:
    """The restricted likelihood as a function of the variances.

    ``products`` are the sums of products of [X, y] (p + 1 squared), ``p`` the columns of X, ``n`` the rows; ``components``
    (rows of ``whole_components``) and ``large`` hold what the random part needs. ``ask`` fetches a batch of points in one go.
    """

    def __init__(self, products: np.ndarray, p: int, n: int, components: DataFrame | None, large: Large | None = None,
                 active: tuple[bool, bool] = (True, False)):
        self.products, self.p, self.n = products, p, n
        self.components, self.large, self.active = components, large, active
        self.known: Parts = {(0.0, 0.0): (np.zeros((p + 1, p + 1)), 0.0)}

    @staticmethod
    def key(main: float, group: float) -> Point:
        """The point that stands for variances whose ratio differs from others' by rounding."""
        ratio = ratio_of((main, group))
        return (main, group) if ratio is None else (main, ratio * main)

    def ask(self, points: Sequence[Point]) -> None:
        points = [p for p in dict.fromkeys(self.key(*p) for p in points) if p not in self.known]
        if not points:
            return
        none = (np.zeros((self.p + 1,) * 2), 0.0)
        small = dict.fromkeys(points, none) if self.components is None else solve_components(self.components, self.p + 1, points)
        if self.large is not None:
            def judge(point: Point, part: tuple[np.ndarray, float]) -> float:
                return self._value(small[point][0] + part[0], small[point][1] + part[1])

            for point, (part, logdet) in self.large.solve(points, judge).items():
                small[point] = (small[point][0] + part, small[point][1] + logdet)
        self.known |= small

    def pieces(self, main: float, group: float) -> tuple[np.ndarray, float, float, np.ndarray]:
        """For ratios to the residual variance: effects, residual sum, log determinants, inverse of X' V^-1 X."""
        self.ask([(main, group)])
        return self._pieces(*self.known[self.key(main, group)])

    def _pieces(self, part: np.ndarray, logdet: float) -> tuple[np.ndarray, float, float, np.ndarray]:
        p, w = self.p, self.products - part
        inverse = np.linalg.inv(w[:p, :p])
        beta = inverse @ w[:p, p]
        rest = max(float(w[p, p] - w[p, :p] @ beta), 1e-300)
        return beta, rest, logdet - float(np.linalg.slogdet(inverse)[1]), inverse

    def _value(self, part: np.ndarray, logdet: float) -> float:
        _, rest, logdet, _ = self._pieces(part, logdet)
        return (self.n - self.p) * float(np.log(rest / (self.n - self.p))) + logdet

    def profile(self, main: float, group: float) -> float:
        """-2 log likelihood with the residual variance at its best value, up to a constant."""
        self.ask([(main, group)])
        return self._value(*self.known[self.key(main, group)])

    def deviance(self, theta: np.ndarray) -> float:
        """-2 log likelihood at variances (main, group, residual), up to a constant."""
        _, rest, logdet, _ = self.pieces(theta[0] / theta[2], theta[1] / theta[2])
        return (self.n - self.p) * float(np.log(theta[2])) + logdet + rest / theta[2]

    def covariance(self, theta: np.ndarray) -> np.ndarray:
        return theta[2] * self.pieces(theta[0] / theta[2], theta[1] / theta[2])[3]


#: Logarithms of variance ratios: bounds, steps of the first grid, and the step at which the search ends.
LOW, HIGH, FIRST, FINEST = -16.0, 10.0, 9, 2e-3


class _Search:
    """The least profile over one or two logarithms: a grid over all, then small grids that follow the best point and shrink around it.

    ``point`` turns the logarithms into a point; along the first axis a grid has five places, along the second three, as
    a place there may cost a basis.
    """

    def __init__(self, point: Callable, bounds: list[tuple[float, float]]):
        self.point, self.bounds = point, bounds
        grids = [np.linspace(low, high, FIRST) for low, high in bounds]
        self.step = max(g[1] - g[0] for g in grids)
        self.grid = [tuple(c) for c in np.array(np.meshgrid(*grids)).reshape(len(bounds), -1).T]
        self.done, self.centre = False, None

    def points(self) -> list[Point]:
        return [] if self.done else [self.point(*c) for c in self.grid]

    def tell(self, value: Callable[[Point], float]) -> None:
        """Read the grid's values and set the next grid."""
        if self.done:
            return
        values = {c: value(self.point(*c)) for c in self.grid}
        best = min(values, key=values.get)
        step = self.step
        if max(values.values()) - values[best] <= 1e-11 * abs(values[best]):  # flat: what is left is rounding
            self.centre, self.done = best, True
        elif self.centre is None:  # the first grid
            self.centre, self.step = best, step / 3
        else:
            on_edge = [abs(b - c) > (1.5 if a == 0 else 0.5) * step and low < b < high
                       for a, (b, c, (low, high)) in enumerate(zip(best, self.centre, self.bounds))]
            if any(on_edge):
                self.centre = best
            else:
                vertex = self._vertex(values, best, step)
                self.centre, self.done, self.step = vertex, step <= FINEST, max(FINEST, step / 6)
        if not self.done:
            offsets = [np.arange(-2, 3), np.arange(-1, 2)][: len(self.bounds)]
            axes = [np.clip(c + o * self.step, *b) for c, o, b in zip(self.centre, offsets, self.bounds)]
            self.grid = sorted({tuple(map(float, c)) for c in np.array(np.meshgrid(*axes)).reshape(len(axes), -1).T})

    def _vertex(self, values: dict, best: tuple, step: float) -> tuple:
        """The least place of the quadratic through the grid's values, no further than a step from the best of them."""
        at = (np.array(list(values)) - best) / step
        dims = at.shape[1]
        cross = [(a, b) for a in range(dims) for b in range(a, dims)]
        terms = np.column_stack([np.ones(len(at)), at, *[at[:, a] * at[:, b] for a, b in cross]])
        if len(at) < terms.shape[1]:
            return best
        fit = np.linalg.lstsq(terms, np.array(list(values.values())) - values[best], rcond=None)[0]
        hessian = np.zeros((dims, dims))
        for c, (a, b) in zip(fit[1 + dims :], cross):
            hessian[a, b] += c
            hessian[b, a] += c
        if np.linalg.eigvalsh(hessian).min() <= 0:
            return best
        move = np.clip(-np.linalg.solve(hessian, fit[1 : 1 + dims]), -1, 1) * step
        return tuple(float(np.clip(v, *b)) for v, b in zip(best + move, self.bounds))


def estimate(criterion: Criterion) -> np.ndarray:
    """Variances (main, group, residual) that maximise the restricted likelihood; a component without support is 0.

    Searches with both components and with one of them at 0 advance together, a batch of points a round.
    """
    searches = []
    if criterion.active[0]:
        searches.append(_Search(lambda a: (float(np.exp(a)), 0.0), [(LOW, HIGH)]))
    if criterion.active[1]:
        searches.append(_Search(lambda a: (0.0, float(np.exp(a))), [(LOW, HIGH)]))
    if all(criterion.active):
        searches.append(_Search(lambda a, d: (float(np.exp(a)), float(np.exp(a + d))), [(LOW, HIGH), (LOW, HIGH)]))
    for _ in range(100):
        points = [p for s in searches for p in s.points()]
        if not points:
            break
        criterion.ask(points)
        for search in searches:
            search.tell(lambda p: criterion.profile(*p))
    ends = [(0.0, 0.0), *[s.point(*s.centre) for s in searches]]
    criterion.ask(ends)
    ratios, least = ends[0], criterion.profile(*ends[0])
    for end in ends[1:]:  # fewer components first
        value = criterion.profile(*end)
        if value < least - 1e-9 * abs(value):
            ratios, least = end, value
    _, rest, _, _ = criterion.pieces(*ratios)
    residual = rest / (criterion.n - criterion.p)
    return np.array([ratios[0] * residual, ratios[1] * residual, residual])


def satterthwaite(criterion: Criterion, theta: np.ndarray) -> Callable[[np.ndarray], float]:
    """Degrees of freedom of a contrast of the effects; components at 0 count as known."""
    live = [i for i in range(3) if theta[i] > 0]
    step = np.where(theta > 0, 2e-3 * theta, 0.0)

    def moved(*shifts: tuple[int, int]) -> np.ndarray:
        out = theta.copy()
        for i, sign in shifts:
            out[i] += sign * step[i]
        return out

    m = len(live)
    needed = [theta, *[moved((i, s)) for i in live for s in (1, -1)],
              *[moved((i, s), (j, t)) for i in live for j in live if j < i for s in (1, -1) for t in (1, -1)]]
    criterion.ask([(t[0] / t[2], t[1] / t[2]) for t in needed])
    hessian = np.zeros((m, m))
    middle = criterion.deviance(theta)
    for a, i in enumerate(live):
        hessian[a, a] = (criterion.deviance(moved((i, 1))) - 2 * middle + criterion.deviance(moved((i, -1)))) / step[i] ** 2
        for b in range(a):
            j = live[b]
            corners = [criterion.deviance(moved((i, s), (j, t))) * s * t for s in (1, -1) for t in (1, -1)]
            hessian[a, b] = hessian[b, a] = sum(corners) / (4 * step[i] * step[j])
    values, vectors = np.linalg.eigh(hessian)
    on = values > 1e-10 * max(values.max(), 1e-300)
    spread = 2 * (vectors[:, on] / values[on]) @ vectors[:, on].T
    slopes = [(criterion.covariance(moved((i, 1))) - criterion.covariance(moved((i, -1)))) / (2 * step[i]) for i in live]
    cov = criterion.covariance(theta)

    def df(c: np.ndarray) -> float:
        slope = np.array([c @ s @ c for s in slopes])
        return float(2 * (c @ cov @ c) ** 2 / (slope @ spread @ slope))

    return df
