"""Risk-set nearest-neighbour matching of adopters to not-yet-adopters.

For every adoption month ``Ti`` the risk set is every household whose own
adoption is missing or later than ``Ti``; controls and the treated units of
``Ti`` are compared on their ``Ti`` look-back profiles, standardised with the
controls' mean and sample sd per feature, and each treated unit gets its
``k = min(k, #controls)`` nearest controls (Euclidean, ties by control id).

Profiles depend only on ``Ti``, so they are built once per (Ti, household)
instead of once per treated unit. The exact k-NN search never forms all
treated x control pairs of a month: a month's standardised controls are cut
into a tree of cells of about equal counts: each node is cut at the quantiles
of its projection on that of the three leading principal directions along which
it is widest. Every node knows its extent in all features and along those
directions, its box. A unit first meets
the controls of a few nearest cells that hold more than k; the k-th distance
found there is an upper bound, and by the triangle inequality only boxes within
that bound can hold a nearer control. So a second step meets the cells of those
boxes and is exact; there are no further rounds. Cells follow the quantiles, so
heavy tails and tight clusters do not fill some cells and empty others.
In many dimensions boxes prune little and most cells are met, so pairs are never
rows: a cell's controls and the units that look at it come together in one task,
which computes the distances and passes on k per unit and cell. Cells hold some
thousand controls and a month has a bounded number of them, so what is shuffled
follows the units and the controls, not their pairs.
Features that are constant (sd 0) or undefined (one control) contribute 0,
and a missing feature value is taken at the control mean.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadshape import schemas as S
from loadshape.operators.profiles import (adoption_months, check_mode, clean, feature_names,
                                          month_vectors, profiles_of)
from loadshape.plans.hints import broadcast_if_small
from loadshape.session import materialize

BOUND_SLACK = 1e-9          # guards the box bounds against floating error
ROUNDING = 1e-12            # of the projections
AXES = 3                    # principal directions along which cells are cut
FANOUT = 8                  # parts of a node of the tree of cells
FIRST_CELLS = 2             # cells a unit meets before it has a bound
QUANTILE_ACCURACY = 10_000  # of the cuts; the search is exact whatever they are
CELL_CONTROLS = 4_096       # least controls of a cell
MONTH_CELLS = 128           # cells of a month; beyond that they grow with it
BLOCK = 1 << 18             # distances held at once


def adoption_info(rows: DataFrame) -> DataFrame:
    """Per household: ``_never`` (some row without adoption) and ``_latest`` adoption."""
    return rows.groupBy("id").agg(
        F.max(F.col("adoption_month").isNull().cast("int")).alias("_never"),
        F.max("adoption_month").alias("_latest"))


def in_risk_set(ti: Column) -> Column:
    return (F.col("_never") == 1) | (F.col("_latest") > ti)


def risk_set(rows: DataFrame) -> DataFrame:
    """(Ti, control id) for every adoption month and household at risk.

    The distinct adoption months (bounded by the calendar span) come back as
    a short list; each household keeps the months it is at risk for with
    ``filter`` over that literal array -- a generator, no join. The output
    has one row per household and month at risk."""
    tis = sorted(r[0] for r in adoption_months(rows).collect())
    if not tis:
        return rows.sparkSession.createDataFrame([], "adoption_month date, control_id string")
    months = F.array(*[F.lit(t) for t in tis])
    at_risk = F.filter(months, lambda t: (F.col("_never") == 1) | (F.col("_latest") > t))
    return adoption_info(rows).select(F.explode(at_risk).alias("adoption_month"),
                                      F.col("id").alias("control_id"))


def _scaled(feats: Sequence[str], prefix: str) -> list[Column]:
    out = []
    for f in feats:
        mu, sd = F.col(f"_mu_{f}"), F.col(f"_sd_{f}")
        z = F.when(sd.isNotNull() & (sd > 0) & ~F.isnan(sd), (F.col(f) - mu) / sd)
        out.append(F.coalesce(z, F.lit(0.0)).alias(f"{prefix}{f}"))
    return out


def month_stats(controls: DataFrame, feats: Sequence[str]) -> DataFrame:
    """Per adoption month: control count, mean and sample sd of every
    feature (the scaling of the study), and unit vectors along the leading principal directions of the standardised controls (the axes of
    the cells). One aggregate; the table has one row per adoption month (bounded
    by the months spanned) and is the only thing collected to the driver,
    where the d x d eigen-decompositions run; it goes back as a DataFrame.

    Any axes keep the search exact, so the covariance is taken from raw sums
    (rounding there only changes how well the cells prune)."""
    d = len(feats)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    agg = controls.groupBy("Ti").agg(
        F.count(F.lit(1)).alias("_nc"),
        *[F.avg(f).alias(f"_mu_{f}") for f in feats],
        *[F.stddev_samp(f).alias(f"_sd_{f}") for f in feats],
        *[F.avg(F.coalesce(F.col(feats[i]), F.lit(0.0)) * F.coalesce(F.col(feats[j]), F.lit(0.0)))
          .alias(f"_m_{i}_{j}") for i, j in pairs])
    out = []
    for row in agg.collect():
        mu = np.array([row[f"_mu_{f}"] or 0.0 for f in feats])
        sd = np.array([row[f"_sd_{f}"] or 0.0 for f in feats])
        raw = np.zeros((d, d))
        for i, j in pairs:
            raw[i, j] = raw[j, i] = row[f"_m_{i}_{j}"] or 0.0
        cov = raw - np.outer(mu, mu)
        scale = np.where(np.isfinite(sd) & (sd > 0), sd, np.inf)
        cor = cov / np.outer(scale, scale)
        vals, vecs = np.linalg.eigh(np.nan_to_num(cor))
        order = np.argsort(vals)[::-1]
        axes = [vecs[:, order[a]] if a < d else np.zeros(d) for a in range(AXES)]
        out.append((row["Ti"], row["_nc"], *[row[f"_mu_{f}"] for f in feats],
                    *[row[f"_sd_{f}"] for f in feats],
                    *[float(x) for axis in axes for x in axis]))
    schema = ", ".join(
        ["Ti date", "_nc bigint"] + [f"_mu_{f} double" for f in feats]
        + [f"_sd_{f} double" for f in feats]
        + [f"_u{a}_{f} double" for a in range(AXES) for f in feats])
    return controls.sparkSession.createDataFrame(out, schema=schema)


def _projections(feats: Sequence[str], prefix: str) -> list[Column]:
    return [sum((F.col(f"_u{a}_{f}") * F.col(f"{prefix}{f}") for f in feats), F.lit(0.0)).alias(f"_p{a}") for a in range(AXES)]


def _distances(units: np.ndarray, controls: np.ndarray) -> np.ndarray:
    """Euclidean distances (unit by control) of the standardised features (one
    row each), summed in feature order."""
    total = np.zeros((units.shape[1], controls.shape[1]))
    diff = np.empty_like(total)
    for t, c in zip(units, controls):
        np.subtract(c[None, :], t[:, None], out=diff)
        np.multiply(diff, diff, out=diff)
        total += diff
    return np.sqrt(total, out=total)


def _smallest(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest values of each row, in order; ties by
    column, NaN last."""
    if k < distance.shape[1]:
        limit = np.partition(distance, k - 1, axis=1)[:, [k - 1]]
        row, column = np.nonzero((distance <= limit) | np.isnan(limit))
    else:
        row, column = (x.ravel() for x in np.indices(distance.shape))
    order = np.lexsort((column, distance[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], column[first]


def _nearest_in_cells(k: int, dims: int):
    """For ``mapInArrow`` over rows ``Ti, node, _unit, id, _x`` sorted by the
    first four: the k nearest controls of each unit in its cell. Only a cell's
    controls and one block of distances are held."""

    def search(batches):
        key, ids, points, known = None, [], [], None

        def block(batch, lo, hi):
            nonlocal known
            if known is None:
                found = pa.chunked_array(ids)
                spots: dict = {}
                for i, name in enumerate(found.to_pylist()):
                    spots.setdefault(name, []).append(i)
                known = found, np.concatenate(points, axis=1), spots
            found, controls, spots = known
            name = batch.column(3).slice(lo, hi - lo)
            own = [spots.get(n, ()) for n in name.to_pylist()]
            distance = _distances(coordinates(batch.column(4).slice(lo, hi - lo)), controls)
            # a unit may be among the controls: as many more, and without itself
            row, column = _smallest(distance, k + max(map(len, own)))
            other = np.array([c not in own[r] for r, c in zip(row.tolist(), column.tolist())], bool)
            row, column = row[other], column[other]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column = row[first], column[first]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo).take(pa.array(row)), name.take(pa.array(row)),
                 found.take(pa.array(column)).combine_chunks(), pa.array(distance[row, column])],
                ["Ti", "treated_id", "control_id", "distance"])

        def coordinates(column):
            return np.ascontiguousarray(column.flatten().to_numpy().reshape(-1, dims).T)

        for batch in batches:
            if not batch.num_rows:
                continue
            months, nodes = batch.column(0).cast(pa.int32()).to_numpy(), batch.column(1).to_numpy()
            unit = batch.column(2).to_numpy()
            new = (months[1:] != months[:-1]) | (nodes[1:] != nodes[:-1]) | (unit[1:] != unit[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if key != (months[lo], nodes[lo]):
                    key, ids, points, known = (months[lo], nodes[lo]), [], [], None
                if not unit[lo]:
                    ids.append(batch.column(3).slice(lo, hi - lo))
                    points.append(coordinates(batch.column(4).slice(lo, hi - lo)))
                elif ids:
                    step = max(1, BLOCK // sum(map(len, ids)))
                    for at in range(lo, hi, step):
                        yield block(batch, at, min(hi, at + step))

    return search


def _cuts(points: DataFrame, per_part: int) -> DataFrame:
    """``Ti, node, _axis, _cuts``: the axis along which a node is widest, and
    the quantiles that cut it there into a power of two of parts of at least
    ``per_part`` points, ``FANOUT`` parts at most. Quantile sketches are combined
    before the shuffle."""
    grid = F.array(*[F.lit(i / FANOUT) for i in range(1, FANOUT)])
    widths = [F.struct(F.stddev_pop(a).alias("width"), F.lit(-i).alias("axis"), F.percentile_approx(a, grid, QUANTILE_ACCURACY).alias("grid"))
              for i, a in enumerate(f"_p{a}" for a in range(AXES))]
    found = points.groupBy("Ti", "node").agg(F.count(F.lit(1)).alias("_n"), F.greatest(*widths).alias("_w"))
    parts = F.least(F.lit(FANOUT), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(per_part)))))).cast("int"))
    step = (F.lit(FANOUT) / parts).cast("int")
    chosen = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("_w.grid", i * step)))
    return found.select("Ti", "node", (-F.col("_w.axis")).alias("_axis"), F.coalesce(chosen, F.array().cast("array<double>")).alias("_cuts"))


def _part() -> Column:
    at = F.element_at(F.array(*[f"_p{a}" for a in range(AXES)]), F.col("_axis") + 1)
    return F.size(F.filter("_cuts", lambda cut: cut < at))


def _box_distance(box: Column) -> Column:
    """Lower bound of the distance of the unit's point ``_x`` from what a box
    holds: from its extent in all features, or along the axes (0 inside)."""
    gap = F.zip_with(F.zip_with(box["lo"], F.col("_x"), lambda lo, x: lo - x),
                     F.zip_with(F.col("_x"), box["hi"], lambda x, hi: x - hi),
                     lambda below, above: F.greatest(below, above, F.lit(0.0)))

    def norm(part):
        return F.sqrt(F.aggregate(part, F.lit(0.0), lambda total, g: total + g * g))
    return F.greatest(norm(F.slice(gap, F.lit(1), F.size(gap) - AXES)), norm(F.slice(gap, F.size(gap) - AXES + 1, F.lit(AXES))))


def _nearest(boxes: str, k: int, most: int) -> Column:
    """Numbers of the ``most`` nearest boxes that hold (or have a part that
    holds) more than k controls: the unit itself may be one of them."""
    full = F.filter(boxes, lambda b: b["most"] > k)
    by_distance = F.array_sort(F.transform(full, lambda b: F.struct(_box_distance(b).alias("d"), b["no"].alias("no"))))
    return F.slice(by_distance, 1, most)["no"]


def _within(boxes: str) -> Column:
    """The boxes that may hold a control within the unit's bound ``_r``."""
    return F.filter(boxes, lambda b: F.col("_r").isNull() | (_box_distance(b) * (1.0 - BOUND_SLACK) - ROUNDING <= F.col("_r")))


class ControlCells:
    """The controls of every month in a tree of cells of some ``per_cell``."""

    def __init__(self, controls: DataFrame, stats: DataFrame, feats: Sequence[str], k: int, per_cell: int) -> None:
        self.k = k
        scaled = [f"c_{f}" for f in feats]
        # One row per adoption month (bounded by the calendar span): broadcast.
        cz = controls.join(F.broadcast(stats), "Ti").select(
            "Ti", "control_id", *_scaled(feats, "c_"), *[f"_u{a}_{f}" for a in range(AXES) for f in feats])
        # Controls with identical standardised features are equally far from
        # every treated unit, so only the k smallest ids of such a group can be
        # chosen, and one more because a unit that adopts again later can be among
        # its own twins: keep those (map-side WindowGroupLimit), which bounds the
        # load of a cell full of identical profiles (e.g. empty homes reading 0).
        twins = Window.partitionBy("Ti", *scaled).orderBy("control_id")
        cz = cz.withColumn("_twin", F.row_number().over(twins)).where(F.col("_twin") <= k + 1)
        cz = cz.select("Ti", "control_id", *scaled, *_projections(feats, "c_"), F.lit(0).cast("long").alias("node"))
        largest = (stats.agg(F.max("_nc")).first()[0] or 0) / per_cell
        depth = 1
        while FANOUT ** depth < largest:
            depth += 1
        for _ in range(depth):
            cz = materialize(cz)
            cz = cz.join(broadcast_if_small(_cuts(cz, per_cell)), ["Ti", "node"]) \
                .withColumn("node", F.col("node") * FANOUT + _part()).drop("_cuts", "_axis")
        self.controls = materialize(cz)
        scaled += [f"_p{a}" for a in range(AXES)]
        boxes = self.controls.groupBy("Ti", "node").agg(
            *[F.min(c).alias(f"_lo{i}") for i, c in enumerate(scaled)], *[F.max(c).alias(f"_hi{i}") for i, c in enumerate(scaled)],
            F.count(F.lit(1)).alias("_most"))
        dims = range(len(scaled))
        self.levels = []        # from the root's children down: Ti, node, boxes of its children
        for _ in range(depth):
            boxes = materialize(boxes)
            box = F.struct(F.col("node").alias("no"), F.array(*[f"_lo{i}" for i in dims]).alias("lo"),
                           F.array(*[f"_hi{i}" for i in dims]).alias("hi"), F.col("_most").alias("most"))
            parent = F.floor(F.col("node") / FANOUT).alias("node")
            # a node has at most FANOUT children
            self.levels.insert(0, boxes.groupBy("Ti", parent).agg(F.array_sort(F.collect_list(box)).alias("_boxes")))
            boxes = boxes.groupBy("Ti", parent).agg(*[F.min(f"_lo{i}").alias(f"_lo{i}") for i in dims],
                                                    *[F.max(f"_hi{i}").alias(f"_hi{i}") for i in dims], F.max("_most").alias("_most"))

    def _descend(self, units: DataFrame, choose) -> DataFrame:
        at = units.withColumn("node", F.lit(0).cast("long"))
        for level, boxes in enumerate(self.levels):
            at = at.join(broadcast_if_small(boxes), ["Ti", "node"]).withColumn("node", F.explode(choose(level))).drop("_boxes")
        return at.select("Ti", "treated_id", "node")

    def home(self, units: DataFrame, k: int) -> DataFrame:
        """``Ti, treated_id, node`` of the cells where a unit looks first."""
        last = len(self.levels) - 1
        return self._descend(units.select("Ti", "treated_id", "_x"), lambda level: _nearest("_boxes", k, FIRST_CELLS if level == last else 1))

    def near(self, units: DataFrame) -> DataFrame:
        """``Ti, treated_id, node`` of every cell within the unit's ``_r``."""
        return self._descend(units.select("Ti", "treated_id", "_x", "_r"), lambda _: _within("_boxes")["no"])

    def pairs(self, cells: DataFrame, units: DataFrame, feats: Sequence[str]) -> DataFrame:
        """``Ti, treated_id, control_id, distance`` of the units and the k
        nearest controls of each cell they look at."""
        def rows(df, unit, id_col, prefix):
            return df.where(F.col(id_col).isNotNull()).select(
                "Ti", "node", F.lit(unit).alias("_unit"), F.col(id_col).alias("id"), F.array(*[F.col(f"{prefix}{f}") for f in feats]).alias("_x"))
        looked = cells.join(units.drop("_x", "_r"), ["Ti", "treated_id"])
        met = rows(self.controls, 0, "control_id", "c_").unionByName(rows(looked, 1, "treated_id", "t_"))
        key = met.schema["id"].dataType.simpleString()
        order = ["Ti", "node", "_unit", "id"]
        return met.repartition("Ti", "node").sortWithinPartitions(*order).mapInArrow(
            _nearest_in_cells(self.k, len(feats)), f"Ti date, treated_id {key}, control_id {key}, distance double")


def knn_edges(treated: DataFrame, controls: DataFrame, feats: Sequence[str], k: int,
              per_cell: int | None = None) -> DataFrame:
    """Exact k nearest controls per treated unit within each ``Ti``.

    ``treated``: ``Ti, treated_id, <feats>``; ``controls``: ``Ti, control_id,
    <feats>`` (unscaled). Returns ``treated_id, Ti, control_id, distance,
    neighbor`` (1 = nearest)."""
    if k < 1:
        raise ValueError("k_neighbors must be >= 1")
    stats = month_stats(controls, feats)
    if per_cell is None:
        largest = stats.agg(F.max("_nc")).first()[0] or 0
        per_cell = max(4 * k, CELL_CONTROLS, -(-largest // MONTH_CELLS))
    cells = ControlCells(controls, stats, feats, k, per_cell)
    return _search(cells, scaled_units(treated, stats, feats), feats, k)


def scaled_units(treated: DataFrame, stats: DataFrame, feats: Sequence[str]) -> DataFrame:
    """``Ti, treated_id, t_<feats>`` and the point ``_x``: the same numbers and
    their projections."""
    tz = treated.join(F.broadcast(stats), "Ti").select(
        "Ti", "treated_id", *_scaled(feats, "t_"), *[f"_u{a}_{f}" for a in range(AXES) for f in feats])
    point = F.array(*[F.col(f"t_{f}") for f in feats], *_projections(feats, "t_"))
    return materialize(tz.select("Ti", "treated_id", *[f"t_{f}" for f in feats], point.alias("_x")))


def bounded_units(cells: ControlCells, units: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    """``units`` with ``_r``, the k-th distance in the cells where a unit looks
    first: NULL (no bound) where no cell of its month holds more than k."""
    order = Window.partitionBy("Ti", "treated_id").orderBy("distance")
    first = cells.pairs(cells.home(units, k), units, feats).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    bound = first.groupBy("Ti", "treated_id").agg(F.max(F.when(F.col("_rank") == k, F.col("distance"))).alias("_r"))
    return materialize(units.join(bound, ["Ti", "treated_id"], "left"))


def _search(cells: ControlCells, units: DataFrame, feats: Sequence[str], k: int) -> DataFrame:
    units = bounded_units(cells, units, feats, k)
    order = Window.partitionBy("Ti", "treated_id").orderBy("distance", "control_id")
    best = cells.pairs(cells.near(units), units, feats).withColumn("neighbor", F.row_number().over(order)).where(F.col("neighbor") <= k)
    return materialize(best.select("treated_id", "Ti", "control_id", "distance", "neighbor"))


def risk_set_matching(data: DataFrame, id_col: str = S.ID, month_col: str = S.TS,
                      adoption_col: str = S.START, lookback_months: int = 12,
                      k_neighbors: int = 5, price_filter: str | None = "all",
                      feature_mode: str = "time_series",
                      value_col: str = "top3_mean_consumption",
                      collapse_months: bool = False, with_neighbor: bool = False) -> DataFrame:
    """Matches: ``id, <features of the control, unscaled>, control_id,
    treated_id, adoption_month, distance`` -- k rows per treated unit that has
    a complete profile and at least one control. ``collapse_months`` merges
    months split by a mid-month adoption first (see ``profiles.clean``);
    ``with_neighbor`` keeps the neighbour rank (1 = nearest)."""
    check_mode(feature_mode)
    feats = feature_names(feature_mode, lookback_months)
    # The households' month vectors feed the adoption months and the profiles:
    # materialise them once.
    vectors = materialize(month_vectors(clean(data, id_col, month_col, adoption_col, value_col, price_filter,
                                              collapse_months)))
    tis = sorted(r[0] for r in vectors.select(F.explode("_own")).distinct().collect())
    months = F.array(*[F.lit(t) for t in tis]).cast("array<date>")
    prof = profiles_of(vectors, months, feature_mode, lookback_months, keep=["_own", "_never", "_latest"])
    # Profiles feed the scaling stats, the cells and the final feature join:
    # materialise them once (reliable checkpoint in the shared folder).
    prof = materialize(prof.withColumn("_own", F.array_contains("_own", F.col("Ti"))))
    treated = prof.where("_own").select("Ti", F.col("id").alias("treated_id"), *feats)
    controls = prof.where(in_risk_set(F.col("Ti"))).select("Ti", F.col("id").alias("control_id"), *feats)
    edges = knn_edges(treated, controls, feats, k_neighbors)
    return edges.join(controls, ["Ti", "control_id"]).select(
        F.col("control_id").alias("id"), *feats, "control_id", "treated_id",
        F.col("Ti").alias("adoption_month"), "distance", *(["neighbor"] if with_neighbor else []))


def knn_match(data: DataFrame, lookback_months: int = 12, k_neighbors: int = 5,
              feature_mode: str = "time_series", **kw) -> DataFrame:
    """Edges only: ``treated_id, adoption_month, control_id, distance, neighbor``."""
    m = risk_set_matching(data, lookback_months=lookback_months, k_neighbors=k_neighbors,
                          feature_mode=feature_mode, with_neighbor=True, **kw)
    return m.select("treated_id", "adoption_month", "control_id", "distance", "neighbor")
