"""One-to-one nearest matching without replacement, inside exact groups and calipers.

The result is that of the sequential rule: treated units in descending score order (then by id) each
take the nearest control still free. A unit is only ever disturbed by units before it in that order, and
only within its exact group. This is what makes the work distributable:

* Treated units are range-partitioned by (exact group, score descending, id) into blocks of a bounded
  number of rows. A block only has to wait for the blocks of its own group before it; what starts or
  lies whole in a partition waits for nothing. A step runs the next block of every group side by side,
  and there are as many steps as the largest group has blocks, whatever the contention.
* Space is cut into cells: the exact group and, per caliper, steps as wide as the caliper. A unit's
  partners can only lie in its own and the adjacent cells, so a block is given the controls of the cells
  its units can reach, less those taken in earlier steps. No list of candidate pairs exists at any point.
* With replacement nobody disturbs anybody, and all blocks are one step.

Where the calipers leave a block more controls than a task may hold (this is counted first), deferred
acceptance takes over. Controls all prefer the same order of treated units, so it ends in exactly the same
matching in any order of proposals:

* Controls, and each unit once per cell it searches, are range-partitioned by (cell, score, hash of
  the id) into chunks of a bounded number of rows.
* In each cell a unit walks outwards from its score, one chunk at a time, keeping for either side the
  chunk it has got to and a lower bound on the distance of whatever is left there. It proposes once
  its nearest find beats all its other bounds.
* Visitors of a chunk are dealt to slots of bounded size; every slot gets the chunk's controls and
  runs the sequential rule on its own. A control then keeps the best of its proposers, the others
  try again in the next round. A control only ever trades up, so what a unit has seen to be
  unavailable stays so.
* Rounds repeat until no treated unit has anywhere left to go.

The small state (who holds which control) is written to the shared folder every step or round. Small inputs
fit one chunk and need a single visit without any of this.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import hash_unit
from ..runtime import checkpointed, parts_for

INF = float("inf")
_WALK = ("l_chunk", "l_dist", "l_tie", "l_order", "r_chunk", "r_dist", "r_tie", "r_order")
_STATE = (
    "unit long, grp string, l_chunk int, l_dist double, l_tie double, l_order double, "
    "r_chunk int, r_dist double, r_tie double, r_order double, control long, gap double"
)
_OPEN, _CLOSED = -1.0, INF  # tie ranks of a side not looked into yet, and of one used up
_TAKEN = "unit long, control long, gap double, row long"
MOST_BLOCKS = 64  # blocks hold more than ``chunk_rows`` where there would be more of them
MOST_ROWS = 1_000_000  # controls, and treated units, of one block


def propensity(df: DataFrame, label: str, covariates: Sequence[str], out: str = "distance") -> DataFrame:
    """Add the fitted probability of ``label`` from an unpenalised logistic model. A missing covariate raises."""
    assembled = VectorAssembler(inputCols=list(covariates), outputCol="_x", handleInvalid="error").transform(df)
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, probabilityCol="_p",
                               rawPredictionCol="_raw", predictionCol="_pred", maxIter=100, tol=1e-9).fit(assembled)
    return model.transform(assembled).withColumn(out, vector_to_array("_p")[1]).drop("_x", "_p", "_raw", "_pred")


def propensity_by_group(
    df: DataFrame, label: str, covariates: Sequence[str], group: str, out: str = "distance", max_iter: int = 50, tol: float = 1e-10
) -> DataFrame:
    """Add the fitted probability of ``label`` from an unpenalised logistic model with one intercept per ``group``.

    The group is a factor of any number of levels. Intercepts and their sums stay in a table with one row per group;
    each Newton step eliminates them (Schur complement), so that only sums over the covariates reach the driver.
    A group in which all labels are equal says nothing about the covariates, and its intercept runs away: its rows
    get the limit, 0 or 1. A covariate without any spread within the groups counts for nothing. Missing values raise,
    and so does a fit that does not converge. No rows give no rows.
    """
    xs = list(covariates)
    p = range(len(xs))
    cells = [(i, j) for i in p for j in range(i + 1)]
    rows = checkpointed(df)
    number = lambda c: F.col(c).cast("double")
    spread = rows.agg(*[F.avg(number(c)) for c in xs], *[F.stddev_pop(number(c)) for c in xs],
                      *[F.count(F.when(F.col(c).isNull(), 1)) for c in (label, group, *xs)]).first()
    if any(spread[2 * len(xs):]):
        raise ValueError(f"missing values among {', '.join((label, group, *xs))}")
    rates = checkpointed(rows.groupBy(F.col(group).alias("_g")).agg(F.avg(number(label)).alias("_rate")))
    # Centred and scaled, for the sums' sake; rows of settled groups take no part.
    fitted = checkpointed(rows.join(rates, rows[group] == rates["_g"]).filter("_rate > 0 AND _rate < 1").select(
        "_g", number(label).alias("y"), *[((number(c) - F.lit(spread[i])) / F.lit(spread[len(xs) + i] or 1.0)).alias(f"x{i}")
                                          for i, c in enumerate(xs)]))

    def sums(coefficients: DataFrame):
        """Per group, log-likelihood, gradient and information at these coefficients; and their reduction over groups.

        The coefficients are columns rather than constants, so that Spark compiles the pass over the rows only once.
        """
        eta = sum((F.col(f"x{i}") * F.col(f"beta{i}") for i in p), F.col("a"))
        small = F.exp(-F.abs("eta"))
        at = fitted.join(coefficients, "_g").withColumn("eta", eta).withColumn(
            "mu", F.when(F.col("eta") >= 0, 1.0).otherwise(small) / (1 + small)
        ).withColumns({"w": F.col("mu") * (1 - F.col("mu")), "r": F.col("y") - F.col("mu")})
        weighted = lambda *c: F.sum(F.col("w") * math.prod(map(F.col, c[1:]), start=F.col(c[0])))
        table = checkpointed(at.groupBy("_g").agg(
            F.first("a").alias("a"), *[F.first(f"beta{i}").alias(f"beta{i}") for i in p], F.sum(F.col("y") * F.col("eta") - F.greatest("eta", F.lit(0.0)) - F.log1p(small)).alias("ll"),
            F.sum("w").alias("w"), F.sum("r").alias("r"), *[F.sum(F.col("r") * F.col(f"x{i}")).alias(f"r{i}") for i in p],
            *[weighted(f"x{i}").alias(f"b{i}") for i in p], *[weighted(f"x{i}", f"x{j}").alias(f"h{i}_{j}") for i, j in cells]))
        share = lambda i: F.col(f"b{i}") / F.greatest("w", F.lit(1e-300))
        ll, *found = table.agg(
            F.sum("ll"), *[F.sum(F.col(f"r{i}") - share(i) * F.col("r")) for i in p],
            *[F.sum(F.col(f"h{i}_{j}") - share(i) * F.col(f"b{j}")) for i, j in cells]).first()
        information = np.zeros((len(xs), len(xs)))
        for (i, j), h in zip(cells, found[len(xs):], strict=True):
            information[i, j] = information[j, i] = h or 0.0
        return table, ll or 0.0, np.array([g or 0.0 for g in found[: len(xs)]]), information

    beta = np.zeros(len(xs))
    start = rates.filter("_rate > 0 AND _rate < 1").select(
        "_g", F.log(F.col("_rate") / (1 - F.col("_rate"))).alias("a"), *[(F.col("_rate") * 0.0).alias(f"beta{i}") for i in p])
    table, ll, gradient, information = sums(start)
    for _ in range(max_iter):
        step = np.linalg.lstsq(information, gradient, rcond=1e-12)[0] if xs else beta
        own = (F.col("r") - sum((F.col(f"b{i}") * F.lit(float(step[i])) for i in p), F.lit(0.0))) / F.greatest("w", F.lit(1e-300))
        size = 1.0
        while True:
            found = sums(table.select("_g", (F.col("a") + F.lit(size) * own).alias("a"), *[
                (F.col(f"beta{i}") + F.lit(float(size * step[i]))).alias(f"beta{i}") for i in p]))
            if found[1] >= ll - 1e-12 * abs(ll):
                break
            size /= 2
            if size < 1e-6:
                raise RuntimeError("propensity: no step raises the likelihood")
        gain, beta = found[1] - ll, beta + size * step
        table, ll, gradient, information = found
        if abs(gain) <= tol * (abs(ll) + 1):
            break
    else:
        raise RuntimeError(f"propensity has not converged after {max_iter} steps")
    levels = rates.join(table.select("_g", "a"), "_g", "left")
    eta = sum(((number(c) - F.lit(spread[i])) / F.lit(spread[len(xs) + i] or 1.0) * F.lit(float(beta[i])) for i, c in enumerate(xs)),
              F.col("a"))
    return rows.join(levels, rows[group] == levels["_g"]).withColumn(
        out, F.when(F.col("a").isNull(), F.col("_rate")).otherwise(1 / (1 + F.exp(-eta)))).drop("_g", "_rate", "a")


def _chunked(units: DataFrame, parts: int) -> DataFrame:
    spread = units.repartitionByRange(parts, "grp", "score", "h", "unit")
    return checkpointed(spread.withColumn("chunk", F.spark_partition_id()))


def _in_one_chunk(units: DataFrame, run) -> DataFrame:
    """Everything fits one chunk: every walk ends inside it, so one visit settles all."""
    start = {"chunk": 0, "slot": 0, "first_chunk": 0, "last_chunk": 0, "l_chunk": 0, "r_chunk": 0,
             "l_dist": 0.0, "r_dist": 0.0, "l_tie": _OPEN, "r_tie": _OPEN, "l_order": -INF, "r_order": -INF,
             "o_dist": INF, "o_tie": INF, "o_order": INF}
    visitors = units.filter("treated = 1").drop("treated").withColumns({k: F.lit(v) for k, v in start.items()})
    controls = units.filter("treated = 0").select(
        *[F.col(c).alias(c) for c in units.columns if c != "treated"], F.lit(0).alias("chunk"), F.lit(0).alias("slot"),
        F.lit(-INF).alias("held_score"), F.lit(-1).cast("long").alias("held_by"),
    )
    moved = visitors.groupBy("chunk", "slot").cogroup(controls.groupBy("chunk", "slot")).applyInPandas(run, _STATE)
    return _pairs(moved.filter("control IS NOT NULL"))


def _pairs(taken: DataFrame) -> DataFrame:
    return taken.select(F.col("unit").alias("treated_id"), F.col("control").alias("control_id"), "gap")


def _first_acceptable(acceptable, start: int, stop: int, step: int) -> int:
    """First acceptable place from ``start`` towards ``stop`` (exclusive), or -1."""
    width, at = 64, start
    while at != stop:
        end = min(at + width, stop) if step > 0 else max(at - width, stop)
        places = np.arange(at, end, step)
        hits = np.flatnonzero(acceptable(places))
        if hits.size:
            return int(places[hits[0]])
        at, width = end, width * 4
    return -1


def _visit(calipers: Sequence[tuple[str, float]], replace: bool):
    """Grouped function: visitors of one slot of one chunk against that chunk's controls."""

    def run(visitors: pd.DataFrame, controls: pd.DataFrame) -> pd.DataFrame:
        if visitors.empty:
            return pd.DataFrame(columns=[f.split()[0] for f in _STATE.split(", ")])
        controls = controls.sort_values(["grp", "score", "h", "unit"], kind="mergesort")
        grp, score, h = (controls[c].to_numpy() for c in ("grp", "score", "h"))
        ids = controls["unit"].to_numpy()
        held_score = controls["held_score"].to_numpy(copy=True)
        held_by = controls["held_by"].to_numpy(copy=True)
        dims = [(controls[c].to_numpy(), visitors.columns.get_loc(c), width) for c, width in calipers]
        visitors = visitors.sort_values(["score", "unit"], ascending=[False, True], kind="mergesort")
        spans: dict = {}
        if len(grp):
            edges = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            for a, b in zip(edges, np.r_[edges[1:], len(grp)]):
                spans[grp[a]] = (int(a), int(b))
        place = {name: visitors.columns.get_loc(name) for name in visitors.columns}
        out = []
        for v in visitors.itertuples(index=False, name=None):
            unit, s, hv, chunk = v[place["unit"]], v[place["score"]], v[place["h"]], v[place["chunk"]]
            a, b = spans.get(v[place["grp"]], (0, 0))
            # First control at or after the unit in (score, h) order.
            lo, hi = a + np.searchsorted(score[a:b], s, "left"), a + np.searchsorted(score[a:b], s, "right")
            at = int(lo + np.searchsorted(h[lo:hi], hv, "left"))

            def acceptable(places):
                ok = (held_score[places] < s) | ((held_score[places] == s) & (held_by[places] > unit))
                for values, i, width in dims:
                    ok &= np.abs(values[places] - v[i]) <= width
                return ok

            def key(i: int, side: float) -> tuple[float, float, float]:
                tie = float(abs(h[i] - hv)) if score[i] == s else side
                return float(abs(score[i] - s)), tie, float(h[i] if side else -h[i])

            others = (v[place["o_dist"]], v[place["o_tie"]], v[place["o_order"]])
            sides = {}
            for name, side, start, stop, step in (("l", 0.0, at - 1, a - 1, -1), ("r", 1.0, at, b, 1)):
                known = tuple(v[place[f"{name}_{part}"]] for part in ("chunk", "dist", "tie", "order"))
                found = -1
                if known[0] == chunk:
                    found = _first_acceptable(acceptable, start, stop, step) if b > a else -1
                    if found >= 0:
                        known = (chunk, *key(found, side))
                    elif chunk == v[place["first_chunk" if name == "l" else "last_chunk"]]:
                        known = (chunk, INF, _CLOSED, INF)
                    else:
                        bound = known[1]
                        if b > a:
                            edge = a if name == "l" else b - 1
                            beyond = score[edge] <= s if name == "l" else score[edge] >= s
                            bound = max(bound, float(abs(score[edge] - s))) if beyond else bound
                        known = (chunk + step, bound, _OPEN, -INF)
                sides[name] = (known, found)
            (left, left_at), (right, right_at) = sides["l"], sides["r"]
            taken = -1
            if left_at >= 0 and left[1:] <= right[1:] and left[1:] < others:
                taken = left_at
            elif right_at >= 0 and right[1:] < left[1:] and right[1:] < others:
                taken = right_at
            if taken >= 0:
                if not replace:
                    held_score[taken], held_by[taken] = s, unit
                out.append((unit, v[place["grp"]], *left, *right, ids[taken], float(abs(score[taken] - s))))
            else:
                out.append((unit, v[place["grp"]], *left, *right, None, None))
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in _STATE.split(", ")])
        return frame.astype({"control": "Int64", "gap": "float64"})

    return run


def match_nearest(
    df: DataFrame,
    label: str,
    score: str,
    exact: str,
    calipers: Mapping[str, float],
    unit: str = "person_id",
    chunk_rows: int = 50_000,
    max_rounds: int = 10_000,
    replace: bool = False,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Pairs (treated_id, control_id, gap), ``gap`` being the score distance.

    Equal distances are settled by side (the lower score first); among controls of the very same
    score as the treated unit by the distance of the id hashes, which spreads exact copies.
    With ``replace`` every treated unit gets its nearest control, shared or not.
    Up to ``chunk_rows`` units are matched in one visit. More are cut into blocks of about so many treated units, larger
    ones if that made more than ``MOST_BLOCKS`` of them; no block has more than about ``most_rows`` units or controls.
    A unit without a score, a group or a caliper's value cannot be placed; any such unit raises.
    """
    dims = list(calipers)
    units = df.select(
        F.col(unit).cast("long").alias("unit"),
        F.col(label).cast("int").alias("treated"),
        F.col(exact).cast("string").alias("grp"),
        F.col(score).cast("double").alias("score"),
        hash_unit(unit).cast("double").alias("h"),
        *[F.col(c).cast("double").alias(c) for c in dims],
    )
    unknown = F.lit(False)
    for c in units.columns:
        unknown = unknown | F.col(c).isNull()
    n_units, n_unknown, n_treated = units.agg(F.count("*"), F.count(F.when(unknown, 1)), F.count(F.when(F.col("treated") == 1, 1))).first()
    if n_unknown:
        raise ValueError(f"{n_unknown} of {n_units} units lack a value among {', '.join(units.columns)}")
    widths = [(c, float(calipers[c])) for c in dims]
    if n_units <= chunk_rows:
        return _in_one_chunk(units, _visit(widths, replace))
    block_rows = max(chunk_rows, min(most_rows, math.ceil(n_treated / MOST_BLOCKS)))
    pairs = _by_blocks(units, widths, parts_for(n_treated, block_rows), most_rows, replace)
    if pairs is None:
        pairs = _by_walks(units, calipers, chunk_rows, max_rounds, replace)
    return pairs


def _settle(calipers: Sequence[tuple[str, float]], replace: bool):
    """Grouped function: the sequential rule for one block of treated units over the controls they can reach."""
    dims, widths = [c for c, _ in calipers], [w for _, w in calipers]

    def run(visitors: pd.DataFrame, controls: pd.DataFrame) -> pd.DataFrame:
        out = []
        controls = controls.sort_values(["grp", "score", "h", "unit"], kind="mergesort")
        offered = dict(list(controls.groupby("grp", sort=False)))
        visitors = visitors.sort_values(["score", "unit"], ascending=[False, True], kind="mergesort")
        for grp, units in visitors.groupby("grp", sort=False):
            if grp in offered:
                places, free = _sequential(units, offered[grp], dims, widths, replace), offered[grp]
                units, places = units[places >= 0], places[places >= 0]
                out.append(pd.DataFrame({
                    "unit": units["unit"].to_numpy(), "control": free["unit"].to_numpy()[places],
                    "gap": np.abs(free["score"].to_numpy()[places] - units["score"].to_numpy()), "row": free["row"].to_numpy()[places]}))
        return pd.concat(out) if out else pd.DataFrame(columns=[f.split()[0] for f in _TAKEN.split(", ")])

    return run


def _sequential(units: pd.DataFrame, controls: pd.DataFrame, dims: list[str], widths: list[float], replace: bool) -> np.ndarray:
    """Per treated unit, in the rule's order, the place of the control it takes, or -1. Controls are ordered by score and hash."""
    where, score, h = np.arange(len(controls)), controls["score"].to_numpy(), controls["h"].to_numpy()
    values = [controls[c].to_numpy() for c in dims]
    free, gone = np.ones(len(where), bool), 0
    out = np.full(len(units), -1)
    for i, (s, hv, *own) in enumerate(units[["score", "h", *dims]].itertuples(index=False, name=None)):
        if gone * 4 > len(free):  # those taken leave, so that nobody walks past them again and again
            where, score, h, values = where[free], score[free], h[free], [v[free] for v in values]
            free, gone = np.ones(len(where), bool), 0

        def fitting(start: int, stop: int) -> np.ndarray:
            ok = free[start:stop].copy()
            for v, x, width in zip(values, own, widths):
                ok &= np.abs(v[start:stop] - x) <= width
            return ok

        # Outwards from the unit's place in (score, hash) order; a side ends where the other's find is nearer.
        lo, hi = score.searchsorted(s, "left"), score.searchsorted(s, "right")
        l_end = r_end = int(lo + h[lo:hi].searchsorted(hv))
        left = right = -1
        n, window = len(score), 64
        while (left < 0 < l_end) or (right < 0 and r_end < n):
            if left < 0 < l_end:
                if right >= 0 and s - score[l_end - 1] > score[right] - s:
                    l_end = 0
                else:
                    start = max(l_end - window, 0)
                    ok = fitting(start, l_end)[::-1]
                    at = int(ok.argmax())
                    left, l_end = l_end - 1 - at if ok[at] else -1, start
            if right < 0 and r_end < n:
                if left >= 0 and score[r_end] - s > s - score[left]:
                    r_end = n
                else:
                    stop = min(r_end + window, n)
                    ok = fitting(r_end, stop)
                    at = int(ok.argmax())
                    right, r_end = r_end + at if ok[at] else -1, stop
            window *= 4
        if left >= 0 and right >= 0:
            keys = [(abs(score[j] - s), abs(h[j] - hv) if score[j] == s else side, h[j] if side else -h[j])
                    for j, side in ((left, 0.0), (right, 1.0))]
            best = left if keys[0] <= keys[1] else right
        else:
            best = max(left, right)
        if best >= 0:
            out[i] = where[best]
            if not replace:
                free[best], gone = False, gone + 1
    return out


def _by_blocks(units: DataFrame, calipers: Sequence[tuple[str, float]], parts: int, most_rows: int, replace: bool) -> DataFrame | None:
    """Pairs, block by block; None where a block can reach more controls than ``most_rows``."""
    dims = [c for c, _ in calipers]
    cells = _cell_numbers(dict(calipers))
    name = lambda columns: F.concat_ws("|", "grp", *[c.cast("string") for c in columns])
    controls = checkpointed(units.filter("treated = 0").select(
        "unit", "grp", "score", "h", *dims, name(cells.values()).alias("cell"), F.monotonically_increasing_id().alias("row")))
    treated = units.filter("treated = 1").drop("treated").repartitionByRange(parts, "grp", F.desc("score"), "unit")
    treated = checkpointed(treated.withColumn("part", F.spark_partition_id()))
    # A partition holds the end of one group at most; all else in it is the first block of its group. At most one row per partition.
    spans = treated.groupBy("grp").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").drop("last")
    step = F.lit(0) if replace else F.coalesce(F.col("part") - F.col("first"), F.lit(0))
    treated = treated.join(F.broadcast(spans), "grp", "left").withColumn("step", step).drop("first")

    near = treated.select("step", "part", "grp", *[cell.alias(f"_{c}") for c, cell in cells.items()]).distinct()
    for c, width in calipers:
        if width > 0:
            near = near.withColumn(f"_{c}", F.explode(F.sequence(F.col(f"_{c}") - 1, F.col(f"_{c}") + 1)))
    near = checkpointed(near.select("step", "part", name([F.col(f"_{c}") for c in dims]).alias("cell")).distinct())
    sizes = near.join(controls.groupBy("cell").agg(F.count("*").alias("n")), "cell").groupBy("step", "part").agg(F.sum("n").alias("n"))
    most, last = sizes.agg(F.max("n"), F.max("step")).first()
    if most is not None and most > most_rows:
        return None
    offered = controls.join(near, "cell").drop("cell")
    run = _settle(calipers, replace)
    if not last:
        moved = treated.groupBy("part").cogroup(offered.groupBy("part")).applyInPandas(run, _TAKEN)
        return _pairs(moved)
    treated, offered = checkpointed(treated, by=["step"]), checkpointed(offered, by=["step"])
    taken = None
    for number in range(last + 1):
        left = offered.filter(F.col("step") == number)
        if taken is not None:
            left = left.join(taken.select("row"), "row", "left_anti")
        visitors = treated.filter(F.col("step") == number)
        moved = checkpointed(visitors.groupBy("part").cogroup(left.groupBy("part")).applyInPandas(run, _TAKEN))
        taken = moved if taken is None else taken.unionByName(moved)
    return _pairs(taken)


def _by_walks(units: DataFrame, calipers: Mapping[str, float], chunk_rows: int, max_rounds: int, replace: bool) -> DataFrame:
    """Pairs by deferred acceptance, walks over chunks of any number of controls."""
    spark, dims = units.sparkSession, list(calipers)
    run = _visit([(c, float(calipers[c])) for c in dims], replace)
    places = _cells(units, calipers)
    chunked = _chunked(places, parts_for(places.count(), chunk_rows))
    controls = chunked.filter("treated = 0").drop("treated")
    treated = chunked.filter("treated = 1").drop("treated").withColumnRenamed("chunk", "home")

    # One row per chunk that has controls: at most as many as there are partitions.
    filled = controls.groupBy("chunk").agg(F.count("*").alias("n"))
    dense = filled.select("chunk", (F.row_number().over(W.orderBy("chunk")) - 1).alias("dense"))
    n_chunks = dense.count()
    controls = controls.join(F.broadcast(dense), "chunk").drop("chunk").withColumnRenamed("dense", "chunk")
    edges = controls.groupBy("grp").agg(F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
    homes = treated.select(F.col("home").alias("chunk")).distinct()
    ordered = W.orderBy("chunk")
    nearby = homes.join(F.broadcast(dense), "chunk", "full").select(
        F.col("chunk").alias("home"),
        F.coalesce(F.last("dense", True).over(ordered.rowsBetween(W.unboundedPreceding, 0)), F.lit(-1)).alias("below"),
        F.coalesce(F.first("dense", True).over(ordered.rowsBetween(0, W.unboundedFollowing)), F.lit(n_chunks)).alias("above"),
    )
    # A walk starts in the unit's own chunk, or between the nearest chunks that have controls; a side
    # on which the cell has no controls is closed from the start.
    left, right = F.least("below", "last_chunk"), F.greatest("above", "first_chunk")
    starts = {}
    for name, chunk, edge, closed in (
        ("l", left, "first_chunk", left < F.col("first_chunk")), ("r", right, "last_chunk", right > F.col("last_chunk")),
    ):
        starts[f"{name}_chunk"] = F.when(closed, F.col(edge)).otherwise(chunk)
        starts[f"{name}_dist"] = F.when(closed, INF).otherwise(0.0)
        starts[f"{name}_tie"] = F.when(closed, _CLOSED).otherwise(_OPEN)
        starts[f"{name}_order"] = F.when(closed, INF).otherwise(-INF)
    places = checkpointed(
        treated.join(F.broadcast(nearby), "home").join(edges, "grp").select(
            "unit", "grp", "score", "h", *dims, "first_chunk", "last_chunk", *[starts[c].alias(c) for c in _WALK]
        )
    )
    fixed = places.drop(*_WALK)
    scores = places.select("unit", "score").distinct()
    walks = places.select("unit", "grp", *_WALK)
    # Fresh column identities, so that both sides of the cogroup can be told apart.
    controls = checkpointed(controls.select(*[F.col(c).alias(c) for c in controls.columns]))
    held = None

    for _ in range(max_rounds):
        free = walks if held is None else walks.join(held.select("unit"), "unit", "left_anti")
        visitors = checkpointed(_next_visits(free).join(fixed, ["unit", "grp"]))
        load = visitors.groupBy("chunk").agg(F.ceil(F.count("*") / F.lit(chunk_rows)).cast("int").alias("slots"))
        # One number per chunk. While few chunks are visited, only their files are read.
        load = {r.chunk: r.slots for r in load.collect()}
        if not load:
            break
        slots = spark.createDataFrame(list(load.items()), "chunk int, slots int")
        visitors = visitors.join(F.broadcast(slots), "chunk").withColumn(
            "slot", F.pmod(F.xxhash64("unit"), F.col("slots")).cast("int")
        ).drop("slots")
        wanted = controls.filter(F.col("chunk").isin(list(load))) if len(load) <= 1000 else controls
        offered = wanted.join(F.broadcast(slots), "chunk").withColumn(
            "slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))
        ).drop("slots")
        if held is None or replace:
            offered = offered.withColumns({"held_score": F.lit(-INF), "held_by": F.lit(-1).cast("long")})
        else:
            holders = held.select(F.col("control").alias("unit"), F.col("unit").alias("held_by"),
                                  F.col("score").alias("held_score"))
            offered = offered.join(holders, "unit", "left").withColumns({
                "held_score": F.coalesce("held_score", F.lit(-INF)),
                "held_by": F.coalesce("held_by", F.lit(-1)),
            })
        moved = checkpointed(
            visitors.groupBy("chunk", "slot").cogroup(offered.groupBy("chunk", "slot")).applyInPandas(run, _STATE)
        )
        proposals = moved.filter("control IS NOT NULL").join(scores, "unit").select("control", "unit", "score", "gap")
        every = proposals if held is None else held.unionByName(proposals)
        if not replace:
            best = F.max(F.struct("score", (-F.col("unit")).alias("neg"), "unit", "gap"))
            every = every.groupBy("control").agg(best.alias("_best")).select(
                "control", "_best.unit", "_best.score", "_best.gap"
            )
        held = checkpointed(every)
        walks = checkpointed(
            walks.join(moved.select("unit", "grp"), ["unit", "grp"], "left_anti")
            .unionByName(moved.select("unit", "grp", *_WALK))
        )
    else:
        raise RuntimeError("matching did not settle")
    if held is None:
        return spark.createDataFrame([], "treated_id long, control_id long, gap double")
    return _pairs(held)


def _cell_numbers(calipers: Mapping[str, float]) -> dict:
    """A hair wider than the caliper, so that rounding cannot push a partner two cells away."""
    return {c: F.floor(F.col(c) / F.lit(float(w) * (1 + 1e-9))) if w > 0 else F.col(c) for c, w in calipers.items()}


def _cells(units: DataFrame, calipers: Mapping[str, float]) -> DataFrame:
    """Controls in their cell, and treated units once in every cell near theirs that has controls."""
    cells = _cell_numbers(calipers)
    controls = units.filter("treated = 0").withColumn(
        "grp", F.concat_ws("|", "grp", *[cell.cast("string") for cell in cells.values()])
    )
    near = units.filter("treated = 1")
    for c, w in calipers.items():
        steps = F.sequence(cells[c] - 1, cells[c] + 1) if w > 0 else F.array(cells[c])
        near = near.withColumn("_cell", F.explode(steps)).withColumn(
            "grp", F.concat_ws("|", "grp", F.col("_cell").cast("string"))
        ).drop("_cell")
    occupied = controls.select("grp").distinct()
    return checkpointed(controls.unionByName(near.join(occupied, "grp", "left_semi")))


def _next_visits(free: DataFrame) -> DataFrame:
    """The chunk each walk has to look into next, and the best bound among the unit's other walks.

    A unit's most promising walk may propose. Its other walks are searched in the same round, so that
    what others have taken meanwhile is known at once. A unit has a few dozen walks at most.
    """
    left, right = (F.struct(*[F.col(f"{n}_{p}").alias(p) for p in ("dist", "tie", "order")]) for n in "lr")
    rows = free.withColumns({"_bound": F.least(left, right), "_left": left <= right}).filter("_bound.dist < double('inf')")
    ranked = W.partitionBy("unit").orderBy("_bound", "grp")
    rows = rows.withColumns({"_rank": F.row_number().over(ranked), "_next": F.lead("_bound").over(ranked)})

    def other(part: str):
        return F.when(F.col("_rank") > 1, -INF).otherwise(F.coalesce(F.col(f"_next.{part}"), F.lit(INF)))

    return rows.withColumns({
        "chunk": F.when(F.col("_left"), F.col("l_chunk")).otherwise(F.col("r_chunk")),
        "o_dist": other("dist"), "o_tie": other("tie"), "o_order": other("order"),
    }).drop("_bound", "_left", "_rank", "_next")


def matched_data(df: DataFrame, pairs: DataFrame, label: str = "is_case", unit: str = "person_id") -> DataFrame:
    """Both ends of every pair with ``weights`` 1 and ``subclass``, the id of the pair's treated unit."""
    ends = pairs.select(F.col("treated_id").alias(unit), F.col("treated_id").alias("subclass"), F.lit(1).alias(label)) \
        .unionByName(
            pairs.select(F.col("control_id").alias(unit), F.col("treated_id").alias("subclass"), F.lit(0).alias(label))
        )
    return df.join(ends, [unit, label]).withColumn("weights", F.lit(1.0))
