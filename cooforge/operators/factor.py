"""Block factorisation and triangular solves by levels of the elimination tree.

Multifrontal: the front of a column block gathers its entries and the updates
from its children, eliminates its columns densely, and sends the rest up as
(destination, i, j, v). Blocks of one level are factorised in parallel, large ones in
an Arrow group each, small ones some dozens to a group; a level's updates are combined before the shuffle. A front is
bounded by its rows, at most ``widest`` of them eliminated.

No row exchanges: a pivot under epsilon in magnitude becomes +epsilon and is
counted. Cholesky raises on a negative pivot before taking its root.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpoint, dealt
from .structure import expand_symmetric, permute, permute_vector

KINDS = ("llt", "ldlt", "lu")
#: Blocks of at most SMALL columns and rows below go to Python by up to TOGETHER of them: 64 fronts of 128 rows are 8 MB.
SMALL, TOGETHER = 128, 64
FRONT = "cblk long, level long, cols array<long>, rows array<long>, diag array<double>, low array<double>, up array<double>, replaced long, dest long, ui array<long>, uj array<long>, uv array<double>"


def factor_dense(a: np.ndarray, l: int, kind: str, epsilon: float) -> int:
    """Eliminate the first l columns in place; how many pivots were replaced.

    Below and right of the first l rows and columns the Schur complement is left.
    llt: L with its diagonal. ldlt: unit L, D on the diagonal, both triangles
    filled with L and (D Lt). lu: unit L below, U above.
    """
    replaced = 0
    for k in range(l):
        pivot = a[k, k]
        if abs(pivot) < epsilon:
            pivot = a[k, k] = epsilon
            replaced += 1
        if kind == "llt":
            if pivot < 0:
                raise ArithmeticError("negative pivot: the matrix is not positive definite")
            a[k, k] = pivot**0.5
            a[k + 1 :, k] /= a[k, k]
            a[k, k + 1 :] = a[k + 1 :, k]
        else:
            a[k + 1 :, k] /= pivot
        a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return replaced


def _batch(size):
    """The group in which a block meets Python: small ones (``size`` columns and rows) by neighbours, others alone."""
    return F.when(size <= SMALL, F.floor(F.col("cblk") / TOGETHER)).otherwise(-F.col("cblk")).cast("long")


def _runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, stop) of runs in sorted values."""
    cuts = np.flatnonzero(np.diff(values)) + 1
    return [(int(values[a]), int(a), int(b)) for a, b in zip([0, *cuts], [*cuts, len(values)])] if len(values) else []


def _front(kind: str, epsilon: float):
    """The fronts of the blocks of a group, one after another."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by = np.argsort(rows["cblk"].to_numpy(), kind="stable")
        c, at, to, level, i, j, v = (rows[name].to_numpy()[by] for name in ("cblk", "first", "last", "level", "i", "j", "v"))
        return pd.DataFrame([one(b, int(level[s]), int(at[s]), int(to[s]), i[s:e], j[s:e], v[s:e]) for b, s, e in _runs(c)])

    def one(cblk, level, first, last, i, j, v):
        held = i > 0
        i, j = i[held], j[held]
        cols = np.arange(first, last + 1)
        below = np.unique(np.concatenate([i, j]))
        index = np.concatenate([cols, below[below > last]])
        l, n = len(cols), len(index)
        a = np.zeros((n, n))
        np.add.at(a, (np.searchsorted(index, i), np.searchsorted(index, j)), v[held])
        replaced = factor_dense(a, l, kind, epsilon)
        rest, dest = index[l:], 0
        ui = uj = uv = np.zeros(0)
        if n > l:
            dest = int(rest[0])  # the column whose block is the parent
            ui, uj, uv = np.repeat(rest, n - l), np.tile(rest, n - l), a[l:, l:].ravel()
        return {
            "cblk": cblk, "level": level, "cols": cols, "rows": rest, "diag": a[:l, :l].ravel(), "low": a[l:, :l].ravel(),
            "up": a[:l, l:].ravel(), "replaced": replaced, "dest": dest, "ui": ui.astype(np.int64), "uj": uj.astype(np.int64), "uv": uv,
        }

    return run


def _to_levels(waiting: dict[int, list[DataFrame]], rows: DataFrame) -> None:
    """Deal rows to the level at which they are read, so that each level reads its own and nothing else."""
    for level, part in dealt(rows, "level").items():
        waiting.setdefault(level, []).append(part)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def factorise(a: DataFrame, analysis: DataFrame, kind: str = "lu", epsilon: float = 1e-31, symmetric_storage: bool = False) -> DataFrame:
    """Fronts of the factor: a row for each column block with its dense parts. Runs a job or two per level."""
    if kind not in KINDS:
        raise ValueError(f"unknown factorisation {kind}")
    full = expand_symmetric(a) if symmetric_storage else a
    analysis = checkpoint(analysis.drop("below"))
    ranges = checkpoint(analysis.groupBy("cblk", "level").agg(F.min("new").alias("first"), F.max("new").alias("last"), _batch(F.count("*") + F.max("rows")).alias("batch")))
    block_of = analysis.select(F.col("new").alias("_col"), "cblk", "level")
    moved = permute(full, analysis.select("old", "new")).withColumn("_col", F.least("i", "j"))
    waiting: dict[int, list[DataFrame]] = {}
    _to_levels(waiting, moved.join(block_of, "_col").select("level", "cblk", "i", "j", "v"))
    fronts, depth = [], analysis.agg(F.max("level")).first()[0]
    for level in range(depth + 1):
        own = ranges.where(F.col("level") == level)
        anchor = own.select("cblk", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"))
        summed = _together([*waiting.pop(level, []), anchor]).groupBy("cblk", "i", "j").agg(F.sum("v").alias("v"))
        done = checkpoint(summed.join(own, "cblk").groupBy("batch").applyInPandas(_front(kind, epsilon), FRONT))
        if level < depth:  # the blocks of the last level are roots
            updates = done.where("dest > 0").select(F.col("dest").alias("_col"), F.explode(F.arrays_zip("ui", "uj", "uv")).alias("u"))
            updates = updates.join(block_of, "_col").select("level", "cblk", F.col("u.ui").alias("i"), F.col("u.uj").alias("j"), F.col("u.uv").alias("v"))
            _to_levels(waiting, updates)
        fronts.append(done.drop("ui", "uj", "uv"))
    return _together(fronts)


def _split(front):
    l = len(front["cols"])
    return np.asarray(front["diag"]).reshape(l, l), np.asarray(front["low"]).reshape(-1, l), np.asarray(front["up"]).reshape(l, -1)


def _triangle(m: np.ndarray, b: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    x = b.copy()
    steps = range(len(m)) if lower else range(len(m) - 1, -1, -1)
    for k in steps:
        if not unit:
            x[k] /= m[k, k]
        others = slice(k + 1, None) if lower else slice(0, k)
        x[others] -= np.outer(m[others, k], x[k])
    return x


def _sweep(kind: str, forward: bool, transposed: bool, sides: list[int]):
    """The blocks of a group in a sweep for all right-hand sides: their unknowns, and forward their contributions to the rows below."""

    def run(fronts: pd.DataFrame, vector: pd.DataFrame) -> pd.DataFrame:
        if not len(fronts):
            return pd.DataFrame({"i": [], "rhs": [], "x": [], "own": []})
        by = np.argsort(vector["to"].to_numpy(), kind="stable")
        to, i, rhs, x = (vector[name].to_numpy()[by] for name in ("to", "i", "rhs", "x"))
        given = {block: slice(s, e) for block, s, e in _runs(to)}
        parts = []
        for front in fronts.to_dict("records"):
            at = given.get(front["cblk"], slice(0, 0))
            parts.append(one(front, i[at], rhs[at], x[at]))
        i, rhs, x, own = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"i": i, "rhs": rhs, "x": x, "own": own})

    def one(front, at, rhs, value):
        diag, low, up = _split(front)
        cols, rows = np.asarray(front["cols"], np.int64), np.asarray(front["rows"], np.int64)
        index = np.concatenate([cols, rows])
        given = np.zeros((len(index), len(sides)))
        np.add.at(given, (np.searchsorted(index, at), np.searchsorted(sides, rhs)), value)
        b, beyond = given[: len(cols)], given[len(cols) :]
        first, second = (up.T, low.T) if transposed and kind == "lu" else (low, up)
        forward_unit = kind != "llt" and not (transposed and kind == "lu")
        if forward:
            triangle = diag.T if transposed and kind == "lu" else diag
            x = _triangle(triangle, b, True, forward_unit)
            x, own = np.concatenate([x, -(first @ x)]), np.repeat([1, 0], [len(cols), len(rows)])
        else:
            triangle = diag.T if kind == "llt" or (transposed and kind == "lu") else diag
            x, own = _triangle(triangle, b - second @ beyond, False, transposed and kind == "lu"), np.ones(len(cols), int)
        return np.repeat(index[: len(x)], len(sides)), np.tile(np.array(sides, np.int64), len(x)), x.ravel(), np.repeat(own, len(sides))

    return run


def solve_factored(fronts: DataFrame, analysis: DataFrame, b: DataFrame, kind: str, transposed: bool = False) -> DataFrame:
    """x with A x = b (or At x = b, for lu), numbered as b. Two jobs or three per level.

    A column rhs tells right-hand sides apart; all go through one sweep, so a
    front's block of unknowns is as wide as there are right-hand sides, whose
    numbers the driver knows. Each level reads only what is dealt to it.
    For ldlt the upper part of a front holds D Lt, so the backward sweep divides by D too.
    """
    several = "rhs" in b.columns
    sides = sorted(r["rhs"] for r in b.select("rhs").distinct().collect()) if several else [0]
    x_of, shape = F.col("x"), "i long, rhs long, x double, own int"
    perm = analysis.select("old", "new")
    fronts = fronts.withColumn("batch", _batch(F.size("cols") + F.size("rows")))
    where = checkpoint(analysis.select(F.col("new").alias("i"), "cblk", "level").join(fronts.select("cblk", "batch"), "cblk").withColumnRenamed("cblk", "to"))
    depth = where.agg(F.max("level")).first()[0]
    moved = b.join(perm, b["i"] == perm["old"]).select(F.col("new").alias("i"), (F.col("rhs") if several else F.lit(0)).cast("long").alias("rhs"), "x")
    fronts_of = dealt(fronts.select("level", "batch", "cblk", "cols", "rows", "diag", "low", "up"), "level")

    def sweep(level, parts, forward):
        vector = _together(parts).groupBy("batch", "to", "i", "rhs").agg(F.sum(x_of).alias("x")) if parts else where.where("false").select("batch", "to", "i", F.lit(0).cast("long").alias("rhs"), F.lit(0.0).alias("x"))
        return checkpoint(fronts_of[level].groupBy("batch").cogroup(vector.groupBy("batch")).applyInPandas(_sweep(kind, forward, transposed, sides), shape))

    waiting: dict[int, list[DataFrame]] = {}
    _to_levels(waiting, moved.join(where, "i").select("level", "batch", "to", "i", "rhs", "x"))
    backward: dict[int, list[DataFrame]] = {}
    for level in range(depth + 1):
        out = sweep(level, waiting.pop(level, []), True)
        backward[level] = [out.where("own = 1").join(where.where(F.col("level") == level), "i").select("batch", "to", "i", "rhs", "x")]
        if level < depth:
            _to_levels(waiting, out.where("own = 0").join(where, "i").select("level", "batch", "to", "i", "rhs", "x"))
    # which fronts need a column above them, dealt by the level of that column
    needs = fronts.select("level", "batch", F.col("cblk").alias("to"), F.explode("rows").alias("i"))
    needs = dealt(needs.join(where.select("i", F.col("level").alias("source")), "i"), "source")
    found = []
    for level in range(depth, -1, -1):
        out = sweep(level, backward.pop(level), False).select("i", "rhs", "x")
        found.append(out)
        if level in needs:
            _to_levels(backward, out.join(needs[level], "i").select("level", "batch", "to", "i", "rhs", "x"))
    back = perm.select(F.col("new").alias("i"), "old")
    return _together(found).join(back, "i").select(F.col("old").alias("i"), *(["rhs"] if several else []), "x")


def factor_entries(fronts: DataFrame) -> DataFrame:
    """(part, i, j, v): the stored factor as entries; part L, U or D (diagonal blocks, both triangles together)."""
    def run(batches):
        for batch in batches:
            for _, f in batch.iterrows():
                diag, low, up = _split(f)
                cols, rows = np.asarray(f["cols"]), np.asarray(f["rows"])
                for part, r, c, m in (("D", cols, cols, diag), ("L", rows, cols, low), ("U", cols, rows, up)):
                    yield pd.DataFrame({"part": part, "i": np.repeat(r, len(c)).astype("int64"), "j": np.tile(c, len(r)).astype("int64"), "v": m.ravel()})

    return fronts.select("cols", "rows", "diag", "low", "up").mapInPandas(run, "part string, i long, j long, v double")


def schur_complement(a: DataFrame, n: int, chosen: DataFrame, epsilon: float = 1e-31, symmetric_storage: bool = False, kind: str = "lu") -> DataFrame:
    """(i, j, v): A22 - A21 A11^-1 A12 over the chosen unknowns (column i), in the user's numbering.

    The other unknowns are analysed and factorised alone; each front's updates that
    reach only chosen unknowns are summed onto A22.
    """
    from .graph import analyse

    full = checkpoint(expand_symmetric(a) if symmetric_storage else a)
    picked = chosen.select("i").distinct()
    inner_i = full.join(picked, "i", "left_anti")
    inner = inner_i.join(picked.withColumnRenamed("i", "j"), "j", "left_anti").select("i", "j", "v")
    corner = full.join(picked, "i", "left_semi").join(picked.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "v")
    ids = a.sparkSession.range(1, n + 1).select(F.col("id").alias("i")).join(picked, "i", "left_anti")
    sides = _schur_solve(full, inner, ids, picked, analyse, epsilon, kind)
    return corner.unionByName(sides).groupBy("i", "j").agg(F.sum("v").alias("v"))


def _schur_solve(full, inner, ids, picked, analyse, epsilon, kind):
    from .structure import isolate

    n_all = ids.count() + picked.count()
    split = isolate(n_all, picked)
    moved = permute(full, split.select("old", "new"))
    m = ids.count()
    local = moved.where((F.col("i") <= m) & (F.col("j") <= m))
    analysis = checkpoint(analyse(local, m, "minimum_degree"))
    # chosen unknowns keep numbers above m and are never eliminated
    order = analysis.select("old", "new", "parent", "rows", "below", "cblk", "level", "subtree")
    keep = split.where("chosen").select(F.col("new").alias("old"), F.col("new").alias("new"))
    perm = order.select("old", "new").unionByName(keep)
    entries = permute(moved, perm).where((F.col("i") <= m) | (F.col("j") <= m))
    block_of = order.select(F.col("new").alias("_col"), "cblk")
    waiting = checkpoint(entries.withColumn("_col", F.least("i", "j")).join(block_of, "_col").select("cblk", "i", "j", "v"))
    ranges = order.groupBy("cblk").agg(F.min("new").alias("first"), F.max("new").alias("last"))
    # borders may join blocks that the inner tree keeps apart, so blocks are taken one after another by number
    out = None
    for level in range(1 + order.agg(F.max("level")).first()[0]):
        own = ranges.join(order.where(F.col("level") == level).select("cblk", "level").distinct(), "cblk")
        anchor = own.select("cblk", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v"))
        summed = waiting.join(own.select("cblk"), "cblk", "left_semi").groupBy("cblk", "i", "j").agg(F.sum("v").alias("v"))
        done = checkpoint(summed.unionByName(anchor).join(own, "cblk").groupBy("cblk").applyInPandas(_front(kind, epsilon), FRONT))
        updates = done.select(F.explode(F.arrays_zip("ui", "uj", "uv")).alias("u")).select(F.col("u.ui").alias("i"), F.col("u.uj").alias("j"), F.col("u.uv").alias("v"))
        up = updates.withColumn("_col", F.least("i", "j"))
        waiting = waiting.unionByName(up.where(F.col("_col") <= m).join(block_of, "_col").select("cblk", "i", "j", "v"))
        ends = up.where(F.col("_col") > m).select("i", "j", "v")
        out = ends if out is None else out.unionByName(ends)
    back = split.where("chosen").select(F.col("new").alias("old"), F.col("old").alias("new"))
    return permute(out, back)
