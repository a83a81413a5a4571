"""Cost of factorising one column block: ``l`` columns and ``g`` rows below the diagonal block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fitted seconds of dense kernels (per unit of work, and per call).
KERNEL_SECONDS = {
    "gemm": (2.429169e-10, 1.216278e-06),
    "trsm": (2.626177e-10, 0.0),
    "factor": (2.439599e-11, 0.0),
    "trsv": (3.224536e-10, 0.0),
    "gemv": (6.192657e-10, 0.0),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def off_diagonal(l="l", g="g") -> Column:
    """Entries of the block's lower part without the diagonal: l (l + 1) / 2 + g l - l."""
    l, g = _c(l).cast("double"), _c(g).cast("double")
    return l * (l + 1) / 2 + g * l - l


#: Real operations of a multiplication and of an addition.
WEIGHTS = {"real": (1.0, 1.0), "complex": (6.0, 2.0)}


def flops(kind: str, l="l", heights="heights") -> Column:
    """Operations of eliminating a block of ``l`` columns over off-diagonal blocks of the given ``heights`` (an array).

    Dense factor of the diagonal block, a triangular solve of the rows below, and
    a product for each block with itself and all below it; LU does the latter two
    for both sides. The counts of multiplications and additions are LAPACK's, the
    triangular solve being counted with as many additions as multiplications.
    A complex multiplication takes 6 real operations, a complex addition 2.
    """
    base = kind.removeprefix("z")
    if base not in ("llt", "ldlt", "lu"):
        raise ValueError(f"unknown factorisation {kind}")
    times, plus = WEIGHTS["complex" if kind.startswith("z") else "real"]
    l, sides = _c(l).cast("double"), 2.0 if base == "lu" else 1.0
    heights = F.transform(_c(heights), lambda x: x.cast("double"))
    below = F.aggregate(heights, F.lit(0.0), lambda total, x: total + x)
    # a height times itself and all after it: half of (square of the sum + sum of squares)
    pairs = (below * below + F.aggregate(heights, F.lit(0.0), lambda total, x: total + x * x)) / 2
    if base == "lu":
        factor = times * (l**3 / 3 + l * 2 / 3) + plus * (l**3 / 3 - l**2 / 2 + l / 6)
    else:
        factor = times * (l**3 / 6 + l**2 / 2 + l / 3) + plus * (l**3 / 6 - l / 6)
    return factor + sides * (times + plus) * (below * l * (l + 1) / 2 + pairs * l)


def factor_seconds(l="l", g="g") -> Column:
    """Modelled time to factorise a block: diagonal, panel, update."""
    l, g = _c(l).cast("double"), _c(g).cast("double")
    k = KERNEL_SECONDS
    return k["factor"][0] * l**3 + k["trsm"][0] * l * l * g + k["gemm"][0] * l * g * g + k["gemm"][1]


def solve_seconds(l="l", g="g") -> Column:
    """Modelled time of one forward and backward solve with a block."""
    l, g = _c(l).cast("double"), _c(g).cast("double")
    return 2 * (KERNEL_SECONDS["trsv"][0] * l * l + KERNEL_SECONDS["gemv"][0] * l * g)


def merge_gain(la="la", ga="ga", lb="lb", gb="gb", lc="lc", gc="gc") -> Column:
    """Modelled seconds saved by merging two blocks into one of lc columns and gc rows."""
    return factor_seconds(la, ga) + factor_seconds(lb, gb) - factor_seconds(lc, gc)
