"""Writers. Parquet is the format to keep; the others are for exchange.

Text formats in one file are written by one task after a distributed sort, since
the format itself is one ordered stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import column_pointers
from ..plans.matrix import SparseMatrix


def save_parquet(matrix: SparseMatrix, folder: str, rhs: DataFrame | None = None) -> None:
    matrix.entries.write.mode("overwrite").parquet(f"{folder}/entries")
    if rhs is not None:
        rhs.write.mode("overwrite").parquet(f"{folder}/rhs")
    meta = matrix.spark.range(1).select(F.lit(matrix.rows).alias("rows"), F.lit(matrix.cols).alias("cols"), F.lit(matrix.symmetry).alias("symmetry"), F.lit(matrix.dof).alias("dof"), F.lit(rhs is not None).alias("has_rhs"))
    meta.coalesce(1).write.mode("overwrite").parquet(f"{folder}/meta")


def save_table(df: DataFrame, path: str, separator: str = " ") -> None:
    """Any relation (entries, vector, permutation, blocks) as separated text, in parallel."""
    df.write.mode("overwrite").csv(path, sep=separator, header=False)


def number(column: str):
    """A double as text that reads back as the same double."""
    return F.col(column).cast("string")


def matrix_market_lines(matrix: SparseMatrix) -> DataFrame:
    """(at, line): banner, size and entries, column after column."""
    complex_values = dict(matrix.entries.dtypes)["v"] != "double"
    value = [F.col("v.re").cast("string"), F.col("v.im").cast("string")] if complex_values else [number("v")]
    count = matrix.entries.agg(F.count("*").alias("n"))
    spark = matrix.spark
    field = "complex" if complex_values else "real"
    first = spark.range(1).select(F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("i"), F.lit(f"%%MatrixMarket matrix coordinate {field} {matrix.symmetry}").alias("line"))
    size = count.select(F.lit(0).cast("long").alias("j"), F.lit(1).cast("long").alias("i"), F.concat_ws(" ", F.lit(matrix.rows), F.lit(matrix.cols), "n").alias("line"))
    body = matrix.entries.select("j", "i", F.concat_ws(" ", "i", "j", *value).alias("line"))
    return first.unionByName(size).unionByName(body)


def write_matrix_market(matrix: SparseMatrix, path: str) -> None:
    matrix_market_lines(matrix).orderBy("j", "i").coalesce(1).select("line").write.mode("overwrite").text(path)


def csc_text_lines(matrix: SparseMatrix) -> DataFrame:
    """(part, at, line): compressed columns as text, four numbers to a line."""
    n, spark = matrix.cols, matrix.spark
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(f"{n} 1 1").alias("line"))
    pointers = column_pointers(matrix.entries, n).select(F.lit(1).alias("part"), (F.col("j") - 1).alias("k"), F.col("ptr").cast("string").alias("w"))
    from pyspark.sql import Window

    ordered = matrix.entries.join(column_pointers(matrix.entries, n), "j").withColumn("k", F.col("ptr") - 2 + F.row_number().over(Window.partitionBy("j").orderBy("i")))
    rows = ordered.select(F.lit(2).alias("part"), "k", F.col("i").cast("string").alias("w"))
    values = ordered.select(F.lit(3).alias("part"), "k", number("v").alias("w"))
    lines = pointers.unionByName(rows).unionByName(values).groupBy("part", F.floor(F.col("k") / 4).alias("at"))
    body = lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda s: s["w"]), " ").alias("line"))
    return head.unionByName(body)


def write_csc_text(matrix: SparseMatrix, path: str) -> None:
    csc_text_lines(matrix).orderBy("part", "at").coalesce(1).select("line").write.mode("overwrite").text(path)


def harwell_boeing_text(matrix: SparseMatrix, title: str = "", key: str = "") -> str:
    """A real assembled matrix as Harwell-Boeing text, made on the driver; for matrices of exchange size."""
    rows = matrix.entries.orderBy("j", "i").collect()
    pointers, at = [1], 0
    for j in range(1, matrix.cols + 1):
        while at < len(rows) and rows[at]["j"] == j:
            at += 1
        pointers.append(at + 1)

    def cards(values, per, width, spell):
        return ["".join(spell(v).rjust(width) for v in values[k : k + per]) for k in range(0, len(values), per)]

    parts = [cards(pointers, 8, 10, str), cards([r["i"] for r in rows], 8, 10, str), cards([r["v"] for r in rows], 3, 25, lambda v: f"{v:.16E}")]
    kind = "RSA" if matrix.symmetry == "symmetric" else "RUA" if matrix.rows == matrix.cols else "RRA"
    counts = [sum(map(len, parts)), *map(len, parts), 0]
    head = [
        f"{title[:72]:<72}{key[:8]:<8}", "".join(f"{c:14d}" for c in counts),
        f"{kind}{'':11}" + "".join(f"{c:14d}" for c in (matrix.rows, matrix.cols, len(rows), 0)), f"{'(8I10)':<16}{'(8I10)':<16}{'(3E25.16)':<20}{'':<20}",
    ]
    return "\n".join([*head, *parts[0], *parts[1], *parts[2]]) + "\n"
