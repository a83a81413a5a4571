"""Queries over the driver's tables, one or more for each operator, with the SQL that must give the same rows.

A is parts x suppliers with the summed quantity, taken as square where an
operator wants that (its pattern is not symmetric); S is nations x nations
(supplier's by customer's); the tree is a symmetric positive definite matrix over
regions, nations, suppliers and customers, each tied to the one it belongs to.
A and the tree grow with the tables. Vectors have x_j = j unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import blocks, complexes, cost
from .operators import dashboard, graph, krylov, norms, ordered, partition, products, structure
from .operators.assembly import Assembly, subset
from .operators.factor import factor_entries, factorise, schur_complement, solve_factored
from .plans.config import SolverConfig
from .plans.lineage import checkpoint
from .plans.matrix import SparseMatrix, from_table
from .plans.solver import ComplexSolver, SparseSolver
from .sources.readers import laplacian, load_matrix
from .sources.writers import csc_text_lines, harwell_boeing_text, matrix_market_lines, save_parquet

NATIONS = 25
A_SQL = "a AS (SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"
S_SQL = """s AS (SELECT CAST(s_nationkey AS BIGINT) + 1 AS i, CAST(c_nationkey AS BIGINT) + 1 AS j, sum(l_quantity) AS v
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
T_SQL = A_SQL + ", t AS (SELECT * FROM a)"
#: The order of A as a square matrix, and of the tree.
PARTS_SQL = "(SELECT max(p_partkey) + 1 FROM part)"
TREE_SQL = "(SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer))"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def raw(spark, d):
    return from_table(read(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_quantity")


def A(spark, d):
    return products.merge_duplicates(raw(spark, d))


def S(spark, d):
    """Quantities by nation pair. Summed by customer and supplier keys on the way, before the small tables are joined."""
    li = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    joined = (
        li.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), li["l_suppkey"] == F.col("s_suppkey"))
        .join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    )
    return products.merge_duplicates(from_table(joined, "s_nationkey", "c_nationkey", "l_quantity"))


def T(spark, d):
    """A as a square matrix."""
    return A(spark, d)


def parts(spark, d) -> int:
    return read(spark, d, "part").agg(F.max("p_partkey")).first()[0] + 1


def tree(spark, d) -> tuple[DataFrame, int]:
    """The tree's lower triangle, -1 for each tie and a dominant diagonal, and its order: regions, nations, suppliers, customers."""
    regions, nations, suppliers = (read(spark, d, t).count() for t in ("region", "nation", "supplier"))
    ties = [("nation", "n_nationkey", "n_regionkey", regions, 0), ("supplier", "s_suppkey", "s_nationkey", regions + nations, regions), ("customer", "c_custkey", "c_nationkey", regions + nations + suppliers, regions)]
    off = [read(spark, d, t).select((F.col(k).cast("long") + at + 1).alias("i"), (F.col(of).cast("long") + above + 1).alias("j"), F.lit(-1.0).alias("v")) for t, k, of, at, above in ties]
    off = off[0].unionByName(off[1]).unionByName(off[2])
    n = regions + nations + suppliers + read(spark, d, "customer").count()
    diagonal = spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))
    full = structure.dominant_diagonal(structure.expand_symmetric(off.unionByName(diagonal)))
    return checkpoint(structure.lower_triangle(full)), n


def index_vector(spark, n):
    return products.generated_vector(spark, n, "i")


def by_index(a: DataFrame, side: str) -> DataFrame:
    """x_k = k over the indices that the matrix uses."""
    return a.select(F.col(side).alias("i")).distinct().withColumn("x", F.col("i").cast("double"))


def query(sql: str | None = None, *ctes: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


# Sources and restructuring


@query("SELECT i, j, v FROM a", A_SQL)
def build_entries(spark, d):
    return A(spark, d)


@query("SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def merge_duplicates(spark, d):
    return products.merge_duplicates(raw(spark, d))


@query("SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, count(*) AS entries FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_report(spark, d):
    return products.duplicates(raw(spark, d))


for _name, _f, _sql in (
    ("no_diag", structure.no_diagonal, "SELECT * FROM s WHERE i <> j"),
    ("transpose", structure.transpose, "SELECT j AS i, i AS j, v FROM s"),
    ("lower_triangle", structure.lower_triangle, "SELECT * FROM s WHERE i >= j"),
    ("upper_triangle", structure.upper_triangle, "SELECT * FROM s WHERE i <= j"),
    ("rebase_to_zero", lambda a: structure.rebase(a, 1, 0), "SELECT i - 1 AS i, j - 1 AS j, v FROM s"),
    ("expand_symmetric", lambda a: structure.expand_symmetric(structure.lower_triangle(a)), "SELECT i, j, v FROM s WHERE i >= j UNION ALL SELECT j, i, v FROM s WHERE i > j"),
    ("drop_small", lambda a: structure.drop_small(a, 100.0), "SELECT * FROM s WHERE abs(v) > 100"),
    ("drop_zeros", lambda a: structure.drop_zeros(a.select("i", "j", (F.col("v") - F.col("v") * (F.col("i") == F.col("j")).cast("double")).alias("v"))), "SELECT * FROM s WHERE i <> j AND v <> 0"),
    ("keep_where", lambda a: structure.keep_where(a, "i + j > 20 AND v > 50"), "SELECT * FROM s WHERE i + j > 20 AND v > 50"),
    ("unit_diagonal", structure.unit_diagonal, "SELECT i, j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM s"),
    ("pattern", structure.pattern, "SELECT DISTINCT i, j FROM s"),
    ("column_count", lambda a: structure.column_count(a, 3), "SELECT count(*) AS entries FROM s WHERE j = 3"),
    ("column_rows", lambda a: structure.column_rows(a, 3), "SELECT i FROM s WHERE j = 3"),
    ("found_base", structure.found_base, "SELECT least(min(i), min(j)) AS base FROM s"),
):
    query(_sql, S_SQL, name=_name)(lambda spark, d, f=_f: f(S(spark, d)))

for _name, _f, _sql in (
    ("missing_mirrors", structure.missing_mirrors, "SELECT t.j AS i, t.i AS j FROM t WHERE i <> j AND NOT EXISTS (SELECT 1 FROM t u WHERE u.i = t.j AND u.j = t.i)"),
    ("symmetrize_pattern", structure.symmetrize_pattern, "SELECT * FROM t UNION ALL SELECT t.j, t.i, 0.0::DOUBLE FROM t WHERE i <> j AND NOT EXISTS (SELECT 1 FROM t u WHERE u.i = t.j AND u.j = t.i)"),
    ("check_symmetry_missing", lambda a: structure.missing_mirrors(a).agg(F.count("*").alias("missing")), "SELECT count(*) AS missing FROM t WHERE i <> j AND NOT EXISTS (SELECT 1 FROM t u WHERE u.i = t.j AND u.j = t.i)"),
    ("dominant_diagonal", structure.dominant_diagonal, "SELECT i, j, CASE WHEN i = j THEN sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) OVER (PARTITION BY j) + 1 ELSE v END AS v FROM t"),
    ("model_dominance", structure.model_dominance, "SELECT i, j, CASE WHEN i = j THEN 2.0 * count(*) OVER (PARTITION BY j) - 1.0 ELSE -0.8 END::DOUBLE AS v FROM t"),
    ("add_edges", lambda a: structure.add_edges(a, a.select(F.col("j").alias("i"), F.col("i").alias("j"))), "SELECT * FROM t UNION ALL SELECT j, i, 0.0::DOUBLE FROM t"),
    ("diag_counts", norms.diagonal_counts, "SELECT count(*) FILTER (i > j) AS lower, count(*) FILTER (i = j) AS diagonal, count(*) FILTER (i < j) AS upper FROM t"),
):
    query(_sql, T_SQL, name=_name)(lambda spark, d, f=_f: f(T(spark, d)))


@query("SELECT i, j FROM t WHERE i <> j UNION SELECT j, i FROM t WHERE i <> j", T_SQL)
def ordering_graph(spark, d):
    """Of T's rows before duplicates are merged, which the graph does not see."""
    return structure.graph_of(raw(spark, d))


@query(f"SELECT * FROM t UNION ALL SELECT k, k, 0.0::DOUBLE FROM (SELECT unnest(range(1, {PARTS_SQL} + 1)) AS k)", T_SQL)
def add_zero_diagonal(spark, d):
    return structure.add_zero_diagonal(T(spark, d), parts(spark, d))


@query(f"SELECT k AS old, row_number() OVER (ORDER BY (v IS NULL), k) AS new, v IS NULL AS weak FROM (SELECT unnest(range(1, {PARTS_SQL} + 1)) AS k) LEFT JOIN t ON i = k AND j = k", T_SQL)
def split_zero_diag(spark, d):
    return structure.split_weak_diagonal(T(spark, d), parts(spark, d), 1e-31)


#: The tree's ties, each both ways, and its diagonal.
TIES_SQL = """u AS (SELECT CAST(n_nationkey AS BIGINT) + 6 AS i, CAST(n_regionkey AS BIGINT) + 1 AS j FROM nation
UNION ALL SELECT s_suppkey + 31, CAST(s_nationkey AS BIGINT) + 6 FROM supplier
UNION ALL SELECT c_custkey + 31 + (SELECT count(*) FROM supplier), CAST(c_nationkey AS BIGINT) + 6 FROM customer),
g AS (SELECT i, j FROM u UNION ALL SELECT j, i FROM u UNION ALL SELECT k, k FROM (SELECT unnest(range(1, """ + TREE_SQL + """ + 1)) AS k))"""


@query("SELECT i, j, min(level) AS level FROM p GROUP BY 1, 2", TIES_SQL, "p AS (SELECT i, j, 0 AS level FROM g UNION ALL SELECT x.i, y.j, 1 FROM g x JOIN g y ON x.j = y.i WHERE x.i > x.j AND y.i < y.j)")
def fill_levels_one(spark, d):
    """The leaves of a nation meet once it is eliminated, for nations come before their suppliers and customers."""
    return graph.fill_levels(tree(spark, d)[0], 1)


def _perm(spark):
    return spark.range(1, NATIONS + 1).select(F.col("id").alias("old"), (F.col("id") * 7 % NATIONS + 1).alias("new"))


P_SQL = "p AS (SELECT range AS old, range * 7 % 25 + 1 AS new FROM range(1, 26))"
for _name, _f, _sql in (
    ("col_perm", structure.permute_columns, "SELECT i, new AS j, v FROM s JOIN p ON j = old"),
    ("row_perm", structure.permute_rows, "SELECT new AS i, j, v FROM s JOIN p ON i = old"),
    ("sym_perm", structure.permute, "SELECT p.new AS i, q.new AS j, v FROM s JOIN p ON i = p.old JOIN p q ON j = q.old"),
    ("invert_perm", lambda a, p: structure.invert_permutation(p), "SELECT new AS old, old AS new FROM p"),
    ("check_permutation", lambda a, p: graph.check_permutation(p, NATIONS), "SELECT 0 AS bad_old, 0 AS bad_new, 0 AS extra"),
    ("permute_rhs", lambda a, p: structure.permute_vector(index_vector(p.sparkSession, NATIONS), p), "SELECT new AS i, old::DOUBLE AS x FROM p"),
):
    query(_sql, S_SQL, P_SQL, name=_name)(lambda spark, d, f=_f: f(S(spark, d), _perm(spark)))

for _name, _f, _sql in (
    ("row_scale", structure.scale_rows, "SELECT i, j, v * i AS v FROM s"),
    ("col_scale", structure.scale_columns, "SELECT i, j, v * j AS v FROM s"),
    ("row_unscale", structure.unscale_rows, "SELECT i, j, round(v / i, 6) AS v FROM s"),
    ("col_unscale", structure.unscale_columns, "SELECT i, j, round(v / j, 6) AS v FROM s"),
    ("unscale_both", structure.unscale, "SELECT i, j, round(v / i / j, 6) AS v FROM s"),
    ("scale_diagonal", structure.scale_diagonal, "SELECT i, j, CASE WHEN i = j THEN v * i ELSE v END AS v FROM s"),
):
    query(_sql, S_SQL, name=_name)(lambda spark, d, f=_f: f(S(spark, d), index_vector(spark, NATIONS)).withColumn("v", F.round("v", 6)))


def _ids(spark, *values, name="i"):
    return spark.range(1, NATIONS + 1).where(F.col("id").isin(*values)).select(F.col("id").alias(name))


for _name, _f, _sql in (
    ("drop_nodes", structure.drop_nodes, "SELECT * FROM s WHERE i = j OR NOT (i IN (2, 5, 7) AND j IN (2, 5, 7))"),
    ("drop_rows", structure.drop_rows, "SELECT * FROM s WHERE i = j OR i NOT IN (2, 5, 7)"),
    ("drop_cols", lambda a, m: structure.drop_columns(a, m.withColumnRenamed("i", "j")), "SELECT * FROM s WHERE i = j OR j NOT IN (2, 5, 7)"),
    ("remove_columns", lambda a, m: structure.without_columns(a, m.withColumnRenamed("i", "j")), "SELECT * FROM s WHERE j NOT IN (2, 5, 7)"),
    ("only_columns", lambda a, m: structure.only_columns(a, m.withColumnRenamed("i", "j")), "SELECT * FROM s WHERE j IN (2, 5, 7)"),
    ("isolate_unknowns", lambda a, m: structure.isolate(NATIONS, m), "SELECT range AS old, row_number() OVER (ORDER BY range IN (2, 5, 7), range) AS new, range IN (2, 5, 7) AS chosen FROM range(1, 26)"),
    ("isolated_submatrix", lambda a, m: structure.induced(a, structure.isolate(NATIONS, m), "chosen", True), "SELECT q.n AS i, r.n AS j, v FROM s JOIN (VALUES (2, 1), (5, 2), (7, 3)) q(o, n) ON i = q.o JOIN (VALUES (2, 1), (5, 2), (7, 3)) r(o, n) ON j = r.o"),
    ("solution_subset", lambda a, m: subset(index_vector(a.sparkSession, NATIONS), m), "SELECT i, x FROM (VALUES (2, 2.0::DOUBLE), (5, 5.0), (7, 7.0)) t(i, x)"),
    ("local_numbers", lambda a, m: structure.local_numbers(m.withColumnRenamed("i", "j")), "SELECT j, local FROM (VALUES (2, 1), (5, 2), (7, 3)) t(j, local)"),
):
    query(_sql, S_SQL, name=_name)(lambda spark, d, f=_f: f(S(spark, d), _ids(spark, 2, 5, 7)))


# Products


@query("SELECT i, sum(v * j) AS x FROM a GROUP BY i", A_SQL)
def spmv(spark, d):
    """A x. The vector is made from the columns themselves, so nothing assumes their number."""
    a = A(spark, d)
    return products.multiply_vector(a, by_index(a, "j"))


@query("SELECT j AS i, sum(v * i) AS x FROM a GROUP BY j", A_SQL)
def spmv_transpose(spark, d):
    a = A(spark, d)
    return products.multiply_vector(a, by_index(a, "i"), transposed=True)


@query("SELECT range AS i, coalesce(x, 0) AS x FROM range(1, 26) LEFT JOIN (SELECT i, sum(v * j) AS x FROM s WHERE i > 5 GROUP BY i) ON i = range", S_SQL)
def spmv_empty_rows(spark, d):
    ids = spark.range(1, NATIONS + 1).select(F.col("id").alias("i"))
    return products.multiply_vector(S(spark, d).where("i > 5"), index_vector(spark, NATIONS), ids=ids)


@query("SELECT i, rhs, sum(v * j * rhs) AS x FROM s, (SELECT range AS rhs FROM range(1, 4)) GROUP BY 1, 2", S_SQL)
def spmv_many(spark, d):
    x = spark.range(1, NATIONS + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("rhs")).withColumn("x", (F.col("i") * F.col("rhs")).cast("double"))
    return products.multiply_vector(S(spark, d), x)


@query("SELECT i, 1000.0 * i + sum(v * j) AS x FROM s GROUP BY i", S_SQL)
def gaxpy(spark, d):
    y = products.scaled_vector(index_vector(spark, NATIONS), 1000.0)
    return products.product_plus(S(spark, d), index_vector(spark, NATIONS), y)


@query("SELECT i, i - sum(v * j) AS x FROM s GROUP BY i", S_SQL)
def residual(spark, d):
    return products.residual(S(spark, d), index_vector(spark, NATIONS), index_vector(spark, NATIONS))


@query("SELECT i, i + sum(abs(v) * j) AS x FROM s GROUP BY i", S_SQL)
def abs_residual_bound(spark, d):
    return products.magnitude_bound(S(spark, d), index_vector(spark, NATIONS), index_vector(spark, NATIONS))


@query("SELECT x.i AS i, y.j AS j, sum(x.v * y.v) AS v FROM s x JOIN s y ON x.j = y.i GROUP BY 1, 2", S_SQL)
def mat_mul(spark, d):
    return products.multiply(S(spark, d), S(spark, d))


@query("SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2 * v AS v FROM s UNION ALL SELECT j, i, 3 * v FROM s) GROUP BY 1, 2", S_SQL)
def add_matrices(spark, d):
    a = checkpoint(S(spark, d))
    return products.add(a, structure.transpose(a), 2.0, 3.0)


for _rule, _sql in (
    ("add", "coalesce(b.v, 0) + coalesce(c.v, 0)"), ("keep", "coalesce(b.v, c.v)"), ("max", "greatest(b.v, c.v)"), ("min", "least(b.v, c.v)"), ("ovw", "coalesce(c.v, b.v)"),
):
    query(
        f"SELECT i, j, {_sql} AS v FROM b FULL JOIN c USING (i, j)", T_SQL, "b AS (SELECT * FROM t)", "c AS (SELECT j AS i, i AS j, v FROM t WHERE i IN (SELECT j FROM t))", name=f"addlocal_{_rule}",
    )(lambda spark, d, rule=_rule: (lambda t: products.merge_local(t, structure.transpose(t), rule))(checkpoint(T(spark, d))))


@query("SELECT i, rhs, sum(v) * rhs AS x FROM s, (SELECT range AS rhs FROM range(1, 3)) GROUP BY 1, 2", S_SQL)
def rhs_ones(spark, d):
    return products.generated_rhs(checkpoint(S(spark, d)), NATIONS, "1", rhs=2)


@query("SELECT i, sum(v * j) AS x FROM s GROUP BY i", S_SQL)
def rhs_xi(spark, d):
    return products.generated_rhs(S(spark, d), NATIONS, "i")


@query("SELECT sum(range * range)::DOUBLE AS dot FROM range(1, 26)")
def dot(spark, d):
    return products.dot(index_vector(spark, NATIONS), index_vector(spark, NATIONS))


@query("SELECT range AS i, (range + 2.5 * range)::DOUBLE AS x FROM range(1, 26)")
def axpy(spark, d):
    return products.axpy(2.5, index_vector(spark, NATIONS), index_vector(spark, NATIONS))


@query("SELECT i, j, v * (i + j) AS re, v * (i * j - 1) AS im FROM s", S_SQL)
def complex_product(spark, d):
    one = complexes.make(F.col("v"), F.col("v") * F.col("i"))
    two = complexes.make(F.col("j"), F.lit(-1.0))
    e = complexes.multiply(one, two)
    return S(spark, d).select("i", "j", e["re"].alias("re0"), e["im"].alias("im0")).select("i", "j", (F.col("re0")).alias("re"), F.col("im0").alias("im"))


# Aggregates and order


for _name, _f, _sql in (
    ("norm1", norms.norm_one, "SELECT max(c) AS norm1 FROM (SELECT sum(abs(v)) AS c FROM a GROUP BY j)"),
    ("norm_max_col", lambda a: norms.side_norm(a, "j", "max"), "SELECT j, max(abs(v)) AS norm FROM a GROUP BY j"),
    ("norm_max_row", lambda a: norms.side_norm(a, "i", "max"), "SELECT i, max(abs(v)) AS norm FROM a GROUP BY i"),
    ("norm2_col", lambda a: norms.side_norm(a, "j", "two").withColumn("norm", F.round("norm", 6)), "SELECT j, round(sqrt(sum(v * v)), 6) AS norm FROM a GROUP BY j"),
    ("norm2_row", lambda a: norms.side_norm(a, "i", "two").withColumn("norm", F.round("norm", 6)), "SELECT i, round(sqrt(sum(v * v)), 6) AS norm FROM a GROUP BY i"),
    ("norm2_col_squared", lambda a: norms.side_norm(a, "j", "two", squared=True), "SELECT j, sum(v * v) AS norm FROM a GROUP BY j"),
    ("matrix_summary", norms.summary, "SELECT count(*) AS entries, count(DISTINCT i) AS rows_used, count(DISTINCT j) AS cols_used, max(abs(v)) AS largest, sum(abs(v)) AS magnitude FROM a"),
    ("majority_owner", lambda a: partition.majority_owner(a.withColumn("rank", F.col("i") % 4)), "SELECT j, rank AS owner FROM (SELECT j, i % 4 AS rank, row_number() OVER (PARTITION BY j ORDER BY count(*) DESC, i % 4 DESC) AS k FROM a GROUP BY j, i % 4) WHERE k = 1"),
    ("cyclic_owner", lambda a: a.select("j").distinct().select("j", partition.cyclic_owner("j", 8).alias("owner")), "SELECT DISTINCT j, CAST((j - 1) % 8 AS INTEGER) AS owner FROM a"),
    ("contiguous_owner", lambda a: a.select("j").distinct().select("j", partition.contiguous_owner("j", 8, 1000).alias("owner")), "SELECT DISTINCT j, CAST(floor((j - 1) * 8 / 1000) AS INTEGER) AS owner FROM a"),
    ("distribute_columns", lambda a: partition.distribute(a, 8, 1000).groupBy("owner").agg(F.count("*").alias("entries"), F.sum("v").alias("v")), "SELECT CAST((j - 1) % 8 AS INTEGER) AS owner, count(*) AS entries, sum(v) AS v FROM a GROUP BY 1"),
):
    query(_sql, A_SQL, name=_name)(lambda spark, d, f=_f: f(A(spark, d)))


@query("SELECT round(sqrt(sum(x * x)), 6) AS norm2 FROM (SELECT i, sum(v * j) AS x FROM a GROUP BY i)", A_SQL)
def norm2(spark, d):
    return norms.norm_two(spmv(spark, d)).select(F.round("norm2", 6).alias("norm2"))


@query("SELECT round(sqrt(sum(r * r) / sum(b * b)), 6) AS error FROM (SELECT i - sum(v * j) AS r, i AS b FROM s GROUP BY i)", S_SQL)
def relative_error(spark, d):
    return norms.relative_error(residual(spark, d), index_vector(spark, NATIONS)).select(F.round("error", 6).alias("error"))


@query("SELECT round(max(abs(i - p) / abs(i + p)), 9) AS berr FROM (SELECT i, sum(v * j) AS p FROM s GROUP BY i)", S_SQL)
def berr(spark, d):
    return norms.backward_error(residual(spark, d), abs_residual_bound(spark, d)).select(F.round("berr", 9).alias("berr"))


@query(f"SELECT k AS j, CAST(coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS ptr FROM (SELECT unnest(range(1, {PARTS_SQL} + 2)) AS k) LEFT JOIN (SELECT j, count(*) AS c FROM t GROUP BY j) ON j = k", T_SQL)
def prefix_colptr(spark, d):
    return ordered.column_pointers(T(spark, d), parts(spark, d))


@query("SELECT i, j, v FROM s", S_SQL)
def sort_columns(spark, d):
    return ordered.sort_within_columns(S(spark, d))


@query("SELECT i, j, v FROM s ORDER BY v DESC, i, j LIMIT 10", S_SQL)
def queue_least(spark, d):
    return ordered.sorted_by(S(spark, d), "-v", "i", "j").limit(10)


@query(", n AS (SELECT i, list(DISTINCT j) AS l FROM t GROUP BY i) SELECT i, CAST(len(l) AS INTEGER) AS degree, list_sum(l)::BIGINT AS total FROM n", T_SQL)
def adjacency(spark, d):
    n = ordered.adjacency(T(spark, d))
    return n.select("i", F.size("neighbours").alias("degree"), F.aggregate("neighbours", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT i, count(DISTINCT j) AS degree FROM (SELECT i, j FROM t UNION ALL SELECT j, i FROM t) GROUP BY i", T_SQL)
def merged_sets(spark, d):
    t = checkpoint(T(spark, d))
    both = ordered.merged_sets(ordered.adjacency(t), ordered.adjacency(structure.transpose(t)))
    return both.select("i", F.size("neighbours").cast("long").alias("degree"))


@query("SELECT cblk, part, first, last FROM (SELECT 1 AS cblk, unnest([0, 1, 2]) AS part, unnest([1, 9, 17]) AS first, unnest([8, 16, 20]) AS last UNION ALL SELECT 2, 0, 21, 25)")
def split_ranges(spark, d):
    ranges = spark.sql("SELECT * FROM VALUES (1L, 1L, 20L), (2L, 21L, 25L) AS t(cblk, first, last)")
    return ordered.split_ranges(ranges, 8)


@query("SELECT start, stop FROM (VALUES (1, 4), (5, 10), (11, 15)) t(start, stop)")
def interval_sweep(spark, d):
    return ordered.interval_sweep(spark.sql("SELECT * FROM VALUES (1L, 10L), (5L, 15L) AS t(first, last)"))


@query("SELECT s_nationkey + 1 AS i, count(*) AS nodes FROM supplier GROUP BY 1")
def element_owners(spark, d):
    """Suppliers as elements of the node of their nation."""
    elements = read(spark, d, "supplier").select(F.col("s_suppkey").alias("element"), (F.col("s_nationkey") + 1).alias("node"))
    owners = spark.range(1, NATIONS + 1).select(F.col("id").cast("int").alias("node"), F.col("id").cast("int").alias("owner"))
    return partition.element_owner(elements, owners).groupBy(F.col("owner").alias("i")).agg(F.count("*").alias("nodes"))


# Assembly


@query("SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, 2 * sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2")
def assembly_add(spark, d):
    return Assembly(spark, 0).add_values(raw(spark, d)).add_values(raw(spark, d)).matrix()


def _ordered_pieces(spark, d):
    li = read(spark, d, "lineitem")
    return li.select((F.col("l_partkey") + 1).alias("i"), (F.col("l_suppkey") + 1).alias("j"), F.col("l_quantity").alias("v"), (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 1000 + F.col("l_quantity").cast("long")).alias("seq"))


L_SQL = "l AS (SELECT l_partkey + 1 AS i, l_suppkey + 1 AS j, l_quantity AS v, l_orderkey * 100000 + l_linenumber * 1000 + CAST(l_quantity AS BIGINT) AS seq FROM lineitem)"
for _rule, _sql in (("ovw", "arg_max(v, seq)"), ("keep", "arg_min(v, seq)"), ("max", "max(v)"), ("min", "min(v)")):
    query(f"SELECT i, j, {_sql} AS v FROM l GROUP BY 1, 2", L_SQL, name=f"assembly_{_rule}")(
        lambda spark, d, rule=_rule: Assembly(spark, 0, rule).add_values(_ordered_pieces(spark, d)).matrix()
    )


@query("SELECT i, j, v + 1 AS v FROM s", S_SQL)
def assembly_sequence(spark, d):
    s = checkpoint(S(spark, d).withColumn("seq", F.col("i") * 100 + F.col("j")))
    session = Assembly(spark, NATIONS).set_sequence(1, s)
    session.use_sequence(1, s.select("seq", "v")).use_sequence(1, s.select("seq", F.lit(1.0).alias("v")))
    return session.matrix(expected=None)


@query("SELECT i, j, v FROM (VALUES (1, 1, 1.0::DOUBLE), (2, 1, 2.0), (1, 2, 3.0), (2, 2, 5.0), (3, 2, 2.0), (2, 3, 3.0), (3, 3, 4.0)) t(i, j, v)")
def assembly_blocks(spark, d):
    """Two dense blocks that overlap at (2, 2)."""
    b = spark.sql("SELECT * FROM VALUES (array(1L, 2L), array(1L, 2L), array(1D, 2D, 3D, 4D)), (array(2L, 3L), array(2L, 3L), array(1D, 2D, 3D, 4D)) AS t(rows, cols, values)")
    return Assembly(spark, 3).add_block_values(b).matrix()


@query("SELECT (i - 1) * 2 + k % 2 + 1 AS i, (j - 1) * 2 + k // 2 + 1 AS j, v * (k + 1) AS v FROM s, (SELECT range AS k FROM range(4))", S_SQL)
def assembly_node_blocks(spark, d):
    b = S(spark, d).select("i", "j", F.array(*[F.col("v") * k for k in range(1, 5)]).alias("values"))
    return Assembly(spark, NATIONS, dof=2).add_node_values(b).matrix()


@query("SELECT count(*) AS blocks, sum(v) AS total FROM s", S_SQL)
def collected_blocks(spark, d):
    b = blocks.collect_blocks(blocks.explode_blocks(S(spark, d).select("i", "j", F.array("v", F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("values")), 2), 2)
    return b.agg(F.count("*").alias("blocks"), F.sum(F.col("values")[0]).alias("total"))


@query("SELECT i, j FROM t UNION SELECT j, i FROM t", T_SQL)
def assembly_graph(spark, d):
    t = checkpoint(T(spark, d))
    return Assembly(spark, parts(spark, d)).add_edges(t).add_edges(structure.transpose(t)).close_graph()


@query("SELECT range AS i, coalesce(x, 0) AS x FROM range(1, 26) LEFT JOIN (SELECT j AS i, sum(v) AS x FROM s WHERE j > 4 GROUP BY j) ON i = range", S_SQL)
def assembly_rhs(spark, d):
    return Assembly(spark, NATIONS).set_rhs(S(spark, d).where("j > 4").select(F.col("j").alias("i"), F.col("v").alias("x"))).current_rhs()


@query("SELECT i, max(x) AS x FROM (SELECT i, j % 3 AS r, sum(v) AS x FROM s GROUP BY 1, 2) GROUP BY i", S_SQL)
def assembly_rhs_two_rules(spark, d):
    values = S(spark, d).select("i", (F.col("j") % 3).alias("rank"), F.col("v").alias("x"))
    return Assembly(spark, NATIONS).set_rhs(values, "ADD", "MAX").current_rhs()


# Graphs and factors


@query("SELECT range AS i, range AS j, 2.0::DOUBLE AS v FROM range(1, 101) UNION ALL SELECT range + 1, range, -1.0 FROM range(1, 100)", name="laplacian")
def laplacian_entries(spark, d):
    return laplacian(spark, 100)[0].entries


@query("SELECT range AS node, CASE WHEN range < 20 THEN range + 1 END AS parent, CAST(20 - range AS INTEGER) AS height FROM range(1, 21)")
def etree_levels(spark, d):
    """The elimination tree of a tridiagonal matrix in its own order is a path."""
    m, _ = laplacian(spark, 20)
    return graph.tree_depths(checkpoint(graph.tree_edges(graph.analyse(m.entries, 20, "natural"))))


@query("SELECT range AS cblk, range AS first, CASE WHEN range = 19 THEN 20 ELSE range END AS last FROM range(1, 20)")
def supernode_intervals(spark, d):
    m, _ = laplacian(spark, 20)
    return graph.column_ranges(graph.analyse(m.entries, 20, "natural")).select("cblk", "first", "last")


@query("SELECT range AS i, range AS j FROM range(1, 21) UNION ALL SELECT range + 1, range FROM range(1, 20)")
def exact_pattern(spark, d):
    m, _ = laplacian(spark, 20)
    return graph.exact_pattern(graph.analyse(m.entries, 20, "natural"))


@query("SELECT sum(l * (l + 1) / 2 + g * l - l) AS off_diagonal FROM (SELECT 1 AS l, 1 AS g FROM range(18) UNION ALL SELECT 2, 0)")
def factor_cost(spark, d):
    m, _ = laplacian(spark, 20)
    return graph.block_costs(graph.analyse(m.entries, 20, "natural")).agg(F.sum(cost.off_diagonal()).alias("off_diagonal"))


@query()
def minimum_degree_order(spark, d):
    lower, n = tree(spark, d)
    return graph.analyse(lower, n, "minimum_degree").select("old", "new", "parent", "rows", "cblk", "level")


@query()
def rcm_order(spark, d):
    lower, n = tree(spark, d)
    return graph.analyse(lower, n, "rcm").select("old", "new", "parent", "rows", "cblk", "level")


@query()
def block_structure(spark, d):
    lower, n = tree(spark, d)
    return graph.block_rows(checkpoint(graph.analyse(lower, n, "minimum_degree")))


def _system(spark, d) -> tuple[DataFrame, int]:
    """The whole tree and its order."""
    lower, n = tree(spark, d)
    return checkpoint(structure.expand_symmetric(lower)), n


ONES = f"SELECT unnest(range(1, {TREE_SQL} + 1)) AS i, 1.0::DOUBLE AS x"
INDEX = f"SELECT k AS i, k::DOUBLE AS x FROM (SELECT unnest(range(1, {TREE_SQL} + 1)) AS k)"


def _rounded(x):
    return x.select(*[c for c in x.columns if c != "x"], F.round("x", 6).alias("x"))


def _direct(kind: str, side: str):
    def run(spark, d):
        a, n = _system(spark, d)
        b = products.generated_rhs(a, n, side)
        if kind == "lu":
            return _rounded(SparseSolver(SparseMatrix(a, n, n), SolverConfig(factor="lu", ordering="minimum_degree", block=64)).solve(b))
        analysis = checkpoint(graph.analyse(a, n, "minimum_degree", small=64))
        return _rounded(solve_factored(factorise(a, analysis, kind), analysis, b, kind))

    return run


query(INDEX, name="llt_solve")(_direct("llt", "i"))
query(INDEX, name="ldlt_solve")(_direct("ldlt", "i"))
query(ONES, name="lu_solve")(_direct("lu", "1"))


@query(f"SELECT k AS i, r AS rhs, (k * r)::DOUBLE AS x FROM (SELECT unnest(range(1, {TREE_SQL} + 1)) AS k), (SELECT unnest(range(1, 4)) AS r)")
def solve_many(spark, d):
    """Three right-hand sides in one sweep."""
    a, n = _system(spark, d)
    b = products.generated_rhs(a, n, "i").select("i", F.explode(F.sequence(F.lit(1), F.lit(3)).cast("array<bigint>")).alias("rhs"), "x")
    solver = SparseSolver(SparseMatrix(a, n, n), SolverConfig(ordering="minimum_degree"))
    return _rounded(solver.solve(b.withColumn("x", F.col("x") * F.col("rhs"))))


def _complex(hermitian: bool):
    def run(spark, d):
        """The tree with imaginary parts: i on ties below the diagonal, -i above where Hermitian."""
        lower, n = tree(spark, d)
        turned = lower.select("i", "j", complexes.make(F.col("v"), F.when(F.col("i") > F.col("j"), 0.5).otherwise(F.lit(0.0 if hermitian else 1.0))).alias("v"))
        matrix = SparseMatrix(checkpoint(turned), n, n, "hermitian" if hermitian else "symmetric")
        full = matrix.full().entries
        x = complexes.make(F.col("j").cast("double"), F.lit(-2.0))
        b = full.select("i", complexes.multiply(F.col("v"), x).alias("p")).groupBy("i").agg(complexes.total(F.col("p")).alias("x"))
        config = SolverConfig(factor="ldlh" if hermitian else "lu", ordering="minimum_degree")
        found = ComplexSolver(matrix, config).solve(checkpoint(b))
        return found.select("i", F.round(F.col("x")["re"], 6).alias("re"), F.round(F.col("x")["im"], 6).alias("im"))

    return run


for _name, _hermitian in (("complex_lu_solve", False), ("hermitian_ldlh_solve", True)):
    query(f"SELECT k AS i, k::DOUBLE AS re, -2.0::DOUBLE AS im FROM (SELECT unnest(range(1, {TREE_SQL} + 1)) AS k)", name=_name)(_complex(_hermitian))


@query("SELECT sum(v * v + i * j)::DOUBLE AS re, sum(v * j - i * v)::DOUBLE AS im FROM s", S_SQL)
def complex_dot(spark, d):
    """conj(v + i sqrt(-1)) (v + j sqrt(-1)), summed."""
    s = checkpoint(S(spark, d).withColumn("k", F.col("i") * 100 + F.col("j")))
    side = lambda c: s.select(F.col("k").alias("i"), complexes.make(F.col("v"), F.col(c)).alias("x"))
    return complexes.dot(side("i"), side("j")).select("dot.re", "dot.im")


FLOPS_SQL = {
    "llt": "{m} * (l * l * l / 6.0 + l * l / 2.0 + l / 3.0) + {p} * (l * l * l / 6.0 - l / 6.0) + ({m} + {p}) * (g * l * (l + 1) / 2.0 + q * l)",
    "lu": "{m} * (l * l * l / 3.0 + 2 * l / 3.0) + {p} * (l * l * l / 3.0 - l * l / 2.0 + l / 6.0) + 2 * ({m} + {p}) * (g * l * (l + 1) / 2.0 + q * l)",
}
for _kind in ("llt", "lu", "zllt", "zlu"):
    _m, _p = (6, 2) if _kind[0] == "z" else (1, 1)
    query(
        f"SELECT o_custkey, round({FLOPS_SQL[_kind.removeprefix('z')].format(m=_m, p=_p)}, 3) AS flops FROM b",
        "h AS (SELECT o_custkey, l_linenumber AS n, sum(l_linenumber) OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
        "b AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS l, CAST(sum(n) AS DOUBLE) AS g, CAST(sum(n * m) AS DOUBLE) AS q FROM h GROUP BY 1)",
        name=f"flops_{_kind}",
    )(lambda spark, d, kind=_kind: _flops(spark, d, kind))


def _flops(spark, d, kind: str):
    """A customer's lines as a column block: as many columns as lines, a block below it of each line's number."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    blocks = lines.groupBy("o_custkey").agg(F.count("*").alias("l"), F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_linenumber"]).alias("heights"))
    return blocks.select("o_custkey", F.round(cost.flops(kind), 3).alias("flops"))


@query(f"SELECT k AS i, k::DOUBLE AS x FROM (SELECT unnest(range(1, {TREE_SQL} + 1)) AS k)")
def lu_transposed_solve(spark, d):
    a, n = _system(spark, d)
    a = checkpoint(structure.scale_rows(a, index_vector(spark, n)))
    b = products.multiply_vector(a, index_vector(spark, n), transposed=True)
    solver = SparseSolver(SparseMatrix(a, n, n), SolverConfig(ordering="minimum_degree"))
    return _rounded(solver.solve(b, transposed=True))


@query("SELECT i, j, v FROM (VALUES (1, 1, round(2 - 8 / 9.0, 6)), (10, 10, round(2 - 8 / 9.0, 6)), (1, 10, round(-1 / 9.0, 6)), (10, 1, round(-1 / 9.0, 6))) t(i, j, v)")
def schur(spark, d):
    """The ends of a path of ten: what is left when the eight inner unknowns are eliminated."""
    m, _ = laplacian(spark, 10)
    chosen = spark.range(1, 11).where("id IN (1, 10)").select(F.col("id").alias("i"))
    return schur_complement(m.entries, 10, chosen, symmetric_storage=True).select("i", "j", F.round("v", 6).alias("v"))


@query()
def factor_parts(spark, d):
    m, _ = laplacian(spark, 20)
    full = m.full().entries
    analysis = checkpoint(graph.analyse(full, 20, "natural"))
    return factor_entries(factorise(full, analysis, "ldlt")).select("part", "i", "j", F.round("v", 9).alias("v"))


def _iterative(method, precondition: bool):
    def run(spark, d):
        a, n = _system(spark, d)
        b = products.generated_rhs(a, n, "1")
        m = krylov.jacobi(a) if precondition else krylov.identity
        x, _ = method(a, b, m, max_iterations=40, epsilon=1e-9)
        return x.select("i", F.round("x", 5).alias("x"))

    return run


query(ONES, name="cg")(_iterative(krylov.conjugate_gradient, True))
query(ONES, name="bicgstab")(_iterative(krylov.bicgstab, True))
query(ONES, name="gmres")(_iterative(krylov.gmres, True))


@query("SELECT range AS i, 1.0::DOUBLE AS x FROM range(1, 13)")
def cg_laplacian(spark, d):
    m, b = laplacian(spark, 12)
    return krylov.conjugate_gradient(checkpoint(m.full().entries), b, epsilon=1e-10)[0].select("i", F.round("x", 6).alias("x"))


@query(ONES)
def ilu_gmres(spark, d):
    """No exact factor: ILU(0) in the given numbering as the preconditioner."""
    a, n = _system(spark, d)
    solver = SparseSolver(SparseMatrix(a, n, n), SolverConfig(refinement="gmres", refine_only=True, fill_level=0, max_iterations=40, epsilon=1e-9))
    return solver.refine(products.generated_rhs(a, n, "1")).select("i", F.round("x", 5).alias("x"))


@query(ONES)
def pivot_refinement(spark, d):
    a, n = _system(spark, d)
    b = products.generated_rhs(a, n, "1")
    solver = SparseSolver(SparseMatrix(a, n, n), SolverConfig(refinement="pivot", ordering="minimum_degree"))
    return _rounded(solver.refine(b))


# Dashboard queries, over orders as runs


for _name, _f, _sql in (
    ("dashboard_newest", lambda r: dashboard.newest(r, ["o_orderpriority", "o_orderstatus"], "o_orderdate", 20, "%URGENT%", "o_orderpriority"), "SELECT DISTINCT o_orderpriority, o_orderstatus, o_orderdate FROM orders WHERE o_orderpriority LIKE '%URGENT%' ORDER BY o_orderdate DESC, o_orderpriority, o_orderstatus LIMIT 20"),
    ("dashboard_totals", lambda r: dashboard.totals(r.withColumn("warnings", F.col("o_custkey") % 3).withColumn("errors", F.col("o_custkey") % 5), ["o_orderstatus"]), "SELECT o_orderstatus, count(*) AS rows, sum(o_custkey % 3)::BIGINT AS warnings, sum(o_custkey % 5)::BIGINT AS errors FROM orders GROUP BY 1"),
    ("dashboard_select", lambda r: dashboard.select_like(r, ["o_orderkey", "o_orderpriority"], {"o_orderpriority": "1%", "o_orderstatus": "F"}, ("o_custkey",), "o_orderkey", 50), "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus LIKE 'F' AND o_custkey > 0 ORDER BY o_orderkey DESC LIMIT 50"),
    ("dashboard_lookup", lambda r: dashboard.lookup(r, {"o_orderkey": 7}).select("o_orderkey", "o_custkey", "o_orderstatus"), "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7"),
    ("dashboard_most_recent", lambda r: dashboard.most_recent(r, "o_orderdate"), "SELECT max(o_orderdate) AS o_orderdate FROM orders"),
    ("dashboard_upsert", lambda r: dashboard.upsert(r.select("o_custkey", "o_orderkey", F.lit(0).alias("gen")), r.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.lit(1).alias("gen")), ["o_custkey"], "o_orderkey"), "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), max(o_orderkey)) AS o_orderkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 1 ELSE 0 END AS gen FROM orders GROUP BY 1"),
    ("dashboard_log_metrics", lambda r: dashboard.log_metrics(r.select("o_orderstatus", F.concat(F.lit("Time to factorize "), "o_orderkey", F.lit(" s")).alias("line")), {"seconds": r"factorize\s+(\d+)"}, "line", ("o_orderstatus",)), "SELECT o_orderstatus, max(o_orderkey::VARCHAR) AS seconds FROM orders GROUP BY 1"),
):
    query(_sql, name=_name)(lambda spark, d, f=_f: f(read(spark, d, "orders")))


# Sinks, read back


@query("SELECT i, j, v FROM s", S_SQL)
def matrix_market_round_trip(spark, d):
    from .plans.lineage import checkpoint as cut
    from .sources.writers import write_matrix_market

    folder = _scratch(spark)
    write_matrix_market(SparseMatrix(cut(S(spark, d)), NATIONS, NATIONS), f"{folder}/mm")
    return load_matrix(spark, f"{folder}/mm", "mm", rhs=False)[0].entries


@query("SELECT i, j, v FROM s", S_SQL)
def csc_text_round_trip(spark, d):
    from .sources.writers import write_csc_text

    folder = _scratch(spark)
    write_csc_text(SparseMatrix(checkpoint(S(spark, d)), NATIONS, NATIONS), f"{folder}/csc")
    return load_matrix(spark, f"{folder}/csc/part-*", "csc", rhs=False)[0].entries


@query("SELECT i, j, v FROM a", A_SQL)
def parquet_round_trip(spark, d):
    folder = _scratch(spark)
    save_parquet(SparseMatrix(A(spark, d), 0, 0), folder)
    return load_matrix(spark, folder, "parquet", rhs=False)[0].entries


@query("SELECT count(*) + 2 AS lines FROM s", S_SQL)
def matrix_market_lines_count(spark, d):
    return matrix_market_lines(SparseMatrix(checkpoint(S(spark, d)), NATIONS, NATIONS)).agg(F.count("*").alias("lines"))


@query("SELECT 1 + CAST(ceil(26 / 4.0) + 2 * ceil(count(*) / 4.0) AS BIGINT) AS lines FROM s", S_SQL)
def csc_text_lines_count(spark, d):
    return csc_text_lines(SparseMatrix(checkpoint(S(spark, d)), NATIONS, NATIONS)).agg(F.count("*").alias("lines"))


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of exchange size, in any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()


def _columns_of(spark, d):
    """S as arrays, by columns: rows, columns, values, pointers. At most 625 entries at any scale."""
    found = sorted((r["j"], r["i"], r["v"]) for r in S(spark, d).collect())
    j, i, v = (np.array(c) for c in zip(*found))
    return i.astype(np.int64), j.astype(np.int64), v.astype(float), np.append(np.searchsorted(j, np.arange(1, NATIONS + 1)), len(j)) + 1


def _text(*columns) -> bytes:
    return "".join(" ".join(str(x) for x in row) + "\n" for row in zip(*columns)).encode()


def _files(fmt: str, i, j, v, ptr) -> dict[str, bytes]:
    """S in a format, by file name ("" where the format is one file)."""
    n, count = NATIONS, len(v)
    if fmt in ("three_files", "mumps"):
        ends = ("ia_threeFiles", "ja_threeFiles", "ra_threeFiles") if fmt == "three_files" else ("ia_mumps", "ja_mumps", "ra_mumps")
        return {"header": f"{n} {n} {count}\n".encode(), **{name: _text(c) for name, c in zip(ends, (i, j, v))}}
    if fmt == "ijv":
        return {"": _text(i, j, v)}
    if fmt == "olaf":
        return {"": b"".join([f"{n}\n{count}\n".encode(), _text(ptr), _text(i), _text(v)])}
    if fmt == "petsc":  # by rows
        by = np.lexsort((j, i))
        parts = [np.array([1211216, n, n, count], ">i4"), np.bincount(i, minlength=n + 1)[1:].astype(">i4"), (j[by] - 1).astype(">i4"), v[by].astype(">f8")]
        return {"": b"".join(x.tobytes() for x in parts)}
    if fmt == "fdupros":
        two = np.array([n, count], "<i4").tobytes()
        return {"MATA01": two + v.astype("<f8").tobytes(), "COORD01": two + np.concatenate([j, i]).astype("<i4").tobytes(), "ZRHS01": np.array([n], "<i4").tobytes() + np.ones(n, "<f8").tobytes()}
    raise ValueError(fmt)


def _read_back(fmt: str):
    def run(spark, d):
        path = _scratch(spark)
        for name, data in _files(fmt, *_columns_of(spark, d)).items():
            _put(spark, f"{path}/{name}" if name else path, data)
        return load_matrix(spark, path, fmt, rhs=False)[0].entries

    return run


for _fmt in ("three_files", "mumps", "ijv", "olaf", "petsc", "fdupros"):
    query("SELECT i, j, v FROM s", S_SQL, name=f"read_{_fmt}")(_read_back(_fmt))


@query("SELECT i, j, v FROM s", S_SQL)
def harwell_boeing_round_trip(spark, d):
    path = _scratch(spark)
    _put(spark, path, harwell_boeing_text(SparseMatrix(S(spark, d), NATIONS, NATIONS)).encode())
    return load_matrix(spark, path, "hb", rhs=False)[0].entries


@query("SELECT i, j, v FROM s WHERE i >= j", S_SQL)
def check_matrix_lower(spark, d):
    """Both triangles of a symmetric matrix, as many entries in each: the lower one stays."""
    lower = checkpoint(structure.lower_triangle(S(spark, d)))
    return partition.check_matrix(structure.expand_symmetric(lower), True).entries


@query(f"SELECT count(*) AS columns, count(*) - 1 AS ties, {TREE_SQL} AS n FROM (SELECT unnest(range(1, {TREE_SQL} + 1)))")
def postorder_tree(spark, d):
    """Every column stands once and, regions apart, under a later one: the tree's ties and its five roots make n."""
    lower, n = tree(spark, d)
    found = graph.analyse(lower, n, "minimum_degree")
    return found.agg(F.countDistinct("new").alias("columns"), (F.count(F.when(F.col("parent") > F.col("new"), 1)) + F.count(F.when(F.col("parent") == 0, 1)) - 1).alias("ties"), F.max("old").alias("n"))


@query(f"SELECT sum(l * (l + 1) / 2 + g * l - l)::DOUBLE AS off_diagonal FROM (SELECT 1 AS l, 1 AS g FROM (SELECT unnest(range(1, {TREE_SQL} + 1 - 5))))")
def tree_factor_entries(spark, d):
    """A tree in an order from its leaves fills nothing: one entry under the diagonal for each tie."""
    lower, n = tree(spark, d)
    pattern = graph.exact_pattern(checkpoint(graph.analyse(lower, n, "minimum_degree")))
    return pattern.where("i > j").agg(F.count("*").cast("double").alias("off_diagonal"))


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    import uuid

    checkpoint(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: duplicate merge, product with x = j, 2-norm."""
    return norm2(spark, d)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
