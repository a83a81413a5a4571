"""Solvers, factors, orderings and sources against dense numpy and known solutions."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cooforge.functions import cost
from cooforge.functions.combine import combine_all
from cooforge.operators import graph, krylov, partition, products, structure
from cooforge.operators.assembly import Assembly
from cooforge.operators.factor import factor_dense, factorise, schur_complement, solve_factored
from cooforge.operators.incomplete import incomplete, incomplete_factor
from cooforge.plans.config import SolverConfig, load_config
from cooforge.plans.lineage import checkpoint
from cooforge.plans.matrix import SparseMatrix
from cooforge.plans.solver import SparseSolver
from cooforge.sources import readers, writers


def dense(a, n, m=None):
    out = np.zeros((n, m or n))
    for r in a.collect():
        out[r["i"] - 1, r["j"] - 1] += r["v"]
    return out


def vector(x, n):
    out = np.zeros(n)
    for r in x.collect():
        out[r["i"] - 1] = r["x"]
    return out


def entries(spark, m):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a) + 1, int(b) + 1, float(m[a, b])) for a, b in zip(i, j)], "i long, j long, v double")


def rhs(spark, x):
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(x)], "i long, x double")


def sample(n, seed, symmetric):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < 0.25, rng.integers(-4, 5, (n, n)), 0).astype(float)
    pattern = (m != 0) | (m.T != 0)
    m = m + m.T if symmetric else np.where(pattern & (m == 0), 0.5, m)
    np.fill_diagonal(m, np.abs(m).sum(axis=1) + 1)
    return m


@pytest.mark.parametrize("kind", ["llt", "ldlt", "lu"])
def test_factor_and_solve_by_levels(spark, kind):
    m = sample(14, 3, kind != "lu")
    a = checkpoint(entries(spark, m))
    analysis = checkpoint(graph.analyse(a, 14, "minimum_degree", small=4))
    b = np.arange(1.0, 15)
    x = vector(solve_factored(factorise(a, analysis, kind), analysis, rhs(spark, b), kind), 14)
    assert np.allclose(m @ x, b)


def test_transposed_solve_and_many_sides(spark):
    m = sample(10, 5, False)
    solver = SparseSolver(SparseMatrix(entries(spark, m), 10, 10), SolverConfig(ordering="rcm"))
    b = np.arange(1.0, 11)
    assert np.allclose(m.T @ vector(solver.solve(rhs(spark, b), transposed=True), 10), b)
    both = rhs(spark, b).withColumn("rhs", F.lit(1)).unionByName(rhs(spark, 2 * b).withColumn("rhs", F.lit(2)))
    out = solver.solve(both)
    assert np.allclose(m @ vector(out.where("rhs = 2"), 10), 2 * b)


def test_schur(spark):
    m = sample(9, 7, True)
    chosen = spark.range(1, 10).where("id IN (2, 8)").select(F.col("id").alias("i"))
    keep, rest = [1, 7], [0, 2, 3, 4, 5, 6, 8]
    want = m[np.ix_(keep, keep)] - m[np.ix_(keep, rest)] @ np.linalg.solve(m[np.ix_(rest, rest)], m[np.ix_(rest, keep)])
    got = dense(schur_complement(entries(spark, m), 9, chosen), 9)[np.ix_(keep, keep)]
    assert np.allclose(got, want)


def test_pivots():
    a = np.array([[1e-40, 1.0], [1.0, 2.0]])
    assert factor_dense(a, 2, "lu", 1e-31) == 1 and a[0, 0] == 1e-31
    with pytest.raises(ArithmeticError):
        factor_dense(np.array([[-1.0, 0.0], [0.0, 1.0]]), 2, "llt", 1e-31)


@pytest.mark.parametrize("method", [krylov.conjugate_gradient, krylov.bicgstab, krylov.gmres])
def test_krylov(spark, method):
    m = sample(8, 11, True)
    a = checkpoint(entries(spark, m))
    b = m @ np.arange(1.0, 9)
    x, stats = method(a, rhs(spark, b), krylov.jacobi(a), max_iterations=30, epsilon=1e-10)
    assert np.allclose(vector(x, 8), np.arange(1.0, 9)) and stats.relative_error < 1e-8 and stats.iterations


def test_orderings_are_permutations_and_trees_match_the_factor(spark):
    m = sample(16, 2, True)
    for ordering in ("rcm", "minimum_degree", "natural"):
        rows = graph.analyse(entries(spark, m), 16, ordering).orderBy("new").collect()
        assert sorted(r["old"] for r in rows) == list(range(1, 17))
        order = [r["old"] - 1 for r in rows]
        l = np.linalg.cholesky(m[np.ix_(order, order)])
        for k, r in enumerate(rows):
            assert set(np.flatnonzero(np.abs(l[:, k]) > 1e-12)[1:] + 1) <= set(r["below"])
            assert r["parent"] == (min(r["below"]) if r["below"] else 0)


def test_fill_levels_reach_the_exact_pattern(spark):
    m = sample(10, 4, True)
    got = {(r["i"], r["j"]) for r in graph.fill_levels(entries(spark, m), 10).where("i > j").collect()}
    analysis = checkpoint(graph.analyse(entries(spark, m), 10, given=spark.range(1, 11).select(F.col("id").alias("old"), F.col("id").alias("new"))))
    assert got == {(r["i"], r["j"]) for r in graph.exact_pattern(analysis).where("i > j").collect()}


def test_structure_properties(spark):
    m = sample(7, 9, False)
    m[2, 5] = 0
    a = entries(spark, m)
    assert (dense(structure.transpose(structure.transpose(a)), 7) == m).all()
    p = structure.random_permutation(spark, 7, 1)
    assert (dense(structure.permute(structure.permute(a, p), structure.invert_permutation(p)), 7) == m).all()
    once = checkpoint(structure.symmetrize_pattern(a))
    assert structure.missing_mirrors(once).count() == 0 and structure.symmetrize_pattern(once).count() == once.count()


def test_check_matrix(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "i long, j long, v double")
    found = partition.check_matrix(rows((0, 0, 1.0), (0, 0, 2.0), (1, 0, 3.0)), symmetric=False)
    assert (found.base, found.duplicates, found.added) == (0, 1, 1) and dense(found.entries, 2)[0, 0] == 3.0
    both = rows((1, 2, 1.0), (2, 1, 1.0), (1, 1, 1.0))
    assert partition.check_matrix(both, symmetric=True).dropped == 1
    with pytest.raises(ValueError):
        partition.check_matrix(rows((1, 2, 1.0), (2, 1, 1.0), (1, 3, 1.0)), symmetric=True)
    with pytest.raises(ValueError):
        partition.check_matrix(both.unionByName(both), symmetric=False, correct=False)
    assert partition.check_matrix(both.where("false"), symmetric=False).duplicates == 0


def test_assembly_errors_and_masks(spark):
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)], "i long, j long, v double")
    with pytest.raises(ValueError):
        Assembly(spark, 2).add_values(a).matrix(expected=4)
    session = Assembly(spark, 2).add_edges(a.where("i = 1"))
    session.close_graph()
    with pytest.raises(ValueError):
        session.add_values(a).matrix()
    masked = Assembly(spark, 2).add_values(a).mask_rows(spark.createDataFrame([(2,)], "i long")).matrix()
    assert {(r["i"], r["j"]) for r in masked.collect()} == {(1, 1), (1, 2)}
    with pytest.raises(ValueError):
        combine_all("AVG")


def test_balanced_elements(spark):
    owned = spark.createDataFrame([(k, 0 if k < 9 else 2) for k in range(11)], "element int, owner int")
    counts = {r["owner"]: r["count"] for r in partition.balance_elements(owned, 3).groupBy("owner").count().collect()}
    assert sorted(counts.values()) == [3, 4, 4]


def test_config():
    assert load_config(["# x", "epsilon = 1e-6", "max_iterations=7", "repair = no"]) == SolverConfig(epsilon=1e-6, max_iterations=7, repair=False)
    for bad in (SolverConfig(refinement="cg"), SolverConfig(factor="llt", refinement="pivot"), SolverConfig(factor="x")):
        with pytest.raises(ValueError):
            bad.checked("symmetric" if bad.factor == "llt" else "general")
    assert load_config(SolverConfig().dump().splitlines()) == SolverConfig()


def test_flops(spark):
    row = spark.range(1).select(F.lit(3).alias("l"), F.array(F.lit(2), F.lit(4)).alias("heights")).select(*[cost.flops(k).alias(k) for k in ("llt", "lu", "zllt", "zlu")]).first()
    solve, product = 3 * 4 / 2 * 6, 3 * (2 * 6 + 4 * 4)  # multiplications; each with as many additions
    assert np.isclose(row["llt"], 10 + 4 + 2 * (solve + product)) and np.isclose(row["zllt"], 6 * 10 + 2 * 4 + 8 * (solve + product))
    assert np.isclose(row["lu"], 11 + 5 + 4 * (solve + product)) and np.isclose(row["zlu"], 6 * 11 + 2 * 5 + 16 * (solve + product))
    one = spark.range(1).select(F.lit(1).alias("l"), F.array(F.lit(2)).alias("heights")).select(cost.flops("llt").alias("x")).first()
    assert one["x"] == 13


# Sources


def test_matrix_market(spark, tmp_path):
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix coordinate complex symmetric\n% note\n3 3 2\n1 1 1.5 -2\n3 1 4 0.5\n")
    m, _ = readers.load_matrix(spark, str(tmp_path / "a.mtx"), "mm")
    assert m.symmetry == "symmetric" and {(r["i"], r["j"], r["v"]["im"]) for r in m.entries.collect()} == {(1, 1, -2.0), (3, 1, 0.5)}
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern general\n2 4 2\n0 1\n1 3\n")
    m, b = readers.load_matrix(spark, str(tmp_path / "p.mtx"), "mm")
    assert (m.rows, m.cols) == (2, 4) and {(r["i"], r["j"], r["v"]) for r in m.entries.collect()} == {(1, 2, 1.0), (2, 4, 1.0)} and vector(b, 2).tolist() == [2, 4]
    (tmp_path / "d.mtx").write_text("%%MatrixMarket matrix array real general\n2 2\n1\n2\n3\n4\n")
    assert (dense(readers.load_matrix(spark, str(tmp_path / "d.mtx"), "mm")[0].entries, 2) == [[1, 3], [2, 4]]).all()
    with pytest.raises(ValueError):
        readers.banner("%%MatrixMarket matrix array pattern general")


def test_dupros(spark, tmp_path):
    (tmp_path / "MATA01").write_bytes(struct.pack("<2i4d", 3, 4, 2.0, -1.0, 3.0, 4.0))
    (tmp_path / "COORD01").write_bytes(struct.pack("<2i8i", 3, 4, 1, 1, 2, 3, 1, 3, 2, 3))
    (tmp_path / "ZRHS01").write_bytes(struct.pack("<i3d", 3, 7.0, 8.0, 9.0))
    m, b = readers.load_matrix(spark, str(tmp_path), "fdupros")
    assert m.symmetry == "symmetric" and (dense(m.full().entries, 3) == [[2, 0, -1], [0, 3, 0], [-1, 0, 4]]).all() and vector(b, 3).tolist() == [7, 8, 9]


def test_harwell_boeing(spark, tmp_path):
    m = sample(6, 1, True)
    lower = SparseMatrix(entries(spark, np.tril(m)), 6, 6, "symmetric")
    (tmp_path / "a.rsa").write_text(writers.harwell_boeing_text(lower, "test", "KEY"))
    found, b = readers.load_matrix(spark, str(tmp_path / "a.rsa"), "hb")
    assert found.symmetry == "symmetric" and (dense(found.full().entries, 6) == m).all()
    assert np.allclose(vector(b, 6), m @ np.arange(1, 7))
    assert readers.fortran_format("(1P5E16.8)") == (5, 16) and readers.fortran_format("(10I8)") == (10, 8)


def test_text_and_binary_columns(spark, tmp_path):
    want = np.array([[1.0, 0, 4], [2, 3, 0], [0, 0, 5]])
    (tmp_path / "olaf").write_text("3 5 1 3 4 6 1 2 2 1 3 1 2 3 4 5")
    (tmp_path / "csc").write_text("3 1 1\n1 3 4 6\n1 2 2 1\n3\n1 2 3 4\n5\n")
    (tmp_path / "petsc").write_bytes(struct.pack(">4i3i5i5d", 1211216, 3, 3, 5, 2, 2, 1, 0, 2, 0, 1, 2, 1, 4, 2, 3, 5))
    (tmp_path / "ijv").write_text("1 1 1\n2 1 2\n2 2 3\n1 3 4\n3 3 5\n")
    for name in ("csc", "petsc", "ijv"):
        assert (dense(readers.load_matrix(spark, str(tmp_path / name), name)[0].entries, 3) == want).all()
    assert (dense(readers.load_matrix(spark, str(tmp_path / "olaf"), "olaf")[0].entries, 3) == want).all()
    folder = tmp_path / "three"
    folder.mkdir()
    for name, text in (("header", "3 3 5"), ("ia_threeFiles", "1\n2\n2\n1\n3"), ("ja_threeFiles", "1\n1\n2\n3\n3"), ("ra_threeFiles", "1\n2\n3\n4\n5")):
        (folder / name).write_text(text + "\n")
    assert (dense(readers.load_matrix(spark, str(folder), "three_files")[0].entries, 3) == want).all()


def test_stored_and_unknown(spark, tmp_path):
    m, b = readers.laplacian(spark, 5)
    writers.save_parquet(m, str(tmp_path / "m"), b)
    found, side = readers.load_matrix(spark, str(tmp_path / "m"), "parquet")
    assert found.symmetry == "symmetric" and found.entries.count() == 9 and vector(side, 5).tolist() == [1, 0, 0, 0, 1]
    with pytest.raises(ValueError):
        readers.load_matrix(spark, "x", "nothing")


def test_streaming_assembly(spark, tmp_path):
    from cooforge.streaming.assembly import assemble, read_pieces, write_matrix

    for k in range(2):
        spark.createDataFrame([(1, 1, 1.0, k), (1, 2, float(k), k)], "i long, j long, v double, seq long").write.mode("append").parquet(str(tmp_path / "in"))
    query = write_matrix(assemble(read_pieces(spark, str(tmp_path / "in"), 1)), str(tmp_path / "state"), str(tmp_path / "out"))
    query.awaitTermination()
    assert {(r["i"], r["j"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 1, 2.0), (1, 2, 1.0)}


def test_product_of_nothing(spark):
    empty = spark.createDataFrame([], "i long, j long, v double")
    ids = spark.range(1, 4).select(F.col("id").alias("i"))
    assert vector(products.multiply_vector(empty, products.generated_vector(spark, 3, "1"), ids=ids), 3).tolist() == [0, 0, 0]


def test_settings_that_nothing_reads_are_refused():
    with pytest.raises(ValueError, match="level_of_fill"):
        load_config(["level_of_fill = 1"])


def test_numbers_over_chunks(spark, monkeypatch):
    """Numbers, sums and neighbours equal those of one window, whatever the chunk; no window sees all rows."""
    from pyspark.sql import Window

    from cooforge.plans import numbering

    monkeypatch.setattr(numbering, "CHUNK", 7)
    rows = spark.range(100).where("id % 11 <> 3 AND id NOT BETWEEN 30 AND 47").select("id", (F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5).alias("x"))
    whole = Window.orderBy("g", "id")
    want = rows.withColumn("r", F.row_number().over(whole).cast("long")).collect()
    assert sorted(want) == sorted(numbering.row_numbers(rows, "r", "id", first=("g",)).collect())
    own = Window.partitionBy("g").orderBy("id")
    want = rows.withColumn("r", F.row_number().over(own).cast("long")).collect()
    assert sorted(want) == sorted(numbering.row_numbers(rows, "r", "id", within=("g",)).collect())
    want = rows.withColumn("s", F.coalesce(F.sum("x").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).collect()
    assert sorted(want) == sorted(numbering.running_sum(rows, F.col("x"), "s", "id").collect())
    for step in (-1, 1):
        want = rows.withColumn("near", F.lag("x", -step).over(Window.orderBy("id"))).orderBy("id").collect()
        assert want == numbering.neighbour(rows, "x", "near", "id", step).orderBy("id").collect()
    assert not numbering.row_numbers(rows.where("false"), "r", "id").collect()


def _incomplete(m, pattern):
    """Plain elimination that keeps the pattern only."""
    f = np.where(pattern, m, 0.0)
    for k in range(len(f)):
        for i in np.flatnonzero(pattern[k + 1 :, k]) + k + 1:
            f[i, k] /= f[k, k]
            f[i, k + 1 :] -= np.where(pattern[i, k + 1 :], f[i, k] * f[k, k + 1 :], 0.0)
    return f


@pytest.mark.parametrize("level", [0, 1, 12])
def test_incomplete_factor_is_elimination_on_the_pattern(spark, level):
    m = sample(12, 21, False)
    a = checkpoint(entries(spark, m))
    pattern = np.zeros((12, 12), bool)
    for r in graph.fill_levels(a, level).collect():
        pattern[r["i"] - 1, r["j"] - 1] = True
    factor = checkpoint(incomplete_factor(a, level))
    assert np.allclose(dense(factor, 12), _incomplete(m, pattern))
    if level == 12:
        assert np.allclose(m @ vector(incomplete(factor, steps=12)(rhs(spark, np.arange(1.0, 13))), 12), np.arange(1.0, 13))


def test_incomplete_factor_preconditions(spark):
    m = sample(12, 23, True)
    a, b = checkpoint(entries(spark, m)), m @ np.arange(1.0, 13)
    x, stats = krylov.conjugate_gradient(a, rhs(spark, b), incomplete(incomplete_factor(a, 1), 4), max_iterations=20, epsilon=1e-10)
    assert np.allclose(vector(x, 12), np.arange(1.0, 13)) and stats.iterations < 12


def test_incomplete_factor_edges(spark):
    none = spark.createDataFrame([], "i long, j long, v double")
    assert incomplete_factor(none).count() == 0
    alone = incomplete(none)(rhs(spark, [2.0]))
    assert [r["x"] for r in alone.collect()] == [2.0]
    with pytest.raises(ArithmeticError):
        incomplete_factor(entries(spark, np.array([[0.0, 1.0], [1.0, 0.0]])))


def test_fill_level_goes_without_the_exact_factor():
    assert load_config(["fill_level = 2", "refine_only = true"]).checked().fill_level == 2
    for bad in (SolverConfig(fill_level=0), SolverConfig(fill_level=-1, refine_only=True)):
        with pytest.raises(ValueError, match="level of fill"):
            bad.checked()


def _hubs(hubs: int, leaves: int):
    """Pairs of stars whose hubs hang on hub 0."""
    leaf = np.arange(leaves)
    return np.concatenate([np.stack([np.zeros(hubs - 1, int), np.arange(1, hubs)]), np.stack([leaf % hubs, leaf + hubs])], axis=1)


def _analysed(n, i, j, ordering, small=1):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(i), np.int32)), pa.array(i), pa.array(j)], names=["kind", "i", "j"])
    return list(graph._analysis(n, ordering, 0.0, 120, small, 1)(iter([batch])))


def _parts(n, i, j, ordering):
    """As Spark hands them over: 10,000 rows a batch."""
    import pyarrow as pa

    cuts = [slice(at, at + 10_000) for at in range(0, len(i), 10_000)]
    return graph._analysis(n, ordering, 0.0, 120, 1, 1)(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(i[c]), np.int32)), pa.array(i[c]), pa.array(j[c])], names=["kind", "i", "j"]) for c in cuts)


def test_a_hub_is_not_counted_for_each_of_its_neighbours():
    """Time grows with the edges also where a vertex has most of them, alone or with pairs of leaves tied (minutes before)."""
    import time

    low, high = _hubs(2, 60_000)
    tied = np.stack([np.arange(2, 60_002, 4), np.arange(4, 60_004, 4)])
    for pairs in (np.stack([low, high]), np.concatenate([np.stack([low, high]), tied], axis=1)):
        began = time.monotonic()
        found = _analysed(60_002, *(pairs + 1), "minimum_degree")
        assert time.monotonic() - began < 15
        old, parent = (np.concatenate([b.column(c).to_numpy() for b in found]) for c in ("old", "parent"))
        assert len(set(old.tolist())) == 60_002 and (parent == 0).sum() == 1


def test_an_analysis_has_no_object_for_each_vertex():
    """A few arrays of the length of the edges: under 400 bytes a vertex here (an array for each took more)."""
    import tracemalloc

    n = 200_000
    i, j = _hubs(20, n - 20) + 1
    for ordering in ("rcm", "minimum_degree"):
        tracemalloc.start()
        rows = sum(b.num_rows for b in _analysed(n, i, j, ordering, 64))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows == n and peak < 400 * n


def test_an_analysis_frees_what_it_is_done_with():
    """Under 150 bytes a vertex (175 before, when the given edges, two graphs and the places of all rows were held on to)."""
    import tracemalloc

    n = 200_000
    low, high = _hubs(20, n - 20) + 1
    for ordering in ("rcm", "minimum_degree"):
        tracemalloc.start()
        found = 0
        for batch in _parts(n, low, high, ordering):
            found += batch.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == n and peak < 150 * n


def test_breadth_first_takes_neighbours_by_degree_and_index():
    from cooforge.operators.elimination import compressed_rows, reverse_cuthill_mckee

    rng = np.random.default_rng(5)
    for n, edges in ((1, 0), (7, 4), (60, 90), (400, 3000)):
        i, j = rng.integers(0, n, (2, edges))
        i, j = i[i != j], j[i != j]
        near = [set() for _ in range(n)]
        for a, b in zip(i.tolist(), j.tolist()):
            near[a].add(b)
            near[b].add(a)
        want, by = [], lambda v: (len(near[v]), v)
        for root in sorted(range(n), key=by):
            queue = [] if root in want else [root]
            want += queue
            while queue:
                queue = [u for v in queue for u in sorted(near[v], key=by) if u not in want and not want.append(u)]
        found = reverse_cuthill_mckee(compressed_rows(n, np.unique(np.concatenate([i * n + j, j * n + i]))))
        assert found.tolist() == want[::-1]


def test_pairs_are_dealt_before_they_are_made_distinct(spark):
    """Rows are made distinct after they are dealt only (a task that read them held all of its pairs before), and mirrored last."""
    m = sample(12, 3, False)
    rows = entries(spark, m)
    found = structure.graph_of(rows.union(rows))
    got, off = sorted((r["i"], r["j"]) for r in found.collect()), (m != 0) | (m.T != 0)
    assert got == [(i + 1, j + 1) for i in range(12) for j in range(12) if i != j and off[i, j]]
    plan = structure.graph_of(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and ", 200), REPARTITION_BY_NUM" in plan and plan.index("Generate") < plan.index("HashAggregate")
    assert plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")  # from the last step to the first


def test_products_outside_the_pattern_are_not_made(spark):
    """A hub before its leaves: all pairs of leaves met at it, now a term for each diagonal entry of a leaf."""
    from cooforge.operators.incomplete import _terms

    n = 3000
    ids = spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"))
    ties = ids.where("i > 1").select("i", F.lit(1).cast("long").alias("j"))
    state = checkpoint(ids.union(ties).union(ties.select("j", "i")))
    assert _terms(state).count() == n - 1


def test_chains_of_triangles_bound_the_sweeps(spark):
    from cooforge.operators.incomplete import _longest

    path = spark.range(1, 5).select((F.col("id") + 1).alias("i"), F.col("id").alias("j"))
    assert [_longest(path, 9), _longest(path, 3), _longest(path.where("i = 3"), 9), _longest(path.where("false"), 9)] == [4, 3, 1, 0]


def test_unknowns_of_a_node_stay_together(spark):
    """Two unknowns a node: the order of nodes, each node's parts in turn, dense under the diagonal of a node."""
    m = np.kron(sample(9, 13, True), np.ones((2, 2))) + 9 * np.eye(18)
    for small in (1, 6):
        rows = graph.analyse(entries(spark, m), 18, dof=2, small=small).orderBy("new").collect()
        old = [r["old"] for r in rows]
        assert sorted(old) == list(range(1, 19)) and all(a % 2 and b == a + 1 for a, b in zip(old[::2], old[1::2]))
        l = np.linalg.cholesky(m[np.ix_(np.array(old) - 1, np.array(old) - 1)] + 200 * np.eye(18))
        for k, r in enumerate(rows):
            assert set(np.flatnonzero(np.abs(l[:, k]) > 1e-12)[1:] + 1) - set(range(1, k + 2)) <= set(r["below"])
            assert r["parent"] == (min(r["below"]) if r["below"] else 0) and r["rows"] == len(r["below"]) and r["new"] == k + 1


def test_the_last_round_of_fill_levels_makes_a_pair_once(spark, monkeypatch):
    """Levels equal plain elimination, ends dealt by stretches; the plan gathers no pairs of the last round."""
    monkeypatch.setattr(graph, "STRETCH", 3)
    m = np.random.default_rng(3).random((14, 14)) < 0.15
    want = np.where(m | m.T, 0, 99)
    for k in range(14):
        inner = want[k + 1 :, k, None] + want[None, k, k + 1 :] + 1
        want[k + 1 :, k + 1 :] = np.minimum(want[k + 1 :, k + 1 :], inner)
    for level in (1, 2):
        found = graph.fill_levels(entries(spark, m.astype(float)), level)
        rows = found.collect()
        assert len(rows) == (want <= level).sum() and all(want[r["i"] - 1, r["j"] - 1] == r["level"] for r in rows)
        assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # was read from a table of all pairs
