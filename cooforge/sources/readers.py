"""Matrix readers. ``load_matrix(spark, path, fmt)`` gives the matrix and, where the file has one, a right-hand side.

Formats of one entry to a line are parsed by Spark in parallel. Formats that are
one stream of numbers with counts in front (compressed columns, Harwell-Boeing,
binary) are parsed by a Python task per file; many files run in parallel.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.products import multiply_vector
from ..plans.lineage import checkpoint
from ..plans.matrix import SparseMatrix
from .lines import numbered_lines, words

ENTRIES = "kind string, i long, j long, v double, im double"


def laplacian(spark: SparkSession, n: int) -> tuple[SparseMatrix, DataFrame]:
    """1-D Laplacian, lower triangle (2 n - 1 entries), and a right-hand side whose solution is 1 for n >= 2."""
    diag = spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(2.0).alias("v"))
    off = spark.range(1, n).select((F.col("id") + 1).alias("i"), F.col("id").alias("j"), F.lit(-1.0).alias("v"))
    b = spark.range(1, n + 1).select(F.col("id").alias("i"), F.when((F.col("id") == 1) | (F.col("id") == n), 1.0).otherwise(0.0).alias("x"))
    return SparseMatrix(diag.unionByName(off), n, n, "symmetric"), b


def banner(line: str) -> dict[str, str]:
    """The parts of a MatrixMarket first line; raises ValueError on impossible ones."""
    parts = line.lower().split()
    if len(parts) != 5 or parts[0] != "%%matrixmarket" or parts[1] != "matrix":
        raise ValueError("not a MatrixMarket file")
    found = dict(zip(("format", "field", "symmetry"), parts[2:]))
    if found["format"] not in ("coordinate", "array") or found["field"] not in ("real", "integer", "complex", "pattern"):
        raise ValueError(f"unknown MatrixMarket format {parts[2:]}")
    if found["symmetry"] not in ("general", "symmetric", "hermitian", "skew-symmetric"):
        raise ValueError(f"unknown symmetry {found['symmetry']}")
    if found["symmetry"] == "hermitian" and found["field"] != "complex" or found["format"] == "array" and found["field"] == "pattern":
        raise ValueError("impossible MatrixMarket banner")
    return found


def matrix_market(spark: SparkSession, path) -> tuple[SparseMatrix, None]:
    """Coordinate or array files; pattern entries are 1; indices from 0 are moved to 1; complex v is a struct."""
    lines = numbered_lines(spark, path)
    head = banner(lines.where("n = 0").first()["value"])
    body = words(lines.where("value NOT LIKE '\\%%'"))
    size_at = body.agg(F.min("n")).first()[0]
    size = [int(x) for x in body.where(F.col("n") == size_at).first()["words"]]
    rest = body.where(F.col("n") > size_at)
    w = lambda k: F.col("words")[k]
    complex_values = head["field"] == "complex"
    if head["format"] == "array":
        if head["symmetry"] != "general":
            raise ValueError("dense files must be general")
        counted = rest.select((F.col("n") - size_at - 1).alias("k"), "words")
        place, first = [(F.col("k") % size[0] + 1).alias("i"), (F.floor(F.col("k") / size[0]) + 1).alias("j")], 0
    else:
        counted, place, first = rest, [w(0).cast("long").alias("i"), w(1).cast("long").alias("j")], 2
    if head["field"] == "pattern":
        value = F.lit(1.0)
    elif complex_values:
        value = F.struct(w(first).cast("double").alias("re"), w(first + 1).cast("double").alias("im"))
    else:
        value = w(first).cast("double")
    entries = counted.select(*place, value.alias("v"))
    low = entries.agg(F.least(F.min("i"), F.min("j"))).first()[0]
    if low == 0:
        entries = entries.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v")
    symmetry = head["symmetry"]
    if symmetry == "skew-symmetric":
        entries = entries.unionByName(entries.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), (-F.col("v")).alias("v")))
        symmetry = "general"
    return SparseMatrix(entries, size[0], size[1], symmetry), None


def distributed_matrix_market(spark: SparkSession, path: str) -> tuple[SparseMatrix, None]:
    """A main file that names its MatrixMarket parts, all of one size."""
    names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
    folder = path.rsplit("/", 1)[0]
    parts = [matrix_market(spark, f"{folder}/{n}")[0] for n in names[1:]]
    entries = parts[0].entries
    for p in parts[1:]:
        entries = entries.unionByName(p.entries)
    return SparseMatrix(entries, max(p.rows for p in parts), max(p.cols for p in parts), parts[0].symmetry), None


def ijv(spark: SparkSession, path, symmetry: str = "general") -> tuple[SparseMatrix, None]:
    """Lines of i j v."""
    w = F.col("words")
    rows = words(numbered_lines(spark, path)).where(F.size("words") >= 3)
    entries = rows.select(w[0].cast("long").alias("i"), w[1].cast("long").alias("j"), w[2].cast("double").alias("v"))
    n, m = entries.agg(F.max("i"), F.max("j")).first()
    return SparseMatrix(entries, n or 0, m or 0, symmetry), None


def three_files(spark: SparkSession, folder: str) -> tuple[SparseMatrix, None]:
    """A header of n n nnz, and columns, rows and values one to a line in three files; joined on the line."""
    size = [int(x) for x in " ".join(r["value"] for r in spark.read.text(f"{folder}/header").collect()).split()]
    line = lambda f, n, t: numbered_lines(spark, f"{folder}/{f}").where(F.trim("value") != "").select("n", F.trim("value").cast(t).alias(n))
    joined = line("ia_threeFiles", "i", "long").join(line("ja_threeFiles", "j", "long"), "n").join(line("ra_threeFiles", "v", "double"), "n")
    return SparseMatrix(joined.select("i", "j", "v"), size[0], size[1] if len(size) > 2 else size[0]), None


def mumps(spark: SparkSession, folder: str) -> tuple[SparseMatrix, None]:
    """The same three files under the names header, ia_mumps, ja_mumps, ra_mumps."""
    size = [int(x) for x in " ".join(r["value"] for r in spark.read.text(f"{folder}/header").collect()).split()]
    line = lambda f, n, t: numbered_lines(spark, f"{folder}/{f}").where(F.trim("value") != "").select("n", F.trim("value").cast(t).alias(n))
    joined = line("ia_mumps", "i", "long").join(line("ja_mumps", "j", "long"), "n").join(line("ra_mumps", "v", "double"), "n")
    return SparseMatrix(joined.select("i", "j", "v"), size[0], size[0]), None


def _rows(kind: str, i, j, v, im=None) -> pd.DataFrame:
    n = len(v)
    return pd.DataFrame({"kind": kind, "i": np.broadcast_to(i, n).astype(np.int64), "j": np.broadcast_to(j, n).astype(np.int64), "v": np.asarray(v, float), "im": np.zeros(n) if im is None else np.asarray(im, float)})


def _meta(rows: int, cols: int, complex_values: bool = False, symmetry: int = 0) -> pd.DataFrame:
    return _rows("meta", rows, cols, [float(symmetry)], [float(complex_values)])


def _columns(pointers: np.ndarray, base: int) -> np.ndarray:
    return np.repeat(np.arange(1, len(pointers)), np.diff(pointers))


def _numbers(text: str) -> list[str]:
    return text.replace("D", "E").replace("d", "e").split()


def parse_csc_text(data: bytes) -> list[pd.DataFrame]:
    """Text columns: n dof has-values, pointers, rows, values (dof * dof to an entry)."""
    t = _numbers(data.decode())
    n, dof, valued = int(t[0]), int(t[1]), int(t[2])
    ptr = np.array(t[3 : n + 4], np.int64)
    count = int(ptr[-1] - ptr[0])
    rows = np.array(t[n + 4 : n + 4 + count], np.int64)
    cols = _columns(ptr, int(ptr[0]))
    size = dof * dof
    v = np.array(t[n + 4 + count : n + 4 + count * (1 + size)], float) if valued else np.ones(count * size)
    k = np.tile(np.arange(size), count)
    i, j = (np.repeat(rows, size) - 1) * dof + k % dof + 1, (np.repeat(cols, size) - 1) * dof + k // dof + 1
    return [_meta(n * dof, n * dof), _rows("a", i, j, v)]


def parse_olaf(data: bytes) -> list[pd.DataFrame]:
    """n, nnz, pointers, rows, values."""
    t = _numbers(data.decode())
    n, count = int(t[0]), int(t[1])
    ptr, rows = np.array(t[2 : n + 3], np.int64), np.array(t[n + 3 : n + 3 + count], np.int64)
    return [_meta(n, n, symmetry=1), _rows("a", rows, _columns(ptr, 1), np.array(t[n + 3 + count : n + 3 + 2 * count], float))]


def parse_local_columns(data: bytes) -> list[pd.DataFrame]:
    """One part of distributed columns: columns and n, nnz, global column numbers, pointers, rows, values, right-hand side.

    Pointers may count from 0 or 1. Columns of several parts are told apart by their global numbers.
    """
    t = _numbers(data.decode())
    width = len(data.decode().lstrip("\n").split("\n", 1)[0].split())
    if width == 2:
        local, n, count, at = int(t[0]), int(t[1]), int(t[2]), 3
    else:
        local, n, count, at = int(t[0]), 0, int(t[1]), 2
    if width == 2 and len(t) - at < 2 * local + 1 + count:
        raise ValueError("a part is too short")
    # parts give the local count second where the first number is a rank or the order
    if len(t) - at != 3 * local + 1 + 2 * count and width == 2:
        local, n = n, local
    l2g = np.array(t[at : at + local], np.int64)
    ptr = np.array(t[at + local : at + 2 * local + 1], np.int64)
    at += 2 * local + 1
    rows = np.array(t[at : at + count], np.int64)
    v = np.array(t[at + count : at + 2 * count], float)
    b = np.array(t[at + 2 * count : at + 2 * count + local], float)
    cols = np.repeat(l2g, np.diff(ptr))
    top = int(max(n, l2g.max(initial=0), rows.max(initial=0)))
    return [_meta(top, top), _rows("a", rows, cols, v), _rows("b", l2g[: len(b)], 0, b)]


_FORMAT = re.compile(r"\(?\s*(?:\d+P)?\s*,?\s*(\d*)\s*([IEDFGL])\s*(\d+)", re.I)


def fortran_format(text: str) -> tuple[int, int]:
    """Numbers to a line and their width in a Fortran format like (10I8) or (1P5E16.8)."""
    found = _FORMAT.search(text.replace(" ", ""))
    if not found:
        raise ValueError(f"unknown Fortran format {text}")
    return int(found[1] or 1), int(found[3])


def _fields(lines: list[str], count: int, fmt: str) -> list[str]:
    per, width = fortran_format(fmt)
    out = []
    for line in lines:
        out += [line[k * width : (k + 1) * width].strip() for k in range(per)]
        if len(out) >= count:
            break
    return [x.upper().replace("D", "E") for x in out[:count]]


def harwell_boeing_header(lines: list[str]) -> dict:
    """Title, key, card counts, type, sizes, formats and, if there are right-hand sides, theirs."""
    cards = [int(lines[1][k * 14 : (k + 1) * 14].strip() or 0) for k in range(5)]
    head = {"title": lines[0][:72].strip(), "key": lines[0][72:80].strip(), "cards": cards, "type": lines[2][:3].upper()}
    head["rows"], head["cols"], head["count"], head["elements"] = (int(lines[2][14 + k * 14 : 28 + k * 14].strip() or 0) for k in range(4))
    head["formats"] = [lines[3][a:b].strip() for a, b in ((0, 16), (16, 32), (32, 52), (52, 72))]
    head["lines"] = 4
    if cards[4]:
        head["rhs_type"], head["rhs"] = lines[4][:3], int(lines[4][14:28].strip() or 1)
        head["lines"] = 5
    return head


def parse_harwell_boeing(data: bytes) -> list[pd.DataFrame]:
    """Assembled R, C or P matrices; right-hand sides (F) numbered in j."""
    lines = data.decode().splitlines()
    head = harwell_boeing_header(lines)
    domain, symmetry = head["type"][0], {"S": 1, "H": 2, "Z": 3}.get(head["type"][1], 0)
    at, each = head["lines"], 2 if domain == "C" else 1
    _, ptr_cards, row_cards, value_cards, rhs_cards = head["cards"]
    ptr = np.array(_fields(lines[at : at + ptr_cards], head["cols"] + 1, head["formats"][0]), np.int64)
    at += ptr_cards
    rows = np.array(_fields(lines[at : at + row_cards], head["count"], head["formats"][1]), np.int64)
    at += row_cards
    v = np.array(_fields(lines[at : at + value_cards], head["count"] * each, head["formats"][2]), float) if value_cards else np.ones(head["count"] * each)
    at += value_cards
    out = [_meta(head["rows"], head["cols"], domain == "C", symmetry), _rows("a", rows, _columns(ptr, 1), v[::each], v[1::2] if each == 2 else None)]
    if rhs_cards:
        m = head["rows"] * head["rhs"]
        b = np.array(_fields(lines[at : at + rhs_cards], m * each, head["formats"][3] or head["formats"][2]), float)
        out.append(_rows("b", np.tile(np.arange(1, head["rows"] + 1), head["rhs"]), np.repeat(np.arange(head["rhs"]), head["rows"]), b[::each], b[1::2] if each == 2 else None))
    return out


def parse_petsc(data: bytes) -> list[pd.DataFrame]:
    """Big-endian binary rows: class id, rows, columns, nnz, row lengths, columns from 0, values."""
    _, n, m, count = np.frombuffer(data, ">i4", 4)
    lengths = np.frombuffer(data, ">i4", n, 16)
    cols = np.frombuffer(data, ">i4", count, 16 + 4 * n).astype(np.int64) + 1
    values = np.frombuffer(data, ">f8", offset=16 + 4 * int(n) + 4 * int(count))
    each = 2 if len(values) >= 2 * count else 1
    rows = np.repeat(np.arange(1, n + 1), lengths)
    return [_meta(int(n), int(m), each == 2), _rows("a", rows, cols, values[: each * count : each].astype(float), values[1 : 2 * count : 2].astype(float) if each == 2 else None)]


SYMMETRY = {0: "general", 1: "symmetric", 2: "hermitian", 3: "general"}


def _parsed(spark: SparkSession, paths, parse) -> tuple[SparseMatrix, DataFrame | None]:
    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                yield from parse(bytes(content))

    return _entries(spark.read.format("binaryFile").load(paths).select("content").mapInPandas(run, ENTRIES))


def _entries(rows: DataFrame) -> tuple[SparseMatrix, DataFrame | None]:
    found = checkpoint(rows)
    meta = found.where("kind = 'meta'").agg(F.max("i").alias("n"), F.max("j").alias("m"), F.max("im").alias("c"), F.max("v").alias("s")).first()
    value = F.struct(F.col("v").alias("re"), "im").alias("v") if meta["c"] else F.col("v")
    entries = found.where("kind = 'a'").select("i", "j", value)
    side = found.where("kind = 'b'").select("i", F.col("j").alias("rhs"), (F.struct(F.col("v").alias("re"), "im") if meta["c"] else F.col("v")).alias("x"))
    sides = side.select("rhs").distinct().count()
    rhs = None if not sides else side.drop("rhs") if sides == 1 else side
    return SparseMatrix(entries, meta["n"], meta["m"], SYMMETRY[int(meta["s"])]), rhs


def ccc(spark: SparkSession, folder: str, real: bool = False) -> tuple[SparseMatrix, None]:
    """hfile (n nnz), ifile (pointers), jfile (rows), afile (re im): complex compressed columns."""
    head = [int(x) for x in spark.read.text(f"{folder}/hfile").first()["value"].split()]
    # values of a file, numbered: pieces of lines in order
    def stream(name):
        w = words(numbered_lines(spark, f"{folder}/{name}")).select("n", F.posexplode("words").alias("k", "w"))
        wide = w.agg(F.max("k")).first()[0] + 1
        return w, wide
    ifile, iw = stream("ifile")
    jfile, jw = stream("jfile")
    afile, _ = stream("afile")
    at = lambda df, wide: df.select((F.col("n") * wide + F.col("k")).alias("pos"), F.col("w"))
    ptr = at(ifile, iw).select((F.col("pos") + 1).alias("j"), F.col("w").cast("long").alias("start"))
    nxt = ptr.select((F.col("j") - 1).alias("j"), F.col("start").alias("stop"))
    from ..operators.structure import expand_pointers

    rows = at(jfile, jw).select((F.col("pos") + 1).alias("pos"), F.col("w").cast("long").alias("i"))
    values = afile.groupBy("n").agg(F.max(F.when(F.col("k") == 0, F.col("w").cast("double"))).alias("re"), F.max(F.when(F.col("k") == 1, F.col("w").cast("double"))).alias("im"))
    value = F.col("re") if real else F.struct("re", "im")
    entries = expand_pointers(ptr.join(nxt, "j"), rows, values.select((F.col("n") + 1).alias("pos"), value.alias("v")))
    return SparseMatrix(entries, head[0], head[0]), None


def distributed_columns(spark: SparkSession, folder: str) -> tuple[SparseMatrix, DataFrame | None]:
    """A folder with ``main``, which names the parts."""
    names = [r["value"].strip() for r in spark.read.text(f"{folder}/main").collect() if r["value"].strip()][1:]
    return _parsed(spark, [f"{folder}/{n}" for n in names], parse_local_columns)


def peer(spark: SparkSession, path: str) -> tuple[SparseMatrix, DataFrame | None]:
    """A file that names the parts, beside it."""
    names = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()][1:]
    folder = path.rsplit("/", 1)[0]
    return _parsed(spark, [n if n.startswith("/") else f"{folder}/{n}" for n in names], parse_local_columns)


def dupros(spark: SparkSession, folder: str, part: int = 1) -> tuple[SparseMatrix, DataFrame]:
    """A folder of little-endian binary files, symmetric: MATA01, COORD01 and ZRHS01 (or the numbers of another part).

    MATA: order and count as 32-bit integers, then the values; COORD: two 32-bit
    integers, all columns, then all rows; ZRHS: a count, then the right-hand side.
    """
    files = spark.read.format("binaryFile").load([f"{folder}/{name}{part:02d}" for name in ("MATA", "COORD", "ZRHS")])

    def run(batches):
        data = {path.rsplit("/", 1)[1][:4]: bytes(content) for batch in batches for path, content in zip(batch["path"], batch["content"])}
        n, count = (int(x) for x in np.frombuffer(data["MATA"], "<i4", 2))
        at = np.frombuffer(data["COOR"], "<i4", 2 * count, 8).astype(np.int64)
        b = np.frombuffer(data["ZRHS"], "<f8", int(np.frombuffer(data["ZRHS"], "<i4", 1)[0]), 4)
        yield _meta(n, n, symmetry=1)
        yield _rows("a", at[count:], at[:count], np.frombuffer(data["MATA"], "<f8", count, 8))
        yield _rows("b", np.arange(1, n + 1), 0, b[:n])

    return _entries(files.select("path", "content").coalesce(1).mapInPandas(run, ENTRIES))


def stored(spark: SparkSession, folder: str) -> tuple[SparseMatrix, DataFrame | None]:
    """What ``writers.save_parquet`` wrote."""
    meta = spark.read.parquet(f"{folder}/meta").first()
    rhs = spark.read.parquet(f"{folder}/rhs") if meta["has_rhs"] else None
    return SparseMatrix(spark.read.parquet(f"{folder}/entries"), meta["rows"], meta["cols"], meta["symmetry"], meta["dof"]), rhs


def _of(parse):
    return lambda spark, path: _parsed(spark, path, parse)


READERS = {
    "laplacian": lambda spark, n: laplacian(spark, int(n)),
    "mm": matrix_market, "mmd": distributed_matrix_market, "ijv": ijv, "three_files": three_files, "mumps": mumps,
    "hb": _of(parse_harwell_boeing), "rsa": _of(parse_harwell_boeing), "chb": _of(parse_harwell_boeing),
    "ccc": ccc, "rcc": lambda spark, path: ccc(spark, path, real=True), "olaf": _of(parse_olaf), "peer": peer, "cscd": distributed_columns,
    "csc": _of(parse_csc_text), "petsc": _of(parse_petsc), "fdupros": dupros, "parquet": stored,
}


def load_matrix(spark: SparkSession, path: str, fmt: str, rhs: bool = True) -> tuple[SparseMatrix, DataFrame | None]:
    """The matrix, and its right-hand side: the file's own, or with ``rhs`` A x for x_i = i."""
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt}; one of {', '.join(READERS)}")
    matrix, b = READERS[fmt](spark, path)
    if b is None and rhs and dict(matrix.entries.dtypes)["v"] == "double":
        x = matrix.col_ids().select(F.col("j").alias("i"), F.col("j").cast("double").alias("x"))
        b = multiply_vector(matrix.full().entries, x, ids=matrix.row_ids())
    return matrix, b
