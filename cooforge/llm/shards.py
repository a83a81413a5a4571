"""K-d tree partitioning of documents into shards of near-equal bytes. DataFrame operations only.

A node that must give m shards is split along its widest metadata dimension
(range in the node over range in the corpus) at the weighted median, or at the
quantile ceil(m / 2) / m where m is odd, until each node is one shard of at most
about the target bytes. Medians are found by distributed histograms: each pass
sums sizes into ``BINS`` bins of every open node and narrows its interval to the
bin that holds the median, so the driver sees a bounded table per pass.

Copies of a text share a place, the least of their metadata, so that they meet
in one leaf. Rows that tie on the dimension are split by text checksum, then doc_id, then an
internal row number. Equal texts stay together where that moves a cut by at most
``SLACK`` of a shard; a larger group of copies is split, so that no shard
depends on one text. Null texts count one byte; null dimensions come first; an
empty table gives no rows; repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, numbered, table

BINS, SLACK = 2048, 0.01
FIRST, LAST = -(2**62), 2**62
#: The columns by which rows are told apart, the dimension first.
ORDER = ["_x", "_crc", "_id", "_tie"]


def _small(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A broadcast table of a few long columns, one row for each open node."""
    values = ", ".join("(" + ", ".join(f"{x}L" for x in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def _dimension(count: int) -> Column:
    return F.element_at(F.array(*[F.col(f"_d{k}") for k in range(count)]), (F.col("dim") + 1).cast("int"))


def kd_shards(docs: DataFrame, dimensions: list[Column], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """The rows of ``docs`` with size, text_crc32, shard and slot.

    ``dimensions`` are integer columns. The number of shards is given, or that
    which brings leaves to ``target_bytes``.
    """
    spark = docs.sparkSession
    dims = {f"_d{k}": F.coalesce(d.cast("long"), F.lit(FIRST)) for k, d in enumerate(dimensions)}
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("_hash"), *[d.alias(k) for k, d in dims.items()])
    copied = slim.groupBy("_hash", "size").agg(F.count("*").alias("_n"), *[F.min(k).alias(f"_g{k}") for k in dims]).where("_n > 1").drop("_n")
    slim = slim.join(copied, ["_hash", "size"], "left").select("doc_id", "size", "text_crc32", *[F.coalesce(f"_g{k}", k).alias(k) for k in dims])
    rows = checkpoint(slim.withColumns({"_tie": F.monotonically_increasing_id(), "_node": F.lit(0).cast("long"), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "_crc": F.col("text_crc32")}))
    total = rows.agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{n}{k}") for k in dims for n, f in (("low", F.min), ("high", F.max))]).first()
    if total["bytes"] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shards = shards or max(1, -(-total["bytes"] // target_bytes))
    width = [max(1, total[f"high{k}"] - total[f"low{k}"]) for k in dims]
    slack = SLACK * total["bytes"] / shards
    leaves = {0: (0, shards)}  # node -> its first shard and how many
    level = 0
    while any(m > 1 for _, m in leaves.values()):
        open_nodes = [n for n, (_, m) in leaves.items() if m > 1]
        stats = {
            r["_node"]: r
            for r in rows.where(F.col("_node").isin(open_nodes) if len(open_nodes) < 64 else F.lit(True))
            .groupBy("_node").agg(F.sum("size").alias("bytes"), *[f(k).alias(f"{n}{k}") for k in dims for n, f in (("low", F.min), ("high", F.max))]).collect()
        }
        cuts, dim_of = {}, {}
        for n in open_nodes:
            if n in stats:
                spans = [(stats[n][f"high{k}"] - stats[n][f"low{k}"]) / w for k, w in zip(dims, width)]
                dim_of[n] = max(range(len(spans)), key=lambda i: (spans[i], -i))
        seek = {n: stats[n]["bytes"] * -(-leaves[n][1] // 2) / leaves[n][1] for n in dim_of}
        spans = {n: (stats[n][f"low_d{d}"], stats[n][f"high_d{d}"]) for n, d in dim_of.items()}
        cuts = _cuts(spark, rows, dim_of, seek, spans, slack, len(dims))
        names = ["node", "dim", *[f"c{k}" for k in range(4)]]
        split = _small(spark, names, [(n, dim_of[n], *cuts[n]) for n in dim_of])
        x = [_dimension(len(dims)), *map(F.col, ORDER[1:])]
        left = x[3] <= F.col("c3")
        for k in (2, 1, 0):
            left = (x[k] < F.col(f"c{k}")) | ((x[k] == F.col(f"c{k}")) & left)
        child = F.when(F.col("node").isNull(), F.col("_node") * 2).otherwise(F.col("_node") * 2 + F.when(left, 0).otherwise(1))
        rows = rows.join(split, F.col("_node") == F.col("node"), "left").withColumn("_node", child).drop(*names)
        after = {}
        for n, (first, m) in leaves.items():
            half = -(-m // 2)
            after[2 * n] = (first, half if n in dim_of else m)
            if n in dim_of:
                after[2 * n + 1] = (first + half, m - half)
        leaves = {n: v for n, v in after.items() if n // 2 in dim_of or v[1] <= 1}
        level += 1
        if level % 4 == 0:
            rows = checkpoint(rows)
    shard_of = _small(spark, ["leaf", "shard_at"], [(n, first) for n, (first, _) in leaves.items()])
    placed = rows.join(shard_of, F.col("_node") == F.col("leaf")).select("doc_id", "size", "text_crc32", F.col("shard_at").cast("int").alias("shard"), "_id", "_tie")
    return numbered(placed, ["shard"], ["_id", "_tie"], "slot").drop("_id", "_tie")


def _cuts(spark, rows: DataFrame, dim_of: dict, seek: dict, spans: dict, slack: float, dims: int) -> dict[int, list[int]]:
    """For each node the key up to which rows go left, where their bytes come nearest to ``seek``.

    Keys are found column by column; each pass narrows every open node's interval of the present column.
    """
    # step: which column; fixed: values of the columns before; low, high: interval; below: bytes left of it
    state = {n: {"step": 0, "fixed": [], "low": spans[n][0], "high": spans[n][1], "below": 0} for n in dim_of}
    done: dict[int, list[int]] = {}
    while state:
        names = ["node", "dim", "step", "f0", "f1", "f2", "low", "high", "wide"]
        for s in state.values():
            s["wide"] = max(1, -(-(s["high"] - s["low"] + 1) // BINS))
        table_rows = [(n, dim_of[n], s["step"], *[*s["fixed"], 0, 0, 0][:3], s["low"], s["high"], s["wide"]) for n, s in state.items()]
        at = _small(spark, names, table_rows)
        joined = rows.join(at, F.col("_node") == F.col("node")).withColumn("_x", _dimension(dims))
        value = F.element_at(F.array(*map(F.col, ORDER)), (F.col("step") + 1).cast("int"))
        here = F.lit(True)
        for k in range(3):
            here = here & ((F.col("step") <= k) | (F.col(ORDER[k]) == F.col(f"f{k}")))
        # low and high lie in [-2^62, 2^62] or close together, so differences fit in a long
        found = (
            joined.withColumn("_v", value).where(here & F.col("_v").between(F.col("low"), F.col("high")))
            .groupBy("node", F.expr("(_v - low) div wide").alias("bin"))
            .agg(F.sum("size").alias("bytes"), F.min("_v").alias("least"), F.max("_v").alias("most")).collect()
        )
        bins: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["node"], r["bin"])):
            bins.setdefault(r["node"], []).append(r)
        for n in list(state):
            s, below = state[n], state[n]["below"]
            for k, r in enumerate(bins[n]):
                if below + r["bytes"] >= seek[n] or k == len(bins[n]) - 1:
                    break
                below += r["bytes"]
            s["below"] = below
            s["low"], s["high"] = r["least"], r["most"]
            if s["low"] != s["high"]:
                continue
            over, under = below + r["bytes"] - seek[n], seek[n] - below
            rest = 3 - s["step"]
            whole = min(over, under) <= slack and s["step"] >= 1 or rest == 0
            if whole:
                tail = [LAST if over <= under else FIRST - 1] * rest
                last = s["low"] if rest or over <= under else s["low"] - 1
                done[n] = [*s["fixed"], last, *tail]
                del state[n]
            else:
                s["fixed"] = [*s["fixed"], s["low"]]
                s["step"] += 1
                s["low"], s["high"] = (0, 2**32 - 1) if s["step"] == 1 else (FIRST, LAST - 1)
    return done


def op5_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    code = lambda c: F.crc32(F.col(c).cast("binary"))
    out = kd_shards(docs, [F.col("n_chars"), code("lang"), code("source")], shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
