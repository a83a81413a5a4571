"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Each text becomes its set of hashed word shingles and a signature of
   ``COORDINATES`` minima. Texts with equal sets are one node from then on, so
   that exact copies, however many, cost no pairs.
2. A node is posted under its rarest coordinate-value pairs. Two signatures that
   agree in ``MATCHES`` coordinates must meet in a prefix of
   COORDINATES - MATCHES + 1 of them under any common order; ordering by how
   often a value occurs (a hashed count over all nodes, of fixed size) keeps
   frequent passages out of the prefix.
3. Entries whose sizes and one-bit summaries rule out every partner in the list go.
   The lists are dealt in chunks of about ``CHUNK`` members, and each chunk counts the
   collisions of its members' signatures. It skips members that are in one
   component already and pairs whose first common entry is another list's, so a
   pair is counted in one list only. What leaves a chunk is a row for each member
   with partners at MATCHES or more, never a row for each pair.
4. Those members get their full sets, and the chunk confirms its pairs on them,
   again skipping what its own links have joined; out come the links of a
   spanning forest. Components grow from them by alternating large and small stars.
5. A list of one chunk is done. Larger ones that still hold several components are
   dealt anew, in another way, for up to ``TURNS`` turns while step 6 would ship
   more rows than there are entries: a group of near copies of which any two are
   linked often enough becomes one component, at a cost linear in it.
6. Whatever lists still hold several components then have each chunk meet each
   other, but for chunks that one component fills alone. No link is lost.

A pair at a Jaccard similarity of exactly 0.8 agrees in fewer than MATCHES of
the 64 coordinates, and is missed, about once in 10^5.

Null and empty texts, and texts without words, have an empty set, no links and
themselves as component. Texts with fewer words than a shingle have one shingle,
the whole sequence. Rows that repeat a doc_id with another text are judged each
by its own text. A null doc_id counts as larger than any other; a group in which
all are null has the component null. Other columns pass untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, checkpoint, map_texts, mix, table

COORDINATES, MATCHES = 64, 37
#: Counters of values; a fixed size at every scale, as the order of a prefix needs no exact counts.
COUNTERS = 1 << 18
#: Members of a chunk and shingles of their sets, about: what one task holds of a list.
CHUNK, CHUNK_SHINGLES = 256, 1 << 21
#: Turns of dealing large lists anew before their chunks meet each other; a bound on rounds, not on what is found.
TURNS = 8
#: Ids or lists that may be broadcast: 4 MB of longs.
BROADCAST_IDS = 250_000
#: A key held by more than one row in so many is hot; there are at most so many hot keys, so they may be broadcast.
HOT = 4096
#: Pairs whose signatures are compared at once.
AT_ONCE = 1 << 15
#: Stands for a null doc_id.
LAST = 2**63 - 1

_RNG = np.random.default_rng(20240501)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_PLACES = np.arange(COORDINATES, dtype=np.int64)


def shingles(text: str | None, words: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = hashes.of(found)
    n = max(1, len(h) - words + 1)
    run = mix(h[:n], 0)
    for k in range(1, min(words, len(h))):
        run = mix(run ^ h[k : k + n], k)
    return np.unique(run)


def signature(items: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(items), 2048):
            low = np.minimum(low, (items[k : k + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, mark (a hash of the text), n (size of the set), print (a fingerprint of the set), sig; the last two are null for empty sets."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                items = shingles(text, words, hashes)
                rows.append((len(items), xxhash.xxh3_128_digest(items.tobytes()), signature(items).tobytes()) if len(items) else (0, None, None))
            found = pd.DataFrame(rows, columns=["n", "print", "sig"])
            yield pd.concat([batch[["doc_id", "mark"]].reset_index(drop=True), found], axis=1)

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text"), run, "doc_id long, mark long, n long, print binary, sig binary")


def distinct_sets(sketched: DataFrame) -> DataFrame:
    """node (a number), print, doc_id and mark of its first row, copies (its rows), n, sig: one row for each distinct set."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "mark")).alias("first")
    groups = sketched.where("n > 0").groupBy("print").agg(first, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return checkpoint(groups.select(F.monotonically_increasing_id().alias("node"), "print", "first.doc_id", "first.mark", "copies", "n", "sig"))


def counters(nodes: DataFrame) -> np.ndarray:
    """How many nodes have a value at a coordinate, summed over the values that share one of COUNTERS counters."""

    def run(batches):
        for batch in batches:
            counter, n = np.unique(_counter(_values(batch["sig"])), return_counts=True)
            yield pd.DataFrame({"counter": counter, "n": n})

    found = map_texts(nodes.select("sig"), run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS, np.int32)
    counts[found["counter"]] = np.minimum(found["n"], 2**31 - 1)
    return counts


def _values(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.int32).reshape(-1, COORDINATES).astype(np.int64)


def _counter(value: np.ndarray) -> np.ndarray:
    return (value * 40503 + _PLACES * 977) % COUNTERS


def _entries(value: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The coordinate-value pairs as 64-bit tokens, and their place in the common order, rare ones first."""
    token = mix((value & 0xFFFFFFFF).astype(np.uint64) | _PLACES.astype(np.uint64) << np.uint64(32), 9)
    return token, counts[_counter(value)].astype(np.uint64) << np.uint64(32) | token >> np.uint64(32)


def postings(nodes: DataFrame, shared) -> DataFrame:
    """token, node, n, bits: each node under the rarest of its coordinate-value pairs, with one bit of each coordinate."""
    prefix = COORDINATES - MATCHES + 1

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            value = _values(batch["sig"])
            token, order = _entries(value, shared.value)
            chosen = np.argsort(order, axis=1, kind="stable")[:, :prefix]
            bits = np.packbits((value & 1).astype(bool), axis=1).view(np.int64).ravel()
            yield pd.DataFrame({
                "token": np.take_along_axis(token, chosen, axis=1).ravel().view(np.int64),
                "node": np.repeat(batch["node"].to_numpy(), prefix),
                "n": np.repeat(batch["n"].to_numpy(), prefix),
                "bits": np.repeat(bits, prefix),
            })

    return map_texts(nodes.select("node", "n", "sig"), run, "token long, node long, n int, bits long")


def _counted(rows: DataFrame) -> DataFrame:
    """Written rows for one side of a join: broadcast where there are few, else dealt, and split where skewed, by Spark."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _spread(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inner join to a written table of unique keys that says in ``held`` how many of ``rows`` have each; hot keys stay where they are."""
    total = keyed.agg(F.sum("held")).first()[0] or 0
    hot = F.col("held") * HOT > total
    often, rest = F.broadcast(keyed.where(hot).drop("held")), keyed.where(~hot).drop("held")
    return rows.join(often, key).unionByName(rows.join(often, key, "left_anti").join(rest, key))


def _chunks(members, size):
    """How many chunks so many members with so many shingles take."""
    return F.ceil(F.greatest(members / CHUNK, size / CHUNK_SHINGLES)).cast("long")


def inverted(nodes: DataFrame, shared) -> DataFrame:
    """token, node, n, chunks: the entries of lists with two members or more, and how many chunks the list takes.

    In a list of one chunk an entry without a partner of a size and of bits that
    leave MATCHES collisions possible has none to count, and goes at once.
    """
    posted = checkpoint(postings(nodes, shared))
    lists = posted.groupBy("token").agg(F.count("*").alias("members"), F.sum("n").alias("size")).where("members > 1")
    lists = checkpoint(lists.select("token", _chunks(F.col("members"), F.col("size")).alias("chunks")))
    wide = lists.where("chunks > 1")
    large = posted.join(_counted(wide), "token").select("token", "node", "n", "chunks")
    whole = posted.join(lists.where("chunks = 1").select("token"), "token").groupBy("token").agg(F.collect_list(F.struct("node", "n", "bits")).alias("members"))
    near = lambda x, y: (5 * x["n"] >= 4 * y["n"]) & (5 * y["n"] >= 4 * x["n"]) & (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= COORDINATES - MATCHES)
    kept = F.filter("members", lambda x: F.exists("members", lambda y: (x["node"] != y["node"]) & near(x, y)))
    small = whole.select("token", F.explode(kept).alias("m")).select("token", "m.node", "m.n", F.lit(1).cast("long").alias("chunks"))
    return checkpoint(small.union(large))


def whole_groups(batches, keys: list[str], rows: int = 4096):
    """The batches of a sorted stream joined to frames of about ``rows`` rows that cut no group of equal keys."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        last = np.logical_and.reduce([(frame[k] == frame[k].iloc[-1]).to_numpy() for k in keys])
        cut = len(frame) - int(last.sum())
        if cut:
            yield frame.iloc[:cut]
        held, n = [frame.iloc[cut:]], len(frame) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def collisions(dealt: DataFrame, nodes: DataFrame, shared) -> DataFrame:
    """token, chunk, node, partners: the members of each chunk that agree with another in MATCHES coordinates.

    ``dealt`` has token, chunk, side, node, root. Sides 0 and 1 of a chunk meet each other, side 2 meets itself.
    Each pair stands once, at one of its two members; the other has a row too.
    """
    least = np.uint64(MATCHES)

    def agreeing(i, j, value, early):
        kept = []
        for k in range(0, len(i), AT_ONCE):
            a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
            same = value[a] == value[b]
            hit = same.sum(axis=1) >= least
            hit[hit] = ~(same[hit] & early[a[hit]]).any(axis=1)
            kept.append(np.stack([a[hit], b[hit]]))
        return np.concatenate(kept, axis=1)

    def run(batches):
        for frame in whole_groups(batches, ["token", "chunk"]):
            token, chunk, side, root, n = (frame[c].to_numpy(np.int64) for c in ("token", "chunk", "side", "root", "n"))
            value = _values(frame["sig"])
            entry, order = _entries(value, shared.value)
            here = entry == token.view(np.uint64)[:, None]
            early, value = order < np.where(here, order, 0).max(axis=1)[:, None], value.astype(np.int32)
            found, gap = [np.zeros((2, 0), np.int64)], 1
            while gap < len(frame):
                together = (token[gap:] == token[:-gap]) & (chunk[gap:] == chunk[:-gap])
                if not together.any():
                    break
                a, b = slice(None, -gap), slice(gap, None)
                met = together & (root[a] != root[b]) & ((side[a] == 2) | (side[a] != side[b])) & (5 * n[a] >= 4 * n[b]) & (5 * n[b] >= 4 * n[a])
                i = np.flatnonzero(met)
                if len(i):
                    found.append(agreeing(i, i + gap, value, early))
                gap += 1
            i, j = np.concatenate(found, axis=1)
            node = frame["node"].to_numpy(np.int64)
            rows = np.unique(np.append(i, j))
            by = np.argsort(i, kind="stable")
            cuts = np.searchsorted(i[by], rows), np.searchsorted(i[by], rows, side="right")
            partners = [node[j[by[low:high]]] for low, high in zip(*cuts)]
            yield pd.DataFrame({"token": token[rows], "chunk": chunk[rows], "node": node[rows], "partners": pd.Series(partners, dtype=object)})

    count = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.join(nodes.select("node", "n", "sig"), "node").repartition(count, "token", "chunk").sortWithinPartitions("token", "chunk")
    return map_texts(rows.select("token", "chunk", "side", "node", "root", "n", "sig"), run, "token long, chunk long, node long, partners array<long>")


def full_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, items: the full sets of the nodes of ``wanted``, read again from their texts."""
    ids = checkpoint(wanted.select("node").distinct().join(nodes.select("node", "doc_id", "mark"), "node"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    texts = texts.join(_counted(ids), ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "items": [shingles(text, words, hashes).tobytes() for text in batch["text"]]})

    return map_texts(texts, run, "node long, items binary")


class Forest:
    """Components of a chunk's members, by position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i


def _linked(items: list[np.ndarray], partners: list[list[int]]) -> Forest:
    """The components of sets under 100 * intersection >= 80 * union, tried for the given partners only."""
    forest, sizes = Forest(len(items)), [len(x) for x in items]
    names, local = np.unique(np.concatenate(items), return_inverse=True)
    local, own = np.split(local, np.cumsum(sizes)[:-1]), np.zeros(len(names), bool)
    for a, others in enumerate(partners):
        if not others:
            continue
        own[local[a]] = True
        for b in others:
            if forest.top(a) != forest.top(b):
                both = int(np.count_nonzero(own[local[b]]))
                if 100 * both >= 80 * (sizes[a] + sizes[b] - both):
                    low, high = sorted((forest.top(a), forest.top(b)))
                    forest.up[high] = low
        own[local[a]] = False
    return forest


def confirmed(collided: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """a, b: links on full sets that join what is linked in each chunk, no more than it has members."""
    collided = checkpoint(collided)
    sets = full_sets(collided, nodes, docs, words)

    def run(batches):
        for frame in whole_groups(batches, ["token", "chunk"], rows=1):
            a, b = [], []
            token, chunk = frame["token"].to_numpy(np.int64), frame["chunk"].to_numpy(np.int64)
            starts = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (chunk[1:] != chunk[:-1])))
            for low, high in zip(starts, np.append(starts[1:], len(frame))):
                node = frame["node"].to_numpy(np.int64)[low:high]
                place = {x: k for k, x in enumerate(node.tolist())}
                items = [np.frombuffer(x, np.uint64) for x in frame["items"].iloc[low:high]]
                forest = _linked(items, [[place[x] for x in p] for p in frame["partners"].iloc[low:high]])
                for k in range(len(node)):
                    if forest.top(k) != k:
                        a.append(node[forest.top(k)])
                        b.append(node[k])
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = collided.join(sets, "node").repartition(count, "token", "chunk").sortWithinPartitions("token", "chunk")
    return map_texts(rows.select("token", "chunk", "node", "partners", "items"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node with a link. Large and small stars until nothing moves."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("held")).select("u", F.least("u", "m").alias("m"), "held")
        large = _spread(both.where("v > u"), checkpoint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpoint(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """node, root with more links."""
    return components(links.union(found.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def several(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The entries of lists with more than one component, with their roots. A list is joined by shares, as many as it has chunks."""
    members = rooted(entries, found).withColumn("share", F.pmod(F.xxhash64("node"), F.col("chunks")))
    open_lists = members.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("chunks").alias("shares")).where("low < high")
    shares = open_lists.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    return members.join(shares, ["token", "share"]).drop("share")


def chunked(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of each list (token, unit, part, n) and its members with theirs.

    A component that fills chunks by itself is a unit, all others of the list are unit -1.
    """
    roots = members.groupBy("token", "root").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    alone = checkpoint(roots.where(f"k >= {CHUNK} OR size >= {CHUNK_SHINGLES}").select("token", "root", F.col("root").alias("unit")))
    dealt = members.join(_counted(alone), ["token", "root"], "left").withColumn("unit", F.coalesce("unit", F.lit(-1).cast("long")))
    units = dealt.groupBy("token", "unit").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    parts = checkpoint(units.select("token", "unit", "k", _chunks(F.col("k"), F.col("size")).alias("parts")))
    chunks = parts.select("token", "unit", (F.col("k") / F.col("parts")).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    of_unit = _counted(parts.select("token", "unit", "parts"))
    return chunks, dealt.join(of_unit, ["token", "unit"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))


def meetings(chunks: DataFrame) -> DataFrame:
    """Which chunks of a list meet: all but two of one component; a number for each meeting."""
    side = lambda s: chunks.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "part", "n")])
    both = side("a").join(side("b"), "token").where("(unit_a < unit_b) OR (unit_a = -1 AND unit_b = -1 AND part_a <= part_b)")
    return both.withColumn("chunk", F.monotonically_increasing_id())


def met(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The members of chunks, once for each meeting."""
    alone = F.expr("unit_a = unit_b AND part_a = part_b")
    left = pairs.select("token", F.col("unit_a").alias("unit"), F.col("part_a").alias("part"), "chunk", F.when(alone, 2).otherwise(0).alias("side"))
    right = pairs.where(~alone).select("token", F.col("unit_b").alias("unit"), F.col("part_b").alias("part"), "chunk", F.lit(1).alias("side"))
    return members.join(left.union(right), ["token", "unit", "part"]).select("token", "chunk", "side", "node", "root")


def linked_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, root: the components of the distinct sets, for every node with a link."""
    shared = nodes.sparkSession.sparkContext.broadcast(counters(nodes))
    entries = inverted(nodes, shared)

    def turn(members: DataFrame, number: int) -> DataFrame:
        chunk = F.pmod(F.xxhash64("node", F.lit(number)), F.col("chunks"))
        dealt = members.select("token", chunk.alias("chunk"), F.lit(2).alias("side"), "node", "root")
        return checkpoint(confirmed(collisions(dealt, nodes, shared), nodes, docs, words))

    found = components(turn(entries.withColumn("root", F.col("node")), 0))
    large = checkpoint(entries.where("chunks > 1"))
    bound = entries.count()
    for number in range(1, TURNS + 1):
        if not large.limit(1).count():
            return found
        members = checkpoint(several(large, found))
        chunks, dealt = chunked(members)
        pairs = checkpoint(meetings(chunks))
        if number == TURNS or (pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).first()[0] or 0) <= bound:
            break
        links = turn(members.drop("n"), number)
        if not links.limit(1).count():
            break
        found = merged(found, links)
    return merged(found, checkpoint(confirmed(collisions(met(dealt, pairs), nodes, shared), nodes, docs, words)))


def judged(docs: DataFrame, words: int) -> DataFrame:
    """For each row doc_id, mark, n_shingles and the doc_id and mark of the first document of its component (null for empty sets)."""
    sketched = checkpoint(sketches(docs, words))
    nodes = distinct_sets(sketched)
    placed = checkpoint(rooted(nodes.select("node", "print", "doc_id", "mark", "copies"), linked_sets(nodes, docs, words)))
    firsts = checkpoint(placed.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"), F.count("*").alias("held")))
    of_print = _spread(placed.select("root", "print", "copies"), firsts, "root")
    of_print = checkpoint(of_print.select("print", F.col("copies").alias("held"), F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark")))
    rows = sketched.select("print", "doc_id", "mark", F.col("n").alias("n_shingles"))
    known = _spread(rows.where("print IS NOT NULL"), of_print, "print").drop("print")
    empty = rows.where("print IS NULL").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("long").alias("first_mark"))
    return known.unionByName(empty)


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of ``docs``."""
    component = F.when(F.col("first_id").isNull(), F.col("doc_id")).when(F.col("first_id") != LAST, F.col("first_id"))
    return judged(docs, words).select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5) -> DataFrame:
    """One document of each group of near copies (the least doc_id), columns as they came; its repeated rows stay."""
    own = F.coalesce("doc_id", F.lit(LAST))
    gone = judged(docs, words).where((F.col("first_id") != own) | (F.col("first_mark") != F.col("mark"))).select(own.alias("_gone"), F.col("mark").alias("_mark")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)) == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_mark"])
    return docs.join(gone, same, "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
