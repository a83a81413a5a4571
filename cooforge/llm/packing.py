"""Best-fit packing by exact-complement hashing.

Documents are cut into pieces of at most ``capacity`` tokens, and the pieces are
packed into as few sequences as possible. Only the number of pieces of each
length matters for the plan, so the driver sees one count per length (at most
``capacity`` rows, however large the corpus): lengths are taken from the longest
down; a gap is closed by a single length, a pair or a triple whose sum fills it
exactly, found in an index of sums, as often as the counts allow;
what has no exact complement is filled by the longest piece that fits (best
fit). Of plans that use pairs and triples for all gaps or for small ones only,
the one with the fewest sequences counts. A plan entry is a pattern of lengths and how often it is used. Pieces are
numbered within their length by a distributed sort and look up their sequence
and offset in the plan.

Null texts are empty: one piece that holds the end token alone. Equal texts are
packed on their own; doc_id may repeat or be null, each row is packed.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, map_texts, numbered, table

#: Characters on which the two tokenizer libraries' patterns agree beyond doubt.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ‐-‧‰-⁞€]*")


class FastEncoder:
    """The ids of a ``tokenizers`` file of byte-level BPE.

    Texts of plain characters go through tiktoken with the ranks of that very
    file (the same ids, four times faster); all others, and those that hold an
    added token's name, through tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x.content for x in self.full.get_added_tokens_decoder().values()}
        self.added = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not (self.added and self.added.search(text)):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=1)
def encoder(path: str) -> FastEncoder:
    return FastEncoder(path)


def cut(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces of each document.

    A longer document's first piece takes the remainder, so that the others are full.
    """

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                first = len(ids) % capacity or capacity
                for piece, start in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[start : start + capacity] if start else ids[:first]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), *([part.tolist()] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return map_texts(docs.select("doc_id", "text"), run, schema)


class Planner:
    """Patterns of lengths that fill sequences, from the count of each length.

    The index has for each sum the larger members of the pairs, and the largest
    of the triples, of available lengths that make it; a member that has run out
    is passed once and for all. Singles close any gap; pairs and triples close
    gaps of ``reach`` at most, larger ones take their best fit first.
    """

    def __init__(self, counts: dict[int, int], capacity: int, reach: int | None = None):
        self.capacity, self.reach = capacity, capacity if reach is None else reach
        self.left = [0] * (capacity + 1)
        for length, count in counts.items():
            self.left[length] += count
        lengths = np.flatnonzero(self.left)
        known = np.array(self.left) > 0
        self.pairs: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.triples: list[list[int]] = [[] for _ in range(capacity + 1)]
        for s in range(2, capacity + 1):
            high = lengths[(2 * lengths >= s) & (lengths < s)]
            self.pairs[s] = high[known[s - high]][::-1].tolist()
        for s in range(3, capacity + 1):
            self.triples[s] = [a for a in lengths[(3 * lengths >= s) & (lengths < s - 1)][::-1].tolist() if self.pairs[s - a]]
        self.at = {2: [0] * (capacity + 1), 3: [0] * (capacity + 1)}

    def _members(self, kind: int, total: int):
        """The members of the index under a sum that are left."""
        members, at = (self.pairs if kind == 2 else self.triples)[total], self.at[kind]
        while at[total] < len(members) and not self.left[members[at[total]]]:
            at[total] += 1
        return (a for a in islice(members, at[total], None) if self.left[a])

    def _exact(self, kind: int, gap: int) -> list[int] | None:
        """Lengths still there, ``kind`` of them, that sum to ``gap``; they are taken."""
        if kind == 1:
            if not self.left[gap]:
                return None
            self.left[gap] -= 1
            return [gap]
        for a in self._members(kind, gap):
            self.left[a] -= 1
            if rest := self._exact(kind - 1, gap - a):
                return [a, *rest]
            self.left[a] += 1
        return None

    def plan(self) -> list[tuple[list[int], int]]:
        out, left = [], self.left
        for length in range(self.capacity, 0, -1):
            while left[length]:
                left[length] -= 1
                pattern, gap = [length], self.capacity - length
                while gap:
                    exact = next((x for kind in ((1, 2, 3) if gap <= self.reach else (1,)) if (x := self._exact(kind, gap))), None)
                    if exact:
                        pattern += exact
                        break
                    best = next((x for x in range(min(gap, length), 0, -1) if left[x]), None)
                    if best is None:
                        break
                    left[best] -= 1
                    pattern.append(best)
                    gap -= best
                more = min(left[x] // pattern.count(x) for x in set(pattern))
                for x in pattern:
                    left[x] -= more
                out.append((pattern, 1 + more))
        return out


def best_plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Of the plans by several reaches that with the fewest sequences; of equal ones that with the widest reach."""
    plans = [Planner(counts, capacity, capacity >> k).plan() for k in (0, 2, 3, 5)]
    return min(plans, key=lambda plan: sum(uses for _, uses in plan))


def places(plan: list[tuple[list[int], int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its numbers are cut, and each interval's first sequence and offset."""
    taken, base, rows = [0] * (capacity + 1), 0, {}
    for pattern, uses in plan:
        offset = 0
        for x in pattern:
            rows.setdefault(x, []).append((taken[x], base, offset))
            taken[x] += uses
            offset += x
        base += uses
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """The pieces with sequence_id and offset.

    ``pieces`` must be cheap to read again (checkpointed or a table) and have
    doc_id, piece and length.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = pieces.sparkSession.sparkContext.broadcast(places(best_plan(counts, capacity), capacity))
    ranked = numbered(pieces, ["length"], ["doc_id", "piece"], "_rank")

    def run(batches):
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            for x in np.unique(lengths):
                here = lengths == x
                low, base, place = found.value[int(x)]
                k = np.searchsorted(low, rank[here], side="right") - 1
                sequence[here], offset[here] = base[k] + rank[here] - low[k], place[k]
            yield batch.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = True) -> DataFrame:
    return pack(checkpoint(cut(docs, path, capacity, end_id, keep_ids)), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
