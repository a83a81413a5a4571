"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is merged by always taking the adjacent pair of least rank, the
leftmost of equals. Pairs wait in one bucket per rank that holds positions in a
linked list of parts; a bitmap of two levels, 1024 ranks to a word, finds the
least non-empty bucket by find-first-set. Merges leave stale entries behind,
which are skipped when they come up. A merge costs O(log) steps, however long
the pre-token is.

Pre-tokens that are new to a worker share one queue, many at a time: no pair
spans two of them, so each sees its own merges in its own order, and a bucket is
found once for all that wait in it. Where a merge makes a pair of lower rank
than its own, that pre-token goes through a queue of its own.

Null texts count as empty: no ids, digests of no bytes. Equal texts give equal
rows; every input row gives one output row; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table

#: The white space of Unicode's White_Space property, as a character class's inside.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


#: Ranks to a word of the bitmap; the upper level has one bit for each word.
BITS = [1 << k for k in range(1024)]

#: Bytes of the pre-tokens that share a queue (one alone may be longer), and pre-tokens that are looked up at once.
SHARED_BYTES, GROUP_PARTS = 1 << 16, 200_000


def _spelled_out(pattern: str, classes: dict[str, str]) -> str:
    """The pattern with these escapes, and \\S, as the insides of character classes; \\s is White_Space, which is what Rust's regex means by it."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((name for name in classes if pattern.startswith(name, i)), None)
        two = pattern[i : i + 2]
        if name:
            out.append(classes[name] if inside else f"[{classes[name]}]")
            i += len(name)
        elif two == r"\S" and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


@lru_cache
def _below_65536(name: str) -> str:
    """The characters of two bytes in UTF-16 that regex counts to a class, as the inside of a class of re."""
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x10000)))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in regex.findall(f"{name}+", every))


class BytePairCodec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 800_000):
        self.ranks = ranks
        self.bytes_of = {rank: part for part, rank in ranks.items()}
        self.parts = pa.array([self.bytes_of.get(rank) for rank in range(max(self.bytes_of) + 1)], pa.binary())
        self.rank_of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        self.rank_of_two = np.full(65536, -1)
        for part, rank in ranks.items():
            if len(part) == 2:
                self.rank_of_two[part[0] << 8 | part[1]] = rank
        self.longest = max(map(len, ranks))
        self.words = [0] * (max(ranks.values()) // 1024 + 1)
        self.buckets: list[list[int]] = [[] for _ in range(max(ranks.values()) + 1)]
        self.split = regex.compile(_spelled_out(pattern, {r"\s": WHITE}))
        # The same pattern for re, which is faster: over ASCII alone, where the letters and digits are few, and below 65536.
        narrow = [
            _spelled_out(pattern, {r"\s": r"\t-\r ", r"\p{L}": "A-Za-z", r"\p{N}": "0-9"}),
            _spelled_out(pattern, {r"\s": WHITE} | {name: _below_65536(name) for name in (r"\p{L}", r"\p{N}")}),
        ]
        self.split_ascii, self.split_two_bytes = (re.compile(p) if r"\p" not in p else self.split for p in narrow)
        self.packed: dict[str, bytes] = {}
        self.remembered = remembered

    @classmethod
    def from_file(cls, path: str, pattern: str) -> BytePairCodec:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(part): int(rank) for part, rank in map(bytes.split, lines)}, pattern)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, get, longest, words, top = len(piece), self.ranks.get, self.longest, self.words, 0
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # end is 0 once a part is gone
        waiting = [-1] * n  # the rank under which the pair that starts here waits
        buckets: dict[int, list[int]] = {}
        fresh = range(n - 1)  # left parts of pairs that are new
        while True:
            for i in fresh:
                waiting[i] = -1
                middle = end[i]
                if middle < n and end[middle] - i <= longest and (rank := get(piece[i : end[middle]])) is not None:
                    waiting[i] = rank
                    if bucket := buckets.get(rank):
                        heappush(bucket, i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> 10
                        words[word] |= BITS[rank & 1023]
                        top |= 1 << word
            while top:
                word = (top & -top).bit_length() - 1
                bits = words[word]
                rank = word << 10 | ((bits & -bits).bit_length() - 1)
                bucket = buckets[rank]
                i = heappop(bucket)
                if not bucket:
                    del buckets[rank]
                    words[word] = bits = bits & (bits - 1)
                    if not bits:
                        top &= top - 1
                if end[i] and waiting[i] == rank:
                    break  # else stale
            else:
                break
            middle = end[i]
            last = end[i] = end[middle]
            end[middle] = 0
            if last < n:
                before[last] = i
            fresh = (i, before[i]) if before[i] >= 0 else (i,)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens in one queue; none is empty or a token itself."""
        text, get, words, buckets = b"".join(pieces), self.ranks.get, self.words, self.buckets
        n, codes = len(text), np.frombuffer(text, np.uint8)
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.zeros(n + 1, np.uint8)  # 1 where a pre-token begins
        starts[0] = 1
        starts[stops] = 1
        pairs = self.rank_of_two[codes[:-1].astype(np.int64) << 8 | codes[1:]]
        pairs[starts[1:-1] == 1] = -1
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        kinds, begins = np.unique(pairs[at], return_index=True)
        at, begins, top = at.tolist(), [*begins.tolist(), len(at)], 0
        for k, rank in enumerate(kinds.tolist()):
            buckets[rank] = at[begins[k] : begins[k + 1]]
            words[rank >> 10] |= BITS[rank & 1023]
            top |= 1 << (rank >> 10)
        waiting = [*pairs.tolist(), -1]
        end, before, first = list(range(1, n + 1)), np.where(starts[:-1] == 1, -1, np.arange(-1, n - 1)).tolist(), starts.tobytes()
        token = self.rank_of_byte[codes].tolist()  # -2 once a part is gone
        edges, alone = [], set()
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << 10 | ((bits & -bits).bit_length() - 1)
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            bucket = buckets[rank]
            bucket.sort()
            for i in bucket:
                if waiting[i] != rank:
                    continue  # stale
                middle = end[i]
                last = end[i] = end[middle]
                waiting[middle], token[middle], token[i] = -1, -2, rank
                right = left = None
                if not first[last]:
                    before[last] = i
                    right = get(text[i : end[last]])
                if right is None:
                    waiting[i] = -1
                else:
                    waiting[i] = right
                    if not (found := buckets[right]):
                        words[right >> 10] |= BITS[right & 1023]
                        top |= 1 << (right >> 10)
                    found.append(i)
                if (j := before[i]) >= 0:
                    left = get(text[j:last])
                    if left is None:
                        waiting[j] = -1
                    else:
                        waiting[j] = left
                        if not (found := buckets[left]):
                            words[left >> 10] |= BITS[left & 1023]
                            top |= 1 << (left >> 10)
                        found.append(j)
                if (right is not None and right < rank) or (left is not None and left < rank):
                    edges = edges or [0, *stops.tolist()]
                    k = bisect_right(edges, i) - 1
                    alone.add(k)
                    waiting[edges[k] : edges[k + 1]] = [-1] * len(pieces[k])
            bucket.clear()
        ids = np.array(token)
        kept = ids != -2
        packed, to = ids[kept].astype("<u4").tobytes(), np.cumsum(kept)[stops - 1].tolist()
        if -1 in ids:
            raise KeyError("a byte without a rank")
        out = [packed[4 * a : 4 * b] for a, b in zip([0, *to], to)]
        for k in alone:
            out[k] = np.array(self.merge(pieces[k]), "<u4").tobytes()
        return out

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text)
        return (self.split_two_bytes if len(text.encode("utf-16-le")) == 2 * len(text) else self.split).findall(text)

    def _learn(self, new: list[str]) -> None:
        """Put the packed ids of new pre-tokens into ``packed``."""
        shared, size = [[]], 0
        for part in new:
            coded = part.encode()
            if (whole := self.ranks.get(coded)) is not None:
                self.packed[part] = whole.to_bytes(4, "little")
                continue
            if size + len(coded) > SHARED_BYTES:
                shared.append([])
                size = 0
            shared[-1].append(part)
            size += len(coded)
        for parts in filter(None, shared):
            self.packed.update(zip(parts, self.merge_all([part.encode() for part in parts])))

    def _look_up(self, parts: list[str]) -> list[bytes]:
        """Packed ids of each pre-token."""
        packed = self.packed
        if len(packed) >= self.remembered:
            packed.clear()
        found, lacking, k = list(map(packed.get, parts)), [], -1
        with suppress(ValueError):
            while True:
                lacking.append(k := found.index(None, k + 1))
        if lacking:
            new = dict.fromkeys([parts[k] for k in lacking])
            self._learn(list(new))
            for k in lacking:
                found[k] = packed[parts[k]]
            for part in new:
                if len(part) > 64:
                    del packed[part]
        return found

    def encode_all(self, texts) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        flat, stops = [], []

        def joined():
            found, a = self._look_up(flat), 0
            for b in stops:
                yield b"".join(found[a:b])
                a = b
            flat.clear()
            stops.clear()

        for text in texts:
            parts = self.pieces(text)
            if len(flat) + len(parts) > GROUP_PARTS:
                yield from joined()
            if len(parts) > GROUP_PARTS:
                yield b"".join([b"".join(self._look_up(parts[k : k + GROUP_PARTS])) for k in range(0, len(parts), GROUP_PARTS)])
            else:
                flat += parts
                stops.append(len(flat))
        yield from joined()

    def encode_packed(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ids, given as integers or packed."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.array(ids, "<u4")
        parts = self.parts.take(pa.array(ids))
        if parts.null_count:
            raise KeyError("an id without a part")
        whole, (_, offsets, data) = len(parts), parts.buffers()
        if not whole:
            return b""
        from_, to = np.frombuffer(offsets, np.int32)[[parts.offset, parts.offset + whole]].tolist()
        return data[from_:to].to_pybytes()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> BytePairCodec:
    return BytePairCodec.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array, unless ``keep_ids`` is off), n_tokens, digests of the ids and of the decoded bytes.

    ``path`` is a rank file that every executor can read.
    """

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if keep_ids else {})
            for packed in coder.encode_all(text or "" for text in batch["text"]):
                out["n_tokens"].append(len(packed) // 4)
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(coder.decode(packed)).hexdigest())
                if keep_ids:
                    out["ids"].append(np.frombuffer(packed, "<u4").tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], **out})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * keep_ids
    return map_texts(docs.select("doc_id", "text"), run, schema)


def op9_bpe_rank_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)
