"""Substring dedup over sliding sentence spans.

A text is cut into sentences (after . ! or ? before white space, and at line
ends). From every sentence the shortest run of consecutive sentences forward,
and to every sentence the shortest run backward, with at least two sentences and
``MIN_WORDS`` words, is hashed (128 bits over its lower-cased words). Of
sentences of ``PIECE_WORDS`` words or more also the whole is hashed, and their
first and last PIECE_WORDS words, twice, four times as many and so on: a passage
pasted into the middle of sentences shares only such pieces of its first and
last sentence. All runs and pieces meet globally: of equal ones the first by
doc_id and position stays, and every sentence or piece covered by a later one is
removed. Forward and backward runs together cover each sentence of any repeated
passage of MIN_WORDS words or more.

Repeats inside a batch of documents, and of those repeated in earlier batches of
the task, are settled where they are hashed: all but
the first are removed for certain and meet nothing else, so a passage that many
documents share is spread over the tasks. Null texts stay null; a text that
loses everything becomes empty; its row stays. Null doc_ids are later than all
others. Rows are told apart by doc_id and text: those that repeat a doc_id, or
have none, go by a hash of the text. Rows equal in both count as one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, map_texts, mix, schema_of, table

MIN_SENTENCES, MIN_WORDS, PIECE_WORDS = 2, 12, 12
#: Stands for a null doc_id.
LAST = 2**63 - 1
#: In the low 16 bits of a place: a piece of a sentence, and that it is the last words.
PIECE, TAIL = 0x8000, 0x4000
WORD = re.compile(r"\S+")
#: Where a sentence ends. No part of a run of marks or white space is read twice, so that the scan is linear.
CUT = re.compile(r"[.!?][\"')\]]*\s+|\n\s*")
#: Digests that a worker remembers as repeated, so that a passage of very many documents is sent about once a task.
REMEMBERED = 50_000


def sentences(text: str) -> list[str]:
    """The sentences with the white space after them; together they are the text."""
    cuts = [0, *(m.end() for m in CUT.finditer(text)), len(text)]
    return [text[i:j] for i, j in pairwise(cuts) if i < j]


def runs(words: list[list[str]], min_sentences: int, min_words: int) -> list[tuple[int, int]]:
    """First sentence and end of each shortest run, forward and backward."""
    before = [0, *accumulate(map(len, words))]
    n, found = len(words), set()
    for i in range(n):
        if not words[i]:
            continue
        j = max(i + min_sentences, bisect_left(before, before[i] + min_words))
        if j <= n:
            found.add((i, j))
    for j in range(n, 0, -1):
        if not words[j - 1]:
            continue
        i = min(j - min_sentences, bisect_right(before, before[j] - min_words) - 1)
        if i >= 0 and before[j] - before[i] >= min_words:
            found.add((i, j))
    return sorted(found)


def hashed(parts: list[str], min_sentences: int, min_words: int, piece_words: int) -> dict[int, bytes]:
    """The digest of each run and, unless ``piece_words`` is 0, of each piece, by place: first sentence, 16 bits of extent.

    The extent is the number of sentences, or for pieces PIECE, TAIL or not, and how often ``piece_words`` doubles.
    """
    words = [x.lower().split() for x in parts]
    spaced = [" ".join(w) for w in words]
    digest = xxhash.xxh3_128_digest
    out = {i << 16 | min(j - i, PIECE - 1): digest(" ".join([x for x in spaced[i:j] if x])) for i, j in runs(words, min_sentences, min_words)}
    if not piece_words:
        return out
    for i, w in enumerate(words):
        size, double, own = piece_words, 0, set()
        if len(w) >= size:
            out[i << 16 | 1] = digest(spaced[i])
        while size < len(w):
            for extent, piece in ((PIECE | double, w[:size]), (PIECE | TAIL | double, w[-size:])):
                value = digest(" ".join(piece))
                if value not in own:  # pieces of one sentence overlap and are never held against each other
                    own.add(value)
                    out[i << 16 | extent] = value
            size, double = 2 * size, double + 1
    return out


def settled(h, g, doc_id, key, place) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's rows: which are repeats for certain, which may be the first of their digest, and which of these others repeat (by number).

    A repeat is a later row of the batch with the same digest, in another document or at another place.
    """
    again, fresh, first = np.zeros(len(h), bool), np.ones(len(h), bool), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    some = order[np.append(same, False) | np.append(False, same)] if len(h) else order
    some = some[np.lexsort((place[some], key[some], doc_id[some], g[some], h[some]))]
    if len(some):
        starts = np.append(True, (h[some][1:] != h[some][:-1]) | (g[some][1:] != g[some][:-1]))
        of = some[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
        fresh[some] = starts
        again[some] = (doc_id[some] != doc_id[of]) | (key[some] != key[of]) | (place[some] != place[of])
        first = np.unique(of[again[some]])
    return again, fresh, first


class Repeated:
    """The first rows of digests that were repeated inside a batch, at most ``most`` of them: h, g, doc_id, key."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.rows = most, np.zeros((4, 0), np.int64)

    def later(self, h, g, doc_id, key) -> np.ndarray:
        """Which rows come after a remembered one of their digest, in another document."""
        own = self.rows
        if not own.shape[1]:
            return np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(own[0], h), own.shape[1] - 1)
        met = (own[0][at] == h) & (own[1][at] == g)
        return met & ((doc_id > own[2][at]) | ((doc_id == own[2][at]) & (key > own[3][at])))

    def add(self, h, g, doc_id, key) -> None:
        """Of two rows of one h the first stays; the newest digests stay when there are too many."""
        rows = np.concatenate([np.stack([h, g, doc_id, key]), self.rows[:, : self.most]], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], rows[0]))]
        self.rows = rows[:, np.append(True, rows[0][1:] != rows[0][:-1])[: rows.shape[1]]]


def spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """A row for each run or piece: h, g (128 bits of digest), doc_id, key (the row's), place, again (it repeats another for certain).

    Where ``again`` is set, h and g are no digest but spread the rows.
    """

    def run(batches):
        known = Repeated()
        for batch in batches:
            digests, place, lengths = [], [], []
            for text in batch["text"]:
                found = hashed(sentences(text or ""), min_sentences, min_words, piece_words)
                digests.extend(found.values())
                place.extend(found)
                lengths.append(len(found))
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            h, g, place = halves[:, 0].copy(), halves[:, 1].copy(), np.array(place, np.int64)
            doc_id, key = (np.repeat(batch[c].to_numpy(np.int64), lengths) for c in ("doc_id", "_key"))
            again, fresh, first = settled(h, g, doc_id, key, place)
            again |= known.later(h, g, doc_id, key)
            known.add(h[first], g[first], doc_id[first], key[first])
            h[again] = mix((key[again] ^ (place[again] << 20)).view(np.uint64)).view(np.int64)
            g[again] = 0
            keep = again | fresh
            yield pd.DataFrame({"h": h[keep], "g": g[keep], "doc_id": doc_id[keep], "key": key[keep], "place": place[keep], "again": again[keep]})

    known = docs.select("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    return map_texts(known, run, "h long, g long, doc_id long, key long, place long, again boolean")


def without(parts: list[str], places, piece_words: int) -> tuple[str, int]:
    """The text without the sentences and pieces at ``places``, and how many sentences lost words."""
    gone, head, tail = np.zeros(len(parts), bool), {}, {}
    for place in places:
        i, extent = place >> 16, place & 0xFFFF
        if extent & PIECE:
            side = tail if extent & TAIL else head
            side[i] = max(side.get(i, 0), piece_words << (extent & (TAIL - 1)))
        else:
            gone[i : i + extent] = True
    left, n = [], 0
    for i, part in enumerate(parts):
        if not gone[i] and (i in head or i in tail):
            at = [m.span() for m in WORD.finditer(part)]
            first, end = head.get(i, 0), len(at) - tail.get(i, 0)
            gone[i] = True
            if first < end:
                left.append(part[at[first][0] if first else 0 : at[end - 1][1]] + part[at[-1][1] :])
        elif not gone[i]:
            left.append(part)
    return "".join(left).strip(), int(gone.sum())


def cut_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, piece_words: int = 0) -> DataFrame:
    """The documents' columns, with text shortened, then how many sentences each had and how many lost words.

    Sentences are cut whole unless ``piece_words`` is set.
    """
    own, cover, sentence_count, removed_count = (free_name(docs, x) for x in ("_key", "_covered", "_sentences", "_removed"))
    rows = docs.withColumn(own, F.xxhash64("text"))
    found = spans(rows.select(F.col(own).alias("_key"), "doc_id", "text"), min_sentences, min_words, piece_words)
    nth = F.dense_rank().over(Window.partitionBy("h", "g").orderBy("doc_id", "key"))
    later = found.withColumn("_nth", nth).where("again OR _nth > 1")
    covered = later.groupBy(F.col("doc_id").alias("_at"), F.col("key").alias("_at_key")).agg(F.collect_set("place").alias(cover))

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, places in zip(batch["text"], batch[cover]):
                parts, n = sentences(text or ""), 0
                if places is not None and len(places):
                    text, n = without(parts, places.tolist(), piece_words)
                texts.append(text)
                counts.append(len(parts))
                removed.append(n)
            yield batch.drop(columns=cover).assign(**{"text": texts, sentence_count: counts, removed_count: removed})

    same = (F.coalesce(rows["doc_id"].cast("long"), F.lit(LAST)) == covered["_at"]) & (rows[own] == covered["_at_key"])
    joined = rows.join(covered, same, "left").select(*[rows[c] for c in docs.columns], covered[cover])
    return map_texts(joined, run, schema_of(docs, f"`{sentence_count}` int", f"`{removed_count}` int"))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut and n_chars as it is now."""
    out = cut_repeats(docs, piece_words=PIECE_WORDS)
    removed = out.columns[-1]
    if "n_chars" in docs.columns:
        length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, length).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_words=PIECE_WORDS)
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("_sentences").alias("n_sentences"), F.col("_removed").alias("n_removed"))
