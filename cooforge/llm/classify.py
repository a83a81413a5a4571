"""Two text classifiers trained in numpy, and their scoring over whole texts.

ConvolutionalFilter (toxicity): embeddings of hashed words and word
beginnings, filters of several widths, max pooling, a logistic layer, and a threshold calibrated for each
language. FtrlFilter (quality): logistic regression on hashed word n-grams,
fitted by follow-the-regularised-leader and scored as sparse dot products.

Both are fitted on the driver over a bounded sample of labelled rows (see
``labelled_sample``) and broadcast at a fixed size. A score reads the text alone
and is deterministic. Null and empty texts are scored as texts without words.
With no labelled rows, or one class only, the score is that of the prior.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, crc_of_id, free_name, labelled_sample, map_texts, mix, release, schema_of, table

#: Bounds of the labelled sample that a fit may see.
MAX_ROWS, MAX_CHARS = 5000, 20_000
#: Every so many-th row of the sample stays out of the toxicity fit and calibrates its thresholds.
ASIDE = 5
#: A toxic document let through weighs as much as so many clean ones rejected.
MISS = 2


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class ConvolutionalFilter:
    """Hashed embeddings -> convolutions -> max pooling -> logistic score."""

    words = re.compile(r"\w+")

    def __init__(self, size: int = 8, widths=(1, 2, 3), filters: int = 6, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.size, self.widths, self.filters, self.rng = 16, size, widths, filters, rng
        # A word's vector is the sum of eight rows: two each (so that two words share both hardly ever) for the word
        # and for its first 4, 6 and 8 letters, which carry over to inflected forms that the fit never saw.
        self.tables = rng.normal(0, 0.01, (8, 1 << self.bits, size)).astype(np.float32)
        self.kernels = [rng.normal(0, 0.1, (w, size, filters)).astype(np.float32) for w in widths]
        self.shift = [np.zeros(filters, np.float32) for _ in widths]
        self.weights, self.prior = np.zeros(filters * len(widths), np.float32), 0.0
        self.thresholds: dict[str, float] = {}
        self.hash = StemHash(4), StemHash(6, 8)

    def __getstate__(self):
        return self.__dict__ | {"hash": None}

    def __setstate__(self, state):
        self.__dict__ = state | {"hash": (StemHash(4), StemHash(6, 8))}

    def rows_of(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Table rows of all words, where each text starts, and which positions are words.

        After each text stand blanks, so that no filter sees two texts.
        """
        found = [self.words.findall((t or "").lower()) for t in texts]
        gap = max(self.widths)
        length = np.array([len(f) + gap for f in found])
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        hashes, real = np.zeros((2, length.sum()), np.uint64), np.zeros(length.sum(), bool)
        for at, f in zip(starts, found):
            real[at : at + len(f)] = True
        every = [word for f in found for word in f]
        for k, of in enumerate(self.hash):
            hashes[k][real] = of.of(every)
        mask = np.uint64((1 << self.bits) - 1)
        rows = np.stack([(hashes[t // 4] >> np.uint64(16 * (t % 4))) & mask for t in range(8)]).astype(np.uint16)
        return rows, starts, real

    def vectors(self, rows, real, kinds=(0, 1, 2, 3)):
        """Of each position, from the tables of some kinds (4 letters, whole word, 6 letters, 8 letters)."""
        return sum(self.tables[t][rows[t]] for k in kinds for t in (2 * k, 2 * k + 1)) * real[:, None]

    def responses(self, x):
        """Of each filter at each position."""
        n, out = len(x), []
        x = np.concatenate([x, np.zeros((max(self.widths), self.size), np.float32)])
        for kernel, shift in zip(self.kernels, self.shift):
            out.append(sum(x[k : k + n] @ kernel[k] for k in range(len(kernel))) + shift)
        return np.concatenate(out, axis=1)

    def score(self, texts: list) -> np.ndarray:
        out = []
        for group in portions(texts):
            rows, starts, real = self.rows_of(group)
            pooled = np.maximum.reduceat(self.responses(self.vectors(rows, real)), starts, axis=0)
            out.append(sigmoid(np.maximum(pooled, 0).astype(np.float64) @ self.weights + self.prior))
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, texts: list, labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.05) -> ConvolutionalFilter:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        self.prior = float(np.log(share / (1 - share)))
        if not 0 < labels.sum() < len(labels):
            return self
        parts = [self.rows_of([t]) for t in texts]
        self._warm(parts, labels, share)
        balance = min(4.0, (1 - share) / share)
        params = [*self.kernels, *self.shift, self.weights]
        squares = [np.full_like(p, 1e-3) for p in params]
        table_squares = np.full(self.tables.shape[:2], 1e-3, np.float32)
        prior_square = 1e-3
        for epoch in range(epochs):
            order = self.rng.permutation(len(texts))
            settling = epoch >= epochs - 1  # the tables rest, all kinds count
            for k in range(0, len(order), batch):
                chosen = order[k : k + batch]
                rows = np.concatenate([parts[i][0] for i in chosen], axis=1)
                real = np.concatenate([parts[i][2] for i in chosen])
                length = np.array([parts[i][0].shape[1] for i in chosen])
                starts = np.concatenate([[0], np.cumsum(length)[:-1]])
                # Some kinds rest in each step: a form that the fit never saw has the evidence of its beginnings only.
                kinds = [0, 1, 2, 3] if settling else [k for k in range(4) if self.rng.random() < (0.4 if k == 1 else 0.7)] or [2, 3]
                x = self.vectors(rows, real, kinds)
                seen = self.responses(x)
                pooled = np.maximum.reduceat(seen, starts, axis=0)
                best = self._first_best(seen, pooled, starts, length)
                active = np.maximum(pooled, 0)
                y = labels[chosen]
                error = (sigmoid(active @ self.weights + self.prior) - y) * np.where(y == 1, balance, 1.0) / len(chosen)
                error = error.astype(np.float32)
                back = error[:, None] * self.weights * (pooled > 0)
                slopes = [np.zeros_like(p) for p in params]
                slopes[-1] = active.T @ error
                x = np.concatenate([x, np.zeros((max(self.widths), self.size), np.float32)])
                for w, kernel in enumerate(self.kernels):
                    own = slice(w * self.filters, (w + 1) * self.filters)
                    g, at = back[:, own], best[:, own]
                    slopes[len(self.kernels) + w] = g.sum(axis=0)
                    for j in range(len(kernel)):
                        place = at + j
                        slopes[w][j] = np.einsum("bf,bfd->df", g, x[place])
                        change = (g[:, :, None] * kernel[j].T[None]).reshape(-1, self.size)
                        place = place.ravel()
                        valid = np.flatnonzero((place < len(real)) & (np.abs(change).sum(axis=1) > 0))
                        valid = valid[real[place[valid]]]
                        for t in [] if settling else [t for k in kinds for t in (2 * k, 2 * k + 1)]:
                            r = rows[t][place[valid]]
                            np.add.at(table_squares[t], r, (change[valid] ** 2).mean(axis=1))
                            np.add.at(self.tables[t], r, -rate * change[valid] / np.sqrt(table_squares[t][r])[:, None])
                for p, s, g in zip(params, squares, slopes):
                    s += g**2
                    p -= rate * g / np.sqrt(s)
                prior_square += float(error.sum()) ** 2
                self.prior -= rate * float(error.sum()) / prior_square**0.5
        for of in self.hash:
            of.clear()
        return self

    def _first_best(self, seen, pooled, starts, length):
        """The first position of each text's maximum, for each filter."""
        owner = np.repeat(np.arange(len(starts)), length)
        hit = seen == pooled[owner]
        places = np.where(hit, np.arange(len(seen))[:, None], len(seen))
        return np.minimum.reduceat(places, starts, axis=0)

    def _warm(self, parts, labels, share, doubt: float = 10.0):
        """The first dimensions start as the evidence of each table row: how much oftener positive texts have it."""
        for t in range(8):
            seen = np.zeros((2, 1 << self.bits))
            for (rows, _, real), y in zip(parts, labels):
                seen[int(y), np.unique(rows[t][real])] += 1
            usual = (seen[0] + seen[1]) * share
            self.tables[t][:, t // 2] = np.log((seen[1] + doubt * share) / (usual + doubt * share))
        for kernel in self.kernels:
            kernel[0, :4, 0] = 0.5
            kernel[0, np.arange(4), 1 + np.arange(4)] = 0.5
        for w in range(len(self.widths)):
            self.shift[w][0], self.shift[w][1:5] = -2.0, -1.0
            self.weights[w * self.filters : (w + 1) * self.filters] = [0.5, 0.3, 0.3, 0.3, 0.3, *[0.05] * (self.filters - 5)]

    def calibrate(self, texts: list, labels: np.ndarray, languages: list, least: int = 30, low: float = 0.3, high: float = 0.7) -> ConvolutionalFilter:
        """Move the scores up where a cut under one half has the least loss, so that it becomes one half; then find a threshold for each language.

        Of equal cuts the nearest to one half counts, thresholds stay within ``low``
        and ``high``. Both take ``least`` examples of either label, else one half stays.
        """
        languages = np.array([str(x) for x in languages], dtype=object)
        if min(labels.sum(), len(labels) - labels.sum()) < least:
            return self
        cut = _best_cut(self.score(texts), labels, 0.2, 0.5)
        self.prior -= float(np.log(cut / (1 - cut)))
        scores = self.score(texts)
        for language in sorted(set(languages)):
            s, y = scores[languages == language], labels[languages == language]
            if min(y.sum(), len(y) - y.sum()) >= least:
                self.thresholds[language] = _best_cut(s, y, low, high)
        return self


def _best_cut(scores: np.ndarray, labels: np.ndarray, low: float, high: float) -> float:
    """The cut with the least loss, a miss counting MISS times a false alarm; of equal ones the nearest to one half."""
    cuts = np.unique(np.concatenate([np.linspace(low, high, 41), [0.5]]))
    loss = np.array([MISS * ((scores < c) & (labels == 1)).sum() + ((scores >= c) & (labels != 1)).sum() for c in cuts])
    best = cuts[loss == loss.min()]
    return float(best[np.argmin(np.abs(best - 0.5))])


class StemHash(WordHash):
    """Two 16-bit hashes each of two beginnings of a word (by default, one and the whole word)."""

    def __init__(self, short: int, long: int | None = None):
        super().__init__()
        self.short, self.long = short, long

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        low, high = (xxhash.xxh3_64_intdigest(word[:n], n or 0) & 0xFFFFFFFF for n in (self.short, self.long))
        value = self[word] = low | high << 32
        return value


class FtrlFilter:
    """Logistic regression on hashed word n-grams by follow-the-regularised-leader."""

    tokens = re.compile(r"[^\W_]+|[^\w\s]+|_+")

    def __init__(self, bits: int = 20, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, seed: int = 11):
        self.bits, self.alpha, self.beta, self.l1, self.l2, self.seed = bits, alpha, beta, l1, l2, seed
        self.weights, self.prior = np.zeros(1 << bits, np.float64), 0.0
        self.known = WordKind()

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def __setstate__(self, state):
        self.__dict__ = state | {"known": WordKind()}

    def features(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots and values of all n-grams, and where each text starts; each family's values sum to 1 in a text.

        Families: words, word pairs, and runs of one to three word forms (lower
        case, capitals, digits, marks, same as the word before, ...).
        """
        found = [self.known.of(self.tokens.findall(t or "")) for t in texts]
        length = np.array([len(f) + 3 for f in found])
        ends = np.cumsum(length)
        code = np.zeros(ends[-1] if len(ends) else 0, np.uint64)
        for end, n, f in zip(ends, length, found):
            code[end - n + 2 : end - 1] = f
        form = code & np.uint64(15)
        word = code >> np.uint64(4)
        same = np.zeros(len(code), bool)
        same[1:] = (word[1:] == word[:-1]) & (word[1:] != 0)
        form = np.where(same, np.uint64(15), form)
        before, older = np.roll(form, 1), np.roll(form, 2)
        f1, f2 = form, form | before << np.uint64(4)
        f3 = f2 | older << np.uint64(8)
        families = [mix(word, 1), mix(mix(np.roll(word, 1), 2) ^ word, 3), mix(f1, 4), mix(f2, 5), mix(f3, 6)]
        slots = (np.stack(families, axis=1) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        values = np.repeat(1.0 / length, length)
        return slots, values, ends - length

    def score(self, texts: list) -> np.ndarray:
        out = []
        for group in portions(texts):
            slots, values, starts = self.features(group)
            out.append(sigmoid(np.add.reduceat(self.weights[slots].sum(axis=1) * values, starts) * SCALE + self.prior))
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, texts: list, labels: np.ndarray, epochs: int = 4) -> FtrlFilter:
        share = (labels.sum() + 1.0) / (len(labels) + 2.0)
        self.prior = float(np.log(share / (1 - share)))
        if not 0 < labels.sum() < len(labels):
            return self
        rows = []
        for t in texts:
            slots, values, _ = self.features([t])
            at, which = np.unique(slots, return_inverse=True)
            rows.append((at, np.bincount(which.ravel(), np.repeat(values, slots.shape[1])) * SCALE))
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        weight = np.minimum(weight / weight.min(), 4.0)
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        rng, prior_square = np.random.default_rng(self.seed), 1.0
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                at, x = rows[i]
                w = self._solve(z[at], n[at])
                g = (float(sigmoid(w @ x + self.prior)) - labels[i]) * weight[i]
                slope = g * x
                step = (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / self.alpha
                z[at] += slope - step * w
                n[at] += slope**2
                prior_square += g * g
                self.prior -= 0.1 * g / prior_square**0.5
        self.weights = self._solve(z, n)
        self.known.clear()
        return self

    def _solve(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))


#: Values of one family sum to this in every text.
SCALE = 4.0


class WordKind(WordHash):
    """A word's hash with its form in the lowest four bits."""

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        if not word[0].isalnum():
            kind = 1 + (len(word) > 1) + 2 * (word[0] in ".,;:!?") + 4 * (len(set(word)) == 1 and len(word) > 1)
            form = min(kind, 8)
        elif word.isdigit():
            form = 9
        elif word.isupper():
            form = 10 if len(word) > 1 else 11
        elif word.islower():
            form = 12
        else:
            form = 13 if word[0].isupper() else 14
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower()) & ~15 | form
        return value


def portions(texts: list, most: int = 400_000):
    """Runs of texts of about ``most`` characters together, so that arrays stay small."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text or "") > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text or "")
    if group:
        yield group


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn=lambda i: F.lit(True), max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> ConvolutionalFilter:
    """Fitted on a bounded sample; a part of it, which the fit does not see, calibrates the thresholds by language."""
    texts, y, languages = labelled_sample(docs, labels, "toxic", learn, max_rows, max_chars)
    aside = np.array([xxhash.xxh3_64_intdigest(t) % ASIDE == 0 for t in texts], bool)  # equal texts fall on one side
    part = lambda side: [t for t, a in zip(texts, aside) if a == side]
    model = ConvolutionalFilter().fit(part(False), y[~aside]).calibrate(part(True), y[aside], np.array(languages, dtype=object)[aside].tolist())
    del texts
    release()
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn=lambda i: F.lit(True), max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> FtrlFilter:
    texts, y, _ = labelled_sample(docs, labels, "quality", learn, max_rows, max_chars)
    model = FtrlFilter().fit(texts, y)
    del texts
    release()
    return model


def scored(docs: DataFrame, model) -> DataFrame:
    """The documents' own columns and the score, under the name ``score_name`` gives."""
    name, shared = score_name(docs), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.assign(**{name: shared.value.score(batch["text"].tolist())})

    return map_texts(docs, run, schema_of(docs, f"`{name}` double"))


def score_name(docs: DataFrame) -> str:
    return free_name(docs, "_score")


def keep_civil(docs: DataFrame, model: ConvolutionalFilter) -> DataFrame:
    """Documents under the toxicity threshold of their language, columns as they came."""
    of = F.create_map(*[x for k, v in sorted(model.thresholds.items()) for x in (F.lit(k), F.lit(v))]) if model.thresholds else None
    threshold = F.coalesce(of[F.coalesce(F.col("lang"), F.lit("None"))], F.lit(0.5)) if of is not None else F.lit(0.5)
    return scored(docs, model).where(F.col(score_name(docs)) < threshold).select(*docs.columns)


def keep_good(docs: DataFrame, model: FtrlFilter) -> DataFrame:
    """Documents whose quality score is one half or more, columns as they came."""
    return scored(docs, model).where(F.col(score_name(docs)) >= 0.5).select(*docs.columns)


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda i: crc_of_id(i) % 5 == 0
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def op7_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda i: crc_of_id(i) % 3 == 1
    model = fit_quality(docs, table(spark, sf_dir, "labels"), lambda i: ~held_out(i))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
