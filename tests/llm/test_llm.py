"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from compare import connect, differences
from conftest import SMALL
from pyspark.sql import functions as F

pytest.importorskip("cooforge.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cooforge.llm import bpe, classify, media, near, packing, queries, shards, spans, topk, urls  # noqa: E402
from cooforge.llm.common import table  # noqa: E402

LONG = "word " * 30_000
ODD = [
    (1, "One two three. Four five six."), (2, None), (3, ""), (4, "   \n\t "), (5, "One two three. Four five six."), (6, "ONE two  three. four five\nsix."),
    (7, LONG), (8, "x"), (8, "x"), (9, "été ß 日本語 \u3000 🙂 \x1c\x85"), (None, "no id here"), (10, "x" * 9000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score string, _key string, _kept long, size string, shard string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i else None, None, len(t or ""), "s", "k", 7, "z", "h") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


# 9: byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def test_bpe_is_tiktoken(codec):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    draw = random.Random(3)
    letters = "aabbcde'stllvre  \t\n\r\x1c\x85\xa0\u2003é日本ñ١Ⅷ²_012.,!?🙂\u0301"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    for text in [*texts, "a" * 4000, "the" * 2000, " " * 999 + "x", "=-" * 1500, *(t or "" for _, t in ODD)]:
        ids = codec.encode(text)
        assert ids == other.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_rows(spark, odd, empty, codec):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = bpe.encode_documents(odd, path, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(ODD) and {r["doc_id"] for r in rows} == {i for i, _ in ODD}
    for r in rows:
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() and r["n_tokens"] == len(r["ids"])
    assert bpe.encode_documents(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_bpe_shared_queue_with_any_ranks(seed):
    """Ranks in any order, so that a merge may make a pair that goes first, and tokens that no merges reach."""
    draw = random.Random(seed)
    parts = {"".join(draw.choices("abc", k=draw.randint(2, 5))).encode() for _ in range(60)} | {bytes([b]) for b in range(256)}
    ranks = dict(zip(sorted(parts), draw.sample(range(3000), len(parts))))
    coder = bpe.BytePairCodec(ranks, r"\p{L}+|\s")

    def plainly(piece):
        if piece in ranks:
            return [ranks[piece]]
        now = [piece[k : k + 1] for k in range(len(piece))]
        while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(now, now[1:])) if a + b in ranks]:
            k = min(found)[1]
            now[k : k + 2] = [now[k] + now[k + 1]]
        return [ranks[x] for x in now]

    words = ["".join(draw.choices("abc", k=draw.choice([1, 2, 3, 5, 9, 40, 200]))) for _ in range(300)]
    expected = [plainly(w.encode()) for w in words]
    coded = [w.encode() for w in words if w.encode() not in ranks]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.merge_all(coded)] == [plainly(w) for w in coded]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_all(words)] == expected
    assert coder.encode(" ".join(words)) == [r for k, ids in enumerate(expected) for r in ([ranks[b" "]] if k else []) + ids]
    assert not any(coder.words) and not any(coder.buckets)


def test_bpe_groups(codec, docs, monkeypatch):
    """Small queues, small groups and a memory that is often cleared give the same ids."""
    texts = [*docs.text[:60].fillna(""), "", "x" * 900, LONG[:9000], *(t or "" for _, t in ODD)]
    expected = [codec.encode_packed(t) for t in texts]
    monkeypatch.setattr(bpe, "GROUP_PARTS", 300)
    monkeypatch.setattr(bpe, "SHARED_BYTES", 100)
    assert list(bpe.BytePairCodec(codec.ranks, public_tokenizers.PATTERN, remembered=500).encode_all(texts)) == expected
    assert [codec.decode(x) for x in expected] == [t.encode() for t in texts]


def test_bpe_splits_alike(codec):
    """Texts below 65536 are split by re; the classes are those of regex, character by character."""
    every = [chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000]
    for k in range(0, len(every), 64):
        text = "\n".join(f"{c}a{c}1 {c}{c} " for c in every[k : k + 64])
        assert codec.pieces(text) == codec.split.findall(text)


def test_bpe_cpu(docs, codec):
    """A text whose pre-tokens are new takes less CPU time, whole, than their merges in a queue for each."""
    text = "\n".join(docs.text.fillna(""))
    pieces = [part.encode() for part in dict.fromkeys(codec.pieces(text))]
    fresh = bpe.BytePairCodec(codec.ranks, public_tokenizers.PATTERN)

    def spent(run):
        began = time.process_time()
        run()
        return time.process_time() - began

    whole, merges = zip(*[(spent(lambda: (fresh.packed.clear(), fresh.encode_packed(text))), spent(lambda: list(map(fresh.merge, pieces)))) for _ in range(2)])
    assert min(whole) < 0.85 * min(merges)


# 6: packing


def test_fast_encoder_is_tokenizers(docs):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*docs.text[:200], *(t or "" for _, t in ODD), "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|", "x<|endoftext|>\n<|endoftext|>y"]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    counts = {int(k): int(c) for k, c in zip(*np.unique(rng.integers(1, 65, 400), return_counts=True))}
    plan = packing.best_plan(counts, 64)
    used = {}
    for pattern, times in plan:
        assert sum(pattern) <= 64 and times > 0
        for x in pattern:
            used[x] = used.get(x, 0) + times
    assert used == counts
    # best fit one piece after another
    room, plain = [0] * 65, 0
    for x in sorted(counts, reverse=True):
        for _ in range(counts[x]):
            gap = next((g for g in range(x, 65) if room[g]), None)
            if gap is None:
                gap, plain = 64, plain + 1
            else:
                room[gap] -= 1
            room[gap - x] += 1
    assert sum(t for _, t in plan) <= plain


def test_packing(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, path).toPandas()
    assert rows.length.sum() == sum(len(packing.encoder(path)(t or "")) + 1 for _, t in ODD)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    for r in rows.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert set(rows[rows.doc_id == 7].sort_values("piece").length[1:]) == {1024}
    assert packing.pack_documents(empty, path).count() == 0


# 8: media


@pytest.mark.parametrize("lines", [1, 2, 15, 16, 17, 333])
def test_avi_round_trip(lines):
    for payload in (np.random.default_rng(lines).integers(0, 256, lines * 192, np.uint8).tobytes(), bytes(192 * lines), b"\xff\x00" * (96 * lines)):
        assert media.load([media.store(payload)])[0][0] == payload


def test_shots():
    dark, light = np.full((16, 192), 10, np.uint8), np.full((16, 192), 200, np.uint8)
    assert media.shots([dark] * 10 + [light] * 5) == [(0, 10), (10, 15)]


def test_media_rows(odd, empty):
    rows = media.media_columns(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        payload, frames, _ = media.load([bytes(r["media"])])[0]
        assert hashlib.sha256(payload).hexdigest() == r["payload_sha256"] and len(payload) % 192 == 0 and len(payload) == r["payload_bytes"]
        assert r["clips"][-1]["end_s"] == pytest.approx(len(frames) / 25) and r["tail_crc32"] == zlib.crc32(payload[-16:])
    assert media.clip_rows(media.media_columns(odd)).count() >= len(ODD)
    assert media.media_columns(empty).count() == 0


# 4 and 7: classifiers


@pytest.mark.parametrize("name,label,least", [("op4_toxicity_cnn", "toxic", 0.93), ("op7_quality_ftrl", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    out = queries.queries()[name](spark, SMALL).toPandas()
    labels = pd.read_parquet(f"{SMALL}/labels.parquet")
    both = out[out.held_out].merge(labels, on="doc_id")
    assert len(out) == 1000 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (both.predicted == both[label]).mean() >= least


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, None), (5, 0, 1), (5, 1, 0), (None, 1, 1), (8, 0, 1)], "doc_id long, quality int, toxic int")
    civil, good = classify.fit_toxicity(odd, labels), classify.fit_quality(odd, labels)
    for model, keep in ((civil, classify.keep_civil), (good, classify.keep_good)):
        scores = classify.scored(odd, model).toPandas().iloc[:, -1]
        assert len(scores) == len(ODD) and scores.between(0, 1).all()
        assert keep(odd, model).columns == odd.columns and keep(empty, model).count() == 0
    for model in (classify.fit_toxicity(empty, labels.where("false")), classify.fit_quality(empty, labels.where("false"))):
        assert classify.scored(odd, model).count() == len(ODD)


def test_score_reads_the_text_alone(spark, odd):
    model = classify.ConvolutionalFilter().fit(["good words", "bad trash words"] * 20, np.array([0, 1] * 20))
    assert model.score(["bad trash words"])[0] > 0.5 > model.score(["good words"])[0]
    assert np.allclose(model.score(["a b c", "", "trash"]), [model.score([t])[0] for t in ("a b c", "", "trash")])


# 2: near duplicates


def brute_components(rows, words):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, docs, words):
    rows = near.near_duplicates(table(spark, SMALL, "documents"), words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(zip(docs.doc_id, docs.text), words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("chunk,turns", [(256, 8), (8, 8), (8, 1)])
def test_near_duplicates_of_a_wide_group(spark, monkeypatch, chunk, turns):
    """Copies of one text with a few words changed: some linked to many, some to none. Small chunks make the later turns work."""
    monkeypatch.setattr(near, "CHUNK", chunk)
    monkeypatch.setattr(near, "TURNS", turns)
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(draw.choice([0, 2, 4, 8, 12, 30])):
            text[draw.randrange(120)] = f"n{i}x{draw.randint(0, 9)}"
        rows.append((i, " ".join(text)))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 2)


def test_near_duplicates_on_odd_rows(odd, empty):
    rows = near.near_duplicates(odd, 2).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD) and by[5]["component_id"] == 1 and by[6]["component_id"] == 1 and by[7]["n_shingles"] == 1
    assert by[None]["component_id"] is None and by[None]["kept"] and by[2]["component_id"] == 2 and by[3]["n_shingles"] == 0
    assert near.keep_one(odd).columns == odd.columns
    assert near.near_duplicates(empty).count() == 0 and near.keep_one(empty).count() == 0


def test_near_duplicates_under_one_id(spark):
    """Rows of one doc_id, or of none, are judged each by its own text."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(7, a), (7, b), (8, a), (9, b), (None, a), (None, "all alone here now"), (7, a)], "doc_id long, text string")
    rows = near.near_duplicates(docs, 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 7, False)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.keep_one(docs, 2).collect()) == sorted([(0, "all alone here now"), (7, a), (7, a), (7, b)])


def test_signature_is_the_minimum():
    items = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    whole = (items[:, None] * near._FACTORS + near._SHIFTS).min(axis=0) >> np.uint64(32)
    assert (near.signature(items) == whole.astype(np.uint32).view(np.int32)).all()


# 10: spans


def brute_spans(rows, min_sentences, min_words):
    seen, out = {}, {}
    for i, text in rows:
        parts = spans.sentences(text or "")
        assert "".join(parts) == (text or "")
        gone = [False] * len(parts)
        count = [len(p.split()) for p in parts]
        for a in range(len(parts)):
            for b in range(a + 1, len(parts) + 1):
                n = sum(count[a:b])
                forward = b - a >= min_sentences and n >= min_words and count[a] and (b - 1 - a < min_sentences or n - count[b - 1] < min_words)
                backward = b - a >= min_sentences and n >= min_words and count[b - 1] and (b - a - 1 < min_sentences or n - count[a] < min_words)
                if forward or backward:
                    key = tuple(" ".join(parts[a:b]).lower().split())
                    if seen.setdefault(key, (i, a, b)) != (i, a, b):
                        gone[a:b] = [True] * (b - a)
        out[i] = "".join(p for p, g in zip(parts, gone) if not g).strip() if any(gone) else text
    return out


def test_spans_are_brute_force(spark, docs):
    rows = sorted(zip(docs.doc_id, docs.text))[:250]
    got = {r["doc_id"]: r["text"] for r in spans.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 2, 25).collect()}
    assert got == brute_spans(rows, 2, 25)


def test_spans_catch_passages_and_leave_the_rest(spark):
    draw = random.Random(1)
    sentence = lambda: " ".join(f"w{draw.randint(0, 10**6)}" for _ in range(draw.randint(3, 14))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    rows = [(i, " ".join([sentence(), sentence(), passage, sentence(), sentence()])) for i in range(30)]
    out = {r["doc_id"]: r["text"] for r in spans.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1] and all(passage not in out[i] and len(out[i]) < len(rows[i][1]) for i in range(1, 30))
    assert all(rows[i][1].split(". ")[0] in out[i] for i in range(30))


def test_sentences_of_a_megabyte_of_marks():
    for text in ("." * 1_000_000, ". " * 300_000, ".'" * 400_000, "a\n" * 300_000, " \n" * 300_000 + "x.", "?!" * 300_000 + " end"):
        began = time.perf_counter()
        parts = spans.sentences(text)
        assert "".join(parts) == text and time.perf_counter() - began < 2
    assert spans.sentences("One... two?! \"Three.\" four\n\nfive") == ["One... ", "two?! ", '"Three." ', "four\n\n", "five"]


def test_spans_catch_short_passages(spark):
    passage = "It rains here. The sun is far. We wait for spring now. Birds will come."
    rows = [(i, f"Own words {i} stand first in row {i}. {passage} The end of {i} is only its own here.") for i in range(3)]
    out = {r["doc_id"]: r["text"] for r in spans.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), piece_words=spans.PIECE_WORDS).collect()}
    assert out[0] == rows[0][1] and all("rains" not in out[i] and "Birds" not in out[i] and f"row {i}" in out[i] and f"end of {i}" in out[i] for i in (1, 2))


def test_repeats_are_remembered_over_batches():
    known = spans.Repeated(most=4)
    known.add(*np.array([[5, 7], [1, 1], [30, 40], [0, 0]]))
    assert known.later(np.array([5, 5, 5, 6, 7]), np.array([1, 1, 2, 1, 1]), np.array([31, 30, 99, 99, 40]), np.array([0, 0, 0, 0, 1])).tolist() == [True, False, False, False, True]
    known.add(*np.array([[5], [1], [10], [0]]))
    assert known.later(np.array([5]), np.array([1]), np.array([30]), np.array([0])).all()


def test_spans_on_odd_rows(odd, empty):
    out = spans.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert {r["doc_id"] for r in out.where("text IS NULL").collect()} == {2}
    assert spans.dedup_documents(empty).count() == 0


def test_spans_catch_passages_pasted_into_sentences(spark):
    """Passages of 50 words and more that share no two whole sentences with their surroundings."""
    draw = random.Random(2)
    some = lambda n: [f"w{draw.randint(0, 10**6)}" for _ in range(n)]
    passages = [[*some(27), some(1)[0] + ".", *some(27)], [*some(18), some(1)[0] + ".", *some(9), some(1)[0] + ".", *some(25)], [*some(5), some(1)[0] + ".", *some(44), some(1)[0] + ".", *some(5)]]
    rows = [(i, " ".join([*some(7), *passages[i % 3], *some(7)]) + ".") for i in range(12)]
    got = {r["doc_id"]: r for r in spans.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), piece_words=spans.PIECE_WORDS).collect()}
    for i, text in rows:
        words = text.split()
        left = got[i]["text"].split()
        if i < 3:
            assert got[i]["text"] == text and not got[i]["_removed"]
        else:  # the rest of its own stays, of the passage less than half
            assert got[i]["_removed"] and left[:7] == words[:7] and left[-7:] == words[-7:] and len(left) - 14 < len(passages[i % 3]) / 2


def test_spans_between_rows_of_one_id(spark):
    """Rows without a doc_id, and different texts under one, are held against each other."""
    passage = " ".join(f"Sentence {k} of the passage that they all share." for k in range(6))
    rows = [(None if i < 10 else 7, f"Own words of row {i} stand here before. {passage} And these close row {i}.") for i in range(20)]
    out = [r["text"] for r in spans.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), piece_words=spans.PIECE_WORDS).collect()]
    assert len(out) == 20 and sum(passage in t for t in out) == 1 and sum("of the passage" in t for t in out) == 1
    assert all(any(f"row {i} stand" in t and f"close row {i}." in t for t in out) for i in range(20))


# 3: top-k


def test_top_k_sql(spark):
    assert not differences(queries.queries()["op3_cover_tree_topk"](spark, SMALL), connect(SMALL), topk.OP3_SQL)


def test_top_k_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 4)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    points = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(200)]
    points += [(i, points[0][1]) for i in range(200, 320)]  # one very common vector
    bad = [(400, None), (420, [None] * 6), (440, [float("nan")] * 6), (460, [float("inf")] + [0.0] * 5), (None, points[1][1]), (480, []), (500, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in points + bad], "vec_id long, embedding array<float>, tree string")
    vectors = topk.integer_vectors(df, 64)
    got = {}
    for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v in points}
    for q in [i for i in whole if i % 20 == 0]:
        order = sorted(((-int(whole[q] @ whole[i]), i) for i in whole if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert set(got) == {i for i in whole if i % 20 == 0}
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_top_k_ships_only_blocks_that_may_hold_an_answer(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "PACK", 3)
    monkeypatch.setattr(topk, "PORTION", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 8
    points = np.concatenate([centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.1, np.repeat(centres[:1], 200, axis=0)])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64)
    queries = vectors.where("vec_id % 20 = 0")
    made = []
    kept = topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda seeded, data: made.append((seeded.count(), data.count(), kept(seeded, data))) or made[-1][2])
    found = sorted(tuple(r) for r in topk.top_k(vectors, queries, 5).collect())
    v = {r["vec_id"]: np.array(r["v"], np.int64) for r in vectors.collect()}
    expected = []
    for q in range(0, 600, 20):
        best = sorted((-int(v[q] @ v[p]), p) for p in v if p != q)[:5]
        expected += [(q, n, p, -s) for n, (s, p) in enumerate(best, 1)]
    assert found == expected
    asked, held, pairs = made[0]
    assert held > 12 and pairs.count() < asked * held / 2


def test_top_k_with_a_repeated_id(spark):
    """An id on 30 rows among equal vectors: the query's own rows take no places from the others."""
    rows = [(0, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(1, 26)] + [(20, [1.0, 2.0])] * 29
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64)
    got = {}
    for r in topk.top_k(vectors.coalesce(1), vectors.where("vec_id = 0").limit(1), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [*range(1, 20), 20]}
    other = topk.top_k(vectors, vectors.where("vec_id = 25"), 20).collect()
    assert [r["vec_id"] for r in other] == [0] * 20


def test_top_k_lists_of_rows_of_one_id(spark):
    """Two query rows of one id have a list each; vectors too long for exact scores are refused."""
    rows = [(0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 3.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id = 0"), 20).collect())
    assert got == [(1, 1, 2 * 3 * 4096), (1, 2, 2 * 3 * 4096), (2, 1, 3 * 4096), (2, 2, 3 * 4096)]
    huge = topk.integer_vectors(spark.createDataFrame([(0, [3e9, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>"), 64)
    with pytest.raises(Exception, match="not be exact"):
        topk.top_k(huge, huge, 2).collect()


# 5: shards


def test_shards(spark, docs):
    rows = queries.queries()["op5_kd_tree_shards"](spark, SMALL).toPandas()
    text = docs.set_index("doc_id").text
    assert sorted(rows.doc_id) == sorted(text.index) and set(rows.shard) == set(range(8))
    assert all(s == len(text[i].encode()) + 1 and c == zlib.crc32(text[i].encode()) for i, s, c in zip(rows.doc_id, rows["size"], rows.text_crc32))
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    sums = rows.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 0.05 * sums.mean()


def test_shards_of_copies_and_odd_rows(spark, odd, empty):
    same = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 600, "one text for most rows").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = shards.kd_shards(same, [F.length("text")], shards=8).toPandas()
    sums = rows.groupby("shard")["size"].sum()
    assert len(rows) == 900 and len(sums) == 8 and sums.max() - sums.min() <= 0.06 * sums.mean()
    found = shards.kd_shards(odd, [F.col("n_chars"), F.crc32(F.col("lang").cast("binary"))], target_bytes=50_000).toPandas()
    assert len(found) == len(ODD) and found["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in ODD)
    assert shards.kd_shards(empty, [F.col("n_chars")], shards=8).count() == 0
    plan = shards.kd_shards(same, [F.length("text")], shards=8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 1: urls


def brute_rule(host, path):
    best = None
    for rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def test_urls(spark):
    odd = ["HTTP://WWW.Example.COM/en/1?x=/fr/#y", None, "", "no scheme/com/", "http://a.net/es/", "http://net/fr/x", "http://a.com", "x://b.com?/", "ftp://É.com/en/", "http://c.net/ES/", "http://xexample.com/en/", "a://b://c/d"]
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").url.tolist()
    df = spark.createDataFrame([(None if k == 3 else k, u, "r") for k, u in enumerate([*odd, *odd, *pages])], "page_id long, url string, rule string")
    rows = urls.filter_urls(df, urls.RULES).collect()
    assert len(rows) == len(odd) * 2 + len(pages)
    by = {r["page_id"]: r for r in rows}
    assert (by[0]["host"], by[0]["path"], by[0]["rule"], by[0]["verdict"]) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (by[1]["host"], by[1]["path"], by[1]["rule"]) == ("", "", None) and by[6]["rule"] is None and by[8]["host"] == "É.com" and by[11]["host"] == "b:"
    for r in rows:
        rule = brute_rule(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] == (urls.RULES[rule] if rule else "block" if r["score"] >= 0.5 else "allow")
    assert urls.filter_urls(df.where("false"), urls.RULES).count() == 0


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = urls.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.93


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "substring_dedup", "packing"]
    docs, labels = table(spark, SMALL, "documents"), pd.read_parquet(f"{SMALL}/labels.parquet")
    start = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL).persist()
        assert docs.columns == start.columns and docs.count() <= before.count()
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(kept & set(labels[(labels.toxic == 1) | (labels.quality == 0)].doc_id)) <= 6
    packed = corpus_pipeline.packing(spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
    assert corpus_pipeline.run(spark, SMALL).count() == packed.count()


def test_every_operator_is_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 11)), "pipeline"}
