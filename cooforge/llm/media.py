"""Media columns: AVI motion-JPEG, written and read with numpy.

Bytes become 8-bit grey samples, 192 to a line, in frames of lossless JPEG
(SOF3, one component, predictor 1) with a restart marker after every line, in
an AVI file with an idx1 index. Reading follows the RIFF index to the intra
frames and decodes all lines of many frames in step: restart markers make the
lines independent, so step k decodes the k-th sample of every line at once.
Shots are found where the grey histogram of a frame differs from the one before
by more than the recent differences' mean and three deviations.

A null text is empty: one line of spaces. Every row gives one row; equal texts
give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

WIDTH, MOST_LINES, RATE = 192, 16, 25
#: Lines coded or decoded at once; bounds the memory whatever the batch.
TOGETHER = 4096
#: Categories 0 to 8 of the differences have codes of four bits, in order.
CODE_COUNTS = bytes([0, 0, 0, 9, *[0] * 12])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_head(lines: int, width: int = WIDTH) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, lines, width, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + CODE_COUNTS + bytes(range(9)))
        + _segment(0xDD, struct.pack(">H", width))
        + _segment(0xDA, bytes([1, 1, 0x00, 1, 0, 0]))
    )


def code_lines(samples: np.ndarray, ends_frame: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded lines with restart markers between them, and where each line's bytes end.

    ``ends_frame`` marks lines with no marker after them; ``turn`` is the line's number in its frame.
    """
    rows = len(samples)
    values = samples.astype(np.int32)
    diff = np.empty_like(values)
    diff[:, 0] = values[:, 0] - 128
    diff[:, 1:] = values[:, 1:] - values[:, :-1]
    size = np.array([x.bit_length() for x in range(256)], np.int32)[np.abs(diff)]
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = size + 4
    code = (size << size) | extra
    after = np.cumsum(length, axis=1)
    whole = (after[:, -1] + 7) // 8
    starts = np.concatenate([[0], np.cumsum(whole)])
    at = (after - length + 8 * starts[:-1, None]).ravel()
    code = code.ravel() << (24 - length.ravel() - (at & 7))
    at >>= 3
    total = int(starts[-1])
    out = np.bincount(at, code >> 16, total + 2) + np.bincount(at + 1, code >> 8 & 255, total + 2) + np.bincount(at + 2, code & 255, total + 2)
    out = out[:total].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << (8 * whole - after[:, -1])) - 1).astype(np.uint8)
    full = np.flatnonzero(out == 255)
    marked = np.flatnonzero(~ends_frame)
    put = np.concatenate([full + 1, np.repeat(starts[1:][marked], 2)])
    what = np.concatenate([np.zeros(len(full), np.uint8), np.column_stack([np.full(len(marked), 255), 0xD0 + turn[marked] % 8]).ravel().astype(np.uint8)])
    order = np.argsort(put, kind="stable")
    out = np.insert(out, put[order], what[order])
    ends = starts[1:] + np.searchsorted(full, starts[1:]) + 2 * np.cumsum(~ends_frame)
    return out, ends


def jpeg_frames(frames: list[np.ndarray]) -> list[bytes]:
    """Lossless JPEG files of grey frames of one width."""
    out, k = [], 0
    while k < len(frames):
        group, lines = [], 0
        while k < len(frames) and (not group or lines + len(frames[k]) <= TOGETHER):
            group.append(frames[k])
            lines += len(frames[k])
            k += 1
        heights = np.array([len(f) for f in group])
        last = np.cumsum(heights) - 1
        ends_frame = np.zeros(lines, bool)
        ends_frame[last] = True
        turn = np.arange(lines) - np.repeat(last + 1 - heights, heights)
        coded, ends = code_lines(np.concatenate(group), ends_frame, turn)
        coded, stops = coded.tobytes(), ends[last]
        for height, a, b in zip(heights, [0, *stops[:-1]], stops):
            out.append(frame_head(int(height)) + coded[a:b] + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(jpegs: list[bytes], width: int, height: int, comment: bytes) -> bytes:
    largest = max(map(len, jpegs))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(jpegs), 0, 1, largest, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(jpegs), largest, 10_000, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 256, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment))
    body, index, at = [b"movi"], [], 4
    for jpeg in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        body.append(_chunk(b"00dc", jpeg))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + head + info + _chunk(b"LIST", b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_riff(file: bytes) -> dict:
    """The frames that the index names, the frame rate and the comment of an AVI file."""
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, stack = {"comment": b"", "rate": RATE}, [(12, min(len(file), 8 + struct.unpack_from("<I", file, 4)[0]))]
    index, movi = [], None
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", file, at)
            if name == b"LIST":
                kind = file[at + 8 : at + 12]
                if kind == b"movi":
                    movi = at + 8
                else:
                    stack.append((at + 12, at + 8 + size))
            elif name == b"avih":
                out["rate"] = 1_000_000 / struct.unpack_from("<I", file, at + 8)[0]
            elif name == b"ICMT":
                out["comment"] = file[at + 8 : at + 8 + size]
            elif name == b"idx1":
                index = list(struct.iter_unpack("<4sIII", file[at + 8 : at + 8 + size]))
            at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    out["frames"] = [file[movi + at + 8 : movi + at + 8 + size] for name, _, at, size in index if name[2:] == b"dc"]
    return out


def _scan(jpeg: bytes) -> tuple[int, int, bytes, bytes]:
    """Height, width, Huffman table and scan of a lossless JPEG of one component with a restart for each line."""
    at, height, width, codes, restart = 2, 0, 0, b"", 0
    while True:
        marker, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        if marker == 0xC3:
            _, height, width, _ = struct.unpack_from(">BHHB", body)
        elif marker == 0xC4:
            codes = body[1:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            if restart != width or body[3] != 1:
                raise ValueError("lines must restart and use predictor 1")
            return height, width, codes, jpeg[at + 2 + size : -2]
        at += 2 + size


def _lookup(codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For 16 bits ahead: the difference and the bits it takes."""
    bits, diff = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int16)
    symbols, code = iter(codes[16:]), 0
    for length, count in enumerate(codes[:16], 1):
        for _ in range(count):
            size = next(symbols)
            if length + size > 16:
                raise ValueError("code and extra bits must fit in 16 bits")
            for extra in range(1 << size):
                low = (code << size | extra) << (16 - length - size)
                high = low + (1 << (16 - length - size))
                bits[low:high] = length + size
                diff[low:high] = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
            code += 1
        code <<= 1
    return bits, diff


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """Grey frames, decoded in step over all lines of up to TOGETHER lines of frames."""
    out, group, lines = [], [], 0
    for scan in map(_scan, jpegs):
        if group and (lines + scan[0] > TOGETHER or scan[1:3] != group[0][1:3]):
            out += _decode_together(group)
            group, lines = [], 0
        group.append(scan)
        lines += scan[0]
    return out + (_decode_together(group) if group else [])


def _decode_together(group: list[tuple[int, int, bytes, bytes]]) -> list[np.ndarray]:
    width, codes = group[0][1:3]
    if codes not in _TABLES:
        _TABLES[codes] = _lookup(codes)
    bits, diff = _TABLES[codes]
    data = np.frombuffer(b"".join(scan for *_, scan in group), np.uint8)
    begins = np.concatenate([[0], np.cumsum([len(scan) for *_, scan in group])])[:-1]
    after_ff = np.zeros(len(data), bool)
    after_ff[1:] = data[:-1] == 255
    after_ff[begins] = False
    stuffed = after_ff & (data == 0)
    marks = np.flatnonzero(after_ff & (data >= 0xD0) & (data <= 0xD7))
    keep = ~stuffed
    keep[marks] = keep[marks - 1] = False
    starts = np.sort(np.concatenate([begins, marks + 1]))
    compact = np.concatenate([[0], np.cumsum(keep)])
    data = np.concatenate([data[keep], np.zeros(4, np.uint8)]).astype(np.uint32)
    ahead = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    at = compact[starts] * 8
    if len(at) != sum(height for height, *_ in group):
        raise ValueError("restart markers and lines differ")
    samples, value = np.empty((width, len(at)), np.uint8), np.full(len(at), 128, np.int16)
    for k in range(width):
        coming = ahead[at >> 3] >> (8 - (at & 7)).astype(np.uint32) & 0xFFFF
        value = value + diff[coming] & 255
        at = at + bits[coming]
        samples[k] = value
    samples = np.ascontiguousarray(samples.T)
    return np.split(samples, np.cumsum([height for height, *_ in group])[:-1])


def store(payload: bytes) -> bytes:
    """The AVI file that holds a payload of whole lines; its true length goes into the comment."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    count = -(-len(lines) // MOST_LINES)
    height = -(-len(lines) // count)
    padded = np.full((count * height, WIDTH), 32, np.uint8)
    padded[: len(lines)] = lines
    return write_avi(jpeg_frames(list(padded.reshape(count, height, WIDTH))), WIDTH, height, b"payload=%d" % len(payload))


def load(files: list[bytes]) -> list[tuple[bytes, list[np.ndarray], float]]:
    """Payload, frames and frame rate of each stored file; all their frames are decoded together."""
    riffs = [read_riff(file) for file in files]
    frames = decode_frames([jpeg for riff in riffs for jpeg in riff["frames"]])
    out, at = [], 0
    for riff in riffs:
        own = frames[at : at + len(riff["frames"])]
        at += len(own)
        size = int(riff["comment"].rstrip(b"\0").split(b"=")[1])
        out.append((b"".join(f.tobytes() for f in own)[:size], own, riff["rate"]))
    return out


def _portions(texts, most: int = TOGETHER * WIDTH // 2):
    """Runs of texts, as bytes, of about ``most`` bytes together."""
    group, size = [], 0
    for text in texts:
        raw = (text or "").encode()
        if group and size + len(raw) > most:
            yield group
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield group


def shots(frames: list[np.ndarray], recent: int = 8, deviations: float = 3.0, least: float = 0.05) -> list[tuple[int, int]]:
    """First frame and end of each shot."""
    grey = np.array([np.bincount(f.ravel() >> 4, minlength=16) / f.size for f in frames])
    change = np.abs(np.diff(grey, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for k, x in enumerate(change):
        before = change[max(0, k - recent) : k]
        usual = before.mean() + deviations * before.std() if len(before) >= 2 else 0.5
        if x > max(least, usual):
            cuts.append(k + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)]))


def media_columns(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, sizes, digests, and the timed clips of each document's stored form (and the file itself)."""

    def run(batches):
        for batch in batches:
            rows, ids = [], iter(batch["doc_id"])
            for group in _portions(batch["text"]):
                files = [store(raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)) for raw in group]
                for raw, file, (payload, frames, rate) in zip(group, files, load(files)):
                    clips = [
                        {"clip": k, "start_s": a / rate, "end_s": b / rate, "frames": b - a, "mean": round(float(np.mean([f.mean() for f in frames[a:b]])), 3)}
                        for k, (a, b) in enumerate(shots(frames))
                    ]
                    rows.append((next(ids), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), clips, *([file] if keep_media else [])))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
            yield pd.DataFrame(rows, columns=names + ["media"] * keep_media)

    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "clips array<struct<clip:int,start_s:double,end_s:double,frames:int,mean:double>>" + ", media binary" * keep_media
    )
    return map_texts(docs.select("doc_id", "text"), run, schema)


def clip_rows(media: DataFrame) -> DataFrame:
    """A row for each timed clip."""
    return media.select("doc_id", F.inline("clips"))


def op8_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_columns(table(spark, sf_dir, "documents"), keep_media=False)
    times = F.transform("clips", lambda c: F.format_string("%.2f-%.2f/%.3f", c["start_s"], c["end_s"], c["mean"]))
    feature = F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";"), F.array_join(times, ","))
    return stored.withColumn("feature", feature).drop("clips")
