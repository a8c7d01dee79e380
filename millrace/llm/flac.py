"""Operator 1: FLAC media columns. Lossless 8-bit mono streams with a seek point for every frame.

Encoding and decoding run over all frames of a slice of rows at once: each frame is a lane of a numpy array, and the
decoder steps all lanes through their Rice codes and predictors together, sample by sample. Frame headers carry CRC-8,
frames carry CRC-16, streams an MD5 of their samples; all three are verified on reading. A frame's place is in the seek
table, so one block of samples can be read without those before it. Streams are read back as rows of PCM
blocks with their sample offsets.

Null payload or text: as empty. Empty text: one block of 64 zero bytes (payloads are padded to a positive multiple of
64). Repeated rows: each gives its row. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import binary_slices, flat, slices, text_of

BLOCK = 1024
RATE = 8000
PAD = 64
LPC_ORDER = 4
LPC_PRECISION = 10
#: Samples that one vectorised step handles.
STEP = 2 << 20

#: Fixed values of the format: the fixed predictors' coefficients, latest sample first.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _crc_table(width: int, polynomial: int) -> np.ndarray:
    top, full, out = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ polynomial) & full if c & top else (c << 1) & full
        out.append(c)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)  # leading zeros of 16 bits


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-16 of each data[start : start + length]."""
    order = np.argsort(-lengths, kind="stable")
    at, n, out = starts[order], lengths[order], np.zeros(len(starts), np.uint16)
    live = len(at)
    for i in range(int(n[0]) if len(n) else 0):
        while live and n[live - 1] <= i:
            live -= 1
        c = out[:live]
        out[:live] = (c << 8) ^ _CRC16[(c >> 8) ^ data[at[:live] + i]]
    back = np.empty_like(out)
    back[order] = out
    return back


def _utf8_number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes a character, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = 1
    while size == 1 or n >= 1 << (7 - size):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        size += 1
    return bytes([(0xFF00 >> size) & 0xFF | n, *reversed(tail)])


_headers: dict[tuple[int, int], bytes] = {}


def frame_header(number: int, size: int) -> bytes:
    if (number, size) in _headers:
        return _headers[number, size]
    code, extra = (10, b"") if size == 1024 else (7, struct.pack(">H", size - 1))
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _utf8_number(number) + extra
    head += bytes([crc8(head)])
    if len(_headers) < 1 << 16:
        _headers[number, size] = head
    return head


def _add(words: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray | int) -> None:
    """Put values of up to 17 bits, highest bit first, at rising bit places of zeroed 64-bit words; no two share a bit."""
    if not len(at):
        return
    word = at >> 6
    room = 64 - (at & 63) - widths  # below 0: the low bits go to the next word
    v = values.astype(np.uint64)
    new = np.empty(len(word), bool)
    new[0] = True
    np.not_equal(word[1:], word[:-1], out=new[1:])
    firsts = np.flatnonzero(new)
    spill = np.flatnonzero(room < 0)
    placed = v << np.maximum(room, 0).astype(np.uint64)
    placed[spill] >>= (-room[spill]).astype(np.uint64)
    words[word[firsts]] |= np.bitwise_or.reduceat(placed, firsts)
    words[word[spill] + 1] |= v[spill] << (64 + room[spill]).astype(np.uint64)


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictor coefficients (lanes, LPC_ORDER) and shifts, by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : f.shape[1] - lag]) for lag in range(LPC_ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-9
    a, error = np.zeros((len(x), LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_PRECISION - 1 - np.ceil(np.log2(most)).astype(np.int64) - 1, 0, 15)
    limit = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64), shift


def _residuals(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """What the predictor leaves of the samples after the first `order` ones."""
    order, n = coefficients.shape[1], x.shape[1]
    guess = np.zeros((len(x), n - order), np.int32)
    for j in range(order):
        guess += coefficients[:, j : j + 1] * x[:, order - 1 - j : n - 1 - j]
    return x[:, order:] - (guess >> (shift[:, None] if isinstance(shift, np.ndarray) else shift))


def _encode_lanes(x: np.ndarray, numbers: list[int], partition_order: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All frames of blocks of one size (lanes, samples): their bytes one after another, and their lengths."""
    lanes, n = x.shape
    tries = [_residuals(x, np.tile(np.array(FIXED[o], np.int32), (lanes, 1)).reshape(lanes, o), 0) for o in range(2 if n > 8 else 1)]
    lpc, shift = np.zeros((lanes, LPC_ORDER), np.int64), np.zeros(lanes, np.int64)
    if n > 8:
        lpc, shift = _lpc(x)
        tries.append(_residuals(x, lpc.astype(np.int32), shift.astype(np.int32)))
    cost = np.stack([np.abs(e).sum(1) for e in tries], 1)
    choice = cost.argmin(1)
    same = (x == x[:, :1]).all(1)
    orders = np.where(choice == 2, LPC_ORDER, choice)
    parts = 1 << partition_order if n % (1 << partition_order) == 0 and n >> partition_order > LPC_ORDER else 1
    size = n // parts

    zigzag = np.zeros((lanes, n), np.int32)
    live = np.ones((lanes, n), bool)
    for c, e in enumerate(tries):
        of = np.flatnonzero(choice == c)
        skip = n - e.shape[1]
        zigzag[of, skip:] = (e[of] << 1) ^ (e[of] >> 31)
        live[of, :skip] = False
    sums = zigzag.reshape(lanes, parts, size).sum(2)
    k = np.clip(np.floor(np.log2(np.maximum(sums / size * 0.7, 1))).astype(np.int32), 0, 14)
    k_of = np.repeat(k, size, 1)
    lengths = np.where(live, (zigzag >> k_of) + 1 + k_of, 0)
    lengths[:, ::size] += 4  # each partition's parameter
    warm = 8 * orders + np.where(choice == 2, 9 + LPC_PRECISION * LPC_ORDER, 0)
    body = 8 + warm + 6 + lengths.sum(1)
    raw = ~same & (body >= 8 + 8 * n)
    coded = ~same & ~raw
    body = np.where(same, 16, np.where(raw, 8 + 8 * n, body))

    heads = [frame_header(i, n) for i in numbers]
    head = np.array([len(h) for h in heads], np.int64)
    frames = head + (body + 7) // 8 + 2
    starts = np.cumsum(frames) - frames
    out = np.zeros(int(frames.sum()) // 8 + 2, np.uint64)
    at = 8 * (starts + head)
    kind = np.where(same, 0, np.where(raw, 1, np.where(choice == 2, 0b100000 | (LPC_ORDER - 1), 0b001000 | orders)))
    _add(out, at, kind << 1, 8)
    at = at + 8
    u = x & 0xFF
    _add(out, at[same], u[same, 0], 8)
    if raw.any():
        _add(out, (at[raw, None] + 8 * np.arange(n)).ravel(), u[raw].ravel(), 8)
    for j in range(int(orders.max(initial=0))):
        of = np.flatnonzero(coded & (orders > j))
        _add(out, at[of] + 8 * j, u[of, j], 8)
    at = at + 8 * orders
    of = np.flatnonzero(coded & (choice == 2))
    _add(out, at[of], np.full(len(of), LPC_PRECISION - 1), 4)
    _add(out, at[of] + 4, shift[of], 5)
    for j in range(LPC_ORDER):
        _add(out, at[of] + 9 + LPC_PRECISION * j, lpc[of, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    at = at + np.where(choice == 2, 9 + LPC_PRECISION * LPC_ORDER, 0)
    of = np.flatnonzero(coded)
    if len(of):
        _add(out, at[of] + 2, np.full(len(of), parts.bit_length() - 1), 4)
        ends = (at[of] + 6)[:, None] + np.cumsum(lengths[of], 1, dtype=np.int64)
        first = ends[:, ::size] - lengths[of][:, ::size]
        _add(out, first.ravel(), k[of].ravel(), 4)
        if len(of) < lanes:
            zigzag, k_of, live = zigzag[of], k_of[of], live[of]
        one = np.where(live, np.int32(1) << k_of, 0)  # warm-up samples have no code: no bits
        width = np.where(live, k_of + 1, 0)
        _add(out, (ends - width).ravel(), ((zigzag & (one - 1)) | one).ravel(), width.ravel())
    out = out.byteswap().view(np.uint8)[: int(frames.sum())]
    where = np.repeat(starts - (np.cumsum(head) - head), head) + np.arange(int(head.sum()))
    out[where] = np.frombuffer(b"".join(heads), np.uint8)
    sums16 = crc16(out, starts, frames - 2)
    out[starts + frames - 2], out[starts + frames - 1] = sums16 >> 8, sums16 & 0xFF
    return out, frames


def encode(payloads: list[bytes], block: int = BLOCK, partition_order: int = 0) -> list[bytes]:
    """A stream for each payload (at least one byte each); its bytes less 128 are the samples."""
    pieces, sizes, numbers, owner = [], [], [], []
    for i, p in enumerate(payloads):
        for number, a in enumerate(range(0, len(p), block)):
            pieces.append((i, a))
            sizes.append(min(block, len(p) - a))
            numbers.append(number)
            owner.append(i)
    size = np.array(sizes)
    frames: list[bytes] = [b""] * len(sizes)
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        for a in range(0, len(of), max(1, STEP // n)):
            lanes = of[a : a + max(1, STEP // n)].tolist()
            x = np.frombuffer(b"".join(payloads[pieces[j][0]][pieces[j][1] : pieces[j][1] + n] for j in lanes), np.uint8)
            data, lengths = _encode_lanes(x.reshape(len(lanes), n).astype(np.int32) - 128, [numbers[j] for j in lanes], partition_order)
            ends = np.cumsum(lengths)
            data = data.tobytes()
            for j, b, e in zip(lanes, (ends - lengths).tolist(), ends.tolist(), strict=True):
                frames[j] = data[b:e]
    out, j = [], 0
    for p in payloads:
        count = -(-len(p) // block)
        own = frames[j : j + count]
        lengths = [len(f) for f in own]
        info = struct.pack(">HH", block, block) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed(p)).digest()
        seek, at = [], 0
        for i, n in enumerate(lengths):
            seek.append(struct.pack(">QQH", i * block, at, sizes[j + i]))
            at += n
        table = b"".join(seek)
        out.append(b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *own]))
        j += count
    return out


def signed(payload: bytes) -> bytes:
    """Samples (byte less 128) as signed bytes."""
    return (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()


def seek_table(media: bytes) -> tuple[dict, np.ndarray]:
    """What the stream's head says: total samples and MD5; and (sample offset, byte offset in media, samples) a frame."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, head, points = 4, False, {}, None
    while not last:
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            head = {"bits": (packed >> 36 & 31) + 1, "channels": (packed >> 41 & 7) + 1, "rate": packed >> 44, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            points = np.array(list(struct.iter_unpack(">QQH", body)), np.int64).reshape(-1, 3)
        at += 4 + size
    if points is None or not head or (head["bits"], head["channels"]) != (8, 1):
        raise ValueError("a stream of 8 bits, one channel and a seek table is needed")
    if not np.array_equal(points[:, 0], np.cumsum(points[:, 2]) - points[:, 2]) or points[:, 2].sum() != head["samples"]:
        raise ValueError("the seek table does not fit the stream")
    points[:, 1] += at
    return head, points


def _decode_lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The samples (lanes, most samples) of frames at data[start:end]; lanes come in order of falling size."""
    lanes, most = len(starts), int(sizes.max())
    found = (data[ends - 2].astype(np.uint16) << 8) | data[ends - 1]
    if not np.array_equal(crc16(data, starts, ends - starts - 2), found):
        raise ValueError("a frame's CRC-16 is wrong")
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    n = len(data) + 8
    window = np.zeros(n, np.uint64)
    for j in range(8):
        window |= padded[j : j + n] << np.uint64(56 - 8 * j)
    heads = np.zeros(lanes, np.int64)
    for i, (a, size, number) in enumerate(zip(starts.tolist(), sizes.tolist(), numbers.tolist(), strict=True)):
        head = frame_header(number, size)
        if data[a : a + len(head)].tobytes() != head:
            raise ValueError("a frame's header or its CRC-8 is wrong")
        heads[i] = len(head)
    pos = 8 * (starts + heads)

    def read(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 32 bits at each place."""
        w = window[at >> 3] << (at & 7).astype(np.uint64)
        width = np.asarray(width)
        return np.where(width > 0, (w >> (np.uint64(64) - np.maximum(width, 1).astype(np.uint64))).astype(np.int64), 0)

    def as_signed(v: np.ndarray, width: int | np.ndarray) -> np.ndarray:
        half = np.int64(1) << (np.asarray(width) - 1)
        return (v ^ half) - half

    kind = read(pos, 8) >> 1
    pos = pos + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all():
        raise ValueError("a reserved subframe type")
    order = np.where(lpc, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    x = np.zeros((lanes, most), np.int32)
    of = np.flatnonzero(constant)
    x[of] = as_signed(read(pos[of], 8), 8)[:, None]
    for i in np.flatnonzero(verbatim).tolist():
        a = int(pos[i]) >> 3
        x[i, : sizes[i]] = data[a : a + sizes[i]].view(np.int8)
    deep = int(order.max(initial=0))
    for j in range(deep):
        of = np.flatnonzero(order > j)
        x[of, j] = as_signed(read(pos[of], 8), 8)
        pos[of] += 8
    coefficients, shift = np.zeros((lanes, deep), np.int64), np.zeros(lanes, np.int64)
    for o in range(1, min(deep, 4) + 1):
        coefficients[fixed & (order == o), :o] = FIXED[o]
    of = np.flatnonzero(lpc)
    if len(of):
        precision = read(pos[of], 4) + 1
        shift[of] = read(pos[of] + 4, 5)
        pos[of] += 9
        for j in range(deep):
            own = order[of] > j
            coefficients[of[own], j] = as_signed(read(pos[of[own]], precision[own]), precision[own])
            pos[of[own]] += precision[own]

    coded = np.flatnonzero(fixed | lpc)
    if len(coded):
        pos, size, order, coefficients, shift = pos[coded], sizes[coded], order[coded], coefficients[coded], shift[coded]
        wide = read(pos, 2)  # 4 or 5 bits a parameter
        if (wide > 1).any():
            raise ValueError("a reserved residual coding")
        part = size >> read(pos + 2, 4)
        pos = pos + 6
        k, raw, y = np.zeros(len(coded), np.int64), np.full(len(coded), -1), np.ascontiguousarray(x[coded].T)
        taps = np.ascontiguousarray(coefficients.T.astype(np.int32))
        shift, any_raw, one = shift.astype(np.int32), False, np.uint64(1)
        lengths, live = np.unique(part).tolist(), len(coded)
        for i in range(most):
            while live and size[live - 1] <= i:
                live -= 1
            p = pos[:live]
            new = np.flatnonzero(i % part[:live] == 0) if any(i % m == 0 for m in lengths) else ()
            if len(new):
                width = 4 + wide[new]
                k[new] = read(p[new], width)
                p[new] += width
                escaped = new[k[new] == (1 << width) - 1]
                raw[new] = -1
                if len(escaped):
                    raw[escaped] = read(p[escaped], 5)
                    p[escaped] += 5
                any_raw = bool((raw[:live] >= 0).any())
                right = (63 - k).astype(np.uint64)
            w = window[p >> 3] << (p & 7).view(np.uint64)
            zeros = _ZEROS[w >> np.uint64(48)]
            rest = w << zeros.view(np.uint64) << one
            if zeros.max(initial=0) == 16:  # codes of 16 zeros or more
                long = np.flatnonzero(zeros == 16)
                at, count = p[long] + 16, np.full(len(long), 16)
                open_ = np.arange(len(long))
                while len(open_):
                    z = _ZEROS[read(at[open_], 16)]
                    count[open_] += z
                    at[open_] += z
                    open_ = open_[z == 16]
                zeros[long] = count
                rest[long] = window[(at + 1) >> 3] << ((at + 1) & 7).view(np.uint64)
            kk = k[:live]
            u = (zeros << kk) | (rest >> right[:live] >> one).view(np.int64)
            e = ((u >> 1) ^ -(u & 1)).astype(np.int32)
            step = zeros + kk
            step += 1
            if any_raw:
                of = np.flatnonzero(raw[:live] >= 0)
                e[of] = np.where(raw[of] > 0, as_signed(read(p[of], raw[of]), np.maximum(raw[of], 1)), 0)
                step[of] = raw[of]
            if i and deep:
                guess = taps[0, :live] * y[i - 1, :live]
                for j in range(1, min(i, deep)):
                    guess += taps[j, :live] * y[i - 1 - j, :live]
                guess >>= shift[:live]
                e += guess
            if i < deep:
                past = order[:live] <= i
                y[i, :live] = np.where(past, e, y[i, :live])
                p += np.where(past, step, 0)
            else:
                y[i, :live] = e
                p += step
        x[coded] = y.T
    return x


def decode_blocks(streams: list[bytes], only: list[list[int]] | None = None) -> Iterator[tuple[int, int, bytes]]:
    """(stream, sample offset, block bytes) of all frames, or of each stream's frames named in `only`, in order."""
    heads = [seek_table(m) for m in streams]
    jobs = []  # stream, frame, start, end, samples, sample offset
    for i, (m, (_, points)) in enumerate(zip(streams, heads, strict=True)):
        edges = [*points[:, 1].tolist(), len(m)]
        for j in range(len(points)) if only is None else only[i]:
            jobs.append((i, j, edges[j], edges[j + 1], int(points[j, 2]), int(points[j, 0])))
    at = 0
    while at < len(jobs):
        total, to = 0, at
        while to < len(jobs) and (to == at or total + jobs[to][4] <= STEP):
            total += jobs[to][4]
            to += 1
        part = sorted(range(at, to), key=lambda j: -jobs[j][4])
        data = np.frombuffer(b"".join(streams[jobs[j][0]][jobs[j][2] : jobs[j][3]] for j in part), np.uint8)
        lengths = np.array([jobs[j][3] - jobs[j][2] for j in part], np.int64)
        ends, sizes = np.cumsum(lengths), np.array([jobs[j][4] for j in part], np.int64)
        x = _decode_lanes(data, ends - lengths, ends, sizes, np.array([jobs[j][1] for j in part]))
        blocks = {j: (x[row, : jobs[j][4]] + 128).astype(np.uint8).tobytes() for row, j in enumerate(part)}
        for j in range(at, to):
            yield jobs[j][0], jobs[j][5], blocks[j]
        at = to


def decode(streams: list[bytes]) -> list[bytes]:
    """All payloads, each held against its stream's length and MD5."""
    parts: list[list[bytes]] = [[] for _ in streams]
    for i, _, block in decode_blocks(streams):
        parts[i].append(block)
    out = [b"".join(p) for p in parts]
    for m, p in zip(streams, out, strict=True):
        head, _ = seek_table(m)
        if head["samples"] != len(p) or head["md5"] != hashlib.md5(signed(p)).digest():
            raise ValueError("a stream's length or MD5 is wrong")
    return out


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stream of each text's padded UTF-8 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                data, offsets = flat(part.column("text"))
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                padded = [t + bytes(-len(t) % PAD or (0 if t else PAD)) for t in texts]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(encode(padded), pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


BLOCKS = "doc_id long, sample_offset long, n_samples int, pcm binary, n_bytes long, media_bytes long, media_sha256 string, md5 binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in binary_slices(batch, "media", STEP):
            streams = part.column("media").to_pylist()
            found = list(decode_blocks(streams))
            own, offsets = np.array([i for i, _, _ in found], np.int64), np.array([a for _, a, _ in found], np.int64)
            whole = {
                "n_bytes": part.column("n_bytes"), "media_bytes": pa.array([len(m) for m in streams], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in streams], pa.string()),
                "md5": pa.array([seek_table(m)[0]["md5"] for m in streams], pa.binary()),
            }
            first = pa.array(own, mask=offsets > 0)
            rows = {"doc_id": part.column("doc_id").take(pa.array(own)), "sample_offset": pa.array(offsets), "n_samples": pa.array([len(b) for _, _, b in found], pa.int32()), "pcm": pa.array([b for _, _, b in found], pa.binary())}
            yield pa.record_batch(rows | {k: v.take(first) for k, v in whole.items()})


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Rows of (doc_id, n_bytes, media): one row a frame, with its sample_offset and pcm (unsigned bytes), checksums
    verified, frames of a stream in order. What is known of a whole stream stands in its first row: n_bytes, media_bytes,
    media_sha256 and md5."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_blocks, BLOCKS)


class _Stream:
    """What is gathered of one stream while its blocks pass."""

    def __init__(self, row: dict):
        self.head = row
        self.sha, self.md5, self.tail = hashlib.sha256(), hashlib.md5(), b""
        self.samples = self.blocks = self.peak = self.energy = self.crossings = 0
        self.loudest, self.loudest_at, self.low = -1, 0, None

    def add(self, data: bytes, offset: int, blocks: int, peak: int, energy: int, crossings: int, loudest: int, loudest_at: int, lows: tuple[bool, bool]) -> None:
        """Blocks that follow one another, and their sums; lows: whether their first and last sample lie below the middle."""
        if offset != self.samples:
            raise ValueError(f"a block begins at sample {offset}, not {self.samples}")
        self.sha.update(data)
        self.md5.update(signed(data))
        self.tail = (self.tail + data[-PAD:])[-PAD:]
        self.samples, self.blocks = self.samples + len(data), self.blocks + blocks
        self.peak, self.energy = max(self.peak, peak), self.energy + energy
        self.crossings += crossings + (self.low is not None and self.low != lows[0])
        self.low = lows[1]
        if loudest > self.loudest:
            self.loudest, self.loudest_at = loudest, loudest_at

    def row(self) -> dict:
        if self.md5.digest() != self.head["md5"]:
            raise ValueError("a stream's MD5 is wrong")
        feature = f"peak={self.peak};energy={self.energy};crossings={self.crossings};loudest={self.loudest_at}"
        return {k: self.head[k] for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256")} | {"payload_bytes": self.samples, "payload_sha256": self.sha.hexdigest(), "tail_crc32": zlib.crc32(self.tail), "feature": feature, "blocks": self.blocks}


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, blocks long"


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream, schema = None, pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column("pcm").to_pylist()
        whole, ends, offsets = b"".join(data), np.cumsum([len(x) for x in data]), batch.column("sample_offset").to_numpy()
        starts, x = ends - [len(x) for x in data], np.frombuffer(whole, np.uint8).astype(np.int16) - np.int16(128)
        energy, peak = np.add.reduceat(x * x, starts, dtype=np.int64), np.maximum.reduceat(np.abs(x), starts)
        low = x < 0
        turns = np.zeros(len(x), np.int64)
        turns[1:] = low[1:] != low[:-1]
        cuts = np.flatnonzero(offsets == 0).tolist()
        edges = [*([0] if not cuts or cuts[0] else []), *cuts, len(data)]
        done = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if offsets[a] == 0:
                done += [stream.row()] if stream else []
                stream = _Stream({k: batch.column(k)[a].as_py() for k in ("doc_id", "n_bytes", "media_bytes", "media_sha256", "md5")})
            i, j = int(starts[a]), int(ends[b - 1])
            at = a + int(np.argmax(energy[a:b]))
            stream.add(whole[i:j], int(offsets[a]), b - a, int(peak[a:b].max()), int(energy[a:b].sum()), int(turns[i + 1 : j].sum()), int(energy[at]), int(offsets[at]), (bool(low[i]), bool(low[j - 1])))
        yield pa.RecordBatch.from_pylist(done, schema)
    if stream:
        yield pa.RecordBatch.from_pylist([stream.row()], schema)


def summaries(blocks: DataFrame) -> DataFrame:
    """What op1 returns, from rows of pcm_blocks as they come: streams pass block by block, so a long one needs no more
    memory. feature: peak, sum of squares, sign changes, and the loudest block's sample offset."""
    return blocks.mapInArrow(_summarise, DIGESTS)


def digests(media: DataFrame) -> DataFrame:
    """What op1 returns, from the streams read back by their PCM blocks: as summaries(pcm_blocks(media)), in one process."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _summarise(_blocks(batches)), DIGESTS)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column goes from one Arrow stage to the next and is not written: it is 1.9 times the size of the compressed
    table, beyond the check's disk budget of 1.5. stored() writes it where that does not matter."""
    return digests(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
