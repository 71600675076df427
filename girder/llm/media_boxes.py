"""Operator 8: ISO base media containers.

`pack` stores a payload as uncompressed 8-bit samples in a movie file (ftyp, moov, mdat); `probe` walks the nested boxes of
any such file, decodes its sample tables (of the movie and of its fragments) and reports codec, duration and the byte ranges
of its keyframes without touching the payload; `unpack` reads the sample bytes back through the tables. `media_columns` applies
`probe` to a binary column.

Defined results: a null or empty text is a payload of 64 zero bytes; a null container, or one whose boxes are damaged, cut
short or claim more than the file holds, yields null columns and a message in `error`, in time and memory that grow with the
file alone, however deep its boxes nest; other columns pass through, and a new column whose name is taken has underscores
added. Rows are independent, so repeats and ties give equal rows, and a lost executor costs only the rows of its tasks.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, free_name, text_or_empty

UNIT = 64  # bytes of one sample; payloads are padded to a multiple of it
CHUNK = 32  # samples of one chunk
KEY_EVERY = 16  # every so many samples one is a sync sample
RATE = 8000  # bytes a second: the time scale of the track
NESTING = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"))


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(UNIT * max(1, -(-len(data) // UNIT)) - len(data))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(payload: bytes) -> bytes:
    """A movie file with one 8-bit PCM track whose samples are the payload's 64-byte units."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of the unit")
    n = len(payload) // UNIT
    chunks, rest = divmod(n, CHUNK)
    runs = ([(1, CHUNK)] if chunks else []) + ([(chunks + 1, rest)] if rest else [])
    keys = range(1, n + 1, KEY_EVERY)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    wide = n * UNIT >= 1 << 31

    def movie(base: int) -> bytes:
        offsets = [base + i * CHUNK * UNIT for i in range(chunks + bool(rest))]
        entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, UNIT)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", UNIT, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        url = full(b"url ", flags=1)
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), url)), stbl)
        clock = struct.pack(">QQIQ", 0, 0, RATE, n * UNIT)
        mdia = box(b"mdia", full(b"mdhd", clock, struct.pack(">HH", 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n * UNIT), bytes(8), struct.pack(">4H", 0, 0, 0x100, 0), matrix, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", clock, struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"qt  ")
    data = box(b"mdat", payload)
    return head + movie(len(head) + len(movie(0)) + len(data) - len(payload)) + data


def boxes(data: bytes | memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first and last byte of each box's body between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit")
        yield kind, body, start + size
        start += size


def numbers(data, at: int, end: int, form: str) -> list[tuple]:
    """The entries of a counted table that starts after a version and flags."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    step = struct.calcsize(">" + form)
    if at + 8 + n * step > end:
        raise ValueError("a table is longer than its box")
    return list(struct.iter_unpack(">" + form, data[at + 8 : at + 8 + n * step]))


class Track:
    """The decoded tables of a track. Samples of fragments come as (offset, size, is keyframe), in order."""

    def __init__(self) -> None:
        self.id, self.codec, self.scale, self.duration = 0, None, 0, 0
        self.stsc: list[tuple[int, int, int]] = []
        self.sizes: list[int] = []
        self.offsets: list[int] = []
        self.sync: list[int] | None = None
        self.more: list[tuple[int, int, bool]] = []


def sample_sizes(data, a: int, b: int, whole: int) -> list[int]:
    size, n = struct.unpack_from(">II", data, a + 4)
    if size * n > whole or not size and a + 12 + 4 * n > b:
        raise ValueError("more samples than the file holds")
    return [size] * n if size else [x for (x,) in struct.iter_unpack(">I", data[a + 12 : a + 12 + 4 * n])]


# fixed values: flags of a fragment's tables, with the bytes of the field that each announces
HEADER_FIELDS = {"base": (0x1, "Q"), "description": (0x2, "I"), "duration": (0x8, "I"), "size": (0x10, "I"), "flags": (0x20, "I")}
BASE_IS_MOOF, NOT_SYNC = 0x20000, 0x10000
RUN_FIELDS = {"duration": (0x100, "I"), "size": (0x200, "I"), "flags": (0x400, "I"), "shift": (0x800, "I")}


def fragment_header(data, a: int, defaults: dict[int, dict]) -> tuple[int, int, dict]:
    """Track, flags and fields of a fragment's header, on the track's defaults."""
    flags, track = struct.unpack_from(">II", data, a)
    at, fields = a + 8, dict(defaults.get(track, {}))
    for name, (flag, form) in HEADER_FIELDS.items():
        if flags & flag:
            (fields[name],) = struct.unpack_from(">" + form, data, at)
            at += struct.calcsize(">" + form)
    return track, flags, fields


def fragment_run(data, a: int, b: int, fields: dict, base: int, behind: int, whole: int) -> tuple[list[tuple[int, int, bool]], int, int]:
    """Samples of a run of a fragment, its duration, and where it ends."""
    flags, n = struct.unpack_from(">II", data, a)
    at, place, first = a + 8, behind, None
    if flags & 0x1:
        place = base + struct.unpack_from(">i", data, at)[0]
        at += 4
    if flags & 0x4:
        (first,) = struct.unpack_from(">I", data, at)
        at += 4
    own = [name for name, (flag, _) in RUN_FIELDS.items() if flags & flag]
    if at + 4 * len(own) * n > b or not own and fields.get("size", 0) * n > whole or n > whole:
        raise ValueError("more samples than the file holds")
    out, duration = [], 0
    for k in range(n):
        entry = dict(zip(own, struct.unpack_from(f">{len(own)}I", data, at + 4 * len(own) * k), strict=True)) if own else {}
        size = entry.get("size", fields.get("size", 0))
        marks = entry.get("flags", first if first is not None and not k else fields.get("flags", 0))
        duration += entry.get("duration", fields.get("duration", 0))
        out.append((place, size, not marks & NOT_SYNC))
        place += size
    return out, duration, place


def tracks(data) -> list[Track]:
    """The decoded tables of each track; the nested boxes are walked without recursion."""
    found: list[Track] = []
    by_id: dict[int, Track] = {}
    defaults: dict[int, dict] = {}
    moof = behind = 0
    run: tuple = (0, 0, {})
    walks = [boxes(data, 0, len(data))]
    while walks:
        got = next(walks[-1], None)
        if got is None:
            walks.pop()
            continue
        kind, a, b = got
        if kind == b"trak":
            found.append(Track())
        elif kind == b"moof":
            moof = behind = a - 8
        elif kind == b"traf":
            run = (0, 0, {})
        t = found[-1] if found else None
        if kind in NESTING:
            walks.append(boxes(data, a, b))
        elif kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">5I", data, a + 4)
            defaults[track] = {"duration": duration, "size": size, "flags": flags}
        elif kind == b"tfhd":
            run = fragment_header(data, a, defaults)
        elif kind == b"trun":
            track, flags, fields = run
            if track not in by_id:
                raise ValueError(f"a fragment of track {track}, which there is not")
            base = fields.get("base", moof if flags & BASE_IS_MOOF or not by_id[track].more else behind)
            samples, duration, behind = fragment_run(data, a, b, fields, base, behind, len(data))
            by_id[track].more += samples
            by_id[track].duration += duration
        elif t is None:
            continue
        elif kind == b"tkhd":
            (t.id,) = struct.unpack_from(">I", data, a + (20 if data[a] else 12))
            by_id.setdefault(t.id, t)
        elif kind == b"mdhd":
            t.scale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] else struct.unpack_from(">II", data, a + 12)
        elif kind == b"stsd":
            t.codec = next((k.decode("latin-1") for k, *_ in boxes(data, a + 8, b)), None)
        elif kind == b"stsc":
            t.stsc = numbers(data, a, b, "III")
        elif kind == b"stsz":
            t.sizes = sample_sizes(data, a, b, len(data))
        elif kind in (b"stco", b"co64"):
            t.offsets = [x for (x,) in numbers(data, a, b, "Q" if kind == b"co64" else "I")]
        elif kind == b"stss":
            t.sync = [x for (x,) in numbers(data, a, b, "I")]
    return found


def places(t: Track) -> list[tuple[int, int]]:
    """Offset and size of each sample of the movie's tables, by chunks."""
    out, sizes, n = [], iter(t.sizes), len(t.offsets)
    ends = [a for a, *_ in t.stsc[1:]] + [n + 1]
    for (first, each, _), end in zip(t.stsc, ends, strict=True):
        if first < 1 or end > n + 1 or end < first:
            raise ValueError("a chunk that there is not")
        for c in range(first - 1, end - 1):
            at = t.offsets[c]
            for _ in range(each):
                if (size := next(sizes, None)) is None:
                    break
                out.append((at, size))
                at += size
    if len(out) < len(t.sizes):
        raise ValueError("samples without a chunk")
    return out


def probe(data: bytes) -> dict:
    """Codec, seconds and keyframe byte ranges of the first track; the payload is not read."""
    t = next(iter(tracks(data)), None)
    if t is None or not t.scale:
        raise ValueError("no track")
    at = places(t)
    if t.sync is not None and any(not 1 <= i <= len(at) for i in t.sync):
        raise ValueError("a keyframe that there is not")
    keys = list(at) if t.sync is None else [at[i - 1] for i in t.sync]
    at += [(a, s) for a, s, _ in t.more]
    keys += [(a, s) for a, s, key in t.more if key]
    if any(a < 0 or a + s > len(data) for a, s in at):
        raise ValueError("a sample lies outside the file")
    return {"codec": t.codec, "duration": t.duration / t.scale, "n_samples": len(at), "keyframes": keys}


def unpack(data: bytes) -> bytes:
    """The first track's samples, one after the other."""
    out, run = [], None
    t = tracks(data)[0]
    for a, s in [*places(t), *((a, s) for a, s, _ in t.more)]:
        if run and run[1] == a:
            run[1] = a + s
        else:
            run = [a, a + s]
            out.append(run)
    return b"".join(data[a:b] for a, b in out)


PROBED = "codec string, duration double, n_samples long, keyframes array<struct<offset:long,size:long>>, error string"


def media_columns(df: DataFrame, column: str = "media", prefix: str = "media_") -> DataFrame:
    """`df` with codec, duration, sample count, keyframe byte ranges and an error of the container in `column`."""

    @F.pandas_udf(PROBED)
    def read(data: pd.Series) -> pd.DataFrame:
        rows = []
        for x in data:
            try:
                found = probe(bytes(x)) if x is not None else {}
                rows.append((found.get("codec"), found.get("duration"), found.get("n_samples"), [{"offset": a, "size": s} for a, s in found["keyframes"]] if found else None, None))
            except (ValueError, IndexError, struct.error) as e:
                rows.append((None, None, None, None, str(e)))
        out = pd.DataFrame(rows, columns=["codec", "duration", "n_samples", "keyframes", "error"], dtype=object)
        return out.astype({"duration": "float64", "n_samples": "Int64"})

    got = read(F.col(column))
    names = [x.split()[0] for x in PROBED.split(", ")]
    return df.withColumn("__probed", got).select(*df.columns, *(F.col(f"__probed.{n}").alias(free_name(df, prefix + n)) for n in names))


def store(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """`df` with a container that holds the text of each row."""

    @F.pandas_udf("binary")
    def write(x: pd.Series) -> pd.Series:
        return x.map(lambda t: pack(padded(t)))

    return df.withColumn(free_name(df, out), write(text_or_empty(text)))


def feature(found: dict) -> str:
    k = found["keyframes"]
    return f"{found['codec'].strip()};{found['duration']:.3f}s;{found['n_samples']} samples;{len(k)} keyframes;{k[0][0]}+{k[0][1]}..{k[-1][0]}+{k[-1][1]}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def round_trip(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Store each text, read the container back and describe both; containers live one at a time."""
    for part in parts:
        rows = []
        for i, text in zip(part["doc_id"], part["text"], strict=True):
            media = pack(padded(text))
            payload = unpack(media)
            n = len((text or "").encode("utf-8", "surrogatepass"))
            rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(probe(media))))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")]).astype({"doc_id": "Int64"})


def digests(documents: DataFrame) -> DataFrame:
    return bounded_batches(documents).select("doc_id", text_or_empty().alias("text")).mapInPandas(round_trip, DIGEST)
