"""Media columns: ISO base media files, written and indexed without decoding a payload.

`mux` stores a payload as 8-bit PCM samples in a file of nested boxes: ftyp, moov (mvhd, trak with its sample tables) and
mdat. `walk` reads the nested boxes of any such file, with 64-bit and to-the-end sizes, and `tracks` decodes the sample
tables (stsd, stts, stsz, stsc, stco or co64, stss, and the runs of movie fragments with their defaults) to codec, duration and
the byte ranges of samples and keyframes, of every track. Only table bytes are read for that; `payload` joins the stored byte
ranges.

Every row is treated on its own inside Arrow batches: nothing is shuffled, and a task holds one batch. A file has no more
samples than bytes; tables that claim more are broken, so that what a task holds is bounded by what it read.

Defined results: null or empty content has no track (an empty array); a broken file gives what was whole before the break,
with `broken` set; other columns pass through, and one named `tracks` or `broken` is refused with an error; repeated rows
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import table

FRAME = 576
PAD = b"\xff"
RATE = 8000

# The boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(content: bytes, frame: int = FRAME) -> bytes:
    """content, with bytes 255 up to a positive multiple of the frame."""
    frames = max(1, -(-len(content) // frame))
    return content + PAD * (frames * frame - len(content))


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, key_every: int = 16) -> bytes:
    """A file with one audio track of `raw ` samples: `frame` bytes a sample, every key_every-th one a sync sample."""
    n = len(payload) // frame
    keys = range(1, n + 1, key_every)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))

    def moov(at: int) -> bytes:
        table_of = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, frame)),
            full_box(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
            full_box(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            full_box(b"stsz", struct.pack(">II", frame, n)),
            full_box(b"co64", struct.pack(">IQ", 1, at)),
        )
        media = box(
            b"mdia",
            full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n * frame, 0x55C4, 0)),
            full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), table_of),
        )
        head = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n * frame, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        track = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * frame), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), flags=3)
        return box(b"moov", head, box(b"trak", track, media))

    before = len(ftyp) + len(moov(0)) + (16 if len(payload) + 8 >= 1 << 32 else 8)
    return ftyp + moov(before) + box(b"mdat", payload)


def walk(data: memoryview | bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """The path, body start and body end of each box, those inside containers included. ValueError at a broken box."""
    open_boxes: list[tuple[tuple[bytes, ...], int]] = [((), len(data))]  # path and end of each box that is not over
    at = 0
    while open_boxes:
        path, end = open_boxes[-1]
        if at >= end:
            open_boxes.pop()
            continue
        if at + 8 > end:
            raise ValueError(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"no room for a size at {at}")
            (size,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} ends at {at + size} of {end}")
        inner = (*path[-7:], kind)  # no meaning depends on more boxes around one
        yield inner, at + head, at + size
        if kind in CONTAINERS:
            open_boxes.append((inner, at + size))
            at += head
        else:
            at += size


class Fields:
    """The fields of one box, read in order; ValueError past its end."""

    def __init__(self, data: memoryview | bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def read(self, form: str) -> tuple[int, ...]:
        size = struct.calcsize(f">{form}")
        if self.at + size > self.end:
            raise ValueError("a box ends within a field")
        found = struct.unpack_from(f">{form}", self.data, self.at)
        self.at += size
        return found

    def one(self, form: str) -> int:
        return self.read(form)[0]

    def rows(self, form: str, count: int) -> list[tuple[int, ...]]:
        """`count` rows of a table that must fit into the box."""
        size = struct.calcsize(f">{form}") * count
        if self.at + size > self.end:
            raise ValueError("a table is longer than its box")
        found = list(struct.iter_unpack(f">{form}", self.data[self.at : self.at + size]))
        self.at += size
        return found

    def name(self) -> str:
        return self.one("4s").decode("latin-1")


@dataclass
class Track:
    """What the tables of one track say."""

    track_id: int = 0
    codec: str | None = None
    handler: str | None = None
    timescale: int = 0
    duration: int = 0
    deltas: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0  # of all samples, where they are of one size
    n_sizes: int = 0
    sizes: list[int] = field(default_factory=list)
    chunks: list[int] = field(default_factory=list)
    chunk_runs: list[tuple[int, int, int]] = field(default_factory=list)
    keys: list[int] | None = None
    fragments: list[tuple[int, int, bool]] = field(default_factory=list)

    def samples(self) -> list[tuple[int, int, bool]]:
        """Offset, size and whether it is a keyframe, of each sample in order."""
        out: list[tuple[int, int, bool]] = []
        keys = None if self.keys is None else set(self.keys)
        for j, (first, per, _) in enumerate(self.chunk_runs):
            last = self.chunk_runs[j + 1][0] - 1 if j + 1 < len(self.chunk_runs) else len(self.chunks)
            if not 1 <= first <= last <= len(self.chunks):
                raise ValueError("a run names chunks that are not there or out of order")
            for at in self.chunks[first - 1 : last]:
                for k in range(len(out), min(len(out) + per, self.n_sizes)):
                    size = self.size or self.sizes[k]
                    out.append((at, size, keys is None or k + 1 in keys))
                    at += size
        return out + self.fragments

    @property
    def seconds(self) -> float:
        units = sum(n * d for n, d in self.deltas) or self.duration
        return units / self.timescale if self.timescale else 0.0


@dataclass
class Defaults:
    """What holds for the samples of a track fragment where its runs do not say."""

    duration: int = 0
    size: int = 0
    flags: int = 0


class Reader:
    """The tracks of a file, box by box."""

    def __init__(self, data: bytes):
        self.data, self.found = data, []
        self.track: Track | None = None  # the one whose boxes come now
        self.extends: dict[int, Defaults] = {}  # of all fragments of a track
        self.moof = self.base = 0  # where the fragment begins, and what its runs' offsets count from
        self.into: Track | None = None  # the track that a fragment adds to
        self.usual = Defaults()
        self.next: int | None = None  # where a run begins that states no offset
        self.held = 0  # samples so far

    def read(self) -> str:
        """What is broken (empty: nothing)."""
        try:
            for path, at, end in walk(self.data):
                kind, box_of = path[-1], Fields(self.data, at, end)
                if kind == b"trak":
                    self.track = Track()
                    self.found.append(self.track)
                elif kind == b"moof":
                    self.moof, self.track, self.next = at - (8 if self.data[at - 4 : at] == kind else 16), None, None
                elif kind == b"trex":
                    _, track_id, _, *usual = box_of.read("6I")
                    self.extends[track_id] = Defaults(*usual)
                elif kind == b"tfhd":
                    self.fragment(box_of)
                elif kind == b"trun":
                    self.run(box_of)
                elif self.track is not None and b"trak" in path:
                    self.table(self.track, path, box_of)
        except (ValueError, struct.error) as e:
            return str(e)
        return ""

    def _hold(self, n: int) -> None:
        self.held += n
        if self.held > len(self.data):
            raise ValueError("more samples than bytes")

    def table(self, t: Track, path: tuple[bytes, ...], box_of: Fields) -> None:
        kind = path[-1]
        if kind == b"tkhd":
            version = box_of.one("I") >> 24
            t.track_id = box_of.read("QQI" if version else "III")[2]
        elif kind == b"mdhd":
            version = box_of.one("I") >> 24
            _, _, t.timescale, t.duration = box_of.read("QQIQ" if version else "IIII")
        elif kind == b"hdlr" and path[-2] == b"mdia":
            box_of.read("II")
            t.handler = box_of.name()
        elif kind == b"stsd":
            box_of.read("III")
            t.codec = box_of.name()
        elif kind == b"stsz":
            _, t.size, n = box_of.read("III")
            self._hold(n)
            if not t.size:
                t.sizes = [x for (x,) in box_of.rows("I", n)]
            t.n_sizes = n
        elif kind in (b"stts", b"stsc", b"stco", b"co64", b"stss"):
            _, n = box_of.read("II")
            rows = box_of.rows({b"stts": "II", b"stsc": "III", b"co64": "Q"}.get(kind, "I"), n)
            if kind == b"stts":
                t.deltas = rows
            elif kind == b"stsc":
                t.chunk_runs = rows
            elif kind == b"stss":
                t.keys = [x for (x,) in rows]
            else:
                t.chunks = [x for (x,) in rows]

    def fragment(self, box_of: Fields) -> None:
        flags = box_of.one("I") & 0xFFFFFF
        track_id = box_of.one("I")
        self.into = next((t for t in self.found if t.track_id == track_id), None)
        usual = self.extends.get(track_id, Defaults())
        self.base = box_of.one("Q") if flags & 0x1 else self.moof if flags & 0x20000 or self.next is None else self.next
        if flags & 0x2:
            box_of.one("I")
        duration = box_of.one("I") if flags & 0x8 else usual.duration
        size = box_of.one("I") if flags & 0x10 else usual.size
        self.usual = Defaults(duration, size, box_of.one("I") if flags & 0x20 else usual.flags)
        self.next = self.base

    def run(self, box_of: Fields) -> None:
        if self.next is None:
            raise ValueError("a run without a fragment's head")
        flags, n = box_of.read("II")
        where = self.base + box_of.one("i") if flags & 0x1 else self.next
        first = box_of.one("I") if flags & 0x4 else None
        stated = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        self._hold(n)
        rows = box_of.rows("I" * len(stated), n) if stated else [()] * n
        place = {bit: k for k, bit in enumerate(stated)}
        for j, row in enumerate(rows):
            size = row[place[0x200]] if 0x200 in place else self.usual.size
            marks = row[place[0x400]] if 0x400 in place else first if j == 0 and first is not None else self.usual.flags
            if self.into is not None:
                self.into.fragments.append((where, size, not marks & 0x10000))
                self.into.deltas.append((1, row[place[0x100]] if 0x100 in place else self.usual.duration))
            where += size
        self.next = where


def tracks(data: bytes) -> tuple[list[Track], str]:
    """The tracks of a file, and what is broken about it (empty: nothing). mdat is skipped, not read."""
    reader = Reader(data)
    broken = reader.read()
    return reader.found, broken


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset, size) in order, with neighbours that touch made one."""
    out: list[tuple[int, int]] = []
    for at, size in ranges:
        if out and out[-1][0] + out[-1][1] == at:
            out[-1] = (out[-1][0], out[-1][1] + size)
        else:
            out.append((at, size))
    return out


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, by its sample tables."""
    spans = merged([(at, size) for at, size, _ in track.samples()])
    if any(at + size > len(data) for at, size in spans):
        raise ValueError("a sample lies outside the file")
    return b"".join(data[at : at + size] for at, size in spans)


_RANGES = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
_TRACKS = pa.list_(
    pa.struct([("codec", pa.string()), ("handler", pa.string()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _RANGES)])
)
INDEX = "tracks array<struct<codec: string, handler: string, seconds: double, n_samples: long, keyframes: array<struct<offset: long, size: long>>>>, broken string"


def describe(data: bytes | None) -> tuple[list[dict], str]:
    """The columns of one file: its tracks in order, and what is broken."""
    found, broken = tracks(data or b"")
    out = []
    for t in found:
        try:
            samples = t.samples()
        except ValueError as e:
            samples, broken = list(t.fragments), broken or str(e)
        keys = [{"offset": at, "size": size} for at, size, key in samples if key and at < 1 << 63]
        out.append({"codec": t.codec, "handler": t.handler, "seconds": t.seconds, "n_samples": len(samples), "keyframes": keys})
    return out, broken


def index_media(files: DataFrame, content: str = "content") -> DataFrame:
    """Every row of files with the tracks of its media (codec, handler, seconds, n_samples, byte ranges of keyframes) and what is
    broken; `content` is dropped."""
    kept = [f for f in files.schema.fields if f.name != content]
    if clash := {f.name for f in kept} & {"tracks", "broken"}:
        raise ValueError(f"columns of the input clash with those of the index: {sorted(clash)}")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [describe(x.as_py()) for x in batch.column(batch.schema.get_field_index(content))]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            columns += [pa.array([x for x, _ in found], _TRACKS), pa.array([x for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "tracks", "broken"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [INDEX]
    return files.mapInArrow(rows, ", ".join(fields))


TEXT_MEDIA = (
    ("doc_id", pa.int64(), "long"),
    ("n_bytes", pa.int64(), "long"),
    ("payload_bytes", pa.int64(), "long"),
    ("payload_sha256", pa.string(), "string"),
    ("tail_crc32", pa.int64(), "long"),
    ("media_bytes", pa.int64(), "long"),
    ("media_sha256", pa.string(), "string"),
    ("feature", pa.string(), "string"),
)


def text_media(content: bytes) -> tuple:
    """Stores a text as media, reads it back by its tables, and digests both."""
    data = mux(padded(content))
    (track,), broken = tracks(data)
    if broken:
        raise ValueError(broken)
    samples = track.samples()
    back = payload(data, track)
    keys = [(at, size) for at, size, key in samples if key]
    named = hashlib.sha256(",".join(f"{at}+{size}" for at, size in keys).encode()).hexdigest()[:16]
    feature = f"{track.codec.strip()}|{track.seconds:.3f}s|{len(samples)} samples|{len(keys)} keyframes from {keys[0][0]}|{named}"
    return len(content), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature


def media_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text -> the columns of TEXT_MEDIA. A null text is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
            found = list(zip(*(text_media(x.as_py() or b"") for x in texts), strict=True)) or [()] * (len(TEXT_MEDIA) - 1)
            columns = [batch.column(batch.schema.get_field_index("doc_id"))]
            columns += [pa.array(list(x), kind) for x, (_, kind, _) in zip(found, TEXT_MEDIA[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[name for name, *_ in TEXT_MEDIA])

    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{name} {kind}" for name, _, kind in TEXT_MEDIA))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_of_texts(table(spark, sf_dir, "documents"))
