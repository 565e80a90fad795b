import hashlib
import struct
import zlib

import pytest

from parley.llm import media


@pytest.mark.parametrize("content", [b"", b"a", b"x" * 576, b"x" * 577, "é".encode() * 40000])
def test_round_trip(content):
    n, stored, digest, crc, size, file_digest, feature = media.text_media(content)
    want = content + b"\xff" * (max(1, -(-len(content) // 576)) * 576 - len(content))
    assert (n, stored) == (len(content), len(want))
    assert digest == hashlib.sha256(want).hexdigest() and crc == zlib.crc32(want[-32:])
    data = media.mux(want)
    assert (size, file_digest) == (len(data), hashlib.sha256(data).hexdigest())


def test_walk_and_tables():
    data = media.mux(media.padded(b"q" * 20000))
    paths = ["/".join(k.decode() for k in p) for p, _, _ in media.walk(data)]
    assert paths[0] == "ftyp" and paths[-1] == "mdat" and "moov/trak/mdia/minf/stbl/co64" in paths
    (track,), broken = media.tracks(data)
    assert not broken and track.codec == "raw " and track.handler == "soun"
    samples = track.samples()
    assert len(samples) == 35 and [k for k, (_, _, key) in enumerate(samples) if key] == [0, 16, 32]
    assert track.seconds == 35 * 576 / 8000


def test_64_bit_and_open_ended_boxes():
    inner = media.mux(media.padded(b"z"))
    at = inner.index(b"mdat") - 4
    body = inner[at + 8 :]
    wide = struct.pack(">I4sQ", 1, b"mdat", len(body) + 16) + body
    open_end = struct.pack(">I4s", 0, b"mdat") + body
    for tail in (wide, open_end):
        assert [p[-1] for p, _, _ in media.walk(inner[:at] + tail)][-1] == b"mdat"


def track_box(track_id, codec, handler=b"vide", tables=()):
    stbl = media.box(b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(8))), *tables)
    mdia = media.box(b"mdia", media.full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), media.full_box(b"hdlr", bytes(4), handler, bytes(13)), media.box(b"minf", stbl))
    return media.box(b"trak", media.full_box(b"tkhd", struct.pack(">IIIII", 0, 0, track_id, 0, 0)), mdia)


def fragment(*parts):
    return media.box(b"moof", media.box(b"traf", *parts))


def test_fragment():
    head = media.box(b"moov", track_box(7, b"avc1"))
    run = media.full_box(b"trun", struct.pack(">IiI", 2, 100, 0), struct.pack(">IIII", 40, 10, 50, 20), flags=0x305)
    (track,), broken = media.tracks(head + fragment(media.full_box(b"tfhd", struct.pack(">II", 7, 0x10000), flags=0x20), run) + bytes(0))
    assert not broken and track.codec == "avc1"
    assert track.samples() == [(len(head) + 100, 10, True), (len(head) + 110, 20, False)]
    assert track.seconds == 0.09


def test_fragments_take_defaults_and_go_on():
    trex = media.box(b"mvex", media.full_box(b"trex", struct.pack(">IIIII", 7, 1, 20, 30, 0x10000)))
    head = media.box(b"moov", track_box(1, b"mp4a", b"soun"), track_box(7, b"avc1"), trex)
    runs = media.full_box(b"trun", struct.pack(">II", 2, 0), flags=0x4), media.full_box(b"trun", struct.pack(">II", 1, 5), flags=0x200)
    data = head + fragment(media.full_box(b"tfhd", struct.pack(">IQ", 7, 4000), flags=0x1), *runs) + bytes(0)
    (audio, video), broken = media.tracks(data)
    assert not broken and audio.samples() == [] and (audio.handler, video.handler) == ("soun", "vide")
    assert video.samples() == [(4000, 30, True), (4030, 30, False), (4060, 5, False)] and video.seconds == 0.06
    # without a base, the next fragment part of one moof goes on where the last ended
    two = media.box(b"moof", *[media.box(b"traf", media.full_box(b"tfhd", struct.pack(">I", 7)), media.full_box(b"trun", struct.pack(">I", 1))) for _ in "ab"])
    (_, video), broken = media.tracks(head + two)
    assert not broken and [at for at, *_ in video.samples()] == [len(head), len(head) + 30]


def test_broken_files_end_in_words():
    empty = lambda *kinds: media.box(b"moov", media.box(b"trak", *[media.box(k) for k in kinds]))
    deep = b""
    for _ in range(2000):
        deep = media.box(b"moov", deep)
    many = media.box(b"moov", track_box(7, b"avc1")) + fragment(media.full_box(b"tfhd", struct.pack(">I", 7)), media.full_box(b"trun", struct.pack(">I", 3_000_000)))
    order = track_box(7, b"avc1", tables=(media.full_box(b"stsc", struct.pack(">IIIIIII", 2, 2, 1, 1, 1, 1, 1)), media.full_box(b"stco", struct.pack(">III", 2, 0, 9)), media.full_box(b"stsz", struct.pack(">II", 1, 2))))
    for data in (empty(b"tkhd"), empty(b"mdhd"), empty(b"stsd"), many, media.box(b"moov", order), media.box(b"moov", track_box(1, b"raw "))[:-3], fragment(media.full_box(b"trun", struct.pack(">I", 1)))):
        assert media.describe(data)[1], data
    assert media.describe(deep) == ([], "")
    assert media.describe(empty(b"free") + media.full_box(b"hdlr", bytes(20)))[1] == ""


def test_columns(spark):
    whole = media.mux(media.padded(b"abc"))
    rows = [(1, bytearray(whole)), (2, None), (3, bytearray()), (4, bytearray(whole[:300])), (5, bytearray(b"\0\0\0\1")), (1, bytearray(whole)), (None, bytearray(whole))]
    files = spark.createDataFrame(rows, "file long, content binary")
    got = media.index_media(files).orderBy("file").collect()
    assert [r["file"] for r in got] == [None, 1, 1, 2, 3, 4, 5]
    (track,) = got[0]["tracks"]
    assert got[1] == got[2] and got[1]["tracks"] == got[0]["tracks"] and got[0]["broken"] == "" and track["codec"] == "raw " and track["n_samples"] == 1
    assert [(k["offset"], k["size"]) for k in track["keyframes"]] == [(len(whole) - 576, 576)]
    assert got[3]["tracks"] == got[4]["tracks"] == [] and got[5]["broken"] and got[6]["broken"]
    assert media.index_media(files.where("false")).count() == 0
    with pytest.raises(ValueError):
        media.index_media(files.withColumnRenamed("file", "tracks"))


def test_texts(spark):
    rows = [(1, "a", 1), (2, None, 1), (3, "a", 1), (None, "é" * 3000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, feature long")
    got = {r["doc_id"]: r for r in media.media_of_texts(docs).collect()}
    assert got[1][1:] == got[3][1:] and got[2]["n_bytes"] == 0 and got[None]["n_bytes"] == 6000
    assert media.media_of_texts(docs.where("false")).count() == 0
