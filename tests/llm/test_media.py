from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from quarrymill.llm import avi

DOC = "doc_id long, text string, Feature string, n_bytes string"


def payload(text):
    b = (text or "").encode()
    return b + b"\xff" * ((-len(b)) % 576 or (0 if b else 576))


def test_round_trip_of_awkward_bytes():
    rng = np.random.default_rng(0)
    payloads = [bytes(range(256)) * 9, b"\x80" * 576, bytes([0, 255]) * 288, (b"\x80" * 63 + b"a") * 9, rng.integers(0, 256, 5760, dtype=np.uint8).tobytes()]
    files = avi.store_payload(payloads)
    movies = [avi.read_avi(f) for f in files]
    assert [avi.read_payload(frames) for frames, _ in avi.decode_movies(movies)] == payloads
    assert [len(m.frames) for m in movies] == [4, 1, 1, 1, 10]
    assert (movies[0].width, movies[0].height, movies[0].codec) == (24, 24, b"MJPG")


def test_features_match_the_contract(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "ü" * 288), (5, "x" * 60_000), (6, "hello"), (None, "hello"), (6, "hello")]
    df = spark.createDataFrame([(*r, "f", "n") for r in rows], DOC)
    got = avi.media_features(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        p = payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    alike = {(r.media_sha256, r.media_bytes, r.feature, r.clips) for r in got if r.doc_id in (1, 6, None)}
    assert len(alike) == 1
    assert avi.media_features(df.limit(0)).count() == 0


def test_shots_are_timed_clips(spark):
    rng = np.random.default_rng(1)

    def frame(level):
        x = np.zeros((9, 64), np.int64)
        x[:, 0] = level
        x[:, 1:4] = rng.integers(-5, 5, (9, 3))
        return x

    levels = np.array([frame(-600)] * 5 + [frame(500)] * 6 + [frame(-200)] * 4)
    head = avi.jpeg_header(24, 24)
    movie = avi.write_avi([head + s + b"\xff\xd9" for s in avi.encode_scans(levels)], 24, 24, fps=10)
    df = spark.createDataFrame([(1, bytearray(movie)), (2, bytearray(b"no film")), (3, None), (4, bytearray(movie[: len(movie) // 2]))], "media_id long, data binary")
    rows = avi.clip_rows(df).collect()
    assert [(r.first_frame, r.end_frame, r.start_s, r.end_s) for r in rows if r.media_id == 1] == [(0, 5, 0.0, 0.5), (5, 11, 0.5, 1.1), (11, 15, 1.1, 1.5)]
    assert all(r.error for r in rows if r.media_id in (2, 3))


def test_files_without_an_index_are_walked():
    movie = avi.store_payload([b"a" * 1152])[0]
    assert avi.read_avi(movie.replace(b"idx1", b"JUNK")).frames == avi.read_avi(movie).frames


@pytest.mark.parametrize("tables", [True, False])
def test_frames_decode_as_another_decoder_does(spark, tables):
    rng = np.random.default_rng(2)
    levels = rng.integers(-60, 60, (1, 9, 64))
    levels[:, :, 20:50] = 0
    levels[:, :, 0] = rng.integers(-400, 400, (1, 9))
    frame = avi.jpeg_header(24, 24, tables=tables) + avi.encode_scans(levels)[0] + b"\xff\xd9"
    layout, scan = avi.parse_jpeg(frame)
    mine = avi.decode_levels(layout, [scan])
    assert (mine[0] == levels[0]).all()
    if tables:
        jvm = spark._jvm
        image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(frame))
        raster = image.getRaster()
        theirs = np.array([[raster.getSample(x, y, 0) for x in range(24)] for y in range(24)])
        assert np.abs(theirs - avi.luma_image(layout, mine)[0].astype(int)).max() <= 1


def test_frames_of_the_jvm_encoder_decode(spark):
    """Colour frames with subsampling and their own tables."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(40, 24, 1)
    for y in range(24):
        for x in range(40):
            image.setRGB(x, y, (x * 6) << 16 | (y * 10) << 8 | (x + y) * 3)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    layout, scan = avi.parse_jpeg(data)
    luma = avi.luma_image(layout, avi.decode_levels(layout, [scan]))[0].astype(float)
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    rgb = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(40)] for y in range(24)])
    y = 0.299 * (rgb >> 16) + 0.587 * (rgb >> 8 & 255) + 0.114 * (rgb & 255)
    assert len(layout.components) == 3 and np.abs(luma - y).mean() < 2.5


def test_hostile_headers_give_an_error_row(spark):
    """A frame header of 65,535 by 65,535 over a few bytes of data, and one without sampling factors."""
    movie = avi.store_payload([b"a" * 576])[0]
    at = movie.index(b"\xff\xc0")
    huge = movie[: at + 5] + b"\xff\xff\xff\xff" + movie[at + 9 :]
    flat = movie[: at + 11] + b"\x00" + movie[at + 12 :]
    df = spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(flat)), (3, bytearray(movie))], "media_id long, data binary")
    got = {r.media_id: r.error for r in avi.clip_rows(df).collect()}
    assert "more blocks" in got[1] and "sampling" in got[2] and got[3] is None
