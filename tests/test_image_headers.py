"""Sizes from image headers: every format, broken files, and few bytes of each."""

from __future__ import annotations

import io

import pytest

from checks.sources import _image_bytes
from lumenfold.sources import image_headers as ih


def size(data, max_bytes=ih.MAX_BYTES):
    f = ih.Ranges(io.BytesIO(data), max_bytes)
    return ih.read_size(f), f.count


@pytest.mark.parametrize("kind", ["png", "jpeg", "gif", "webp"])
def test_each_format(kind):
    for wide, high in ((1, 1), (640, 480), (9000, 7)):
        found, count = size(_image_bytes(kind, wide, high))
        assert found == (kind, wide, high) and count <= 2048


def test_other_webp_kinds():
    plain = b"RIFF" + bytes(4) + b"WEBPVP8 " + bytes(4) + bytes(3) + b"\x9d\x01\x2a" + (300).to_bytes(2, "little") + (0x4000 | 200).to_bytes(2, "little")
    assert size(plain + bytes(50))[0] == ("webp", 300, 200)
    lossless = b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + ((99) | (49 << 14)).to_bytes(4, "little")
    assert size(lossless + bytes(50))[0] == ("webp", 100, 50)


@pytest.mark.parametrize("data, why", [
    (b"", "cut short"), (b"text that is no image", "unknown kind"), (b"\x89PNG\r\n\x1a\n" + bytes(30), "no image header"),
    (b"\xff\xd8\xff\xe0\x00\x10" + bytes(5), "cut short"), (b"\xff\xd8\xff\xda\x00\x04" + bytes(50), "no frame"),
    (b"\xff\xd8\x00\x00" + bytes(50), "no marker"), (b"GIF89a" + bytes(50), "no size"), (b"RIFF" + bytes(4) + b"WEBPABCD" + bytes(50), "unknown kind"),
])
def test_what_is_no_image_says_why(data, why):
    with pytest.raises(ih.Unreadable, match=why):
        size(data)


def test_a_header_is_bounded():
    many = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + bytes(65533)) * 40
    with pytest.raises(ih.Unreadable, match="too long"):
        size(many, max_bytes=8192)


def test_the_source_over_a_folder(spark, tmp_path):
    for k in range(7):
        (tmp_path / f"i{k}.jpg").write_bytes(_image_bytes("jpeg", 10 + k, 20))
    (tmp_path / "broken.png").write_bytes(b"x" * 100)
    df = ih.read_headers(spark, str(tmp_path), files_per_task=3)
    assert df.rdd.getNumPartitions() == 3
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["problem"]) for r in df.collect()}
    assert got == {**{f"i{k}.jpg": (10 + k, 20, None) for k in range(7)}, "broken.png": (None, None, "unknown kind of image")}
    empty = tmp_path / "none"
    empty.mkdir()
    assert ih.read_headers(spark, str(empty)).count() == 0
