"""WebP and WARC: round trips, transforms written by hand, ranges of every size."""

import hashlib
import os
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from quillstone.llm import warc, webp


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 6000])
@pytest.mark.parametrize("kind", ["random", "text", "run", "accents"])
def test_samples_round_trip(n, kind):
    random.seed(n)
    raw = {"random": os.urandom(n), "text": bytes(random.choices(b"etaoin shrdlu,.\n", k=n)), "run": b"a" * n, "accents": ("éüaß " * n)[:n].encode()}[kind]
    payload = webp.padded(raw)
    media = webp.encode_samples(payload)
    assert len(payload) % 576 == 0 and webp.decode_samples(media) == payload
    pixels = webp.decode(media)
    assert pixels.shape == (len(payload) // 576, 576, 4) and pixels[..., 0].tobytes() == payload and (pixels[..., 3] == 255).all()


def test_several_images(monkeypatch):
    monkeypatch.setattr(webp, "MAX_ROWS", 2)
    payload = os.urandom(576 * 5)
    assert webp.decode_samples(webp.encode_samples(payload)) == payload


def transforms_of(media):
    bits = webp.Bits(webp._chunk(media)[0])
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    return [t[0] for t in webp._read_transforms(bits, width, height)[0]]


def test_the_encoder_takes_the_shorter_way():
    """Few values go by a palette, ramps and repeated rows by a predictor, lines that came before by references."""
    rng = random.Random(5)
    text = lambda n: bytes(rng.choices(b"etaoin shrdlucmf", k=n))
    row = rng.randbytes(576)
    lines = b"".join(rng.choice([text(60) + b",.;:!?\n"]) for _ in range(6))
    cases = {
        "one": (b"a" * 3000, [webp.PALETTE]), "two": (bytes(rng.choices(b"ab", k=3000)), [webp.PALETTE]), "four": (bytes(rng.choices(b"abc", k=3000)), [webp.PALETTE]),
        "sixteen": (bytes(rng.choices(b"0123456789|\n", k=3000)), [webp.PALETTE]), "ramp": (bytes(3 * i & 255 for i in range(6000)), [webp.PREDICTOR, webp.SUBTRACT_GREEN]),
        "rows": (row * 20, [webp.PREDICTOR, webp.SUBTRACT_GREEN]), "text": (text(9000) + b",.;:!?", [webp.SUBTRACT_GREEN]), "lines": (lines * 40, [webp.SUBTRACT_GREEN]), "noise": (rng.randbytes(5000), [webp.SUBTRACT_GREEN]),
    }
    for name, (raw, kinds) in cases.items():
        payload = webp.padded(raw)
        for _ in range(4):  # by the general loop first, then by tables
            media = webp.encode_samples(payload)
            assert transforms_of(media) == kinds, name
            assert webp.decode_samples(media) == payload, name
        pixels = webp.decode(media)
        assert all(pixels[..., c].tobytes() == payload for c in range(3)) and (pixels[..., 3] == 255).all()
    assert len(webp.encode_samples(webp.padded(cases["lines"][0]))) < len(lines * 40) // 8
    assert len(webp.encode_samples(webp.padded(cases["two"][0]))) < 600


def put_image(out, argb, cache_bits=0, main=True, back=None):
    """An entropy-coded image of literals, cache hits and, at pixels in ``back``, references (length, distance code)."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    flat = [int(x) for x in argb.reshape(-1)]
    ops, cache, n = [], {}, 0
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while n < len(flat):
        if back and n in back:
            length, code = back[n]
            ops.append(("copy", length, code))
        elif cache_bits and cache.get(slot(flat[n])) == flat[n]:
            length = 1
            ops.append(("cache", slot(flat[n])))
        else:
            length = 1
            ops.append(("pixel", flat[n]))
        for p in flat[n : n + length]:
            if cache_bits:
                cache[slot(p)] = p
        n += length
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    weights = [np.zeros(s, dtype=np.int64) for s in sizes]
    for op in ops:
        if op[0] == "pixel":
            a, r, g, b = op[1] >> 24, op[1] >> 16 & 255, op[1] >> 8 & 255, op[1] & 255
            for w, s in zip(weights, (g, r, b, a), strict=False):
                w[s] += 1
        elif op[0] == "copy":
            weights[0][256 + webp.prefix_symbol(op[1])[0]] += 1
            weights[4][webp.prefix_symbol(op[2])[0]] += 1
        else:
            weights[0][280 + op[1]] += 1
    codes = [webp.put_prefix(out, webp.balanced_lengths(w)) for w in weights]
    for op in ops:
        if op[0] == "pixel":
            a, r, g, b = op[1] >> 24, op[1] >> 16 & 255, op[1] >> 8 & 255, op[1] & 255
            for c, s in zip(codes, (g, r, b, a), strict=False):
                out.code(c[s])
        elif op[0] == "copy":
            for c, base, v in ((codes[0], 256, op[1]), (codes[4], 0, op[2])):
                s, extra, bits = webp.prefix_symbol(v)
                out.code(c[base + s])
                out.put(extra, bits)
        else:
            out.code(codes[0][280 + op[1]])


def argb_of(pixels):
    return webp._joined(np.ascontiguousarray(pixels[..., [3, 0, 1, 2]]))


def picture(h=13, w=21, seed=1):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    return np.stack([(x * 7 + y) & 255, (x + 3 * y + rng.integers(0, 9, (h, w))) & 255, (y * 11) & 255, 255 - (x & 3)], axis=-1).astype(np.uint8)


def finish(out):
    return webp._container(out.bytes())


@pytest.mark.parametrize("cache_bits", [0, 1, 6, 11])
def test_literals_and_cache(cache_bits):
    pixels = np.repeat(picture(6, 5), 3, axis=1)
    out = webp._start(15, 6, True)
    out.put(0, 1)
    put_image(out, argb_of(pixels), cache_bits)
    assert (webp.decode(finish(out)) == pixels).all()


def test_back_references():
    rows = np.tile(picture(1, 30), (9, 1, 1))
    out = webp._start(30, 9, True)
    out.put(0, 1)
    put_image(out, argb_of(rows), 3, back={30: (100, 1), 130: (140, 120 + 60)})  # the row above; two rows above as a far one
    assert (webp.decode(finish(out)) == rows).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    pixels = picture()
    h, w = pixels.shape[:2]
    argb = webp._channels(argb_of(pixels)).astype(np.int64)
    modes = np.full((-(-h >> 2), -(-w >> 2)), mode)
    residual = np.zeros_like(argb)
    for y in range(h):
        for x in range(w):
            residual[y, x] = (argb[y, x] - webp.predicted(argb, x, y, modes, 2)) & 255
    out = webp._start(w, h, True)
    for v, n in ((1, 1), (webp.PREDICTOR, 2), (0, 3)):
        out.put(v, n)
    put_image(out, np.uint32(0xFF000000) | modes.astype(np.uint32) << np.uint32(8), main=False)
    out.put(0, 1)
    put_image(out, webp._joined(residual.astype(np.uint8)))
    assert (webp.decode(finish(out)) == pixels).all()


def test_predictions_by_hand():
    rows = np.zeros((2, 3, 4), dtype=np.int64)
    rows[0] = [[255, 10, 20, 30], [255, 40, 50, 60], [255, 70, 80, 90]]
    rows[1, 0] = [255, 100, 110, 120]
    expect = {0: [255, 0, 0, 0], 1: [255, 100, 110, 120], 2: [255, 40, 50, 60], 3: [255, 70, 80, 90], 4: [255, 10, 20, 30], 7: [255, 70, 80, 90], 12: [255, 130, 140, 150], 11: [255, 100, 110, 120], 13: [255, 100, 110, 120]}
    for mode, want in expect.items():
        assert webp.predicted(rows, 1, 1, np.full((1, 1), mode), 2).tolist() == want, mode


def test_cross_colour_and_subtract_green():
    pixels = picture()
    h, w = pixels.shape[:2]
    rng = np.random.default_rng(2)
    elements = np.concatenate([np.full((4, 6, 1), 255), rng.integers(0, 256, (4, 6, 3))], axis=-1).astype(np.uint8)
    argb = webp._channels(argb_of(pixels)).copy()
    argb[..., 1] -= argb[..., 2]
    argb[..., 3] -= argb[..., 2]
    moved = webp.color_shift(argb, elements, 2, -1)
    out = webp._start(w, h, True)
    for v, n in ((1, 1), (webp.SUBTRACT_GREEN, 2), (1, 1), (webp.CROSS_COLOR, 2), (0, 3)):
        out.put(v, n)
    put_image(out, webp._joined(elements), main=False)
    out.put(0, 1)
    put_image(out, webp._joined(moved))
    assert (webp.decode(finish(out)) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    index = rng.integers(0, colours, (5, 19))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    bits = 8 >> pack
    width = -(-19 >> pack)
    packed = np.zeros((5, width), dtype=np.uint32)
    for x in range(19):
        packed[:, x >> pack] |= (index[:, x] << bits * (x & (1 << pack) - 1)).astype(np.uint32)
    channels = palette[:, [3, 0, 1, 2]].astype(np.int64)
    deltas = (np.diff(channels, axis=0, prepend=np.zeros((1, 4), dtype=np.int64)) & 255).astype(np.uint8)
    out = webp._start(19, 5, True)
    for v, n in ((1, 1), (webp.PALETTE, 2), (colours - 1, 8)):
        out.put(v, n)
    put_image(out, webp._joined(deltas[None]), main=False)
    out.put(0, 1)
    put_image(out, np.uint32(0xFF000000) | packed << np.uint32(8))
    assert (webp.decode(finish(out)) == palette[index]).all()


def test_broken_media_are_told(spark):
    good = webp.encode_samples(webp.padded(b"text"))
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, good[:30]), (4, None)], "id long, media binary").withColumn("width", F.lit("clash"))
    rows = {r.id: r for r in webp.decode_pixels(df).collect()}
    assert rows[1].width == 576 and len(rows[1].pixels) == 576 * 4 and rows[2].error and rows[3].error and rows[4].pixels is None and rows[4].error is None


def test_store_and_measure(spark):
    texts = ["", None, "One", "é" * 5000, "x" * 576, "One"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "One", "x")], "doc_id long, text string, media string")
    for r in webp.measure_media(webp.store_texts(df)).collect():
        raw = ((texts[r.doc_id] if r.doc_id is not None else "One") or "").encode()
        payload = webp.padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert webp.measure_media(webp.store_texts(df.where("false"))).count() == 0


@pytest.mark.parametrize("split", [1, 9, 100, 3000, 1 << 20])
def test_ranges_own_each_record_once(tmp_path, split):
    random.seed(5)
    records = [warc.record(i, f"http://x/{i}", random.randbytes(random.randint(0, 3000)) if i % 3 else b"ab" * i, "0" * 40, None) for i in range(12 if split < 100 else 120)]
    noise = zlib.compressobj(6, zlib.DEFLATED, 31)
    records.insert(5, noise.compress(b"no record") + noise.flush())
    blob = b"".join(records)
    (tmp_path / "x.warc.gz").write_bytes(blob)
    found = []
    for start in range(0, len(blob), split):
        end = min(len(blob), start + split)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.warc.gz")) as f:
            found += [warc.parse(d)[0]["warc-record-id"] for d in warc.members(warc.Range(f, start, end, len(blob)), start, end)]
    assert found == [f"<urn:page:{i}>" for i in range(len(records) - 1)]


def test_round_trip_of_pages(spark):
    big = "é" * 700
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (2, "http://a\n/2", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (None, "u", "none"), (5, "http://a/5", big)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=repr)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = sorted(((p, len((h or "").encode()), sha(h), "revisit" if h == big and p != 5 else "response", 5 if h == big and p != 5 else None) for p, _, h in rows), key=repr)
    assert got == want
    assert warc.round_trip(df.where("false")).count() == 0
    read = warc.read_archives(warc.write_archives(df, warc.scratch_path(spark, "t")), split_bytes=64)
    assert sorted((r.payload or b"").decode() for r in read.where("record_type = 'response'").collect()) == sorted(h or "" for p, _, h in rows if h != big or p == 5)


def test_long_payloads_span_ranges(spark):
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=3_000_000))
    rows = [(1, "u", "x" * 10), (2, "u", long), (3, "u", long), (4, "u", "y" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = warc.read_archives(warc.write_archives(df, warc.scratch_path(spark, "long")), split_bytes=1 << 18).collect()
    found = {r.page_id: (r.record_type, r.refers_to, (r.payload or b"").decode()) for r in read}
    assert len(read) == 4 and found == {1: ("response", None, "x" * 10), 2: ("revisit", 3, ""), 3: ("response", None, long), 4: ("response", None, "y" * 2000)}


def test_work_a_record_does_not_grow_with_the_range(tmp_path):
    """What a range holds before a record is let go of, so reading on costs the same in ranges of any size."""
    one = warc.record(1, "http://x", os.urandom(2000), "0" * 40, None)
    (tmp_path / "x").write_bytes(one * 3000)
    held = []
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as f:
        source = warc.Range(f, 0, len(one) * 3000, len(one) * 3000)
        held = [len(source.data) for _ in warc.members(source, 0, len(one) * 3000)]
    assert len(held) == 3000 and held[-1] <= 2 * warc.STEP_BYTES + len(one)


def test_null_media_and_other_columns(spark):
    stored = webp.store_texts(spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"))
    rows = stored.unionByName(spark.createDataFrame([(3, 0, None)], "doc_id long, n_bytes long, media binary")).selectExpr("*", "1 AS feature")
    got = {r.doc_id: r for r in webp.measure_media(rows).collect()}
    assert got[3].payload_sha256 is None and got[3].feature is None and got[1].payload_bytes == got[2].payload_bytes == 576
