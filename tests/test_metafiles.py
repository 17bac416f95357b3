import math
import struct
import zlib

import numpy as np
import pytest

from vectorloom import constants as K
from vectorloom.operators import bitmaps, clip, embedded, framing, plus, raster
from vectorloom.operators.replay import replay
from vectorloom.operators.embedded import draw_bytes
from vectorloom.plans.render import render
from vectorloom.sources import encode as E
from vectorloom.sources.metafiles import Options, with_headers


def run(records, bounds=(0, 0, 100, 100), canvas=(100, 100), **more):
    return replay(E.emf([*records, E.eof()], bounds), "emf", bounds, canvas, **more)


def run_wmf(records, bounds=(0, 0, 64, 64)):
    b = E.wmf(records, bounds)
    return replay(b, "wmf", bounds, (64, 64), 40)


def test_literal_emf_header_and_framing(spark):
    """Offsets as laid out in the format, not through our own writer."""
    head = bytearray(108)
    struct.pack_into("<II", head, 0, 1, 108)
    struct.pack_into("<8i", head, 8, 0, 0, 800, 600, 0, 0, 21000, 15000)
    struct.pack_into("<IIII", head, 40, 0x464D4520, 0x10000, 108, 1)
    body = bytes(head) + struct.pack("<II4i", 43, 24, 1, 2, 30, 40) + struct.pack("<IIIII", 14, 20, 0, 0, 20) + b"trailing"
    short = bytes(head[:80])
    wmf = struct.pack("<IH4hHIH", 0x9AC6CDD7, 0, 0, 0, 800, 600, 0, 0, 0) + struct.pack("<HHHIHIH", 1, 9, 0x300, 10, 0, 10, 0)
    files = spark.createDataFrame([("a.emf", body), ("short.emf", short), ("b.wmf", wmf), ("c.wmf", wmf[22:] + bytes(6)), ("none", None)], "path string, content binary")
    h = {r.path: r for r in with_headers(files).collect()}
    assert (h["a.emf"].kind, tuple(h["a.emf"].bounds), h["a.emf"].canvas_w, h["a.emf"].canvas_h) == ("emf", (0, 0, 800, 600), 800, 600)
    assert h["short.emf"].bounds is None and h["none"].bounds is None
    assert (h["b.wmf"].kind, tuple(h["b.wmf"].bounds), h["b.wmf"].header_size) == ("wmf", (0, 0, 800, 600), 40)
    assert (tuple(h["c.wmf"].bounds), h["c.wmf"].header_size) == ((0, 0, 800, 600), 18)
    recs = framing.records(with_headers(files))
    got = [(r.off, r.rtype, r.size) for r in recs.filter("path = 'a.emf'").orderBy("seq").collect()]
    assert got == [(0, 1, 108), (108, 43, 24), (132, 14, 20)]
    assert framing.unhandled(recs).count() == 0 and framing.dispatched(recs).filter("rtype = 1").count() == 0
    assert {(r.rtype, r.n) for r in framing.histogram(recs).filter("path = 'a.emf'").collect()} == {(1, 1), (43, 1), (14, 1)}
    small = with_headers(files, Options(max_width=400, max_height=100, dpi_scale=2)).filter("path = 'a.emf'").first()
    assert (small.canvas_w, small.canvas_h) == (133, 100)


def test_framing_stops():
    ok = E.rectangle(0, 0, 1, 1)
    assert [r.rtype for r in framing.emf_records(ok * 3, 2)] == [43, 43]
    assert [r.rtype for r in framing.emf_records(ok + struct.pack("<II", 43, 4))] == [43]
    assert [r.rtype for r in framing.emf_records(ok + struct.pack("<II", 43, 999))] == [43]
    b = E.plus_comment([E.plus_record(0x4004), E.plus_record(0x4002), E.plus_record(0x4004)])
    (r,) = framing.emf_records(b)
    assert [p.rtype for p in framing.plus_records(b, *framing.plus_comment(b, r))] == [0x4004, 0x4002]
    assert framing.plus_comment(E.emf_record(70, struct.pack("<II", 4, K.GDIC_SIGNATURE)), next(framing.emf_records(E.emf_record(70, struct.pack("<II", 4, K.GDIC_SIGNATURE))))) is None
    assert [r.rtype for r in framing.wmf_records(E.wmf_record(0x1E) + E.wmf_record(0) + E.wmf_record(0x1E), 0)] == [0x1E]


def test_objects_and_state():
    ops = run([E.brush(1, 0x0000FF), E.select(1), E.pen(2, 1, 3, 0x00FF00), E.select(2), E.rectangle(10, 20, 30, 60), E.emf_record(40, struct.pack("<I", 1)), E.rectangle(0, 0, 1, 1), E.select(1), E.select(0x80000005), E.select(0x80000008), E.rectangle(0, 0, 1, 1)])
    assert [o["op"] for o in ops] == ["fill", "stroke", "fill", "stroke"]
    assert ops[0]["fill"] == ops[2]["fill"] == "#ff0000" and ops[0]["geom"] == [("R", [10, 20, 20, 40])]
    assert (ops[1]["stroke"], ops[1]["line_width"], ops[1]["dash"]) == ("#00ff00", 3, [8, 4])


def test_save_restore_levels():
    set_text = lambda n: E.emf_record(20, struct.pack("<I", n))
    ops = run([E.emf_record(33), set_text(4), E.emf_record(33), set_text(11), E.emf_record(34, struct.pack("<i", -2)), E.select(0x80000007), E.rectangle(0, 0, 1, 1)])
    assert ops[0]["fill"] == "#ffffff" and ops[1]["stroke"] == "#000000"
    ops = run([set_text(4), E.rectangle(0, 0, 1, 1), set_text(6), E.rectangle(0, 0, 1, 1)])
    assert ops[0]["fill"] == "#000000" and (ops[2]["fill"], ops[2]["gco"]) == ("#ffffff", "difference")


def test_mapping_and_world():
    ext = [E.emf_record(n, struct.pack("<ii", *v)) for n, v in ((10, (10, 10)), (9, (50, 50)), (12, (5, 5)), (11, (100, 200)))]
    ops = run([*ext, E.rectangle(20, 20, 30, 30)])
    assert ops[0]["geom"] == [("R", [25, 45, 20, 40])]
    ops = run([E.emf_record(35, struct.pack("<6f", 2, 0, 0, 3, 1, 1)), E.emf_record(36, struct.pack("<6fI", 1, 0, 0, 1, 4, 5, 2)), E.rectangle(1, 1, 2, 2)])
    assert ops[0]["geom"] == [("R", [7, 9, 2, 3])]
    ops = run([*ext, E.emf_record(31, struct.pack("<4i", 1, 2, 1, 0)), E.rectangle(20, 20, 30, 30)])
    assert ops[0]["geom"] == [("R", [15, 45, 10, 40])]


@pytest.mark.parametrize("n,fmt,cmds,fills", [(3, "i", "MLLZ", 1), (86, "h", "MLLZ", 1), (4, "i", "MLL", 0), (87, "h", "MLL", 0), (6, "i", "MLLL", 0), (2, "i", "M", 0), (5, "i", "MC", 0)])
def test_polys(n, fmt, cmds, fills):
    pts = struct.pack(f"<6{fmt}", 1, 2, 30, 40, 5, 60)
    ops = run([E.emf_record(n, bytes(16) + struct.pack("<I", 3) + pts)])
    assert "".join(c for c, _ in ops[-1]["geom"]) == cmds
    assert sum(o["op"] == "fill" for o in ops) == fills


def test_polypolygons_and_arcs():
    body = bytes(16) + struct.pack("<II", 2, 6) + struct.pack("<II", 3, 3)
    for n, fmt in ((8, "i"), (91, "h"), (7, "i")):
        ops = run([E.emf_record(n, body + struct.pack(f"<12{fmt}", *range(12)))])
        assert "".join(c for c, _ in ops[-1]["geom"]) == ("MLLMLL" if n == 7 else "MLLZMLLZ")
    arc = struct.pack("<8i", 0, 0, 100, 50, 100, 25, 50, 50)
    kinds = {n: run([E.emf_record(n, arc)]) for n in (45, 46, 47, 55)}
    assert [len(kinds[n]) for n in (45, 46, 47, 55)] == [1, 2, 2, 1]
    cx, cy, rx, ry, a, z, _ = kinds[45][0]["geom"][1][1]
    assert (cx, cy, rx, ry, a) == (50, 25, 50, 25, 0) and math.isclose(z, math.pi / 2)
    assert run([E.emf_record(42, struct.pack("<4i", 0, 0, 10, 20))])[0]["geom"][0][1][:4] == [5, 10, 5, 10]
    assert [c for c, _ in run([E.emf_record(44, struct.pack("<6i", 0, 0, 40, 20, 10, 10))])[0]["geom"]] == ["M", "A", "A", "A", "A", "Z"]
    assert run([E.emf_record(15, struct.pack("<iiI", 3, 4, 0x0000FF))])[0]["geom"] == [("R", [3, 4, 1, 1])]


def test_path_bracket_and_clip():
    square = [E.emf_record(27, struct.pack("<ii", 10, 10)), *[E.emf_record(54, struct.pack("<ii", *p)) for p in ((50, 10), (50, 50), (10, 50))], E.emf_record(61)]
    ops = run([E.emf_record(59), *square, E.emf_record(60), E.emf_record(63, bytes(16)), E.emf_record(67, struct.pack("<I", 5)), E.emf_record(29, struct.pack("<4i", 20, 20, 30, 30)), E.rectangle(0, 0, 100, 100)])
    assert [o["op"] for o in ops] == ["fill", "stroke", "fill", "stroke"]
    region = ops[2]["clip"]
    assert [clip.contains(region, *p) for p in ((15, 15), (25, 25), (60, 60))] == [True, False, False]
    data = struct.pack("<4I4i", 32, 1, 2, 32, 0, 0, 0, 0) + struct.pack("<8i", 0, 0, 10, 10, 20, 20, 30, 30)
    ops = run([E.emf_record(75, struct.pack("<II", len(data), 5) + data), E.emf_record(26, struct.pack("<ii", 5, 0)), E.rectangle(0, 0, 1, 1)])
    assert [clip.contains(ops[0]["clip"], *p) for p in ((7, 5), (2, 5), (27, 25), (40, 25))] == [True, False, True, False]


@pytest.mark.parametrize("op,law", [("intersect", lambda a, b: a and b), ("exclude", lambda a, b: a and not b), ("xor", lambda a, b: a != b), ("union", lambda a, b: a or b), ("complement", lambda a, b: b and not a), ("replace", lambda a, b: b)])
def test_clip_laws(op, law):
    a, b = clip.rect(0, 0, 6, 6), clip.rect(3, 3, 9, 9)
    region, exact = clip.combine([a], b, op)
    assert exact == (op != "union")
    for x in (1.5, 4.5, 7.5, 10.5):
        for y in (1.5, 4.5, 7.5, 10.5):
            assert clip.contains(region, x, y) == law(clip.contains([a], x, y), clip.contains([b], x, y))
    whole, _ = clip.combine(None, b, op)
    assert clip.contains(whole, 4, 4) == law(True, True) and clip.contains(whole, 1, 1) == law(True, False)
    assert clip.contains(clip.combine_regions([a], None, op)[0], 1, 1) == law(True, True)


def test_text():
    font = struct.pack("<Iiiiii", 1, -20, 0, 0, 0, 700) + bytes([1, 1, 0, 0]) + "Courier New".encode("utf-16-le").ljust(64, b"\0")
    s = "Hi".encode("utf-16-le")
    text = bytes(16) + struct.pack("<Iff", 1, 1, 1) + struct.pack("<iiIIIIIIII", 10, 40, 2, 76, 0, 0, 0, 0, 0, 0) + s
    ops = run([E.emf_record(82, font.ljust(324, b"\0")), E.select(1), E.emf_record(24, struct.pack("<I", 0xFF)), E.emf_record(22, struct.pack("<I", 0x18)), E.emf_record(84, text)])
    assert (ops[0]["text"], ops[0]["font"], ops[0]["fill"], ops[0]["baseline"], ops[0]["geom"]) == ("Hi", 'italic bold 20px "Courier New"', "#ff0000", "alphabetic", [("M", [10, 40])])
    assert ops[1]["op"] == "fill" and ops[1]["geom"][0][1][1] == 42


def dib(w, h, bpp, rows, comp=0, palette=b"", masks=b""):
    return struct.pack("<IiiHHIIiiII", 40, w, h, 1, bpp, comp, len(rows), 0, 0, len(palette) // 4, 0) + masks + palette + rows


def test_bitmaps():
    two = bytes([0, 0, 255, 0, 255, 0, 0, 0])  # palette of red and blue, as B G R 0
    assert bitmaps.dib(dib(2, 2, 24, bytes([0, 0, 255, 0, 255, 0, 0, 0, 255, 0, 0, 9, 9, 9, 0, 0])))[:, :, :3].tolist() == [[[0, 0, 255], [9, 9, 9]], [[255, 0, 0], [0, 255, 0]]]
    assert bitmaps.dib(dib(3, -1, 1, bytes([0b01000000, 0, 0, 0]), palette=two))[0, :, 0].tolist() == [255, 0, 255]
    assert bitmaps.dib(dib(2, -1, 4, bytes([0x1F, 0, 0, 0]), palette=two))[0].tolist() == [[0, 0, 255, 255], [0, 0, 0, 255]]
    assert bitmaps.dib(dib(1, -1, 16, struct.pack("<HH", 0x7C00, 0)))[0, 0].tolist() == [255, 0, 0, 255]
    assert bitmaps.dib(dib(1, -1, 16, struct.pack("<HH", 0x07E0, 0), 3, masks=struct.pack("<3I", 0xF800, 0x7E0, 0x1F)))[0, 0].tolist() == [0, 255, 0, 255]
    assert bitmaps.dib(dib(2, -1, 32, bytes([1, 2, 3, 0, 1, 2, 3, 7])))[0].tolist() == [[3, 2, 1, 255], [3, 2, 1, 7]]
    assert bitmaps.dib(dib(4, 2, 8, bytes([3, 1, 0, 0, 0, 3, 1, 0, 1, 0, 0, 1]), 1, two))[:, :, 2].tolist() == [[255, 255, 255, 0], [255, 0, 255, 0]]
    assert bitmaps.dib(dib(4, 1, 4, bytes([4, 0x01, 0, 1]), 2, two))[0, :, 0].tolist() == [255, 0, 255, 0]
    assert bitmaps.dib(dib(9000, 1, 24, b"")) is None and bitmaps.dib(b"x") is None and bitmaps.dib(dib(1, 1, 24, b"", 4)) is None
    assert bitmaps.plus_pixels(bytes([10, 20, 40, 128]), 1, 1, 4, bitmaps.PARGB32)[0, 0].tolist() == [80, 40, 20, 128]
    assert bitmaps.plus_pixels(bytes([1, 2, 3, 0, 4, 5, 6, 0]), 1, 2, -4, bitmaps.RGB24)[:, 0, 0].tolist() == [6, 3]


def test_stretch_dib():
    d = dib(2, -1, 24, bytes([0, 0, 255, 255, 0, 0, 0, 0]))
    head, bits = d[:40], d[40:]
    body = bytes(16) + struct.pack("<6i", 10, 10, 0, 0, 2, 1) + struct.pack("<4I", 80, 40, 120, len(bits)) + struct.pack("<IIii", 0, 0xCC0020, 20, 10)
    out = draw_bytes(E.emf([E.emf_record(81, body + head + bits), E.eof()], (0, 0, 40, 30)))
    assert out[12, 12].tolist() == [255, 0, 0, 255] and out[12, 27].tolist() == [0, 0, 255, 255] and out[5, 5, 3] == 0


def obj(kind, ident, data, flags=0):
    return E.plus_record(0x4008, kind << 8 | ident | flags, data)


V = struct.pack("<I", 0xDBC01002)
SOLID = V + struct.pack("<II", 0, 0xFF008000)


def test_plus_objects_and_state():
    pen = V + struct.pack("<III f", 0, 0x20, 2, 4.0) + struct.pack("<i", 1) + SOLID
    save, restore = E.plus_record(0x4025, 0, struct.pack("<I", 7)), E.plus_record(0x4026, 0, struct.pack("<I", 7))
    ops = run([E.plus_comment([obj(1, 0, SOLID), obj(2, 1, pen), save, E.plus_record(0x402D, 0, struct.pack("<ff", 5, 6)), E.plus_record(0x400A, 0, struct.pack("<II4f", 0, 1, 1, 2, 3, 4)), restore, E.plus_record(0x400B, 0x4001, struct.pack("<I4h", 1, 1, 2, 3, 4))]), E.plus_comment([E.plus_record(0x4010, 0x8000, struct.pack("<I6f", 0x80FF8040, 0, 90, 0, 0, 10, 10))])])
    assert (ops[0]["fill"], ops[0]["transform"], ops[0]["geom"]) == ("rgba(0,128,0,1.000)", [1, 0, 0, 1, 5, 6], [("R", [1, 2, 3, 4])])
    assert (ops[1]["stroke"], ops[1]["line_width"], ops[1]["dash"], ops[1]["transform"]) == ("rgba(0,128,0,1.000)", 4, [12, 4], [1, 0, 0, 1, 0, 0])
    assert ops[2]["fill"] == "rgba(255,128,64,0.502)" and [c for c, _ in ops[2]["geom"]] == ["M", "A", "Z"]


def test_continued_object():
    total = struct.pack("<I", len(SOLID))
    ops = run([E.plus_comment([obj(1, 3, total + SOLID[:6] + SOLID[6:8], 0x8000), obj(1, 3, SOLID[8:]), E.plus_record(0x400A, 0, struct.pack("<II4f", 3, 1, 0, 0, 1, 1))])])
    assert ops[0]["fill"] == "rgba(0,128,0,1.000)"


def test_gradients():
    linear = V + struct.pack("<IIIffffII", 4, 4, 0, 0, 0, 100, 50, 0xFFFF0000, 0xFF0000FF) + bytes(8) + struct.pack("<IffII", 2, 1.0, 0.0, 0xFF0000FF, 0xFFFF0000)
    g = plus.brush(linear)["gradient"]
    assert (g["x0"], g["y0"], g["x1"], g["y1"]) == (0, 25, 100, 25)
    assert [s["color"] for s in g["stops"]] == ["rgba(255,0,0,1.000)", "rgba(0,0,255,1.000)"]
    radial = V + struct.pack("<IIIIffI", 3, 0, 0, 0xFFFFFFFF, 5, 5, 1) + struct.pack("<I", 0xFF008000) + struct.pack("<I4f", 2, 8, 9, 5, 6)
    g = plus.brush(radial)["gradient"]
    assert (g["type"], g["r"], [s["color"] for s in g["stops"]]) == ("radial", 5, ["rgba(255,255,255,1.000)", "rgba(0,128,0,1.000)"])
    assert plus.brush(V + struct.pack("<III", 1, 0, 0xFF010203))["color"] == "rgba(1,2,3,1.000)" and plus.brush(b"") is None
    ops = run([E.plus_comment([obj(1, 0, linear), E.plus_record(0x400A, 0, struct.pack("<II4f", 0, 1, 0, 0, 100, 50))])])
    out = raster.render([ops[0] | {"geom": [("R", [0, 0, 100, 50])], "clip": None}], 100, 60)
    assert out[10, 2, 0] > 240 and out[10, 97, 2] > 240 and out[55, 5, 3] == 0


def test_plus_paths_regions_and_clips():
    path = V + struct.pack("<II", 4, 0x4000) + struct.pack("<8h", 0, 0, 10, 0, 10, 10, 0, 10) + bytes([0, 1, 1, 0x81])
    region = V + struct.pack("<I", 2) + struct.pack("<I", 4) + struct.pack("<I4f", 0x10000000, 0, 0, 20, 20) + struct.pack("<I4f", 0x10000000, 5, 5, 5, 5)
    clip_of = lambda n, flags, data=b"": E.plus_record(n, flags, data)
    fill = E.plus_record(0x4014, 0x8000, struct.pack("<I", 0xFF000000))
    ops = run([E.plus_comment([obj(3, 0, path), obj(8, 1, region), clip_of(0x4034, 1), fill, clip_of(0x4031, 0), clip_of(0x4033, 0), clip_of(0x4035, 0, struct.pack("<ff", 2, 0)), fill, clip_of(0x4032, 0x400, struct.pack("<4f", 0, 0, 4, 20)), fill])])
    assert [c for c, _ in ops[0]["geom"]] == ["M", "L", "L", "L", "Z"]
    assert [clip.contains(ops[0]["clip"], *p) for p in ((2, 2), (7, 7), (15, 15), (25, 5))] == [True, False, True, False]
    assert [clip.contains(ops[1]["clip"], *p) for p in ((1, 5), (11, 5))] == [False, True]
    assert [clip.contains(ops[2]["clip"], *p) for p in ((3, 5), (11, 5))] == [False, True]
    assert plus.region(V + struct.pack("<II", 0, 0x99)) is None


def test_images_come_last_and_nest():
    inner = E.emf([E.brush(1, 0x0000FF), E.select(1), E.select(0x80000008), E.rectangle(0, 0, 10, 10), E.eof()], (0, 0, 10, 10))
    image = V + struct.pack("<III", 2, 0, len(inner)) + inner
    draw = E.plus_record(0x401A, 5, bytes(24) + struct.pack("<4f", 0, 0, 20, 20))
    b = E.emf([E.plus_comment([obj(5, 5, image), draw]), E.brush(1, 0xFF0000), E.select(1), E.select(0x80000008), E.rectangle(10, 10, 40, 40), E.eof()], (0, 0, 40, 40))
    ops = replay(b, "emf", (0, 0, 40, 40), (40, 40))
    assert [(o["op"], o["phase"]) for o in ops] == [("fill", 0), ("image", 1)]
    out = draw_bytes(b)
    assert out[15, 15].tolist() == [255, 0, 0, 255] and out[30, 30].tolist() == [0, 0, 255, 255]
    deep = inner
    for _ in range(6):
        deep = E.emf([E.plus_comment([obj(5, 5, V + struct.pack("<III", 2, 0, len(deep)) + deep), E.plus_record(0x401A, 5, bytes(24) + struct.pack("<4f", 0, 0, 10, 10))]), E.eof()], (0, 0, 10, 10))
    assert draw_bytes(deep)[..., 3].sum() == 0  # beyond the depth limit


def test_wmf_slots_and_shapes():
    make = lambda c: E.wmf_record(0x2FC, struct.pack("<HIH", 0, c, 0))
    use, free = E.wmf_record(0x12D, struct.pack("<H", 0)), E.wmf_record(0x1F0, struct.pack("<H", 0))
    box = E.wmf_record(0x41B, struct.pack("<4h", 40, 30, 20, 10))
    ops = run_wmf([x for c in (0x0000CC, 0x16C3F4, 0x000099) for x in (make(c), use, box, free)])
    assert [o["fill"] for o in ops if o["op"] == "fill"] == ["#cc0000", "#f4c316", "#990000"]
    assert ops[0]["geom"] == [("R", [10, 20, 20, 20])]
    ops = run_wmf([E.wmf_record(0x20C, struct.pack("<hh", 128, 128)), E.wmf_record(0x20B, struct.pack("<hh", 10, 20)), box, E.wmf_record(0x325, struct.pack("<h4h", 2, 20, 10, 40, 30)), E.wmf_record(0x521, struct.pack("<h", 3) + b"abc\0" + struct.pack("<hh", 12, 24))])
    assert ops[0]["geom"] == [("R", [-5, 5, 10, 10])] and ops[-1]["text"] == "abc" and ops[-1]["geom"] == [("M", [2, 1])]


def test_png_and_render(spark):
    b = E.emf([E.brush(1, 0x0000FF), E.select(1), E.select(0x80000008), E.rectangle(0, 0, 4, 2), E.eof()], (0, 0, 8, 4))
    files = spark.createDataFrame([("x.emf", b), ("bad", b"no"), ("null", None)], "path string, content binary")
    got = {r.path: r for r in render(files).collect()}
    assert got["bad"].data_url is None and got["null"].data_url is None
    import base64

    raw = base64.b64decode(got["x.emf"].data_url.removeprefix("data:image/png;base64,"))
    w, h = struct.unpack(">II", raw[16:24])
    at = raw.index(b"IDAT")
    size = struct.unpack(">I", raw[at - 4 : at])[0]
    px = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)
    assert (w, h, got["x.emf"].painted) == (8, 4, 8)
    assert px[1, 3].tolist() == [255, 0, 0, 255] and px[3, 3, 3] == 0


def test_streaming(spark, tmp_path):
    from vectorloom.streaming.watch import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.emf").write_bytes(E.emf([E.rectangle(0, 0, 4, 2), E.eof()], (0, 0, 8, 4)))
    for _ in range(2):  # a second run finds nothing new
        watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def _png(px: np.ndarray, depth: int, kind: int, filters=(0,), laced: bool = False, more: list = ()) -> bytes:
    """An encoder apart from the engine's: px has the samples, (h, w, n)."""
    h, w, n = px.shape
    raw, step = b"", max(1, n * depth // 8)
    grids = [(0, 0, 1, 1)] if not laced else [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
    for x0, y0, dx, dy in grids:
        part = px[y0::dy, x0::dx]
        if not part.size:
            continue
        up = bytes((part.shape[1] * n * depth + 7) // 8)
        for y, line in enumerate(part):
            bits = "".join(f"{int(v):0{depth}b}" for v in line.reshape(-1))
            row = int(bits.ljust(len(up) * 8, "0"), 2).to_bytes(len(up), "big")
            f = filters[y % len(filters)]
            out = bytearray()
            for i, v in enumerate(row):
                a, b, c = (row[i - step] if i >= step else 0), up[i], (up[i - step] if i >= step else 0)
                p = a + b - c
                paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
                out.append(v - (0, a, b, (a + b) // 2, paeth)[f] & 255)
            raw += bytes([f]) + bytes(out)
            up = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("laced", [False, True])
@pytest.mark.parametrize("kind,depth", [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (4, 16), (6, 8), (6, 16)])
def test_png_of_every_kind(kind, depth, laced):
    r = np.random.default_rng(kind * 100 + depth)
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    px = r.integers(0, 1 << depth, (9, 13, n))
    palette = r.integers(0, 256, (1 << min(depth, 8), 3), np.uint8)
    alpha = bytes(r.integers(0, 256, len(palette) // 2, np.uint8))
    more = [(b"PLTE", palette.tobytes()), (b"tRNS", alpha)] if kind == 3 else []
    got = embedded.png_pixels(_png(px, depth, kind, (0, 1, 2, 3, 4), laced, more))
    if kind == 3:
        assert (got[..., :3] == palette[px[..., 0]]).all() and (got[..., 3] == np.append(np.frombuffer(alpha, np.uint8), np.full(len(palette) - len(alpha), 255))[px[..., 0]]).all()
        return
    level = px >> 8 if depth == 16 else px * 255 // ((1 << depth) - 1)
    assert (got[..., :3] == (level[..., :3] if n >= 3 else level[..., :1])).all()
    assert (got[..., 3] == (level[..., -1] if n in (2, 4) else 255)).all()


def test_damaged_pngs_are_no_pictures():
    good = _png(np.zeros((2, 2, 1), int), 8, 0)
    assert embedded.png_pixels(good).shape == (2, 2, 4)
    for bad in (good[:20], good[:45], good.replace(b"IDAT", b"IDOT"), b"\x89PNG\r\n\x1a\n", good[:16] + struct.pack(">I", 90000) + good[20:]):
        assert embedded.png_pixels(bad) is None
    clear = embedded.png_pixels(_png(np.array([[[7], [8]]]), 8, 0, more=[(b"tRNS", struct.pack(">H", 8))]))
    assert clear[0, :, 3].tolist() == [255, 0]


def test_text_is_drawn():
    out = E.emf_record(84, struct.pack("<16xIffiiIII16xI", 1, 1.0, 1.0, 10, 10, 2, 76, 0, 0) + "H-".encode("utf-16-le"))
    px = raster.render(run([out]), 100, 100)
    painted = px[..., 3] > 0
    rows, cols = np.nonzero(painted)
    assert painted.sum() > 10 and rows.min() >= 9 and rows.max() <= 23 and cols.min() >= 10 and cols.max() <= 25
    assert not painted[:, 40:].any() and (px[painted] == [0, 0, 0, 255]).all()


def test_large_canvas_takes_four_bytes_a_pixel():
    ops = run([E.brush(1, 0x0000FF), E.select(1), E.select(0x80000008), E.rectangle(0, 0, 4000, 3000), E.emf_record(42, struct.pack("<4i", 0, 0, 4096, 4096))], (0, 0, 4096, 4096), (4096, 4096))
    px = raster.render(ops, 4096, 4096)
    assert px.dtype == np.uint8 and px.nbytes == 4 * 4096 * 4096
    assert px[10, 10].tolist() == [255, 0, 0, 255] and px[4090, 2048].tolist() == [255, 0, 0, 255] and px[4095, 4095, 3] == 0


def test_nested_images_that_are_lost():
    jpeg = V + struct.pack("<IiiiiI", 1, 0, 0, 0, 0, 1) + b"\xff\xd8\xff" + bytes(9)
    show = E.plus_record(0x401A, 5, bytes(24) + struct.pack("<4f", 0, 0, 20, 20))
    inner = E.emf([E.plus_comment([obj(5, 5, jpeg), show]), E.eof()], (0, 0, 10, 10))
    assert embedded.lost(inner, True) == ["jpeg"] and embedded.lost(b"junk", True) == ["unknown"] and embedded.lost(None, False) == ["unknown"]
    assert embedded.image_kind(b"GIF89a") == "gif" and embedded.image_kind(inner) == "metafile"
