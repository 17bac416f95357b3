"""Fixed values of the metafile formats: record numbers and names, signatures, limits, tables."""

EMF_SIGNATURE, EMFPLUS_SIGNATURE, GDIC_SIGNATURE, PLACEABLE = 0x464D4520, 0x2B464D45, 0x43494447, 0x9AC6CDD7
MAX_SIDE, MAX_RECORDS, MAX_PLUS_RECORDS, MAX_DEPTH, MAX_OBJECT = 8192, 200_000, 500_000, 3, 64 << 20
MAX_POINTS, MAX_POLYS, MAX_STOPS, MAX_REGION_DEPTH = 100_000, 10_000, 4096, 64
DEFAULT_DPI_SCALE, CLIP_HUGE = 1, float(1 << 24)

EMF = {
    1: "HEADER", 2: "POLYBEZIER", 3: "POLYGON", 4: "POLYLINE", 5: "POLYBEZIERTO", 6: "POLYLINETO", 7: "POLYPOLYLINE", 8: "POLYPOLYGON",
    9: "SETWINDOWEXTEX", 10: "SETWINDOWORGEX", 11: "SETVIEWPORTEXTEX", 12: "SETVIEWPORTORGEX", 13: "SETBRUSHORGEX", 14: "EOF", 15: "SETPIXELV",
    17: "SETMAPMODE", 18: "SETBKMODE", 19: "SETPOLYFILLMODE", 20: "SETROP2", 21: "SETSTRETCHBLTMODE", 22: "SETTEXTALIGN", 24: "SETTEXTCOLOR",
    25: "SETBKCOLOR", 26: "OFFSETCLIPRGN", 27: "MOVETOEX", 28: "SETMETARGN", 29: "EXCLUDECLIPRECT", 30: "INTERSECTCLIPRECT", 31: "SCALEVIEWPORTEXTEX",
    32: "SCALEWINDOWEXTEX", 33: "SAVEDC", 34: "RESTOREDC", 35: "SETWORLDTRANSFORM", 36: "MODIFYWORLDTRANSFORM", 37: "SELECTOBJECT", 38: "CREATEPEN",
    39: "CREATEBRUSHINDIRECT", 40: "DELETEOBJECT", 42: "ELLIPSE", 43: "RECTANGLE", 44: "ROUNDRECT", 45: "ARC", 46: "CHORD", 47: "PIE", 54: "LINETO",
    55: "ARCTO", 58: "SETMITERLIMIT", 59: "BEGINPATH", 60: "ENDPATH", 61: "CLOSEFIGURE", 62: "FILLPATH", 63: "STROKEANDFILLPATH", 64: "STROKEPATH",
    67: "SELECTCLIPPATH", 70: "COMMENT", 75: "EXTSELECTCLIPRGN", 76: "BITBLT", 81: "STRETCHDIBITS", 82: "EXTCREATEFONTINDIRECTW", 84: "EXTTEXTOUTW",
    85: "POLYBEZIER16", 86: "POLYGON16", 87: "POLYLINE16", 88: "POLYBEZIERTO16", 89: "POLYLINETO16", 91: "POLYPOLYGON16", 95: "EXTCREATEPEN",
    98: "SETICMMODE", 115: "SETLAYOUT",
}
EMF_SKIPPED = (1, 13, 28, 98, 115)
EMFPLUS = {
    0x4001: "Header", 0x4002: "EndOfFile", 0x4004: "GetDC", 0x4008: "Object", 0x400A: "FillRects", 0x400B: "DrawRects", 0x400C: "FillPolygon",
    0x400D: "DrawLines", 0x400E: "FillEllipse", 0x400F: "DrawEllipse", 0x4010: "FillPie", 0x4011: "DrawPie", 0x4012: "DrawArc", 0x4014: "FillPath",
    0x4015: "DrawPath", 0x401A: "DrawImage", 0x401B: "DrawImagePoints", 0x401C: "DrawString", 0x401E: "SetAntiAliasMode", 0x401F: "SetTextRenderingHint",
    0x4021: "SetInterpolationMode", 0x4022: "SetPixelOffsetMode", 0x4024: "SetCompositingQuality", 0x4025: "Save", 0x4026: "Restore",
    0x4028: "BeginContainerNoParams", 0x4029: "EndContainer", 0x402A: "SetWorldTransform", 0x402B: "ResetWorldTransform",
    0x402C: "MultiplyWorldTransform", 0x402D: "TranslateWorldTransform", 0x402E: "ScaleWorldTransform", 0x402F: "RotateWorldTransform",
    0x4030: "SetPageTransform", 0x4031: "ResetClip", 0x4032: "SetClipRect", 0x4033: "SetClipPath", 0x4034: "SetClipRegion", 0x4035: "OffsetClip",
    0x4036: "DrawDriverString",
}
WMF = {
    0x0000: "EOF", 0x001E: "SAVEDC", 0x0102: "SETBKMODE", 0x0104: "SETROP2", 0x0106: "SETPOLYFILLMODE", 0x0127: "RESTOREDC", 0x012D: "SELECTOBJECT",
    0x012E: "SETTEXTALIGN", 0x01F0: "DELETEOBJECT", 0x0201: "SETBKCOLOR", 0x0209: "SETTEXTCOLOR", 0x020B: "SETWINDOWORG", 0x020C: "SETWINDOWEXT",
    0x0213: "LINETO", 0x0214: "MOVETO", 0x02FA: "CREATEPENINDIRECT", 0x02FB: "CREATEFONTINDIRECT", 0x02FC: "CREATEBRUSHINDIRECT", 0x0324: "POLYGON",
    0x0325: "POLYLINE", 0x0418: "ELLIPSE", 0x041B: "RECTANGLE", 0x0521: "TEXTOUT", 0x0538: "POLYPOLYGON", 0x061C: "ROUNDRECT", 0x0817: "ARC",
    0x081A: "PIE", 0x0830: "CHORD", 0x0A32: "EXTTEXTOUT",
}

#: Raster operation: composite operation, colour transform, whether it is exact.
ROP2 = {
    1: ("source-over", "black", True), 2: ("darken", "invert", False), 3: ("darken", "invert", False), 4: ("source-over", "invert", True),
    5: ("difference", "same", False), 6: ("difference", "white", True), 7: ("difference", "same", False), 8: ("lighten", "invert", False),
    9: ("darken", "same", False), 10: ("difference", "invert", False), 11: ("source-over", "transparent", True), 12: ("lighten", "invert", False),
    13: ("source-over", "same", True), 14: ("lighten", "same", False), 15: ("lighten", "same", False), 16: ("source-over", "white", True),
}
#: Pen dash by style: in pixels for GDI, in pen widths for EMF+.
GDI_DASH = {1: [8, 4], 2: [2, 2], 3: [8, 4, 2, 4], 4: [8, 4, 2, 4, 2, 4]}
PLUS_DASH = {1: [3, 1], 2: [1, 1], 3: [3, 1, 1, 1], 4: [3, 1, 1, 1, 1, 1]}
#: Stock objects: kind, style, colour or family.
STOCK = {
    0: ("brush", 0, "#ffffff"), 1: ("brush", 0, "#c0c0c0"), 2: ("brush", 0, "#808080"), 3: ("brush", 0, "#404040"), 4: ("brush", 0, "#000000"),
    5: ("brush", 1, "#000000"), 6: ("pen", 0, "#ffffff"), 7: ("pen", 0, "#000000"), 8: ("pen", 5, "#000000"), 10: ("font", 0, "monospace"),
    11: ("font", 0, "monospace"), 12: ("font", 0, "sans-serif"), 13: ("font", 0, "sans-serif"), 14: ("font", 0, "sans-serif"), 17: ("font", 0, "sans-serif"),
}
#: Pixels per EMF+ page unit at 96 dpi.
PAGE_UNIT = {3: 96 / 72, 4: 96.0, 5: 96 / 300, 6: 96 / 25.4}
