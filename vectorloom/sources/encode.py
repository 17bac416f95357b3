"""Small metafile writers, for round trips and tests."""

from __future__ import annotations

import struct

from .. import constants as K


def emf_record(rtype: int, payload: bytes = b"") -> bytes:
    payload += bytes(-len(payload) % 4)
    return struct.pack("<II", rtype, 8 + len(payload)) + payload


def emf(records: list[bytes], bounds=(0, 0, 64, 8), frame=(0, 0, 2100, 1500)) -> bytes:
    size = 108 + sum(map(len, records))
    head = struct.pack("<II4i4iIIIIHHIIIII", 1, 108, *bounds, *frame, K.EMF_SIGNATURE, 0x10000, size, 1 + len(records), 1, 0, 0, 0, 0, 0, 0)
    return head + bytes(108 - len(head)) + b"".join(records)


def eof() -> bytes:
    return emf_record(14, struct.pack("<III", 0, 0, 20))


def brush(handle: int, color: int, style: int = 0) -> bytes:
    return emf_record(39, struct.pack("<IIII", handle, style, color, 0))


def pen(handle: int, style: int, width: int, color: int) -> bytes:
    return emf_record(38, struct.pack("<IIiiI", handle, style, width, 0, color))


def select(handle: int) -> bytes:
    return emf_record(37, struct.pack("<I", handle))


def rectangle(left: int, top: int, right: int, bottom: int) -> bytes:
    return emf_record(43, struct.pack("<4i", left, top, right, bottom))


def plus_record(rtype: int, flags: int = 0, data: bytes = b"") -> bytes:
    data += bytes(-len(data) % 4)
    return struct.pack("<HHII", rtype, flags, 12 + len(data), len(data)) + data


def plus_comment(records: list[bytes]) -> bytes:
    body = struct.pack("<I", K.EMFPLUS_SIGNATURE) + b"".join(records)
    return emf_record(70, struct.pack("<I", len(body)) + body)


def wmf_record(rtype: int, payload: bytes = b"") -> bytes:
    payload += bytes(len(payload) % 2)
    return struct.pack("<IH", (6 + len(payload)) // 2, rtype) + payload


def wmf(records: list[bytes], bounds=(0, 0, 64, 64), inch: int = 96) -> bytes:
    placeable = struct.pack("<IH4hHIH", K.PLACEABLE, 0, *bounds, inch, 0, 0)
    return placeable + struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + b"".join(records) + wmf_record(0)
