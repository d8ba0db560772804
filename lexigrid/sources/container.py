"""Binary containers of help books: blocks, entities and zip storage.

Layout, all numbers little-endian: a 16-byte header, then the descriptor block of 12-byte
entries (header offset, body offset, splitter). A block is a 31-byte ASCII header (payload
size, block size, next offset in hex) and its bytes; long payloads go on in the next block.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile

HEADER, DESCRIPTOR, BLOCK = 16, 12, 31
#: Fixed value: no body, no next block, and the end of a descriptor.
NONE = 0x7FFFFFFF
MAX_ENTRY = 64 << 20
_BLOCK = re.compile(rb"\r\n([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) ([0-9a-fA-F]{8}) \r\n")


class ContainerError(ValueError):
    """What is wrong: a code and a message; `code` goes to the error column of a scan."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def block(data: bytes, offset: int) -> bytes:
    """The payload that begins in the block at `offset`, over all its blocks."""
    parts, seen, need, at = [], set(), None, offset
    while True:
        if at in seen:
            raise ContainerError("BLOCK_CYCLE", f"the chain at {offset} comes back to {at}")
        seen.add(at)
        head = _BLOCK.fullmatch(data[at : at + BLOCK])
        if head is None:
            raise ContainerError("BAD_BLOCK_HEADER", f"no block header at {at}")
        payload, size, following = (int(x, 16) for x in head.groups())
        if need is None:
            need = payload
            if need > len(data):
                raise ContainerError("OVERSIZE_PAYLOAD", f"{need} bytes are declared in a file of {len(data)}")
        body = data[at + BLOCK : at + BLOCK + size]
        if len(body) < size:
            raise ContainerError("BLOCK_OUT_OF_RANGE", f"the block at {at} ends behind the file")
        if need and not size:
            raise ContainerError("NO_PROGRESS", f"the block at {at} is empty before the payload is complete")
        parts.append(body[:need])
        need -= len(parts[-1])
        if not need or following == NONE:
            break
        at = following
    if need:
        raise ContainerError("SHORT_CHAIN", f"the chain at {offset} lacks {need} bytes")
    return b"".join(parts)


class Container:
    """Entities of one container by name."""

    def __init__(self, data: bytes):
        if len(data) < HEADER:
            raise ContainerError("BAD_HEADER", f"{len(data)} bytes, {HEADER} are the least")
        self.data = data
        self.free_block, self.block_size, self.count_hint, self.reserved = struct.unpack_from("<4I", data)
        table = block(data, HEADER)
        if len(table) % DESCRIPTOR:
            raise ContainerError("BAD_DESCRIPTORS", f"{len(table)} bytes of descriptors")
        self.bodies: dict[str, int | None] = {}
        for head, body, end in struct.iter_unpack("<3I", table):
            if end != NONE:
                raise ContainerError("BAD_SPLITTER", f"descriptor ends with {end:#010x}")
            name = block(data, head)[20:].decode("utf-16-le").rstrip("\0")
            if body != NONE and body >= len(data):
                raise ContainerError("BODY_OUT_OF_RANGE", f"entity {name} at {body}")
            self.bodies[name] = None if body == NONE else body

    def read(self, name: str) -> bytes:
        if name not in self.bodies:
            raise ContainerError("MISSING_ENTITY", name)
        if self.bodies[name] is None:
            raise ContainerError("ENTITY_HAS_NO_BODY", name)
        return block(self.data, self.bodies[name])


def write_container(entities: list[tuple[str, bytes | None]], block_size: int | None = None) -> bytes:
    """A container of the entities (None: without body); payloads over `block_size` go on in
    further blocks."""
    out = bytearray(struct.pack("<4I", NONE, 512, len(entities), 0))

    def put(payload: bytes) -> int:
        first, size = len(out), block_size or max(1, len(payload))
        chunks = [payload[i : i + size] for i in range(0, len(payload), size)] or [b""]
        for i, chunk in enumerate(chunks):
            following = len(out) + BLOCK + len(chunk) if i + 1 < len(chunks) else NONE
            out.extend(b"\r\n%08x %08x %08x \r\n" % (len(payload) if i == 0 else 0, len(chunk), following))
            out.extend(chunk)
        return first

    whole = block_size
    block_size = None
    table = put(bytes(DESCRIPTOR * len(entities))) + BLOCK
    for i, (name, body) in enumerate(entities):
        block_size = None
        head = put(bytes(20) + name.encode("utf-16-le") + bytes(4))
        block_size = whole
        at = NONE if body is None else put(body)
        struct.pack_into("<3I", out, table + DESCRIPTOR * i, head, at, NONE)
    return bytes(out)


def zip_entry(data: bytes, path: str | None = None) -> bytes:
    """The first entry of a zip, or that of a path."""
    with zipfile.ZipFile(io.BytesIO(data)) as zipped:
        names = zipped.namelist()
        name = names[0] if path is None and names else path
        if name is None or name not in names:
            raise ContainerError("MISSING_ZIP_ENTRY", str(path))
        if zipped.getinfo(name).file_size > MAX_ENTRY:
            raise ContainerError("OVERSIZE_ENTRY", name)
        return zipped.read(name)


def zip_pages(data: bytes) -> list[tuple[str, bytes]]:
    """(path without leading /, bytes) of the stored pages: no folders, no names in __."""
    with zipfile.ZipFile(io.BytesIO(data)) as zipped:
        return [(n.lstrip("/"), zipped.read(n)) for n in zipped.namelist() if not n.endswith("/") and not n.rsplit("/", 1)[-1].startswith("__")]
