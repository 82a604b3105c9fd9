"""Makes binary documents: records, definitions, and a small OLE2 compound file. Queries decode what they make from table rows."""

import struct
import zlib

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def record(tag, level, payload=b""):
    size = len(payload)
    if size < 4095:
        return struct.pack("<I", tag | level << 10 | size << 20) + payload
    return struct.pack("<II", tag | level << 10 | 4095 << 20, size) + payload


def wide(text):
    raw = text.encode("utf-16-le")
    return struct.pack("<H", len(raw) // 2) + raw


def file_header(version=(5, 0, 6, 0), flags=0, name=b"HWP Document File"):
    major, minor, build, revision = version
    return name.ljust(32, b"\0") + bytes((revision, build, minor, major)) + struct.pack("<I", flags) + bytes(216)


def paragraph(level, text="", changes=(), shape=0, style=0, controls=b"", raw=None):
    units = raw if raw is not None else text.encode("utf-16-le")
    out = record(66, level, struct.pack("<IIHB", len(units) // 2, 0, shape, style))
    if units:
        out += record(67, level + 1, units + b"\r\0")
    if changes:
        out += record(68, level + 1, b"".join(struct.pack("<II", *c) for c in changes))
    return out + controls


def control(level, name, rest=b"", below=b""):
    return record(71, level, name.encode()[::-1] + rest) + below


def cell(level, row, col, row_span, col_span, paragraphs):
    return record(72, level, struct.pack("<HIHHHHH", 1, 0, 0, col, row, col_span, row_span)) + paragraphs


def char_shape(size=1000, attr=0, color=0):
    return struct.pack("<7H", *range(7)) + bytes(28) + struct.pack("<iI", size, attr) + bytes(2) + struct.pack("<4I", color, 0, 0xFFFFFF, 0)


def compound(streams, cutoff=4096):
    """The bytes of a compound file; streams maps paths to bytes."""
    tree = {"": {}}
    for path in streams:
        at = tree[""]
        *folders, name = path.strip("/").split("/")
        for f in folders:
            at = at.setdefault(f, {})
        at[name] = streams[path]
    entries, mini, mini_fat, sectors, fat = [], bytearray(), [], [], []

    def chain(raw):
        if not raw:
            return END
        first, n = len(sectors), -(-len(raw) // 512)
        sectors.extend(raw[512 * k : 512 * k + 512].ljust(512, b"\0") for k in range(n))
        fat.extend([*range(first + 1, first + n), END])
        return first

    def add(name, kind, start=END, size=0):
        entries.append({"name": name, "type": kind, "child": FREE, "right": FREE, "start": start, "size": size})
        return len(entries) - 1

    def folder(index, children):
        last = None
        for name, body in children.items():
            if isinstance(body, dict):
                own = add(name, 1)
                folder(own, body)
            elif len(body) < cutoff:
                first, n = len(mini_fat), -(-len(body) // 64)
                mini.extend(body.ljust(64 * n, b"\0"))
                mini_fat.extend([*range(first + 1, first + n), END] if n else [])
                own = add(name, 2, first if n else END, len(body))
            else:
                own = add(name, 2, chain(body), len(body))
            if last is None:
                entries[index]["child"] = own
            else:
                entries[last]["right"] = own
            last = own

    root = add("Root Entry", 5)
    folder(root, tree[""])
    entries[root]["start"], entries[root]["size"] = chain(bytes(mini)), len(mini)
    mini_start = chain(struct.pack(f"<{len(mini_fat)}I", *mini_fat)) if mini_fat else END
    raw = b""
    for e in entries:
        name = e["name"].encode("utf-16-le") + b"\0\0"
        raw += name.ljust(64, b"\0") + struct.pack("<HBBIII", len(name), e["type"], 1, FREE, e["right"], e["child"]) + bytes(36) + struct.pack("<IQ", e["start"], e["size"])
    directory = chain(raw)
    fats = 1
    while (len(fat) + fats) > fats * 128:
        fats += 1
    first = len(sectors)
    table = fat + [0xFFFFFFFD] * fats
    table += [FREE] * (fats * 128 - len(table))
    sectors.extend(struct.pack("<128I", *table[128 * k : 128 * k + 128]) for k in range(fats))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6)
    head += struct.pack("<IIIIIIIII", 0, fats, directory, 0, cutoff, mini_start, -(-len(mini_fat) // 128) if mini_fat else 0, END, 0)
    head += struct.pack("<109I", *range(first, first + fats), *[FREE] * (109 - fats))
    return head + b"".join(sectors)


def deflated(raw):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush()


def document(sections, info=b"", flags=1, version=(5, 0, 6, 0), extra=None):
    packed = deflated if flags & 1 else bytes
    streams = {"/FileHeader": file_header(version, flags), "/DocInfo": packed(info)}
    streams |= {f"/BodyText/Section{k}": packed(s) for k, s in enumerate(sections)}
    return compound(streams | (extra or {}))


def units(text):
    """A text as a paragraph's units: a tab takes eight."""
    return text.encode("utf-16-le").replace(b"\t\0", b"\t\0" + bytes(12) + b"\t\0") if "\t" in text else text.encode("utf-16-le")


def plain(level, text, changes=(), shape=0, style=0, controls=b""):
    return paragraph(level, changes=changes, shape=shape, style=style, controls=controls, raw=units(text))
