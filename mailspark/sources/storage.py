"""Files as tasks see them: any file system Arrow can open, and the codecs of
compressed archives as streams."""

import bisect
import fnmatch
import gzip
import io
import lzma
import posixpath
import re
import struct
import zlib

from pyarrow import fs

from mailspark.functions.columns import CODECS


def resolve(path):
    """(file system, path in it)."""
    if re.match(r"^[a-z][a-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:", "", path)


def codec_of(path):
    for suffix, codec in CODECS.items():
        if path.lower().endswith(suffix):
            return codec
    return None


def _with_scheme(path, inner):
    scheme = re.match(r"^([a-z][a-z0-9+.-]*://)", path)
    return inner if not scheme or scheme[1] == "file://" else scheme[1] + inner


def list_files(path):
    """[(path, size)] of a file, a folder or a glob pattern, by name. A folder
    gives all files below it. In a pattern, ``*``, ``?`` and ``[]`` stand for
    characters of one path segment. Hidden and bookkeeping files, and files in
    such folders, are left out: they may be half written."""
    system, inner = resolve(path)
    if any(ch in inner for ch in "*?["):
        found = _matching(system, inner)
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(_with_scheme(path, info.path), info.size)]
        found = [] if info.type == fs.FileType.NotFound else _below(system, inner)
    return sorted((_with_scheme(path, info.path), info.size) for info in found)


def _hidden(name):
    return name[:1] in ("", ".", "_")


def _below(system, base):
    selector = fs.FileSelector(base, allow_not_found=True, recursive=True)
    return [info for info in system.get_file_info(selector)
            if info.type == fs.FileType.File
            and not any(map(_hidden, posixpath.relpath(info.path, base).split("/")))]


def _matching(system, pattern):
    """Files that a pattern names, segment by segment: only folders that match
    so far are listed."""
    segments = pattern.split("/")
    fixed = next(i for i, s in enumerate(segments) if any(ch in s for ch in "*?["))
    folders = ["/".join(segments[:fixed]) or ("/" if pattern.startswith("/") else ".")]
    for i, segment in enumerate(segments[fixed:], fixed):
        kind = fs.FileType.File if i == len(segments) - 1 else fs.FileType.Directory
        entries = [info for folder in folders
                   for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True))]
        found = [info for info in entries if info.type == kind and not _hidden(info.base_name)
                 and fnmatch.fnmatchcase(info.base_name, segment)]
        folders = [info.path for info in found]
    return found


def list_folders(path):
    """Names of the folders right below a path."""
    system, inner = resolve(path)
    selector = fs.FileSelector(inner, allow_not_found=True)
    return sorted(info.base_name for info in system.get_file_info(selector)
                  if info.type == fs.FileType.Directory)


def exists(path):
    system, inner = resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def delete(path):
    system, inner = resolve(path)
    system.delete_file(inner)


def file_size(path):
    system, inner = resolve(path)
    return system.get_file_info(inner).size


def open_random(path):
    system, inner = resolve(path)
    return system.open_input_file(inner)


def open_decoded(path, codec=None):
    """Byte stream of the uncompressed content."""
    system, inner = resolve(path)
    raw = system.open_input_stream(inner, compression=None)
    return decoder(raw, codec or codec_of(path))


def decoder(raw, codec):
    if codec is None:
        return raw
    if codec == "gzip":
        return gzip.GzipFile(fileobj=io.BufferedReader(raw), mode="rb")
    if codec == "lzma":
        return lzma.LZMAFile(raw, "rb")
    import zstandard

    return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)


def compress_bytes(data, codec):
    """One complete frame; frames may be joined to one file."""
    if codec == "gzip":
        return _sized_member(data)
    if codec == "lzma":
        return lzma.compress(data)
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


# A zstd file of many frames may end in a table of their sizes, kept in a frame
# that decoders skip (the format is public: "zstd seekable format"). With it a
# reader can enter the file at any frame.

# Magic numbers of the skippable frame and of the table's end.
SKIPPABLE, TABLE_END = 0x184D2A5E, 0x8F92EAB1
_FOOTER, _ENTRY = "<IBI", "<II"


def seek_table_bytes(frames):
    """The table for frames given as (compressed, uncompressed) sizes."""
    body = b"".join(struct.pack(_ENTRY, *f) for f in frames) + struct.pack(_FOOTER, len(frames), 0, TABLE_END)
    return struct.pack(_ENTRY, SKIPPABLE, len(body)) + body


def seek_table(path):
    """([compressed start], [uncompressed start], uncompressed size, [length])
    of the frames of a compressed file that tells them: a zstd file with a
    table, an xz file by the indexes of its streams, a gzip file whose members
    carry their sizes. None for others. Lengths are of xz blocks only."""
    tables = {"zstd": _zstd_table, "lzma": _xz_table, "gzip": _gzip_table}
    read = tables.get(codec_of(path))
    if read is None:
        return None
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        return read(f, f.size())


def append_frames(path, out):
    """Copies the frames of a compressed file to the end of an open one. Of a
    zstd file with a table it leaves out the table, and gives the frames'
    (compressed, uncompressed) sizes."""
    table = seek_table(path) if codec_of(path) == "zstd" else None
    with open_random(path) as f:
        left, frames = f.size(), []
        if table is not None:
            packed, plain, whole, _ = table
            left -= len(seek_table_bytes([(0, 0)] * len(packed)))
            frames = [(b - a, d - c) for a, b, c, d in zip(
                packed, [*packed[1:], left], plain, [*plain[1:], whole])]
        while left > 0:
            data = f.read(min(1 << 20, left))
            if not data:
                raise EOFError(f"{path} ends early")
            out.write(data)
            left -= len(data)
    return frames


def _at(f, offset, size):
    f.seek(offset)
    return f.read(size)


def _zstd_table(f, size):
    if size < struct.calcsize(_FOOTER):
        return None
    count, flags, end = struct.unpack(_FOOTER, _at(f, size - struct.calcsize(_FOOTER), struct.calcsize(_FOOTER)))
    entry = struct.calcsize(_ENTRY) + (4 if flags & 0x80 else 0)
    length = count * entry + struct.calcsize(_FOOTER)
    if end != TABLE_END or flags & 0x7F or length + struct.calcsize(_ENTRY) > size:
        return None
    head = _at(f, size - length - struct.calcsize(_ENTRY), struct.calcsize(_ENTRY))
    if struct.unpack(_ENTRY, head) != (SKIPPABLE, length):
        return None
    table = f.read(count * entry)
    return _summed([struct.unpack_from(_ENTRY, table, i * entry) for i in range(count)])


def _summed(frames, at=0):
    """Frames given as (compressed, uncompressed) sizes, one after another."""
    packed, plain, offset = [], [], 0
    for c, u in frames:
        packed.append(at)
        plain.append(offset)
        at, offset = at + c, offset + u
    return packed, plain, offset, None


# An xz file is a row of streams. A stream is a header, blocks, an index of the
# blocks' sizes and a footer that tells the index's size (the format is
# public). A block can be decoded by itself behind the header of its stream.

# Magic bytes of a stream's header and footer.
XZ_START, XZ_END = b"\xfd7zXZ\0", b"YZ"
_EDGE = 12


def _number(data, at):
    """(value, next position) of a number in seven-bit groups, low ones
    first."""
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def _xz_table(f, size):
    """Read from the end, as the footers are found there. Besides the starts
    it keeps the length of each block and the header of its stream."""
    streams, end = [], size
    while end > 0:
        if end >= 4 and _at(f, end - 4, 4) == b"\0\0\0\0":
            end -= 4
            continue
        if end < 2 * _EDGE:
            return None
        footer = _at(f, end - _EDGE, _EDGE)
        length = 4 * (struct.unpack_from("<I", footer, 4)[0] + 1)
        if footer[-2:] != XZ_END or length + 2 * _EDGE > end:
            return None
        index = _at(f, end - _EDGE - length, length)
        if struct.unpack("<I", index[-4:])[0] != zlib.crc32(index[:-4]) or index[0]:
            return None
        count, at = _number(index, 1)
        sizes = []
        for _ in range(count):
            unpadded, at = _number(index, at)
            plain, at = _number(index, at)
            sizes.append((unpadded, plain))
        start = end - 2 * _EDGE - length - sum(-(-c // 4) * 4 for c, _ in sizes)
        header = _at(f, start, _EDGE) if start >= 0 else b""
        if not header.startswith(XZ_START):
            return None
        streams.append((start, header, sizes))
        end = start
    packed, plain, offset, blocks = [], [], 0, []
    for start, header, sizes in reversed(streams):
        starts, _, _, _ = _summed([(-(-c // 4) * 4, u) for c, u in sizes], start + _EDGE)
        for at, (length, u) in zip(starts, sizes):
            packed.append(at)
            plain.append(offset)
            blocks.append((header, length))
            offset += u
    return packed, plain, offset, blocks


class _XzBlocks(io.RawIOBase):
    """Content of the blocks of an xz file from one of them on."""

    def __init__(self, raw, table, block):
        self.raw, self.table, self.block = raw, table, block
        self.decoder, self.left = None, 0

    def readable(self):
        return True

    def readinto(self, buffer):
        packed, _, _, blocks = self.table
        while True:
            if self.decoder is None:
                if self.block >= len(packed):
                    return 0
                header, self.left = blocks[self.block]
                self.raw.seek(packed[self.block])
                self.decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
                self.decoder.decompress(header)
                self.block += 1
            fed = b""
            if self.decoder.needs_input and self.left:
                fed = self.raw.read(min(1 << 16, self.left))
                if not fed:
                    raise EOFError("the xz file ends inside a block")
                self.left -= len(fed)
            out = self.decoder.decompress(fed, len(buffer))
            if out:
                buffer[:len(out)] = out
                return len(out)
            if not self.left and self.decoder.needs_input:
                self.decoder = None

    def close(self):
        self.raw.close()
        super().close()


# A gzip file is a row of members, whose headers may carry fields of any kind.
# Members made here carry their sizes, so that a reader can go from one to the
# next; to other readers they are ordinary members.

# Start of a member with an extra field, and the field's name.
GZIP_START, GZIP_SIZES = b"\x1f\x8b\x08\x04", b"MS"
_SIZED = "<4sIBBH2sHQQ"


def _sized_member(data):
    """A gzip member of the data that carries both its sizes."""
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = struct.calcsize(_SIZED) + len(body) + 8
    return (struct.pack(_SIZED, GZIP_START, 0, 2, 255, 20, GZIP_SIZES, 16, total, len(data))
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def _gzip_table(f, size):
    frames, at = [], 0
    while at < size:
        head = _at(f, at, struct.calcsize(_SIZED))
        if len(head) < struct.calcsize(_SIZED):
            return None
        start, _, _, _, extra, name, _, total, plain = struct.unpack(_SIZED, head)
        if (start, extra, name) != (GZIP_START, 20, GZIP_SIZES) or total < len(head):
            return None
        frames.append((total, plain))
        at += total
    return _summed(frames) if at == size else None


CHUNK = 1 << 20


def gzip_members(path, start, end):
    """(compressed start, uncompressed size) of the members of any gzip file
    that start in a range of it. What looks like a start is one if it can be
    decoded up to the member's checksum."""
    system, inner = resolve(path)
    with system.open_input_file(inner) as f:
        at = start
        while at < end:
            held = _at(f, at, CHUNK + 3)
            hit = held.find(GZIP_START[:3])
            if hit < 0 or at + hit >= end:
                at += CHUNK
                continue
            at += hit
            found = _member(f, at)
            if found is None:
                at += 1
            else:
                yield at, found[1]
                at += found[0]


def _member(f, at):
    """(compressed, uncompressed) size of the member at a place, or None."""
    f.seek(at)
    decoder, packed, plain = zlib.decompressobj(31), 0, 0
    try:
        while not decoder.eof:
            fed = decoder.unconsumed_tail
            if not fed:
                fed = f.read(1 << 16)
                packed += len(fed)
                if not fed:
                    return None
            plain += len(decoder.decompress(fed, CHUNK))
    except zlib.error:
        return None
    return packed - len(decoder.unused_data), plain


def open_at(path, offset, table):
    """Byte stream of the uncompressed content from ``offset`` on."""
    packed, plain, _, blocks = table
    frame = max(bisect.bisect_right(plain, offset) - 1, 0)
    system, inner = resolve(path)
    raw = system.open_input_file(inner)
    if blocks is not None:
        stream = io.BufferedReader(_XzBlocks(raw, table, frame), 1 << 20)
    else:
        if packed:
            raw.seek(packed[frame])
        stream = decoder(raw, codec_of(path))
    left = offset - (plain[frame] if plain else 0)
    while left > 0:
        skipped = stream.read(min(1 << 20, left))
        if not skipped:
            break
        left -= len(skipped)
    return stream


class Published:
    """A file written under a name of its own and moved into place when it is
    complete, so a repeated attempt replaces it whole."""

    def __init__(self, path, attempt):
        self.path = path
        self.system, inner = resolve(path)
        folder, name = posixpath.split(inner)
        self.final, self.partial = inner, f"{folder}/.{name}.{attempt}"
        self.system.create_dir(folder, recursive=True)
        self.file = self.system.open_output_stream(self.partial, compression=None)

    def write(self, data):
        self.file.write(data)

    def publish(self):
        self.file.close()
        self.system.move(self.partial, self.final)

    def drop(self):
        """Removes what a failed attempt has written."""
        self.file.close()
        self.system.delete_file(self.partial)
