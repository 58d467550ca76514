"""Secret scans: a worklist of decoded layers, each scanned again, with spans mapped back to the text."""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import mmap
import re
import tempfile
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.ship import ship

# The kinds of secrets, in order, with their patterns and least lengths.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|\\U([0-9A-Fa-f]{8})")
# An escape of any form at the end of a text, what it can end in, and its greatest length.
ESCAPED_TOP = re.compile(r"(?:&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});|%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})"
                         r"|%u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8}))\Z")
ESCAPE_END, LONGEST_ESCAPE = frozenset("0123456789abcdefABCDEF;"), 10
# Rounds that rewrite escapes layer by layer; what is nested deeper is decoded to its fixpoint at once.
ROUNDS = 12
# A line end inside a run, also where it is spelled out.
_LINE_END = r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
_SIX, _FOUR = "[A-Za-z0-9+/_-]", "[0-9A-Fa-f]"
BASE64, HEX_BYTES = re.compile(f"({_SIX}{{16,}})={{0,2}}"), re.compile(f"({_FOUR}{{16,}})")
BASE64_WRAPPED = re.compile(f"(?<!{_SIX})({_SIX}++(?:{_LINE_END}{_SIX}++)+)={{0,2}}")
HEX_WRAPPED = re.compile(f"(?<!{_FOUR})({_FOUR}++(?:{_LINE_END}{_FOUR}++)+)")
LINE_END = re.compile(_LINE_END)
MAGIC = {b"\x1f\x8b": "gzip", b"x\x01": "zlib", b"x^": "zlib", b"x\x9c": "zlib", b"x\xda": "zlib", b"BZh": "bz2",
         b"\xfd7zXZ\x00": "xz", b"\x28\xb5\x2f\xfd": "zstd"}
MAGICS = re.compile(b"|".join(map(re.escape, MAGIC)))
ZEROS = re.compile(rb"\x00*")
# Bytes of characters without control characters but blanks, as many as the shortest secret has.
LEAST_TEXT = 12
READABLE = re.compile(
    rb"(?:[\t-\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){12,}+")
UNBROKEN, PRINTED = re.compile("[!-~]+"), re.compile("[ -~]+")
PERCENT_CHAR = re.compile("%([0-9A-Fa-f]{2})()()()")
ESCAPED_CHAR = re.compile(r"""\\(?:x([0-9A-Fa-f]{2})|u00([0-9A-Fa-f]{2})|([0-7]{1,3})|([abfnrtv\\'"]))""")
SIGNS = {b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b"\\": b"\\", b"'": b"'", b'"': b'"'}


def _of_bytes(pattern: re.Pattern) -> re.Pattern:
    return re.compile(pattern.pattern.encode())


ASSIGN_BYTES, ACCESS_BYTES, HEX_SECRET_BYTES, ESCAPE_BYTES = map(_of_bytes, (ASSIGN, ACCESS, HEX, ESCAPE))
BASE64_BYTES, BASE64_WRAPPED_BYTES, HEX_RUN_BYTES, HEX_WRAPPED_BYTES = map(_of_bytes, (BASE64, BASE64_WRAPPED, HEX_BYTES, HEX_WRAPPED))
PERCENT_BYTE, ESCAPED_BYTE, LINE_END_BYTES = map(_of_bytes, (PERCENT_CHAR, ESCAPED_CHAR, LINE_END))
# What an archive holds is kept in a file from this size on; archives are read so many bytes at a time.
PIECE, FEED = 1 << 22, 1 << 14
ARROW_ROWS = 512

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The matches in `text` itself: leftmost and non-overlapping per kind, failing ones dropped."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text and where it comes from: runs of (start, start in the root, root characters per character or None).

    A run without a fixed ratio maps each of its characters to the run's whole root range.
    """

    def __init__(self, text: str, runs: list[tuple[int, int, int, bool]], kinds: Iterable[str] = (), depth: int = 0):
        # (start here, root start, root end, one root character each)
        # `depth` is the number of rounds in a row that rewrote escapes.
        # `kinds` of secrets are in an archive: they have the whole range of the archive, and no text here.
        self.text, self.runs, self.kinds, self.depth = text, runs, frozenset(kinds), depth
        self.starts = [r[0] for r in runs]

    def root(self, start: int, end: int) -> tuple[int, int]:
        return self._place(start)[0], self._place(end - 1)[1]

    def _place(self, at: int) -> tuple[int, int]:
        here, a, b, exact = self.runs[bisect_right(self.starts, at) - 1]
        return (a + at - here, a + at - here + 1) if exact else (a, b)


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of `pattern` decoded; None if nothing changes."""
    parts, runs, at, here, changed = [], [], 0, 0, False

    def keep(a: int, b: int) -> None:
        nonlocal here
        while a < b:
            k = bisect_right(layer.starts, a) - 1
            stop = min(b, layer.starts[k + 1] if k + 1 < len(layer.starts) else b)
            lo, exact = layer._place(a)[0], layer.runs[k][3]
            runs.append((here, lo, lo + stop - a if exact else layer.runs[k][2], exact))
            parts.append(layer.text[a:stop])
            here += stop - a
            a = stop

    for m in pattern.finditer(layer.text):
        for text, a, b in decode(m):
            if text is None:
                continue
            keep(at, a)
            runs.append((here, *layer.root(a, b), False))
            parts.append(text)
            here += len(text)
            at, changed = b, True
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), runs, depth=layer.depth + 1)


def _percent(m: re.Match) -> Iterator[tuple[str | None, int, int]]:
    """The characters of a run of %XX: UTF-8 where it is valid."""
    raw, at, i = bytes.fromhex(m.group().replace("%", "")), m.start(), 0
    while i < len(raw):
        size = 1 if raw[i] < 0x80 else 2 if 0xC2 <= raw[i] < 0xE0 else 3 if 0xE0 <= raw[i] < 0xF0 else 4
        try:
            char = raw[i:i + size].decode()
        except UnicodeDecodeError:
            char, size = None, 1
        yield char, at + 3 * i, at + 3 * (i + size)
        i += size


def _escape(m: re.Match) -> Iterator[tuple[str | None, int, int]]:
    groups = m.groups()
    digits = next(g for g in groups if g is not None)
    code = int(digits, 10 if groups[3] is not None else 16)
    valid = code < 0x110000 and not 0xD800 <= code < 0xE000
    yield chr(code) if valid else None, m.start(), m.end()


def _settled(layer: Layer) -> Layer | None:
    """The layer with all escapes of ASCII characters decoded to their fixpoint, in one pass; None if nothing changes.

    Characters go onto a stack. Where its top is an escape, the character that it stands for replaces it and may end
    the next one, so every step shortens the stack: the time is linear, however deep escapes are nested.
    """
    chars: list[str] = []
    places: list[tuple[int, int, bool]] = []
    changed = False
    for at, char in enumerate(layer.text):
        here, a, b, exact = layer.runs[bisect_right(layer.starts, at) - 1]
        chars.append(char)
        places.append((a + at - here, a + at - here + 1, True) if exact else (a, b, False))
        while chars[-1] in ESCAPE_END and (m := ESCAPED_TOP.search("".join(chars[-LONGEST_ESCAPE:]))):
            digits = next(k for k, g in enumerate(m.groups()) if g is not None)
            code = int(m.group(digits + 1), 10 if digits == 0 else 16)
            if code >= 0x80:
                break
            size = len(m.group())
            start, end = places[-size][0], places[-1][1]
            del chars[-size:], places[-size:]
            chars.append(chr(code))
            places.append((start, end, False))
            changed = True
    if not changed:
        return None
    runs: list[tuple[int, int, int, bool]] = []
    for k, (a, b, exact) in enumerate(places):
        if exact and runs and runs[-1][3] and runs[-1][2] == a:
            runs[-1] = (*runs[-1][:2], b, True)
        else:
            runs.append((k, a, b, exact))
    return Layer("".join(chars), runs, depth=1)


class _Spool:
    """Bytes that are written once: in memory, or in a file of the worker's temp folder from a size of PIECE on."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.size, self.file = 0, None

    def write(self, piece: bytes) -> None:
        self.size += len(piece)
        if self.file is None:
            self.pieces.append(piece)
            if self.size > PIECE:
                self.file = tempfile.TemporaryFile()
                self.file.writelines(self.pieces)
                self.pieces = []
        else:
            self.file.write(piece)

    def held(self) -> bytes | mmap.mmap:
        if self.file is None:
            return b"".join(self.pieces)
        self.file.flush()
        with self.file:
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)


def _zlib_pieces(kind: str, raw: memoryview) -> Iterator[tuple[bytes, int]]:
    stream, at = zlib.decompressobj(47 if kind == "gzip" else 15), 0
    while at < len(raw) and not stream.eof:
        data: bytes | memoryview = raw[at:at + FEED]
        at += len(data)
        while data and not stream.eof:
            piece = stream.decompress(data, PIECE)
            data = stream.unconsumed_tail
            yield piece, 0
    if not stream.eof:
        yield stream.flush(), len(raw)
    else:
        yield b"", at - len(stream.unused_data)


def _other_pieces(kind: str, raw: memoryview) -> Iterator[tuple[bytes, int]]:
    stream, at = bz2.BZ2Decompressor() if kind == "bz2" else lzma.LZMADecompressor(memlimit=1 << 27), 0
    while not stream.eof:
        data = b""
        if stream.needs_input:
            data = raw[at:at + FEED]
            at += len(data)
            if not data:
                break
        yield stream.decompress(data, PIECE), 0
    yield b"", at - len(stream.unused_data) if stream.eof else len(raw)


def _zstd_pieces(kind: str, raw: memoryview) -> Iterator[tuple[bytes, int]]:
    import zstandard
    with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(raw, read_across_frames=True) as stream:
        while piece := stream.read(PIECE):
            yield piece, 0
    yield b"", len(raw)


def _unpack(raw: bytes | mmap.mmap | memoryview, at: int = 0) -> tuple[bytes | mmap.mmap, int]:
    """What the archive at `at` holds, with the members that follow it, and where it ends; what is broken ends the stream."""
    out, view = _Spool(), memoryview(raw)
    end = at
    while sign := MAGICS.match(view, end):
        kind, size = MAGIC[next(s for s in MAGIC if sign.group().startswith(s))], 0
        pieces = {"gzip": _zlib_pieces, "zlib": _zlib_pieces, "zstd": _zstd_pieces}.get(kind, _other_pieces)
        try:
            for piece, size in pieces(kind, view[end:]):
                out.write(piece)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            break
        except Exception as error:  # zstandard's own error class exists only where it is installed
            if kind != "zstd" or type(error).__name__ not in ("ZstdError", "ModuleNotFoundError"):
                raise
            break
        end = ZEROS.match(view, end + size).end()
    return out.held(), end


def _archives(raw: bytes | mmap.mmap) -> Iterator[tuple[bytes | mmap.mmap, int, int]]:
    """(content, start, end) of the archives in `raw`, wherever they begin."""
    at = 0
    while sign := MAGICS.search(raw, at):
        held, end = _unpack(raw, sign.start())
        if len(held):
            yield held, sign.start(), end if end > sign.start() else len(raw)
        at = max(end, sign.start() + 1)


def _decoded(raw: bytes | mmap.mmap, start: int, end: int, least: int, shift: int, decode) -> bytes | mmap.mmap:
    """The bytes of a base64 or hex run from its digit `shift` on: `least` digits are decoded together."""
    out, rest, skip = _Spool(), b"", shift
    ends = [(m.start(), m.end()) for m in LINE_END_BYTES.finditer(raw, start, end)]
    lines = zip([start, *(b for _, b in ends)], [*(a for a, _ in ends), end])
    for digits in (raw[at:min(b, at + PIECE)] for a, b in lines for at in range(a, b, PIECE)):
        digits, skip = digits[skip:], max(0, skip - len(digits))
        digits = rest + digits
        cut = len(digits) // least * least
        out.write(decode(digits[:cut]))
        rest = digits[cut:]
    if least == 4 and len(rest) > 1:
        out.write(decode(rest + b"=" * (4 - len(rest))))
    return out.held()


def _rewritten_bytes(raw: bytes | mmap.mmap, pattern: re.Pattern, decode, literal=None) -> bytes | mmap.mmap | None:
    """`raw` with the matches of `pattern` decoded; None if there are none."""
    out, at = _Spool(), 0
    for m in pattern.finditer(raw):
        between = raw[at:m.start()]
        out.write(literal(between) if literal else between)
        out.write(decode(m))
        at = m.end()
    if not at:
        return None
    for k in range(at, len(raw), PIECE):
        out.write(literal(raw[k:k + PIECE]) if literal else raw[k:k + PIECE])
    return out.held()


def _byte(m: re.Match) -> bytes:
    """The byte that %XX or a backslash escape stands for."""
    digits = m.group(1) or m.group(2)
    if digits:
        return bytes.fromhex((digits if isinstance(digits, str) else digits.decode()))
    if m.group(3):
        return bytes([int(m.group(3), 8) & 255])
    sign = m.group(4)
    return SIGNS[sign.encode() if isinstance(sign, str) else sign]


def _character(m: re.Match) -> bytes:
    code = int(next(g for g in m.groups() if g is not None), 10 if m.group(4) is not None else 16)
    return chr(code).encode() if code < 0x110000 and not 0xD800 <= code < 0xE000 else m.group()


def _below(raw: bytes | mmap.mmap) -> Iterator[bytes | mmap.mmap]:
    """What bytes hold in turn: archives, rewritten escapes, and the content of base64 and hex runs."""
    for held, _, _ in _archives(raw):
        yield held
    if raw.find(b"%") >= 0:
        yield _rewritten_bytes(raw, PERCENT_BYTE, _byte)
        if raw.find(b"+") >= 0:
            yield _rewritten_bytes(raw, PERCENT_BYTE, _byte, lambda b: b.replace(b"+", b" "))
    if raw.find(b"\\") >= 0:
        yield _rewritten_bytes(raw, ESCAPED_BYTE, _byte)
    if raw.find(b"\\") >= 0 or raw.find(b"&#") >= 0 or raw.find(b"%u") >= 0:
        yield _rewritten_bytes(raw, ESCAPE_BYTES, _character)
    for patterns, least, decode in (((BASE64_BYTES, BASE64_WRAPPED_BYTES), 4, _sixes), ((HEX_RUN_BYTES, HEX_WRAPPED_BYTES), 2, _pairs)):
        for pattern in patterns:
            for m in pattern.finditer(raw):
                for shift in range(least):
                    yield _decoded(raw, m.start(1), m.end(1), least, shift, decode)


def _sixes(digits: bytes) -> bytes:
    return base64.b64decode(digits.translate(_STANDARD_BYTES))


def _pairs(digits: bytes) -> bytes:
    return bytes.fromhex(digits.decode())


def kinds_in(raw: bytes | mmap.mmap) -> set[str]:
    """The kinds of secrets in the content of an archive and in all layers below it. It is looked at whole, in no pieces."""
    found: set[str] = set()
    work, seen = [raw], set()
    while work and len(found) < len(KINDS):
        raw = work.pop()
        mark = blake2b(raw, digest_size=16).digest()
        if mark in seen:
            continue
        seen.add(mark)
        if any(len(m.group(2)) >= LEAST_VALUE for m in ASSIGN_BYTES.finditer(raw)):
            found.add("assign")
        if any(m.end() - m.start() >= LEAST_ACCESS for m in ACCESS_BYTES.finditer(raw)):
            found.add("access")
        if HEX_SECRET_BYTES.search(raw):
            found.add("hex")
        work += [b for b in _below(raw) if b is not None and (len(b) >= LEAST_TEXT)]
    return found


def _from_bytes(raw: bytes, place, last: int) -> Iterator[Layer]:
    """The layers that decoded bytes hold: archives wherever they begin, and readable text between other bytes.

    `place(i, j)` maps a byte range to the root; `last` is where the root's range of all bytes ends.
    """
    for held, start, end in _archives(raw):
        a, b = place(start, end)
        kinds = kinds_in(held)
        if kinds:
            yield Layer(" ", [(0, a, last if end == len(raw) else b, False)], kinds)
    for m in READABLE.finditer(raw):
        runs, at = [], m.start()
        text = m.group().decode()
        for k, char in enumerate(text):
            size = len(char.encode())
            runs.append((k, *place(at, at + size), False))
            at += size
        yield Layer(text, runs)


def _digits(text: str, start: int, end: int) -> tuple[str, list[int] | range]:
    """A run without its line ends, and the place of each digit."""
    run = text[start:end]
    if not LINE_END.search(run):
        return run, range(start, end)
    places, at = [], start
    for m in LINE_END.finditer(text, start, end):
        places += range(at, m.start())
        at = m.end()
    places += range(at, end)
    return LINE_END.sub("", run), places


def _blobs(layer: Layer) -> Iterator[Layer]:
    """The layers behind base64 and hex runs of a layer, alone and joined over line ends, from each digit that can be the first."""
    for pattern in (BASE64, BASE64_WRAPPED):
        for m in pattern.finditer(layer.text):
            whole, places = _digits(layer.text, m.start(1), m.end(1))
            if len(whole) < 16 or whole.isalpha() and (whole.islower() or whole[1:].islower()):
                continue  # a long word; no text or archive of 12 bytes encodes to one case
            for shift in range(4):
                run = whole[shift:]
                run = run[:len(run) - (len(run) % 4 == 1)].translate(_STANDARD)
                raw = base64.b64decode(run + "=" * (-len(run) % 4))

                def place(i: int, j: int, shift=shift, n=len(run), places=places) -> tuple[int, int]:
                    first, last = shift + i * 8 // 6, shift + min(n, -(-j * 8 // 6)) - 1
                    return layer.root(places[first], places[last] + 1)

                yield from _from_bytes(raw, place, layer.root(m.end() - 1, m.end())[1])
    for pattern in (HEX_BYTES, HEX_WRAPPED):
        for m in pattern.finditer(layer.text):
            whole, places = _digits(layer.text, m.start(1), m.end(1))
            for shift in range(2 if len(whole) >= 16 else 0):
                run = whole[shift:]
                run = run[:len(run) // 2 * 2]

                def place(i: int, j: int, shift=shift, places=places) -> tuple[int, int]:
                    return layer.root(places[shift + 2 * i], places[shift + 2 * j - 1] + 1)

                yield from _from_bytes(bytes.fromhex(run), place, layer.root(places[shift + len(run) - 1], places[shift + len(run) - 1] + 1)[1])


def _escaped_archives(layer: Layer) -> Iterator[Layer]:
    """The archives whose bytes are written as %XX or as backslash escapes, with plain characters between."""
    for runs, sign, pattern in ((UNBROKEN, "%", PERCENT_CHAR), (PRINTED, "\\", ESCAPED_CHAR)):
        if sign not in layer.text:
            continue
        for m in runs.finditer(layer.text):
            if sign not in m.group():
                continue
            for text in {m.group(), m.group().replace("+", " ") if sign == "%" else m.group()}:
                parts, here, there, at, size = [], [0], [0], 0, 0
                for e in pattern.finditer(text):
                    parts += [text[at:e.start()].encode(), _byte(e)]
                    size += e.start() - at
                    here += [size, size + 1]
                    there += [e.start(), e.end()]
                    at, size = e.end(), size + 1
                if len(here) == 1:
                    continue
                raw = b"".join([*parts, text[at:].encode()])

                def root_of(k: int) -> int:
                    i = bisect_right(here, k) - 1
                    return m.start() + there[i] + k - here[i]

                for held, start, end in _archives(raw):
                    kinds = kinds_in(held)
                    if kinds:
                        yield Layer(" ", [(0, *layer.root(root_of(start), root_of(end - 1) + 1), False)], kinds)


_STANDARD = str.maketrans("-_", "+/")
_STANDARD_BYTES = bytes.maketrans(b"-_", b"+/")


def layers(text: str) -> Iterator[Layer]:
    """Every layer below `text`, until nothing new is found. A layer that was seen at the same place is not opened again."""
    work = [Layer(text, [(0, 0, len(text), True)])] if text else []
    seen: set[bytes] = set()
    while work:
        layer = work.pop()
        found: list[Layer] = []
        settled = _settled(layer) if layer.depth >= ROUNDS else None
        if settled:
            found.append(settled)
        else:
            if "%" in layer.text:
                found += filter(None, [_rewritten(layer, PERCENT, _percent)])
            if "\\" in layer.text or "&#" in layer.text or "%u" in layer.text:
                found += filter(None, [_rewritten(layer, ESCAPE, _escape)])
        found += _blobs(layer)
        found += _escaped_archives(layer)
        for new in found:
            mark = blake2b(new.text.encode("utf-8", "surrogatepass"), digest_size=16)
            mark.update(repr((new.root(0, len(new.text)), sorted(new.kinds))).encode())
            if mark.digest() not in seen:
                seen.add(mark.digest())
                work.append(new)
                yield new


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans with those of decoded layers; by start, kind and end."""
    def order(span: Span) -> tuple[int, int, int]:
        return span[1], KINDS.index(span[0]), span[2]

    base = base_spans(text)
    everything = set(base)
    for layer in layers(text):
        for kind, start, end in base_spans(layer.text):
            everything.add((kind, *layer.root(start, end)))
        everything.update((kind, *layer.root(0, 1)) for kind in layer.kinds)
    return sorted(base, key=order), sorted(everything, key=order)


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_secrets(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """`docs` with `base` (secrets of the text itself) and `spans` (those and the ones in decoded layers).

    A span is (kind, start, end) in code points of the text, end exclusive. A worklist unwraps percent-encoding, Unicode escapes,
    character references, base64, hex and compressed data, nested as they come, until no new layer is found; each
    layer is scanned as the text is. Base64 and hex runs are read alone and joined over line ends, and from each digit that can be
    the first; archives are followed wherever they begin, to their last member, and what they hold is looked at whole (from 4 MiB on
    in a file of the worker's temp folder). A span in a layer is mapped to the characters that encode it, and to the whole run for
    compressed data. Layers are remembered by content and place, so cycles end. Escapes nested over ROUNDS deep are decoded to
    their fixpoint in one pass, without the layers between.

    NULL and empty texts have none. Repeated rows come out alike. An empty table gives none. Columns named as an added one are replaced.
    """
    spark = ship(docs.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    read = docs.drop("base", "spans")
    names = read.columns
    kept = [c for c in names if keep_text or c != "text"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [secret_spans(t or "") for t in batch.column(names.index("text")).to_pylist()]
            base, spans = ([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(names.index(c)) for c in kept), pa.array(base, kind), pa.array(spans, kind)], [*kept, "base", "spans"])

    fields = [read.schema[names.index(c)] for c in kept]
    return read.mapInArrow(run, T.StructType([*fields, T.StructField("base", SPANS), T.StructField("spans", SPANS)]))


def spelled(spans: str) -> Column:
    """The spans of a column as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def number_of(spans: str, kind: str) -> Column:
    """How many spans of a column are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
