"""Secrets in texts, also under nested URL, Unicode, base64 and compressed encodings.

A worklist holds the layers of a document, the text itself first. Each layer is scanned; every
encoded part of it that decodes to text is a new layer, until no layer gives another. A layer is not
entered again where the same content stood for the same stretch of the text before, which ends cycles; the same
content elsewhere in the text is entered for each place. Every layer carries a map from its
characters to code points of the text, through which spans found in it are reported.

Escapes (`%41`, `\\u0041`, `\\x41`, `&#65;`) are decoded over a whole layer, so that a secret may be
partly escaped. Base64 runs of 16 and more characters, also over line breaks, become layers of their own, in each of
the four alignments, since other characters may be glued on before; their bytes are
decompressed (gzip, zlib, bzip2, xz, zstandard; nested too, several members in a row, and each of the parts that stand
between other bytes) and are read as UTF-8, UTF-16 or else Latin-1; bytes beside compressed parts are read
with them. Every layer is scanned; one that does not read as text counts as a layer only if it holds a span. What
decompression yields maps to the whole base64 run.

Bounds: a part that would decompress to more than LAYER_BYTES, or past TOTAL_BYTES for a document, is
left closed and counted in n_unopened; such parts are decompression bombs.

Edge cases: null is the empty text; repeated rows are scanned each; an empty table gives no rows; a very long text is scanned whole,
in time that grows with its length; a lone surrogate escape stays as it is; the same kind, start and
end found in several layers is one span.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces

KINDS = ("assign", "access", "hex")
LAYER_BYTES, TOTAL_BYTES = 64 << 20, 256 << 20
FEED_BYTES = 1 << 16  # of compressed bytes at a time
MOST_CONTROLS = 0.1  # of the characters of a layer that counts as text; others are scanned, but count if they hold a span
VALUE_LENGTH, ACCESS_LENGTH, HEX_LENGTH, RUN_LENGTH = 8, 16, 32, 16

_KEYS = "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""(?:{_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}")  # a longest run: what is shorter fails as a whole
HEX = re.compile(rf"[0-9a-f]{{{HEX_LENGTH},}}")
# Each way begins with a plain character, by which a search skips what cannot begin an escape.
ESCAPE = re.compile(
    r"%[0-9A-Fa-f]{2}(?:%[0-9A-Fa-f]{2})*|\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|\\U[0-9A-Fa-f]{8}"
    r"|\\x[0-9A-Fa-f]{2}(?:\\x[0-9A-Fa-f]{2})*|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
)
RUN = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}={{0,2}}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{RUN_LENGTH},}}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={{0,2}}")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")
# The same as conditions for a whole column: a text without them has neither spans nor layers.
ANY_PLAIN = rf"""(?:{_KEYS})["']?\x20*[:=]|AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4}}}|[0-9a-f]{{{HEX_LENGTH}}}|%[0-9A-Fa-f]{{2}}|\\[uUx][0-9A-Fa-f]{{2}}|&#"""
ANY_RUN = rf"[A-Za-z0-9+/_-]{{{RUN_LENGTH}}}"

Span = tuple[str, int, int]


def plain_spans(text: str) -> list[Span]:
    """The base spans of one layer, by start and kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= VALUE_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=_by_start)


def _by_start(span: Span) -> tuple:
    return span[1], KINDS.index(span[0]), span[2]


def unescape(text: str) -> tuple[str, np.ndarray, np.ndarray] | None:
    """(decoded, starts, ends): character i comes from text[starts[i]:ends[i]]. None if nothing decodes."""
    parts, starts, ends, at = [], [], [], 0
    for m in ESCAPE.finditer(text):
        raw, begin = m[0], m.start()
        if raw[0] == "%" or raw[1] == "x":
            step = 3 if raw[0] == "%" else 4
            chars = bytes.fromhex(raw.replace("%", "").replace("\\x", "")).decode("utf-8", "surrogateescape")
            decoded, widths, done = [], [], 0
            for c in chars:
                wrong = 0xDC80 <= ord(c) <= 0xDCFF
                width = step if wrong else len(c.encode()) * step
                if wrong and step == 3:  # a byte that is no UTF-8 stays as it is
                    decoded.append(raw[done : done + 3])
                    widths += [1, 1, 1]
                else:
                    decoded.append(chr(ord(c) - 0xDC00) if wrong else c)
                    widths.append(width)
                done += width
            out = "".join(decoded)
        elif raw[1] == "u":
            decoded, widths, done = [], [], 0
            for c in bytes.fromhex(raw.replace("\\u", "")).decode("utf-16-be", "surrogatepass"):
                width = 12 if ord(c) > 0xFFFF else 6
                lone = 0xD800 <= ord(c) < 0xE000
                decoded.append(raw[done : done + 6] if lone else c)
                widths += [1] * 6 if lone else [width]
                done += width
            out = "".join(decoded)
        else:
            point = int(raw[2:], 16) if raw[1] == "U" else int(raw[3:-1], 16) if raw[2] in "xX" else int(raw[2:-1])
            if point > 0x10FFFF or 0xD800 <= point < 0xE000:
                continue
            out, widths = chr(point), [len(raw)]
        parts += [text[at:begin], out]
        edges = begin + np.concatenate(([0], np.cumsum(widths)))
        starts += [np.arange(at, begin), edges[:-1]]
        ends += [np.arange(at + 1, begin + 1), edges[1:]]
        at = m.end()
    if not parts:
        return None
    parts.append(text[at:])
    starts.append(np.arange(at, len(text)))
    ends.append(np.arange(at + 1, len(text) + 1))
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


class TooLarge(Exception):
    """A part would decompress beyond the bound."""


def _grown(parts: list[bytes], most: int) -> int:
    size = sum(map(len, parts))
    if size > most:
        raise TooLarge
    return size


def _member(data: memoryview, most: int) -> tuple[bytes, int | None] | None:
    """(content, bytes read) of the compressed member that data begins with; None if there is none.

    The bytes read are None if the member does not end. Raises TooLarge beyond `most` bytes.
    """
    head = bytes(data[:6])
    try:
        if head[:4] == b"\x28\xb5\x2f\xfd":
            with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=False) as reader:
                _grown([reader.read(most + 1)], most)
            tool, bounded = zstandard.ZstdDecompressor().decompressobj(), False  # of a size known by now
        elif head[:2] == b"\x1f\x8b":
            tool, bounded = zlib.decompressobj(31), True
        elif head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
            tool, bounded = zlib.decompressobj(), True
        elif head[:3] == b"BZh":
            tool, bounded = bz2.BZ2Decompressor(), True
        elif head == b"\xfd7zXZ\x00":
            tool, bounded = lzma.LZMADecompressor(), True
        else:
            return None
        parts: list[bytes] = []
        for at in range(0, len(data), FEED_BYTES):
            feed = bytes(data[at : at + FEED_BYTES])
            while True:
                left = most + 1 - _grown(parts, most)
                parts.append(tool.decompress(feed, left) if bounded else tool.decompress(feed))
                feed = getattr(tool, "unconsumed_tail", b"")
                if tool.eof or not (feed or not getattr(tool, "needs_input", True)):
                    break
            if tool.eof:
                _grown(parts, most)
                return b"".join(parts), min(at + FEED_BYTES, len(data)) - len(tool.unused_data)
            parts = [b"".join(parts)]
        _grown(parts, most)
        return b"".join(parts), None
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
        return None


def _inflated(data: memoryview, most: int) -> tuple[bytes, int | None] | None:
    """As `_member`, of all members in a row, with zeros between them."""
    parts, size, at, end = [], 0, 0, None
    while (member := _member(data[at:], most - size)) is not None:
        parts.append(member[0])
        size += len(member[0])
        end = None if member[1] is None else at + member[1]
        if end is None:
            break
        at = end
        while at < len(data) and data[at] == 0:
            at += 1
    return (b"".join(parts), end) if parts else None


def inflate(data: bytes, most: int) -> bytes | None:
    """One layer of compression removed, of all members in a row; None if there is none. Raises TooLarge beyond `most` bytes."""
    found = _inflated(memoryview(data), most)
    return found and found[0]


def compressed_parts(data: bytes, most: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(begin, end, content) of each compressed part between other bytes; the content is None beyond `most` bytes in all."""
    view, past = memoryview(data), 0
    for begin in chain([0], (m.start() for m in MAGIC.finditer(data, 1))):
        if begin < past:
            continue
        try:
            found = _inflated(view[begin:], most)
        except TooLarge:
            yield begin, len(data), None
            continue
        if found is not None:
            most -= len(found[0])
            past = begin if found[1] is None else begin + found[1]
            yield begin, len(data) if found[1] is None else past, found[0]


def runs(layer: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """(base64 characters, their places, end with padding): runs that go on over line breaks, then single runs."""
    for m in WRAPPED.finditer(layer):
        lines = [(m.start() + x.start(), x[0]) for x in LINE.finditer(m[0])]
        firsts = [0] if len(lines[0][1]) == len(lines[1][1]) or len(lines) == 2 else [0, 1]  # a line glued on before
        for first in firsts:
            yield "".join(x for _, x in lines[first:]), np.concatenate([np.arange(at, at + len(x)) for at, x in lines[first:]]), m.end()
    for m in RUN.finditer(layer):
        body = m[0].rstrip("=")
        yield body, np.arange(m.start(), m.start() + len(body)), m.end()


def base64_bytes(body: str) -> bytes:
    """What base64 characters without padding stand for; one character over is left out."""
    body = body.translate({ord("-"): "+", ord("_"): "/"})
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def readable(data: bytes) -> tuple[str, np.ndarray, int, bool]:
    """(text, bytes of each character, bytes before them, whether it reads as text): UTF-16, UTF-8 or else Latin-1."""
    low, high = data[1::2].count(0), data[::2].count(0)
    coding = "utf-16-le" if data[:2] == b"\xff\xfe" or 4 * low > len(data) else "utf-16-be" if data[:2] == b"\xfe\xff" or 4 * high > len(data) else "utf-8"
    skip = 2 if data[:2] in (b"\xff\xfe", b"\xfe\xff") and coding != "utf-8" else 0
    try:
        text, known = data[skip:].decode(coding), True
    except UnicodeDecodeError:
        text, coding, skip, known = data.decode("latin-1"), "latin-1", 0, False
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if coding == "utf-8":
        sizes = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    else:
        sizes = np.ones(len(points), np.int64) if coding == "latin-1" else 2 + 2 * (points > 0xFFFF).astype(np.int64)
    controls = ((points < 0x20) & ~np.isin(points, [0x09, 0x0A, 0x0C, 0x0D, 0x1B])) | ((points > 0x7E) & (points < 0xA0))
    return text, sizes, skip, known and int(controls.sum()) <= MOST_CONTROLS * len(text)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def scan(text: str) -> tuple[list[Span], list[tuple[str, Span]], int, int]:
    """(base spans, (path, span) found in layers, layers opened, parts left closed) of one text."""
    base = plain_spans(text)
    inner: list[tuple[str, Span]] = []
    seen = {(_digest(text.encode()), 0, len(text))}
    work: list[tuple[str, str, np.ndarray | None, np.ndarray | None, bool]] = [(text, "", None, None, True)]
    opened = closed = total = 0
    shut: set[bytes] = set()
    while work:
        layer, path, lows, highs, clean = work.pop()

        def root(begin: int, end: int, lows=lows, highs=highs) -> tuple[int, int]:
            return (begin, end) if lows is None else (int(lows[begin]), int(highs[end - 1]))

        if path:
            spans = plain_spans(layer)
            opened += clean or bool(spans)
            inner += [(path, (kind, *root(begin, end))) for kind, begin, end in spans]
        found: list[tuple[str, str, np.ndarray, np.ndarray, bool]] = []
        if any(mark in layer for mark in ("%", "\\", "&#")) and (out := unescape(layer)):
            decoded, begins, ends = out
            if lows is not None:
                begins, ends = lows[begins], highs[ends - 1]
            found.append((decoded, "escape", begins, ends, clean))
        for body, places, stop in runs(layer):
            begin, end = root(int(places[0]), stop)
            for turn in range(4):  # a run may have characters glued on before it
                queue, inside = [(base64_bytes(body[turn:]), "base64")], set()
                while queue:
                    data, name = queue.pop()
                    outside = len(data)
                    for low, high, out in compressed_parts(data, min(LAYER_BYTES, TOTAL_BYTES - total)):
                        if out is None:
                            mark = _digest(data)
                            closed += mark not in shut
                            shut.add(mark)
                            outside = 0 if low == 0 else outside
                            continue
                        total += len(out)
                        outside -= high - low
                        if (mark := _digest(out)) not in inside:
                            inside.add(mark)
                            queue.append((out, f"{name}/inflate"))
                    if outside <= 0:  # nothing beside the compressed parts
                        continue
                    decoded, sizes, skip, reads = readable(data)
                    if not decoded:
                        continue
                    if name == "base64":
                        after = skip + np.cumsum(sizes)
                        first = places[turn + (after - sizes) * 4 // 3]
                        past = places[np.minimum(turn + -(-after * 4 // 3), len(places)) - 1] + 1
                        begins, ends = (first, past) if lows is None else (lows[first], highs[past - 1])
                    else:
                        begins, ends = np.full(len(decoded), begin), np.full(len(decoded), end)
                    found.append((decoded, name, begins, ends, reads))
        for decoded, name, begins, ends, reads in found:
            mark = _digest(decoded.encode("utf-8", "surrogatepass")), int(begins[0]), int(ends[-1])
            if mark not in seen:
                seen.add(mark)
                work.append((decoded, f"{path}/{name}" if path else name, begins, ends, reads))
    return base, inner, opened, closed


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


COLUMNS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, layer_spans string, n_unopened long"


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, base counts and digest, all spans, and where decoded layers had them."""
    nothing = (0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, "", 0)

    def row(text: str) -> tuple:
        base, inner, opened, closed = scan(text)
        kinds = [kind for kind, _, _ in base]
        every = sorted({*base, *(span for _, span in inner)}, key=_by_start)
        deep = ",".join(f"{path}:{joined([span])}" for path, span in sorted(inner, key=lambda x: (_by_start(x[1]), x[0])))
        return (*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), opened, deep, closed)

    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts = pc.fill_null(piece.column("text"), "")
            hits = pc.or_(pc.match_substring_regex(texts, ANY_PLAIN), pc.match_substring_regex(texts, ANY_RUN))
            rows = [row(text.as_py()) if hit else nothing for text, hit in zip(texts, hits.to_pylist(), strict=True)]
            columns = [pa.array(list(c)) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
