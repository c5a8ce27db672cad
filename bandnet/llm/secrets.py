"""Secret scans with a recursive decoding worklist.

A text is scanned as it is; then every layer that can be unwrapped from it (percent escapes, Unicode escapes, base64,
and compressed bytes inside them) is scanned and unwrapped in turn until nothing new appears. A layer keeps, for each
of its characters, the stretch of the original text that it comes from, so each finding is a span of the original.
"""

from __future__ import annotations

import base64
import bz2
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandnet.llm.storage import fresh_name
from bandnet.llm.textbytes import give_back

# What a secret looks like, and the least length of what counts (of group 2 for assign)
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex"]
LEAST = {"assign": 8, "access": 16, "hex": 32}

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN, re.ASCII | re.IGNORECASE), re.compile(ACCESS), re.compile(HEX)
_KEYWORD = re.compile(r"[:=]")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
_ESCAPE_UNIT = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))")
_BASE64 = re.compile(r"([A-Za-z0-9+/_-]{16,})={0,2}")
_ALPHABETS = [re.compile(r"[A-Za-z0-9+/]{16,}"), re.compile(r"[A-Za-z0-9_-]{16,}")]
_TO_STANDARD = str.maketrans("-_", "+/")
# A line break, also one that is written as an escape, and the indent of the next line
_GAP = r"[ \t]*(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*"
_BREAK = re.compile(_GAP)
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]++(?:{_GAP}[A-Za-z0-9+/_-]++)++)={{0,2}}")
# First bytes of compressed data, and who opens it by the first of them
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]")
_MAKERS: dict[int, tuple[str, Callable]] = {
    0x1F: ("gzip", lambda: zlib.decompressobj(31)),
    ord("B"): ("bz2", bz2.BZ2Decompressor),
    0xFD: ("xz", lzma.LZMADecompressor),
    0x78: ("zlib", zlib.decompressobj),
}
# Bytes written as escapes, also the short ones of strings in programs
_PERCENT_BYTE = re.compile(rb"%[0-9A-Fa-f]{2}")
_ESCAPED_BYTE = re.compile(rb"\\(?:x[0-9A-Fa-f]{2}|u00[0-9A-Fa-f]{2}|U000000[0-9A-Fa-f]{2}|[0abfnrtv\\'\"])")
_SHORT_ESCAPES = {
    b"0": b"\0", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t", b"v": b"\v", b"\\": b"\\", b"'": b"'", b'"': b'"',
}
# UTF-8 without control characters, as long as the shortest secret
_STRETCH = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){14,}+"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three kinds in a text as it stands, ordered by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """A decoded text; ``begin`` and ``finish`` give the original stretch behind each character (None: itself)."""

    def __init__(self, text: str, begin: np.ndarray | None, finish: np.ndarray | None, path: tuple[str, ...]):
        self.text, self.begin, self.finish, self.path = text, begin, finish, path

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.begin is None:
            return start, end
        return int(self.begin[start]), int(self.finish[end - 1])

    def child(self, text: str, starts: np.ndarray, ends: np.ndarray, how: str) -> Layer:
        """A layer whose characters come from the given stretches of this one."""
        if self.begin is not None:
            starts, ends = self.begin[starts], self.finish[ends - 1]
        path = self.path if self.path[-1:] == (how,) else (*self.path, how)
        return Layer(text, starts, ends, path)


def _rewritten(layer: Layer, pattern: re.Pattern, decode: Callable, how: str) -> Layer | None:
    """The whole layer with the matches of a pattern decoded; decode gives (characters, starts, ends) or None."""
    pieces, starts, ends, at, changed = [], [], [], 0, False
    for match in pattern.finditer(layer.text):
        decoded = decode(match[0])
        if decoded is None:
            continue
        changed = True
        plain = np.arange(at, match.start(), dtype=np.int64)
        pieces += [layer.text[at : match.start()], decoded[0]]
        starts += [plain, match.start() + np.array(decoded[1], dtype=np.int64)]
        ends += [plain + 1, match.start() + np.array(decoded[2], dtype=np.int64)]
        at = match.end()
    if not changed:
        return None
    plain = np.arange(at, len(layer.text), dtype=np.int64)
    pieces.append(layer.text[at:])
    return layer.child("".join(pieces), np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1]), how)


def _percent(run: str):
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return text, [3 * i for i in range(len(raw))], [3 * i + 3 for i in range(len(raw))]
    cuts = np.cumsum([0] + [len(c.encode()) for c in text]) * 3
    return text, cuts[:-1], cuts[1:]


def _escapes(run: str):
    units = [(int(m[1] or m[2] or m[3], 16), m.start(), m.end()) for m in _ESCAPE_UNIT.finditer(run)]
    characters, starts, ends, i = [], [], [], 0
    while i < len(units):
        code, start, end = units[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            code, end, i = 0x10000 + ((code - 0xD800) << 10) + units[i + 1][0] - 0xDC00, units[i + 1][2], i + 1
        if 0xD800 <= code < 0xE000 or code > 0x10FFFF:
            code = 0xFFFD
        characters.append(chr(code))
        starts.append(start)
        ends.append(end)
        i += 1
    return "".join(characters), starts, ends


def _inflate(data: bytes, start: int, limit: int) -> tuple[int, str, bytes | None, bool] | None:
    """Where the compressed data at a place ends, how it is compressed, what it holds and whether its end was seen.

    Members of the same kind that follow, also behind zero bytes, belong to it. No content if that has more than
    ``limit`` bytes; None if it is not compressed.
    """
    how, make = _MAKERS[data[start]]
    contents, size, end, ended, at = [], 0, start, False, start
    while at < len(data) and data[at] == data[start]:
        try:
            member = make()
            content = member.decompress(memoryview(data)[at:], limit - size + 1)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError):
            break
        contents.append(content)
        size, ended = size + len(content), member.eof
        if size > limit:
            return len(data), how, None, True
        if not ended:
            end = len(data)
            break
        end = at = len(data) - len(member.unused_data)
        while at < len(data) and not data[at]:
            at += 1
    if not size and not ended:
        return None
    return end, how, b"".join(contents), ended


def _streams(data: bytes, limit: int) -> Iterator[tuple[int, int, str, bytes | None, bool]]:
    """Compressed data in bytes: begin, end, how, content (None if too large) and whether its end was seen."""
    at = 0
    while (mark := _MAGIC.search(data, at)) is not None:
        opened = _inflate(data, mark.start(), limit)
        if opened is not None:
            yield mark.start(), *opened
        at = opened[0] if opened is not None and opened[3] else mark.start() + 1


def _readable(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 with hardly any control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = sum(c < 32 and c not in (9, 10, 13) for c in data)
    return text if text and odd * 20 <= len(data) else None


def _tokens(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """Base64 runs without padding, the place of each character, and where they end with padding.

    Runs of both alphabets, their parts of one, and runs joined where only line breaks and indents separate them.
    """
    for match in _BASE64.finditer(text):
        start, stop = match.span(1)
        yield match[1], np.arange(start, stop), match.end()
        for alphabet in _ALPHABETS:
            for part in alphabet.finditer(text, start, stop):
                if part.span() != (start, stop):
                    yield part[0], np.arange(*part.span()), match.end() if part.end() == stop else part.end()
    for match in _WRAPPED.finditer(text):
        places, at = [], match.start()
        for gap in _BREAK.finditer(text, *match.span(1)):
            places.append(np.arange(at, gap.start()))
            at = gap.end()
        token, places = _BREAK.sub("", match[1]), np.concatenate([*places, np.arange(at, match.end(1))])
        if len(token) >= 16:
            yield token, places, match.end()


def _texts(data: bytes, limit: int) -> tuple[list[tuple[str, str | None, int, int]], bool]:
    """Texts in bytes as (how compressed, text, begin, end), and whether they account for all the bytes.

    Compressed streams are opened wherever they begin; a text of None is one too large to open. Bytes that are no text as
    a whole give their readable stretches.
    """
    found, whole, done = [], False, set()
    work: list[tuple[bytes, str, tuple[int, int] | None]] = [(data, "", None)]
    while work:
        data, how, place = work.pop()
        done.add((data, place))
        complete = False
        for begin, end, kind, content, ended in _streams(data, limit):
            complete |= ended and (begin, end) == (0, len(data))
            below = place or (begin, end)
            if content is None:
                found.append((how, None, *below))
            elif content != data and (content, below) not in done:
                work.append((content, f"{how}+{kind}", below))
        if not complete and (text := _readable(data)) is not None:
            complete = True
            found.append((how, text, *(place or (0, len(data)))))
        elif not complete:
            found += [(how, m[0].decode(), *(place or m.span())) for m in _STRETCH.finditer(data)]
        whole |= complete and place is None
    return found, whole


def _escaped_streams(layer: Layer, units: re.Pattern, limit: int, how: str) -> Iterator[Layer | tuple[int, int]]:
    """Compressed data whose bytes are written as escapes, or as themselves where they are printable."""
    raw = layer.text.encode("latin-1", "replace")  # a byte for each character
    for said in {raw, raw.replace(b"+", b" ")} if how == "url" else {raw}:
        data = units.sub(_escaped_byte, said)
        if _MAGIC.search(data) is None:
            continue
        spans = np.array([m.span() for m in units.finditer(said)], dtype=np.int64).reshape(-1, 2)
        inside = np.zeros(len(said), dtype=bool)
        for start, end in spans:
            inside[start + 1 : end] = True
        starts = np.flatnonzero(~inside)
        ends = np.append(starts[1:], len(said))
        for kind, text, begin, end in _texts(data, limit)[0]:
            if text is None:
                yield layer.origin(int(starts[begin]), int(ends[end - 1]))
            elif kind:
                first, last = np.full(len(text), starts[begin]), np.full(len(text), ends[end - 1])
                yield layer.child(text, first, last, f"{how}{kind}")


def _escaped_byte(unit: re.Match) -> bytes:
    said = unit[0]
    if said[1:] in _SHORT_ESCAPES and said[:1] == b"\\":
        return _SHORT_ESCAPES[said[1:]]
    return bytes([int(said[-2:], 16)])


def _unwrapped(layer: Layer, limit: int) -> Iterator[Layer | tuple[int, int]]:
    """Layers one step below a layer; a bare span stands for compressed data that is too large to open."""
    if "%" in layer.text and (found := _rewritten(layer, _PERCENT, _percent, "url")):
        yield found
    if "\\" in layer.text and (found := _rewritten(layer, _ESCAPE, _escapes, "unicode")):
        yield found
    if "%" in layer.text:
        yield from _escaped_streams(layer, _PERCENT_BYTE, limit, "url")
    if "\\" in layer.text:
        yield from _escaped_streams(layer, _ESCAPED_BYTE, limit, "unicode")
    for token, places, stop in _tokens(layer.text):
        token = token.translate(_TO_STANDARD)
        for shift in range(4):  # the other alignments are for runs with more characters in front
            part = token[shift : len(token) - ((len(token) - shift) % 4 == 1)]
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            found, whole = _texts(data, limit)
            for how, text, begin, end in found:
                if how or text is None:
                    cuts = np.array([begin, end])
                else:
                    cuts = begin + np.cumsum([0] + [len(c.encode()) for c in text])
                # four characters carry three bytes
                starts = places[shift + cuts[:-1] // 3 * 4 + cuts[:-1] % 3]
                ends = places[shift + (cuts[1:] - 1) // 3 * 4 + (cuts[1:] - 1) % 3 + 1] + 1
                if text is None or how:
                    if end == len(data):
                        ends[-1] = stop
                    if text is None:
                        yield layer.origin(int(starts[0]), int(ends[0]))
                        continue
                    starts, ends = np.repeat(starts, len(text)), np.repeat(ends, len(text))
                yield layer.child(text, starts, ends, f"base64{how}")
            if whole:
                break


def find_secrets(text: str | None, limit: int = 16_000_000) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points; those of decoded layers have a kind like ``base64.assign``.

    Works off a list of layers; a layer with the same content for the same stretch as one before is a cycle and is left.
    Compressed data of more than ``limit`` bytes is reported whole, as kind ``oversize``.
    """
    text = text or ""
    spans = base_spans(text)
    taken = set(spans)
    added: set[tuple[str, int, int]] = set()
    seen = {(text, 0, len(text))}
    work = [Layer(text, None, None, ())]
    while work:
        layer = work.pop()
        for below in _unwrapped(layer, limit):
            if isinstance(below, tuple):
                added.add(("oversize", *below))
                continue
            key = (below.text, *below.origin(0, len(below.text)))
            if not below.text or key in seen:
                continue
            seen.add(key)
            work.append(below)
            for kind, start, end in base_spans(below.text):
                start, end = below.origin(start, end)
                if (kind, start, end) not in taken:
                    taken.add((kind, start, end))
                    added.add((f"{'.'.join(below.path)}.{kind}", start, end))

    def order(span: tuple[str, int, int]) -> tuple:
        return span[1], KINDS.index(span[0]) if span[0] in KINDS else len(KINDS), span[0], span[2]

    return sorted([*spans, *added], key=order)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every stretch covered by spans replaced by one mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda s: (s[1], s[2])):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        out += [text[at:start], "[SECRET]"]
        at = end
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan_secrets(docs: DataFrame, text: str = "text", redact: bool = False, limit: int = 16_000_000) -> DataFrame:
    """Add ``secrets`` (kind, start, end in code points, end exclusive) and, with ``redact``, the text without them.

    Null and empty texts have no secrets and stay as they are; texts are scanned whole; repeated rows are scanned alike;
    an empty table gives an empty one. Columns named secrets or redacted are replaced, all others stay.
    """
    docs = docs.drop("secrets", "redacted")
    (found,) = fresh_name(docs, "found")

    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = column.to_pylist()
            spans = [find_secrets(t, limit) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            masked = [redacted(t, s) if redact and s else None for t, s in zip(texts, spans, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(_SPAN)), pa.array(masked, pa.string())], names=["secrets", "redacted"])
        give_back()

    scan.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(scan, "secrets array<struct<kind:string,start:long,end:long>>, redacted string").asNondeterministic()
    out = docs.withColumn(found, udf(F.col(text).cast("string")))
    masked = [F.coalesce(f"{found}.redacted", F.col(text).cast("string")).alias("redacted")] if redact else []
    return out.select(*docs.columns, F.col(f"{found}.secrets").alias("secrets"), *masked)
