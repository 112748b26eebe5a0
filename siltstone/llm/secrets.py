"""Secret scan with a recursive decoding worklist.

Each text is scanned for three kinds of secrets.  Encoded stretches are then decoded into new layers, which go on a
worklist; each layer is scanned and searched for encoded stretches again, until no layer is new (a digest of every
layer seen guards against cycles).  Every layer carries a map from its characters to the characters of the text, so
all findings are spans of the text.  Kinds of layers:

* percent-encoded bytes, anywhere in a layer;
* Unicode escapes: ``\\uXXXX`` (also as surrogate pairs), ``\\u{X}``, ``\\xXX``;
* base64 and base64url of at least 16 characters, in one line or over equally long lines; all four alignments are
  tried, so that a stretch may be glued to a path or a word in front of it;
* gzip, zlib, bzip2 and xz data with any number of members, starting anywhere in the bytes of a base64 stretch, of a
  percent-encoded one or of a bytes literal, compressed once or several times.  All that is in it has the span of its
  compressed bytes, so it is inflated in steps and scanned in windows, cut where no finding and no encoded
  stretch can go on; only data without any such place is held whole.

Bytes that are not UTF-8 are one unknown character each; the rest of their layer is scanned.

Defined results: a null text counts as empty and has no findings; a finding in a layer maps to the smallest
span of the text that encodes it; equal spans of one kind are reported once; base findings are always reported as they
are; compressed data that is damaged or ends early counts up to there; repeated rows give repeated results; an empty
table gives an empty one; columns with the results' names are replaced.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from siltstone.llm.common import bounded_batches, read_table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: One of these is in any text with an assignment, in lower case.
HINTS = ("passw", "secret", "token", "api")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
#: Bytes in percent-encoding or as a bytes literal; other characters stand for themselves.
PERCENT_BYTES = re.compile(r"[!-~]+")
LITERAL_BYTES = re.compile(r"[ -~]+")
BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\([ntr\\'\"])|(.)", re.S)
CONTROL = {"n": "\n", "t": "\t", "r": "\r"}
#: How compressed data starts: gzip, zlib, bzip2 (with and without a block), xz.
HEADER = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\0")
#: Any finding and any encoded stretch that holds one has so many printable characters in a row.
PROMISING = re.compile(rb"[ -~]{16}")
#: Bytes inflated at a time.
STEP = 1 << 20
#: Places after which no finding and no encoded stretch of the bytes before goes on.
CUT = re.compile(rb"[^A-Za-z0-9+/_\s-][ \t\r]*\n|\n[ \t\r]*\n|[\x00-\x08\x0e-\x1f\x7f-\xff]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """Findings as (start, end, kind), by start and then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


class Layer:
    """A decoded text; ``start[i]`` and ``end[i]`` give character i's span in the layer below's source."""

    __slots__ = ("end", "start", "text")

    def __init__(self, text: str, start, end):
        self.text, self.start, self.end = text, start, end

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


class Same:
    """A map that gives every character the same place."""

    __slots__ = ("at",)

    def __init__(self, at: int):
        self.at = at

    def __getitem__(self, _: int) -> int:
        return self.at


def _decoded(raw: bytes) -> tuple[str, Sequence[int]]:
    """UTF-8 text, and the place of the first byte of each character (and the end); other bytes are unknown characters."""
    if raw.isascii():
        return raw.decode("ascii"), range(len(raw) + 1)
    text = raw.decode("utf-8", "surrogateescape")
    places, at = [0], 0
    for c in text:
        at += 1 if c < "\x80" or "\udc80" <= c <= "\udcff" else len(c.encode())
        places.append(at)
    return re.sub("[\udc80-\udcff]", "�", text), places


class Inflater:
    """What is compressed in chunks of bytes, all members after each other, in steps of bounded size; ``used``: how many
    bytes they take so far."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.data, self.used = iter(chunks), b"", 0

    def _more(self) -> bool:
        self.data = next(self.chunks, b"")
        return bool(self.data)

    def _member(self):
        """A decompressor for what comes next, padding skipped; None at the end of the members."""
        while len(self.data.lstrip(b"\0")) < 10 and (more := next(self.chunks, b"")):
            self.data += more
        padding = len(self.data) - len(self.data.lstrip(b"\0")) if self.used else 0
        head = HEADER.match(self.data, padding)
        if head is None:
            return None
        self.data = self.data[padding:]
        self.used += padding
        if head[0][:1] == b"B":
            return bz2.BZ2Decompressor()
        return lzma.LZMADecompressor(lzma.FORMAT_XZ) if head[0][:1] == b"\xfd" else zlib.decompressobj(wbits=47)

    def __iter__(self) -> Iterator[bytes]:
        try:
            while (member := self._member()) is not None:
                while not member.eof:
                    out = member.decompress(self.data, STEP)
                    rest = member.unused_data if member.eof else getattr(member, "unconsumed_tail", b"")
                    self.used += len(self.data) - len(rest)
                    self.data = rest
                    if out:
                        yield out
                    elif not member.eof and not self.data and not self._more():
                        return
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return  # what came before counts


def _windows(chunks: Iterable[bytes], digest) -> Iterator[bytes]:
    """The data in parts, cut where nothing of interest can go on."""
    held, tried = bytearray(), STEP
    for chunk in chunks:
        digest.update(chunk)
        held += chunk
        while len(held) > 2 * STEP and (cut := CUT.search(held, tried)):
            yield bytes(held[: cut.end()])
            del held[: cut.end()]
            tried = STEP
        tried = max(STEP, len(held) - 64)
    yield bytes(held)


def _inflated(raw: bytes) -> Iterator[tuple[Iterator[str], int, int]]:
    """For each stretch of compressed data: texts in it, inflated again while there is a header, and its bytes' span."""

    def chunks(a: int) -> Iterator[bytes]:
        return (raw[i : i + (1 << 16)] for i in range(a, len(raw), 1 << 16))

    def texts(a: int) -> Iterator[str]:
        seen: set[bytes] = set()
        levels = 0
        while True:
            levels += 1
            data: Iterable[bytes] = chunks(a)
            for _ in range(levels):
                data = Inflater(data)
            digest, size = hashlib.blake2b(digest_size=16), 0
            for window in _windows(data, digest):
                size += len(window)
                if PROMISING.search(window):
                    yield _decoded(window)[0]
            if not size or digest.digest() in seen:
                return
            seen.add(digest.digest())

    at = 0
    while head := HEADER.search(raw, at):
        at = head.start() + 1
        whole = Inflater(chunks(head.start()))
        if sum(map(len, whole)):
            yield texts(head.start()), head.start(), head.start() + whole.used
            at = max(at, head.start() + whole.used)


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, list[int], list[int]] | None:
    """``text`` with matches decoded to (character, length in the text) pieces, and the span of each character."""
    out: list[str] = []
    start: list[int] = []
    end: list[int] = []
    at, changed = 0, False
    for m in pattern.finditer(text):
        pieces = decode(m.group())
        if pieces is None:
            continue
        changed = True
        out.append(text[at : m.start()])
        start.extend(range(at, m.start()))
        end.extend(range(at + 1, m.start() + 1))
        p = m.start()
        for c, n in pieces:
            out.append(c)
            start.append(p)
            end.append(p + n)
            p += n
        at = m.end()
    if not changed:
        return None
    out.append(text[at:])
    start.extend(range(at, len(text)))
    end.extend(range(at + 1, len(text) + 1))
    return "".join(out), start, end


def _percent(run: str) -> list[tuple[str, int]]:
    text, places = _decoded(bytes.fromhex(run.replace("%", "")))
    return [(c, 3 * (b - a)) for c, a, b in zip(text, places, places[1:])]


def _escape(run: str) -> list[tuple[str, int]] | None:
    if len(run) == 12:
        return [(chr(0x10000 + (int(run[2:6], 16) - 0xD800 << 10) + int(run[8:], 16) - 0xDC00), 12)]
    code = int(run[2:].strip("{}"), 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), len(run))]


def _literal_bytes(layer: Layer) -> Iterator[Layer]:
    """The layers compressed in percent-encoded stretches or bytes literals."""
    for mark, pattern in (("%", PERCENT_BYTES), ("\\x", LITERAL_BYTES)):
        for m in pattern.finditer(layer.text) if mark in layer.text else ():
            if mark not in m[0]:
                continue
            raw, places = bytearray(), [0]
            for b in BYTE.finditer(m[0]):
                digits = b[1] if mark == "%" else b[2]
                if digits:
                    raw.append(int(digits, 16))
                elif mark != "%" and b[3]:
                    raw.append(ord(CONTROL.get(b[3], b[3])))
                else:
                    raw.extend(b[0].encode())
                    places.extend(range(places[-1] + 1, b.end()))
                places.append(b.end())
            for texts, start, end in _inflated(bytes(raw)):
                a, b = layer.span(m.start() + places[start], m.start() + places[end])
                yield from (Layer(text, Same(a), Same(b)) for text in texts)


def _base64(layer: Layer, run: str, at: Sequence[int]) -> Iterator[Layer]:
    """The layers in a base64 stretch whose characters are at these places; its first quadruple may be anywhere."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    for phase in range(4):
        size = len(body) - phase
        size -= size % 4 == 1
        if size < 16:
            return
        raw = base64.b64decode(body[phase : phase + size] + "=" * (-size % 4))

        def place(a: int, b: int, phase=phase, whole=len(raw)) -> tuple[int, int]:
            """The span of some bytes; the last one takes the padding with it."""
            end = len(at) if b == whole and phase + size == len(body) else phase + -(-b * 4 // 3)
            return layer.start[at[phase + a * 4 // 3]], layer.end[at[end - 1]]

        for texts, start, stop in _inflated(raw):
            a, b = place(start, stop)
            yield from (Layer(text, Same(a), Same(b)) for text in texts)
        if PROMISING.search(raw):
            text, places = _decoded(raw)
            spans = [(layer.start[at[phase + a * 4 // 3]], layer.end[at[phase + -(-b * 4 // 3) - 1]]) for a, b in zip(places, places[1:])]
            yield Layer(text, [a for a, _ in spans], [b for _, b in spans])


def _stretches(text: str) -> Iterator[tuple[str, Sequence[int]]]:
    """Base64 stretches and the place of each character: every line on its own, and equally long lines together, with
    and without a shorter last one (which may be a word)."""
    chained = 0
    for m in BASE64.finditer(text):
        yield m.group(), range(m.start(), m.end())
        if m.start() < chained:
            continue
        lines, last = [m.span()], None
        while (end := lines[-1][1]) < len(text) and text[end - 1] != "=" and (more := NEXT_LINE.match(text, end)):
            if (n := len(more[1])) > len(m.group()):
                break
            if n < len(m.group()):
                last = more.span(1)
                break
            lines.append(more.span(1))
        chained = lines[-1][1]
        for parts in ([lines] if len(lines) > 1 else []) + ([[*lines, last]] if last else []):
            yield "".join(text[a:b] for a, b in parts), [i for a, b in parts for i in range(a, b)]


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers encoded in a layer, with spans in the original text."""
    text = layer.text
    for mark, pattern, decode in (("%", PERCENT, _percent), ("\\", ESCAPE, _escape)):
        if mark in text and (got := _replaced(text, pattern, decode)):
            new, start, end = got
            yield Layer(new, [layer.start[i] for i in start], [layer.end[i - 1] for i in end])
    yield from _literal_bytes(layer)
    for run, at in _stretches(text):
        yield from _base64(layer, run, at)


def scan_all(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base findings, all findings (with those of decoded layers), and the number of layers."""
    base = scan(text)
    if not ("%" in text or "\\" in text or BASE64.search(text)):
        return base, base, 0
    found = set(base)
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    work = [unwrap(Layer(text, range(len(text)), range(1, len(text) + 1)))]
    layers = 0
    while work:  # depth first, so that only the layers on the way are held
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        key = hashlib.blake2b(new.text.encode("utf-8", "surrogatepass") + b"%d:%d" % (new.start[0], new.end[-1]), digest_size=16).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        found.update((*new.span(a, b), k) for a, b, k in scan(new.text))
        work.append(unwrap(new))
    return base, sorted(found, key=lambda x: (x[0], x[2], x[1])), layers


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def _findings(batches: Iterator[pa.RecordBatch], text: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        base, all_, layers = [], [], []
        for value in batch.column(text):
            b, a, n = scan_all(value.as_py() or "")
            base.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in b])
            all_.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in a])
            layers.append(n)
        arrays = [batch.column(c) for c in kept] + [pa.array(base, pa.list_(span)), pa.array(all_, pa.list_(span)), pa.array(layers, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "base_spans", "all_spans", "n_layers"])


def find_secrets(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``base_spans``, ``all_spans`` (kind, start, end) and ``n_layers``; columns of these
    names are replaced."""
    bounded_batches(df.sparkSession)
    new = T.DataType.fromDDL("base_spans array<struct<kind:string,start:long,end:long>>, all_spans array<struct<kind:string,start:long,end:long>>, n_layers long")
    kept = [c for c in df.columns if c.lower() not in new.names]
    schema = T.StructType([df.schema[c] for c in kept] + new.fields)
    return df.mapInArrow(lambda b: _findings(b, text_col, kept), schema)


def op3_secrets(spark, sf_dir):
    from pyspark.sql import functions as F

    def count(kind):
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(text("base_spans"), 256).alias("base_sha256"), text("all_spans").alias("spans"), "n_layers")
