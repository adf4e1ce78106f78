"""Secret scans through nested encodings.

Every document is a worklist of layers, at first its text.  A layer is scanned by the rules,
and adds a layer with all its URL escapes decoded in place (bytes that are not UTF-8 as
replacement characters), one with all its Unicode and hex escapes, and one for every run
that decodes as base64, or as gzip, zlib, bzip2, xz or zstandard data inside base64.  A run
that does not, is tried again from each ``/``, ``-`` and ``_`` in it on, to its end and to the
next of them, as paths and names run into coded text there.  The list runs to its fixpoint: a layer whose content was seen in the document is not added again, so cycles end
and depth has no bound.  Each layer maps its characters to spans of its parent, so a finding
deep down is reported with its span in the document: exact through URL and Unicode escapes
and base64, the whole run through compression.

Compressed data is inflated as a stream, through all its members or frames and what stands
behind them.  A layer over ``MAX_LAYER`` bytes once decompressed is reported as ``oversized
layer`` and scanned in chunks of that size, one at a time, so that a bomb can't take the
executor's memory.  Chunks overlap, by a run without blanks at least, but by half of their
size at most; each is read if it is text.

Defined results: null, empty and clean texts give no rows; a null ``doc_id`` is carried;
repeated rows give repeated findings; equal findings of one span by one rule are reported
once, at the least depth; an empty table gives an empty result; other columns are not read.
Whole texts are scanned.  Secrets are reported by their first characters and a digest.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import bz2
import hashlib
import lzma
import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

MAX_LAYER = 16 << 20
_PIECE = 1 << 20

RULES = {
    "aws access key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "github token": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})",
    "slack token": r"(?<![A-Za-z0-9])xox[abposr]-[A-Za-z0-9-]{10,}",
    "google api key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}",
    "stripe key": r"(?<![A-Za-z0-9])(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}",
    "json web token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "credentials in url": r"(?<![A-Za-z])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[^\s/]",
    "assigned secret": r"(?i:token|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)[\"']?\s{0,4}(?:=|:|=>)\s{0,4}[\"']?(?P<value>[A-Za-z0-9+/_.~-]{12,})",
}
_RULES = {name: re.compile(rule) for name, rule in RULES.items()}
#: A cheap test for each rule, so that most texts are searched for literals only.
_HINTS = {
    "aws access key": ("AKIA", "ASIA"), "github token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), "slack token": ("xox",),
    "google api key": ("AIza",), "stripe key": ("k_live_", "k_test_"), "json web token": ("eyJ",), "private key": ("-----BEGIN ",),
    "credentials in url": ("://",),
}
_ASSIGN = re.compile(r"(?i)(?:token|secret|passw|pwd|_key|-key|apikey|accesskey|authkey)")
#: An escape character may be escaped over and over ("%252525...", two characters a level); a longer chain goes on from its last levels.
CHAIN = 16
_URL = re.compile(rf"%(?:25){{{CHAIN + 1},}}|(?:%[0-9A-Fa-f]{{2}}(?!(?<=%25)(?:25){{{CHAIN},}}))+")
_ESCAPED = re.compile(
    rf"\\(?P<link>u005[cC]|x5[cC]|U0000005[cC]|u\{{5[cC]\}})(?P=link){{{CHAIN},}}|\\u\{{[0-9A-Fa-f]{{1,6}}\}}|\\u[0-9A-Fa-f]{{4}}|\\U[0-9A-Fa-f]{{8}}|\\x[0-9A-Fa-f]{{2}}"
)
_STRAY = re.compile(r"[\udc80-\udcff]")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
_JOINT = re.compile(r"[/_-]")
_UNPACK = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", b"\xfd7zXZ": "xz", b"\x28\xb5\x2f\xfd": "zstd"}

Span = tuple[int, int]


_BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def _codec(data: bytes) -> str | None:
    if len(data) > 2 and data[0] == 0x78 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return next((name for magic, name in _UNPACK.items() if data.startswith(magic)), None)


def _member(codec: str, data: bytes, at: int):
    """The content of one member or frame in pieces of bounded size; returns where it ends."""
    if codec in ("gzip", "zlib"):
        d, step = zlib.decompressobj(47), 1 << 16
    elif codec == "zstd":  # has no bound on its output but that of its input
        d, step = zstandard.ZstdDecompressor().decompressobj(), 1 << 10
    else:
        d, step = bz2.BZ2Decompressor() if codec == "bzip2" else lzma.LZMADecompressor(), 1 << 16
    while at < len(data) and not d.eof:
        piece = data[at : at + step]
        at += len(piece)
        if codec == "zstd":
            yield d.decompress(piece)
        elif codec in ("gzip", "zlib"):
            yield d.decompress(piece, _PIECE)
            while d.unconsumed_tail and not d.eof:
                yield d.decompress(d.unconsumed_tail, _PIECE)
        else:
            yield d.decompress(piece, _PIECE)
            while not d.eof and not d.needs_input:
                yield d.decompress(b"", _PIECE)
    if codec in ("gzip", "zlib") and not d.eof:
        yield d.flush()
    return at - len(d.unused_data)


def _members(data: bytes):
    """The content of all members or frames in a row, None, and what stands behind them, in pieces."""
    at = 0
    while at < len(data):
        codec = _codec(data[at : at + 6])
        if codec is None:
            behind = data[at:].lstrip(b"\0")
            if _codec(behind) is None:
                yield from (None, behind)
                return
            at = len(data) - len(behind)
            continue
        at = yield from _member(codec, data, at)


def _cut(block: bytes) -> int:
    """Where the chunk after this one starts: before the run at its end, and an overlap before it; by half a chunk at least."""
    half, at = len(block) // 2, len(block) - len(block) // 16
    run = max(block.rfind(c, half) for c in (b" ", b"\n", b"\t"))
    if run >= 0:
        at = min(at, run)
        at = max(half, max(block.rfind(c, half, at) for c in (b" ", b"\n", b"\t")))
    else:
        at = half
    while at and block[at] & 0xC0 == 0x80:  # inside a character
        at -= 1
    return at


def _chunks(pieces):
    """(readable text or None, whether it is over the limit) of a stream of bytes; beyond ``MAX_LAYER`` bytes in overlapping chunks."""
    held, over = bytearray(), False
    try:
        for piece in pieces:
            if piece is None:  # what stands behind may be no text
                yield _readable(bytes(held)), over
                held.clear()
                continue
            held += piece
            while len(held) > MAX_LAYER:
                end, over = MAX_LAYER, True
                while end > MAX_LAYER - 4 and held[end] & 0xC0 == 0x80:
                    end -= 1
                block = bytes(held[:end])
                yield _readable(block), over
                del held[: max(1, _cut(block))]
    except _BROKEN:
        pass  # what came before the damage is scanned
    yield _readable(bytes(held)), over


def _inflate(data: bytes):
    """The codec and the chunks of text of compressed data, or None."""
    codec = _codec(data)
    if codec is None:
        return None
    pieces = _members(data)
    try:
        first = next(pieces, b"")
    except _BROKEN:
        return None
    return codec, _chunks(chain([first], pieces))


class Spans:
    """For each character of a text the span of its parent that it comes from; starts and ends never fall."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts, self.ends = starts, ends

    @classmethod
    def all_of(cls, n: int, start: int, end: int) -> Spans:
        """The same span for each of ``n`` characters, held once."""
        return cls(np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(end), n))

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, a: int, b: int) -> Span:
        return int(self.starts[a]), int(self.ends[b - 1])

    def within(self, outer: Spans | None, at: int) -> Spans:
        """These spans, of a run at ``at`` of a layer, as spans of the layer's own parent."""
        if not len(self):
            return self
        if self.starts.strides == (0,) or (outer is not None and outer.starts.strides == (0,)):
            a, b = int(self.starts[0]) + at, int(self.ends[-1]) + at
            return Spans.all_of(len(self), *((a, b) if outer is None else outer.of(a, b)))
        if outer is None:
            return Spans(self.starts + at, self.ends + at)
        return Spans(outer.starts[self.starts + at], outer.ends[self.ends + (at - 1)])


def _readable(data: bytes) -> str | None:
    """The bytes as text, if they are UTF-8 and nearly all printable."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if _printable(text) else None


_PLAIN = bytes([9, 10, 13, *range(32, 127)])


def _printable(text: str) -> bool:
    if text.isascii():
        bad = len(text.encode().translate(None, _PLAIN))
    else:
        bad = len(text) - sum(map(str.isprintable, text)) - sum(map(text.count, "\r\n\t"))
    return bool(text) and bad <= 0.05 * len(text)


def _widths(text: str) -> np.ndarray:
    """Bytes of each character in UTF-8; one for a byte that was kept as a surrogate."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    return np.where((code >= 0xDC80) & (code <= 0xDCFF), 1, width)


def _in_place(layer: str, tokens: re.Pattern, value) -> tuple[str, Spans] | None:
    """A layer with all tokens decoded in place; ``value`` gives a token's text and, unless each character comes from all of it, spans."""
    out, cuts, inner, at = [], [], [], 0
    for m in tokens.finditer(layer):
        a, b = m.span()
        text, spans = value(m[0])
        if spans is not None:
            inner.append((len(cuts), spans))
        out += (layer[at:a], text)
        cuts.append((a, b, len(text)))
        at = b
    if not cuts:
        return None
    text = "".join([*out, layer[at:]])
    a, b, n = np.array(cuts, np.int64).T
    lost = np.concatenate([[0], np.cumsum(b - a - n)])  # characters fewer, up to each token and after the last
    first = a - lost[:-1]
    starts = np.arange(len(text)) + np.repeat(lost, np.diff(np.concatenate([[0], first + n, [len(text)]])))
    ends = starts + 1
    decoded = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    starts[decoded], ends[decoded] = np.repeat(a, n), np.repeat(b, n)
    for k, (s, e) in inner:
        starts[first[k] : first[k] + n[k]], ends[first[k] : first[k] + n[k]] = a[k] + s, a[k] + e
    return text, Spans(starts, ends)


def _escape_value(token: str) -> tuple[str, None]:
    if len(token) > 10:
        return "\\" + _ESCAPED.fullmatch(token)["link"] * CHAIN, None
    code = int(token.strip("\\uUx{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd", None


def _url_value(token: str) -> tuple[str, tuple[np.ndarray, np.ndarray] | None]:
    if token.startswith("%2525"):
        return "%" + "25" * CHAIN, None
    text = bytes.fromhex(token.replace("%", "")).decode("utf-8", "surrogateescape")
    if len(text) == 1:
        return _STRAY.sub("\ufffd", text), None
    ends = 3 * np.cumsum(_widths(text))
    return _STRAY.sub("\ufffd", text), (np.concatenate([[0], ends[:-1]]), ends)


def _unescape(layer: str) -> tuple[str, Spans] | None:
    return _in_place(layer, _ESCAPED, _escape_value)


def _unquote(layer: str) -> tuple[str, Spans] | None:
    return _in_place(layer, _URL, _url_value)


def _unbase64(run: str) -> tuple[str, str | Iterator, Spans | None] | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        if _codec(_bytes(body[:8])) is None:
            return None
        body = body[:-1]  # behind compressed data anything may stand
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None
    packed = _inflate(data)
    if packed is not None:
        return f"base64>{packed[0]}", packed[1], None
    text = _readable(data)
    if text is None:
        return None
    after = np.cumsum(_widths(text))
    first, last = np.concatenate([[0], after[:-1]]), after - 1  # bytes of each character
    return "base64", text, Spans(4 * first // 3, np.minimum(len(body), 4 * last // 3 + 2))


def _coded(run: str) -> list[tuple[int, int]]:
    """The parts of a run that may decode: all of it, or else what follows a separator, to the end or another separator.

    The end of a run decodes alike from all places of one alignment, so of those that look
    right at most one fails for each alignment, and the time is linear in the run.
    """
    if _unbase64(run) is not None:
        return [(0, len(run))]
    cuts = [0, *(m.end() for m in _JOINT.finditer(run))]
    ends = [*(c - 1 for c in cuts[1:]), len(run)]
    out, failed, until = [], set(), 0
    for k, (p, q) in enumerate(zip(cuts, ends)):
        if p < until or len(run) - p < 16:
            continue
        if p % 4 not in failed and _looks_coded(run[p : p + 16]):
            good = p + _good(run[p:])
            last = bisect.bisect_right(ends, good)  # ends up to the last good character
            best = next((e for e in [*ends[max(last, k) : last + 1], *reversed(ends[max(k, last - 4) : last])] if e - p >= 16 and _unbase64(run[p:e]) is not None), None)
            if best is not None:
                out.append((p, best))
                until = best
                continue
            failed.add(p % 4)
        if len(cuts) > 1 and q - p >= 16:
            out.append((p, q))
    return out


def _bytes(run: str) -> bytes:
    """What the whole groups of four characters of a run decode to."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    return base64.b64decode(body[: len(body) // 4 * 4])


def _looks_coded(start: str) -> bool:
    """Whether the first characters of a run decode to the start of a text or of compressed data."""
    data = _bytes(start)
    return _codec(data) is not None or all(c >= 32 or c in b"\t\r\n" for c in data)


def _good(run: str) -> int:
    """How many characters of a run decode to UTF-8; all of them, if it is compressed."""
    data = _bytes(run)
    if _codec(data) is None:
        try:
            data.decode()
        except UnicodeDecodeError as e:
            return (e.start * 4 + 2) // 3
    return len(run)


def _decoded(layer: str):
    """(codec, start and end of the run, content, spans in the run) of all that decodes in a layer; compressed content in chunks, all from the whole run."""
    if "%" in layer and (got := _unquote(layer)):
        yield "url", (0, len(layer)), *got
    if "\\" in layer and (got := _unescape(layer)):
        yield "unicode", (0, len(layer)), *got
    for m in _BASE64.finditer(layer):
        for a, b in _coded(m[0]):
            if got := _unbase64(m[0][a:b]):
                yield got[0], (m.start() + a, m.start() + b), got[1], got[2]


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _found(layer: str):
    for name, rule in _RULES.items():
        hints = _HINTS.get(name)
        if not (any(h in layer for h in hints) if hints else _ASSIGN.search(layer)):
            continue
        for m in rule.finditer(layer):
            value = m["value"] if "value" in rule.groupindex else m[0]
            if "value" in rule.groupindex and (entropy(value) < 3.0 or not any(c.isdigit() for c in value)):
                continue  # a word, not a secret
            yield name, *(m.span("value") if "value" in rule.groupindex else m.span()), value


def scan(text: str | None) -> list[tuple[str, str, int, int, int, str, str]]:
    """(rule, path of codecs, depth, start, end, first characters, digest) of each secret in a text."""
    if not text:
        return []
    out, best = [], {}
    work, seen = deque([(text, None, "", 0)]), {_digest(text)}

    def search(layer: str, spans: Spans | None, path: str, depth: int) -> None:
        whole = (lambda a, b: (a, b)) if spans is None else spans.of
        for name, a, b, value in _found(layer):
            start, end = whole(a, b)
            digest = hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()[:16]
            if (name, start, end, digest) not in best:  # breadth first: the least depth comes first
                best[name, start, end, digest] = True
                out.append((name, path, depth, start, end, value[:4], digest))
        for codec, (a, b), content, inner in _decoded(layer):
            below = f"{path}>{codec}" if path else codec
            if not isinstance(content, str):
                work.append((content, (*whole(a, b), path), below, depth + 1))
            elif content and new(content):
                work.append((content, inner.within(spans, a), below, depth + 1))

    def new(content: str) -> bool:
        n = len(seen)
        seen.add(_digest(content))
        return len(seen) > n

    while work:
        layer, spans, path, depth = work.popleft()
        if isinstance(layer, str):
            search(layer, spans, path, depth)
            continue
        start, end, above = spans
        large = False
        for chunk, over in layer:  # one in memory at a time
            if over and not large:
                large = True
                out.append(("oversized layer", above, depth - 1, start, end, "", ""))
            if chunk and new(chunk):
                search(chunk, Spans.all_of(len(chunk), start, end), path, depth)
    return out


def _digest(content: str) -> bytes:
    return hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16).digest()


_FINDING = T.StructType([
    T.StructField("rule", T.StringType()), T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("preview", T.StringType()), T.StructField("digest", T.StringType()),
])
_ARROW = pa.list_(pa.struct([
    ("rule", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
    ("preview", pa.string()), ("digest", pa.string()),
]))


@F.arrow_udf(T.ArrayType(_FINDING))
def _scan(texts: pa.Array) -> pa.Array:
    names = _FINDING.names
    return pa.array([[dict(zip(names, f)) for f in scan(t)] for part in slices(texts) for t in part.to_pylist()], _ARROW)


def findings(docs: DataFrame) -> DataFrame:
    """One row a finding: doc_id, rule, path, depth, start, end, preview, digest."""
    return docs.select("doc_id", F.inline(_scan("text")))
