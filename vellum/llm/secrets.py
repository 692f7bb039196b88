"""Secret scan with a worklist of decoded layers.

Every text is scanned as it stands. Parts that look encoded are unwrapped into layers
of their own: percent-encoded and Unicode-escaped text, base64 runs, and compressed
bytes inside those. Each layer is scanned and unwrapped in turn, until nothing new
comes out; a layer met before, with the same content from the same place, is not taken
up again, so encodings that decode to themselves or to each other end.

Layers of decoded letters know where each letter comes from, as runs of letters that
were copied or decoded alike, so a secret found five layers down is reported as a span
of the original text. What was compressed has no such places: its secrets get the span
of the encoded run. Those layers are streams: they are unpacked and scanned a piece at a
time, in windows that overlap, with an encoded run that goes on beyond a window decoded
as a stream of its own. Memory is thus bounded whatever comes out, and nothing is cut.

Bytes that are no UTF-8 are read as one character each, so binary neighbours hide
nothing. A base64 run is decoded from each of its first four letters, as what stands
before it may look like a part of it.

A filter in SQL tells which texts hold anything to scan or unwrap; only those are
handed to Python, the others are settled where they are.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.columns import table_of, text_slices, trimmed

KINDS = ("assign", "access", "hex")
#: Fixed patterns: (kind, pattern, group whose length counts, least length). Letters of the first group of "assign" in either case.
KEYS = "password|passwd|secret|token|api_?key"
ASSIGN = re.compile(rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
ESCAPES = r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|[Uu]\+([0-9A-Fa-f]{4,6})"
PERCENT = r"(?:%[0-9A-Fa-f]{2})+"
ESCAPED = re.compile(f"{ESCAPES}|{PERCENT}")
#: A run of either alphabet's letters.
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
ENCODED = re.compile("|".join([ESCAPED.pattern, BASE64.pattern]))
#: What a text must hold to be worth scanning or unwrapping, in SQL: what any of the patterns above needs.
WORTH = "|".join([f"(?i:{KEYS})", ACCESS.pattern, HEX.pattern, ENCODED.pattern])
LETTERS = re.compile("[A-Za-z0-9+/_-]{16}")
#: Runs on lines of their own, as encoders wrap them; the first may stand behind something and the last before something. At least one line is as long as a run.
BREAK = r"[ \t]*+(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*+"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK}[A-Za-z0-9+/_-]++)+={{0,2}}")
LINE = re.compile(rf"(?:{BREAK})?([A-Za-z0-9+/_-]+)")
LEAST_RUN = 16
URLSAFE = str.maketrans("-_", "+/")
#: How compressed bytes begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x78[\x01\x5e\x9c\xda]", re.DOTALL)
BYTES = re.compile("[\\x00-\\xff]+")
#: So many steps of escapes within escapes are layers each; beyond that, one step undoes all that are left.
STEPS = 16
#: Letters of the longest escape but one.
REACH = 11
#: What is unpacked at a time, the least window, and what of it the next one sees again.
CHUNK, PIECE, OVERLAP = 1 << 20, 1 << 20, 1 << 16
#: What is left of a longer run of spaces in a stream: a secret may hold any number of them.
SPACES, SHORT = re.compile(rb" {1025,}"), b" " * 1024
#: A run that a window breaks off, and how one goes on.
BROKEN_RUN = re.compile(r"[A-Za-z0-9+/_\r\n-]+\Z")
RUN_ON = re.compile(rb"[A-Za-z0-9+/_\r\n-]*")
NO_LETTERS = bytes(c for c in range(256) if not re.match(rb"[A-Za-z0-9+/_-]", bytes([c])))

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Secrets of a text: leftmost matches of each kind that do not overlap, without those too short."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _hot(text: str) -> bool:
    """If a decoded text holds anything to scan or unwrap; what WORTH asks, by quicker means where most holds nothing."""
    low = text.lower()
    return any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key", "akia")) or _escaped(text) or LETTERS.search(text) is not None


def _escaped(text: str) -> bool:
    return any(c in text for c in "%\\&+") and ESCAPED.search(text) is not None


class Layer:
    """A text, and where its letters come from: here, from themselves."""

    steps = 0  # of escapes that led here without another encoding between

    def __init__(self, text: str):
        self.text = text

    def origin(self, a: int, b: int) -> tuple[int, int]:
        """The span of the original text that letters a to b come from, a < b."""
        return a, b


class Unescaped(Layer):
    """What a step of escapes makes of a layer.

    Each piece is (its place, start and end of its origin in the layer below, letters
    there for a letter here; 0 where the piece is one whole).
    """

    def __init__(self, below: Layer, text: str, pieces: list[tuple[int, int, int, int]]):
        self.text, self.below, self.pieces, self.steps = text, below, pieces, below.steps + 1
        self.places = [p[0] for p in pieces]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        at, start, _, scale = self.pieces[bisect_right(self.places, a) - 1]
        at_, start_, end_, scale_ = self.pieces[bisect_right(self.places, b - 1) - 1]
        return self.below.origin(start + (a - at) * scale, start_ + (b - at_) * scale_ if scale_ else end_)


class Run(Layer):
    """What the letters of a base64 run from its letter ``shift`` on hold; wide: bytes a letter, 0 for UTF-8; skip: bytes before the first."""

    def __init__(self, below: Layer, parts: list[tuple[int, int]], letters: int, shift: int, text: str, wide: int, skip: int = 0):
        self.text, self.below, self.parts, self.letters, self.shift, self.wide, self.skip = text, below, parts, letters, shift, wide, skip
        self.firsts, n = [], 0
        for a, b in parts:
            self.firsts.append(n)
            n += b - a
        self.upto: np.ndarray | None = None

    def _byte(self, i: int) -> int:
        if self.wide:
            return self.skip + self.wide * i
        if self.upto is None:
            self.upto = np.concatenate([[0], np.cumsum([1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF) for c in map(ord, self.text)])])
        return int(self.upto[i])

    def _place(self, letter: int) -> int:
        i = bisect_right(self.firsts, letter) - 1
        return self.parts[i][0] + letter - self.firsts[i]

    def origin(self, a: int, b: int) -> tuple[int, int]:
        first, last = self.shift + self._byte(a) * 4 // 3, min(self.shift + (self._byte(b) * 4 + 2) // 3, self.letters)
        return self.below.origin(self._place(first), self._place(last - 1) + 1)


def _code(m: re.Match) -> str | None:
    code = int(next(g for g in m.groups() if g is not None), 10 if m[6] else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _narrow(text: str) -> bytes:
    """Letters as the bytes they may stand for, else as UTF-8."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def _first_letter(raw: bytes) -> tuple[str, int]:
    """The letter that bytes begin with in UTF-8, else the first byte's, and how many bytes it is."""
    n = 1 if raw[0] < 0xC2 else 2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4 if raw[0] < 0xF5 else 1
    try:
        return raw[:n].decode(), n
    except UnicodeDecodeError:
        return chr(raw[0]), 1


def _step(layer: Layer) -> tuple[Layer | None, list[tuple[int, int, bytes]]]:
    """(the layer with every escape decoded once, runs of percent-encoded bytes that hold compressed ones)."""
    text, parts, pieces, packed, last, size = layer.text, [], [], [], 0, 0
    for m in ESCAPED.finditer(text):
        new, scale = (None, 3) if m[0][0] == "%" else (_code(m), 0)
        if scale:
            raw = bytes.fromhex(m[0].replace("%", ""))
            if MAGIC.search(raw):
                packed.append((m.start(), m.end(), raw))
            if raw.isascii():
                new = raw.decode()
        elif new is None:
            continue
        if m.start() > last:
            parts.append(text[last : m.start()])
            pieces.append((size, last, m.start(), 1))
            size += m.start() - last
        last = m.end()
        if new is not None:
            parts.append(new)
            pieces.append((size, m.start(), m.end(), scale))
            size += len(new)
            continue
        i = 0
        while i < len(raw):
            letter, n = _first_letter(raw[i : i + 4])
            parts.append(letter)
            pieces.append((size, m.start() + 3 * i, m.start() + 3 * (i + n), 0))
            size, i = size + 1, i + n
    if not size or not last:
        return None, packed
    if last < len(text):
        parts.append(text[last:])
        pieces.append((size, last, len(text), 1))
    return Unescaped(layer, "".join(parts), pieces), packed


#: Escapes of the letter that escapes begin with, as many as follow, are one.
ONE = re.compile(rf"%(?:25)+|\\(?:u005[cC])+|{ESCAPES}|(?:%[0-9A-Fa-f]{{2}}){{1,4}}")
STARTERS = frozenset("%\\&Uu")


def _settled(layer: Layer) -> Layer:
    """The layer with every escape decoded, and those that decoding makes, until none is left: one pass from left to right.

    What an escape gives is read again together with what stands beside it.
    """
    text, out, pieces, size = layer.text, [], [], 0
    behind: list[tuple[str, int, int]] = []  # the last letters read, which may begin an escape yet
    ahead: list[tuple[str, int, int]] = []  # letters to read before the text goes on, the next one last
    i = 0

    def settle(letters: list[tuple[str, int, int]]) -> None:
        nonlocal size
        for c, a, b in letters:
            out.append(c)
            pieces.append((size, a, b, 0))
            size += 1

    def decoded(m: re.Match) -> tuple[str | None, int]:
        if m[0][0] == "%" and m[0][1:3] != "25":
            letter, n = _first_letter(bytes.fromhex(m[0].replace("%", "")))
            return letter, 3 * n
        if m[0][0] == "%" or next((g for g in m.groups() if g is not None), None) is None:
            return m[0][0], len(m[0])
        return _code(m), len(m[0])

    def again() -> None:
        k = next((k for k, (c, _, _) in enumerate(behind) if c in STARTERS), len(behind))
        ahead.extend(reversed(behind[k:]))
        del behind[k:]

    while True:
        if ahead:
            window = "".join(c for c, _, _ in ahead[: -25 : -1]) + text[i : i + 24]
            m = ONE.match(window)
            new, n = decoded(m) if m else (None, 0)
            if new is None:
                behind.append(ahead.pop())
                if len(behind) > REACH:
                    settle([behind.pop(0)])
                continue
            a = ahead[-1][1]
            for _ in range(min(n, len(ahead))):
                b = ahead.pop()[2]
                n -= 1
            if n:
                i += n
                b = i
            ahead.append((new, a, b))
            again()
            continue
        m = ONE.search(text, i)
        end = m.start() if m else len(text)
        if end - i > REACH:
            settle(behind)
            behind.clear()
            out.append(text[i : end - REACH])
            pieces.append((size, i, end - REACH, 1))
            size, i = size + end - REACH - i, end - REACH
        behind += [(text[j], j, j + 1) for j in range(i, end)]
        settle(behind[:-REACH])
        del behind[:-REACH]
        i = end
        if m is None:
            settle(behind)
            return Unescaped(layer, "".join(out), pieces)
        new, n = decoded(m)
        if new is None:
            behind.append((text[i], i, i + 1))
            i += 1
            continue
        ahead.append((new, i, i + n))
        i += n
        again()


def _encoded(text: str) -> Iterator[list[tuple[int, int]]]:
    """All that may be a base64 run: its parts, more than one where it is wrapped."""
    for m in BASE64.finditer(text):
        yield [m.span()]
    for m in WRAPPED.finditer(text):
        parts = [x.span(1) for x in LINE.finditer(text, *m.span())]
        if max(b - a for a, b in parts) >= LEAST_RUN:
            yield parts


def _decoded(text: str, parts: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(first letter, letters, bytes) of a run read from each of its first four letters."""
    body = "".join(text[a:b] for a, b in parts).rstrip("=").translate(URLSAFE)
    for shift in range(4):
        own = body[shift : len(body) - ((len(body) - shift) % 4 == 1)]
        if len(own) >= 8:
            yield shift, len(body), binascii.a2b_base64(own + "=" * (-len(own) % 4))


def _wide(raw: bytes) -> Iterator[tuple[int, str]]:
    """(bytes before the first letter, text) of bytes of which every other one is zero, as UTF-16 has them."""
    if 3 * raw.count(0) > len(raw):
        for skip in (0, 1):
            yield skip, raw[skip::2].decode("latin-1")


class Stream:
    """Bytes that come a piece at a time and stand for one span: only the kinds of secrets in them are found.

    ``feed`` and ``close`` say what is to be done next with streams within this one, as
    (stream, bytes, None at its end), so that any number of layers need no recursion.
    """

    __slots__ = ("above", "buffer", "child", "key", "kinds", "met", "packer", "raw", "rest", "runs", "seen", "step", "steps")

    def __init__(self, kinds: set[int], met: set[bytes], raw: bool = False, steps: int = 0, above: Stream | None = None, key: bytes = b""):
        self.kinds, self.met, self.raw, self.steps, self.above, self.key = kinds, met, raw, steps, above, key
        self.buffer, self.rest, self.seen = b"", b"", 0
        self.packer = self.child = self.runs = self.step = None

    def feed(self, data: bytes) -> Iterator[tuple[Stream, bytes | None]]:
        self.buffer += SPACES.sub(SHORT, data)
        if len(self.buffer) - self.seen >= PIECE:
            yield from self._window(False)

    def close(self) -> Iterator[tuple[Stream, bytes | None]]:
        yield from self._window(True)
        for s in [self.child if self.packer else None, *([x for x, _ in self.runs] if self.runs else []), self.step]:
            if s is not None:
                yield s, None

    def _within(self, data: bytes, steps: int = 0) -> Iterator[tuple[Stream, bytes | None]]:
        """A stream of all of these bytes, unless they were met."""
        key = hashlib.sha256(data).digest()
        if key not in self.met:
            self.met.add(key)
            s = Stream(self.kinds, self.met, steps=steps, above=self)
            for i in range(0, len(data), CHUNK):
                yield s, data[i : i + CHUNK]
            yield s, None

    def _window(self, last: bool) -> Iterator[tuple[Stream, bytes | None]]:
        whole, fresh = self.buffer, self.seen
        yield from self._unpack(whole, fresh, last)
        if not self.raw:
            text = whole.decode("latin-1")
            if self.step is not None or (self.steps < STEPS and _escaped(text)):
                yield from self._unescape(whole, fresh, last)
            if self.runs is not None:
                yield from self._run_on(whole, fresh)
            if _hot(text):
                self.kinds.update(k for _, k, _ in scan(text))
                if self.steps == STEPS and _escaped(text):
                    yield from self._within(_narrow(_settled(Layer(text)).text), STEPS + 1)
                for parts in _encoded(text):
                    for _, _, raw in _decoded(text, parts):
                        if MAGIC.search(raw) or _hot(raw.decode("latin-1")) or 3 * raw.count(0) > len(raw):
                            yield from self._within(raw)
            for _, narrow in _wide(whole):
                if _hot(narrow):
                    yield from self._within(narrow.encode("latin-1"))
            if not last and self.runs is None and (m := BROKEN_RUN.search(text, max(0, len(text) - OVERLAP))) and len(m[0]) > OVERLAP // 2:
                start = len(text) - len(BROKEN_RUN.search(text)[0])
                self.runs = [(Stream(self.kinds, self.met, above=self), []) for _ in range(4)]
                for i, (_, held) in enumerate(self.runs):
                    held += [b"", i]
                yield from self._run_on(whole, start)
        self.buffer = b"" if last else whole[-OVERLAP:]
        self.seen = len(self.buffer)

    def _run_on(self, whole: bytes, fresh: int) -> Iterator[tuple[Stream, bytes | None]]:
        m = RUN_ON.match(whole, fresh)
        letters = m[0].translate(bytes.maketrans(b"-_", b"+/"), NO_LETTERS)
        for s, held in self.runs:
            own = held[0] + letters[held[1] :]
            held[1] = max(0, held[1] - len(letters))
            cut = len(own) if m.end() < len(whole) else len(own) // 4 * 4
            held[0] = own[cut:]
            own = own[: cut - (cut % 4 == 1)]
            if own:
                yield s, binascii.a2b_base64(own + b"=" * (-len(own) % 4))
        if m.end() < len(whole):
            for s, _ in self.runs:
                yield s, None
            self.runs = None

    def _unescape(self, whole: bytes, fresh: int, last: bool) -> Iterator[tuple[Stream, bytes | None]]:
        """What a step of escapes makes of the bytes that are new, as a stream that goes on with this one."""
        new = whole[fresh:]
        if self.step is None:
            self.step, new = Stream(self.kinds, self.met, steps=self.steps + 1, above=self), whole
        new = self.rest + new
        text, out, at = new.decode("latin-1"), [], 0
        stop = len(new) if last else max(0, len(new) - REACH)  # an escape may be broken off
        for m in ESCAPED.finditer(text):
            if m.start() >= stop:
                break
            out += [new[at : m.start()], bytes.fromhex(m[0].replace("%", "")) if m[0][0] == "%" else _narrow(_code(m) or m[0])]
            at = m.end()
        out.append(new[at:stop])
        self.rest = new[max(at, stop) :]
        data = b"".join(out)
        for i in range(0, len(data), CHUNK):
            yield self.step, data[i : i + CHUNK]

    def _unpack(self, whole: bytes, at: int, last: bool) -> Iterator[tuple[Stream, bytes | None]]:
        """What compressed bytes hold, member after member, as far as they aren't damaged."""
        if self.packer is None:
            at = max(0, at - 9)
        while True:
            if self.packer is None:
                m = MAGIC.search(whole, at)
                if m is None:
                    return
                at, rest = m.start() + 1, whole[m.start() :]
                key = hashlib.sha256(b"packed" + rest[:PIECE]).digest()
                if (last and key in self.met) or self._inside(key):
                    continue
                if last:
                    self.met.add(key)
                self.packer = {31: lambda: zlib.decompressobj(31), 66: bz2.BZ2Decompressor, 253: lzma.LZMADecompressor}.get(rest[0], zlib.decompressobj)()
                self.child = Stream(self.kinds, self.met, above=self, key=key)
            else:
                rest = whole[at:]
            done, packer, child = 0, self.packer, self.child
            try:
                data = rest
                while not packer.eof:
                    out = packer.decompress(data, CHUNK)
                    done += len(out)
                    if out:
                        yield child, out
                    data = getattr(packer, "unconsumed_tail", b"")
                    if not data and (packer.needs_input if hasattr(packer, "needs_input") else len(out) < CHUNK):
                        break
            except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
                self.packer = None
                yield child, None
                continue
            if not packer.eof:
                return
            self.packer = None
            yield child, None
            at = len(whole) - len(packer.unused_data)

    def _inside(self, key: bytes) -> bool:
        s: Stream | None = self
        while s is not None:
            if s.key == key:
                return True
            s = s.above
        return False


def kinds_within(raw: bytes) -> set[int]:
    """The kinds of secrets in what compressed bytes among these hold, however deep."""
    kinds: set[int] = set()
    stream = Stream(kinds, set(), raw=True)
    for i in range(0, len(raw), CHUNK):
        _driven(stream.feed(raw[i : i + CHUNK]))
    _driven(stream.close())
    return kinds


def _driven(first: Iterator[tuple[Stream, bytes | None]]) -> None:
    stack = [first]
    while stack:
        said = next(stack[-1], None)
        if said is None:
            stack.pop()
        else:
            stack.append(said[0].close() if said[1] is None else said[0].feed(said[1]))


def unwrap(layer: Layer, found: set[Span]) -> Iterator[Layer]:
    """Every layer directly below; what compressed bytes hold goes to ``found`` at once."""
    text = layer.text

    def packed(raw: bytes, a: int, b: int) -> None:
        start, end = layer.origin(a, b)
        found.update((start, k, end) for k in kinds_within(raw))

    if layer.steps <= STEPS and _escaped(text):
        if layer.steps == STEPS:
            below, runs = _settled(layer), []
        else:
            below, runs = _step(layer)
        for a, b, raw in runs:
            packed(raw, a, b)
        if below is not None:
            for m in BYTES.finditer(below.text) if not below.text.isascii() else ():
                # compressed bytes as escapes: from their beginning to the last escape
                piece = bisect_right(below.places, m.end() - 1) - 1
                while piece >= 0 and below.pieces[piece][3] == 1:
                    piece -= 1
                stop = below.places[piece + 1] if piece + 1 < len(below.places) else len(below.text)
                raw = below.text[m.start() : min(m.end(), stop)].encode("latin-1")
                if x := MAGIC.search(raw):
                    start, end = below.origin(m.start() + x.start(), m.start() + len(raw))
                    found.update((start, k, end) for k in kinds_within(raw[x.start() :]))
            yield below
    for parts in _encoded(text):
        for shift, letters, raw in _decoded(text, parts):
            run = Run(layer, parts, letters, shift, "", 1)
            if x := MAGIC.search(raw):
                start, end = layer.origin(run._place(shift + x.start() * 4 // 3), parts[-1][1])
                found.update((start, k, end) for k in kinds_within(raw[x.start() :]))
            for skip, narrow in _wide(raw):
                if _hot(narrow):
                    yield Run(layer, parts, letters, shift, narrow, 2, skip)
            try:
                inner, wide = raw.decode(), int(raw.isascii())
            except UnicodeDecodeError:
                inner, wide = raw.decode("latin-1"), 1
            if _hot(inner):
                yield Run(layer, parts, letters, shift, inner, wide)


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """(spans of the text itself, those with the spans of all layers), each by start, then kind."""
    base = sorted(scan(text))
    every, seen, work = set(base), set(), []
    if ENCODED.search(text):
        work.append(unwrap(Layer(text), every))
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        key = hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.origin(0, 1), layer.origin(len(layer.text) - 1, len(layer.text))
        if key in seen:  # the same content from the same place: a cycle, or two ways to one layer
            continue
        seen.add(key)
        for a, kind, b in scan(layer.text):
            start, end = layer.origin(a, b)
            every.add((start, kind, end))
        if ENCODED.search(layer.text):
            work.append(unwrap(layer, every))
    return base, sorted(every)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap or touch become one mark."""
    out, last = [], 0
    for a, b in merged(spans):
        out += [text[last:a], mark]
        last = b
    return "".join([*out, text[last:]])


def merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, the columns ``keep`` names, n_assign, n_access, n_hex, base, spans, and clean if asked for.

    base and spans: ``kind:start:end`` joined by commas, of the text itself and of all
    layers; offsets in code points. The counts are those of the text itself. ``clean``
    is the text with all spans replaced by a mark (a null text stays null). A null text
    counts as empty; repeated rows repeat; an empty table gives no rows; columns not
    named are not looked at, whatever their names.
    """
    keep = keep or []
    text = F.coalesce(F.col(text_col), F.lit(""))
    held: list[Column] = [F.col(id_col).alias("_id"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(1).alias("k")]).alias("_keep")]
    rows = docs.select(*held, F.when(text.rlike(WORTH), text).alias("_worth"), *([F.col(text_col).alias("_text")] if redact else []))
    schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("changed", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in text_slices(b, "_worth"):
                out: list[list] = [[] for _ in schema]
                for t in texts:
                    base, spans = find_all(t) if t else ([], [])
                    n = [sum(k == i for _, k, _ in base) for i in range(3)]
                    for o, x in zip(out, (*n, joined(base), joined(spans), redacted(t, spans) if redact and spans else None), strict=True):
                        o.append(x)
                made = table_of(schema, **dict(zip(schema.names, out, strict=True)))
                own = [i for i, c in enumerate(b.schema.names) if c != "_worth"]
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(start, len(texts)) for i in own], *made.columns], names=[*[b.schema.names[i] for i in own], *schema.names])

    kept = [f for f in rows.schema.fields if f.name != "_worth"]
    fields = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["n_assign long", "n_access long", "n_hex long", "base string", "spans string", "changed string"])
    out = rows.mapInArrow(trimmed(work), fields)
    names = [F.col(f"_keep.k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("_id").alias(id_col), *names, "n_assign", "n_access", "n_hex", "base", "spans", *([F.coalesce("changed", "_text").alias("clean")] if redact else []))
