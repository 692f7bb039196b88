"""The secret scan against plain regular expressions, and secrets hidden under layers."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import subprocess
import sys
import time
import urllib.parse
import zlib
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.llm import secrets

ROOT = Path(__file__).resolve().parents[2]
HEX40 = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
LINE = f'token = "{HEX40}"'


def plain(text):
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "PASSWORD", "api_key", "ſecret", "=", ": ", '"', " ", "abc123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "😀", "%41", "\\u0041", "x"]), max_size=14))
def test_base_spans(parts):
    text = "".join(parts)
    base, every = secrets.find_all(text)
    assert base == plain(text)
    assert set(base) <= set(every)


def hidden(text, shell, inner=LINE):
    """The span of the shell is reported for the secrets inside it."""
    base, every = secrets.find_all(text)
    start = text.index(shell)
    got = [(a, k, b) for a, k, b in every if (a, k, b) not in base]
    assert {k for _, k, _ in got} >= {k for _, k, _ in secrets.scan(inner)}, (text, every)
    assert all(start <= a < b <= start + len(shell) for a, _, b in got)
    return got


def b64(x):
    return base64.b64encode(x).decode()


def test_layers():
    url = urllib.parse.quote(LINE)
    twice = "".join(f"%{ord(c):02X}" for c in LINE)
    for shell in (b64(LINE.encode()), base64.urlsafe_b64encode(("é" + LINE).encode()).decode(), twice, urllib.parse.quote(twice), "".join(f"\\u{ord(c):04x}" for c in LINE), "".join(f"&#{ord(c)};" for c in LINE),
                  b64(gzip.compress(LINE.encode())), b64(zlib.compress(LINE.encode())), b64(b64(b64(LINE.encode()).encode()).encode()), b64(gzip.compress(gzip.compress(b64(url.encode()).encode()))), urllib.parse.quote(b64(LINE.encode()), safe="")):
        hidden(f"some 😀 prose. {shell} and more", shell)


def test_spans_are_mapped_to_the_letter():
    text = f"é {b64(b'abc' * 5 + LINE.encode() + b'xyz' * 3)}"
    (a, _, b), *_ = [x for x in secrets.find_all(text)[1] if x[1] == 2]
    cut = text[a:b]
    assert HEX40 in base64.b64decode(text[2:][: (b - 2 + 3) // 4 * 4]).decode() and len(cut) < 62
    part = "x %74%6F%6B%65%6E=abcdefg y"
    assert secrets.find_all(part)[1] == [(2, 0, 25)]


def test_cycles_and_repeats_end():
    shell = b64(LINE.encode())
    base, every = secrets.find_all(f"{shell} {shell}")
    assert not base and len({a for a, _, _ in every}) >= 2  # both places
    assert secrets.find_all("%25" * 50 + "41" * 3)[0] == []
    assert secrets.find_all("A" * 100_000 + "=" * 3) == ([], [])


def test_redaction():
    text = f"a {LINE} b token: secret99 c"
    assert secrets.redacted(text, secrets.find_all(text)[1]) == 'a [SECRET]" b [SECRET] c'


def test_documents(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, f"a {LINE}", "y"), (3, f"a {LINE}", "y"), (4, b64(LINE.encode()), "z"), (None, "clean", "z"), (5, "é" * 200_000 + " AKIA" + "A" * 16, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = secrets.find_secrets(df, redact=True)
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in got] == [(None, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0), (3, 1, 0, 1), (3, 1, 0, 1), (4, 0, 0, 0), (5, 0, 1, 0)]
    assert got[1].clean is None and got[3].clean == 'a [SECRET]"' and got[5].base == "" and got[5].spans.startswith("assign:0:")
    assert got[6].base == "access:200001:200021"
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_urlsafe_runs_are_whole():
    """With - or _ only after letter 16, where the standard alphabet would end."""
    for i in range(60):
        for inner in (f"abcdefghijklmnopq? password=hunter2hunter2 ok {i}".encode(), zlib.compress(f"{i} {LINE} {i * 7919}".encode())):
            shell = base64.urlsafe_b64encode(inner).decode()
            assert any(k == 0 for _, k, _ in secrets.find_all(f"see {shell} end")[1]), shell
    shell = base64.urlsafe_b64encode(b"abcdefghijklmnopq? password=hunter2hunter2 ok").decode()
    assert not {"-", "_"} & set(shell[:16]) and {"-", "_"} & set(shell[16:])
    for text in (f"key_{b64(LINE.encode())}", f"some-name-{b64(LINE.encode())}", f"path/{shell}"):  # the other alphabet's letters beside a run
        assert any(k == 0 for _, k, _ in secrets.find_all(text)[1]), text


SHELLS = [lambda t: "".join(f"\\U{ord(c):08x}" for c in t), lambda t: "".join(f"\\u{{{ord(c):x}}}" for c in t), lambda t: "".join(f"\\x{ord(c):02x}" for c in t), lambda t: "".join(f"\\u{ord(c):04X}" for c in t),
          lambda t: "".join(f"&#{ord(c)};" for c in t), lambda t: "".join(f"&#x{ord(c):x};" for c in t), lambda t: "".join(f"u+{ord(c):04x}" for c in t), lambda t: "".join(f"%{ord(c):02x}" for c in t), lambda t: b64(t.encode()), str]


def test_every_text_with_spans_is_looked_at(spark):
    """The filter in SQL lets through whatever the scan finds something in."""
    plain_texts = ["password=abcdef", "api_key: abcdef", "ApiKey=abcdef", "PASSWD = 'abcdef", "AKIA" + "A1" * 8, "0a" * 12]
    texts = [f(t) for t in plain_texts for f in SHELLS]
    assert all(secrets.find_all(t)[1] for t in texts)
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: secrets.joined(secrets.find_all(t)[1]) for i, t in enumerate(texts)}


def noise(n, seed=1):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma"]) + str(r.randrange(10**6)) for _ in range(n))


def test_wrapped_runs_are_one():
    long = f"{noise(12)} {LINE} {noise(12)}".encode()
    for inner in (long, gzip.compress(long), zlib.compress(long), lzma.compress(long)):
        for width, end in ((76, "\n"), (64, "\r\n"), (40, "\n  "), (16, "\n")):
            letters = b64(inner)
            shell = end.join(letters[i : i + width] for i in range(0, len(letters), width))
            for text in (f"\n\n{shell}\n\nend", f"key: {shell}\nend", f"Payload\n{shell}\nDone\n", f"-----BEGIN X-----\n{shell}\n-----END X-----"):
                assert {0, 2} <= {k for _, k, _ in secrets.find_all(text)[1]}, text
    (a, _, b), *_ = [x for x in secrets.find_all(f"\n{base64.encodebytes(long).decode()}")[1] if x[1] == 2]
    assert b - a < 60


def test_every_member_is_read():
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        for inner in (pack(b"nothing here") + pack(LINE.encode()), pack(b"a") + pack(b"b") + b"\0" * 8 + pack(LINE.encode()), pack(b"\xff\xfe\xfd" * 9) + pack(LINE.encode()), pack(b"nothing") + LINE.encode(), gzip.compress(pack(b"x") + pack(LINE.encode()))):
            assert {0, 2} <= {k for _, k, _ in secrets.find_all(f"see {b64(inner)} end")[1]}, (pack, inner)


def test_deep_layers_end():
    inner = LINE.encode()
    for _ in range(1500):
        inner = zlib.compress(inner, 0)
    assert {0, 2} <= {k for _, k, _ in secrets.find_all(b64(inner))[1]}


def test_large_layers_are_read_to_the_end(monkeypatch):
    monkeypatch.setattr(secrets, "PIECE", 1 << 13)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secrets, "CHUNK", 1 << 12)
    for lead in (0, 8170, 8191, 65_500, 130_000):
        for inner in (("é" * lead) + f" {LINE} " + "é" * 70_000, "x" * lead + " password" + " " * 5000 + "= hunter2hunter2 " + HEX40):
            for pack in (gzip.compress, lambda x: gzip.compress(bz2.compress(x))):
                assert {0, 2} <= {k for _, k, _ in secrets.find_all(b64(pack(inner.encode())))[1]}, lead


def test_long_runs_within_streams(monkeypatch):
    """An encoded run that is longer than a window, and what is compressed in it, is one run."""
    monkeypatch.setattr(secrets, "PIECE", 1 << 13)
    monkeypatch.setattr(secrets, "OVERLAP", 1 << 10)
    monkeypatch.setattr(secrets, "CHUNK", 1 << 12)
    r = random.Random(8)
    body = r.randbytes(60_000)
    for lead in (0, 3):
        for run in (b64(gzip.compress(body + LINE.encode())), b64(body + LINE.encode()), base64.encodebytes(bz2.compress(body + LINE.encode())).decode(), "".join(f"%{b:02x}" for b in gzip.compress(body[:20_000] + LINE.encode()))):
            text = b64(gzip.compress(f"{'-' * 9000} {'k' * lead}{run} {'-' * 9000}".encode()))
            assert {0, 2} <= {k for _, k, _ in secrets.find_all(text)[1]}, (lead, run[:20])


def wrapped(x):
    return base64.encodebytes(x).decode()


CODES = {
    "percent": lambda t: "".join(f"%{b:02X}" for b in t.encode()), "quote": lambda t: urllib.parse.quote(t, safe=""), "letters": lambda t: "".join(f"\\u{ord(c):04x}" if ord(c) < 65536 else c for c in t), "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    "base64": lambda t: b64(t.encode()), "urlsafe": lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("="), "wrapped": lambda t: wrapped(t.encode()), "path": lambda t: "/p/" + b64(t.encode()), "word": lambda t: "abcde" + b64(t.encode()),
    "gzip": lambda t: b64(gzip.compress(t.encode())), "zlib": lambda t: b64(zlib.compress(t.encode())), "bz2": lambda t: wrapped(bz2.compress(t.encode())), "xz": lambda t: b64(lzma.compress(t.encode())), "utf-16": lambda t: b64(t.encode("utf-16")), "utf-16-be": lambda t: b64(b"x" + t.encode("utf-16-be")),
    "binary": lambda t: b64(b"\x00\xff\x90\x01" + t.encode() + b"\xfe\x00"), "controls": lambda t: b64(b"\x01\x02\x03" * 9 + t.encode()), "members": lambda t: b64(gzip.compress(b"a") + bz2.compress(b"b") + gzip.compress(t.encode())), "percent of gzip": lambda t: "".join(f"%{b:02x}" for b in gzip.compress(t.encode())),
    "escapes of zlib": lambda t: "".join(f"\\x{b:02x}" for b in zlib.compress(t.encode())), "json lines": lambda t: wrapped(t.encode()).strip().replace("\n", "\\n"),
}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(sorted(CODES)), min_size=1, max_size=4), st.booleans())
def test_random_nestings(codes, prose):
    """Whatever is put around a secret, it is found, within the encoded part."""
    inner = f"é 😀 {LINE} x" if prose else LINE
    for c in codes:
        if len(inner) > 60_000:
            break
        inner = CODES[c](inner)
    inner = inner.strip()
    hidden(f"some 😀 prose\n\n{inner}\n\nand more", inner)


def test_single_codes():
    for c in CODES:
        shell = CODES[c](LINE).strip()
        hidden(f"some prose: {shell} and more", shell)


def brute_layers(text):
    """All that percent and letter escapes come to, one step at a time."""
    seen, work = {text}, [text]
    while work:
        t = work.pop()
        for new in (re.sub("(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("latin-1"), t), re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), t)):
            if new not in seen:
                seen.add(new)
                work.append(new)
    return seen


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["%25", "%5c", "%5C", "\\u005c", "\\u0025", "%", "\\", "25", "5c", "u0041", "41", "7", "0", "token=abcdef", "y", " "]), max_size=12))
def test_settling_agrees_with_steps(parts):
    """The last of all layers, made step by step, is what one pass makes; and its letters come from where they should."""
    text = "".join(parts)
    settled = secrets._settled(secrets.Layer(text))
    last = [t for t in brute_layers(text) if not secrets.ESCAPED.search(t)]
    assert settled.text in last
    if settled.text:
        spans = [settled.origin(i, i + 1) for i in range(len(settled.text))]
        assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a < b and b == c for (a, b), (c, _) in zip(spans, spans[1:] + [(len(text), 0)], strict=True))


def test_escapes_of_escapes_take_linear_time():
    for unit, head in (("25", "%"), ("u005c", "\\"), ("#x26;", "&"), ("5cu0025", "%")):
        text = head + unit * (1_000_000 // len(unit)) + " " + urllib.parse.quote(urllib.parse.quote(urllib.parse.quote(f"é{LINE}")))
        began = time.process_time()
        kinds = {k for _, k, _ in secrets.find_all(text)[1]}
        assert {0, 2} <= kinds and time.process_time() - began < 12, (unit, time.process_time() - began)


def test_bombs_are_read_in_bounded_memory():
    """A layer of 400 MB, with a secret at its end, in a process of its own."""
    code = f"""
import base64, resource, sys, zlib
sys.path.insert(0, {str(ROOT)!r})
from vellum.llm import secrets
c = zlib.compressobj(9, wbits=31)
out = [c.compress(b'0 ' * (1 << 19)) for _ in range(400)] + [c.compress({LINE.encode()!r}), c.flush()]
text = base64.b64encode(b''.join(out)).decode()
kinds = {{k for _, k, _ in secrets.find_all('x ' + text)[1]}}
print(sorted(kinds), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split("]")
    assert said[0] == "[0, 2" and int(said[1]) < 500


def test_compressed_cycles_end():
    """What unpacks to what it was unpacked from is not taken up again."""
    inside = secrets.Stream(set(), set(), above=secrets.Stream(set(), set(), key=hashlib.sha256(b"packed" + gzip.compress(b"x", mtime=0)).digest()))
    secrets._driven(inside.feed(gzip.compress(b"x", mtime=0)))
    secrets._driven(inside.close())
    assert inside.child is None


def test_every_escape_layer_is_scanned():
    """Hexadecimal letters behind k more percent escapes: each of the k + 1 layers has a run of its own, two letters shorter than that of the layer before."""
    for k in range(secrets.STEPS):
        text = "%" + "25" * k + "6a" * 12
        _, spans = secrets.find_all(text)
        assert {x for x in spans if x[1] == 2} == {(1 + 2 * j, 2, len(text)) for j in range(k + 1)}, k


def test_deeply_nested_escapes_end():
    """Many more layers than steps: the innermost text is scanned all the same, in bounded time."""
    text = "%" + "25" * 100_000 + "41 %70assword=hunter2hunter2"
    began = time.time()
    _, spans = secrets.find_all(text)
    assert any(k == 0 for _, k, _ in spans) and time.time() - began < 30
