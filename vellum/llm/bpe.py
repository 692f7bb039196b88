"""Byte-pair encoding by forced boundaries.

A merge can only join two bytes that lie side by side inside some token of the
vocabulary. Where two neighbouring bytes never do, no merge crosses, so the text can
be cut there for certain and both sides encoded on their own. White space is the
first such boundary (no token holds any), the pre-tokenizer's word ends are the
second, and inside a word every byte pair outside ``Vocabulary.inside`` is the third.
The fragments are encoded independently, each distinct one once, and concatenated.

Words keep their ids in a bounded table that is searched for a whole batch at once:
a word of up to 32 bytes is four integers read straight from the batch's bytes and
compared in full, so no Python object is made for words that are known.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from vellum.llm.columns import table_of, text_slices, trimmed

END = "</w>"
WORDS_KEPT = 600_000
LOADS = 4  # of 8 bytes a word
#: White space of the normalizer; str.split() also splits at U+001C to U+001F.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
NOT_SPACE = re.compile("[\\x1c-\\x1f]")
ASCII_PIECES = re.compile("\\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+", re.ASCII)
#: Letters up to U+02FF can be put into lower case before NFC, as nothing there composes; what bytes alone don't show as white space or not is left out.
WIDE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u0300-\\U0010ffff]")
CONTROL = re.compile("[\\x00-\\x20\\x7f]")
#: Marks a cut while fragments are made; no byte's letter.
CUT = "\u01ff"


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte: itself if printable in Latin-1, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """A BPE model file whose words end in ``</w>``, its certain cuts and its word cache."""

    def __init__(self, path: str, with_text: bool = False, words_kept: int = WORDS_KEPT):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        if model["end_of_word_suffix"] != END:
            raise ValueError("a vocabulary with </w> word ends is needed")
        self.whole = Tokenizer.from_file(path)
        self.token = {i: t for t, i in model["vocab"].items()}
        self.ends_word = np.zeros(max(self.token) + 1, np.int64)
        self.ends_word[[i for i, t in self.token.items() if t.endswith(END)]] = 1
        self.special = {x["content"]: x["id"] for x in said["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.inside = {a + b for t in model["vocab"] if t not in self.special for a, b in pairwise(t.removesuffix(END))}
        self.joined = np.zeros((512, 512), bool)  # by byte letters
        for a, b in self.inside:
            self.joined[ord(a), ord(b)] = True
        self.joined[[10, 32], :] = self.joined[:, [10, 32]] = True  # the separators of pieces and words
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.encoders = [self._encoder(model["vocab"], merges, end) for end in (None, END)]  # of inner and of last fragments
        self.with_text, self.words_kept = with_text, words_kept
        self._reset()

    @staticmethod
    def _encoder(vocab: dict[str, int], merges: list[tuple[str, str]], end: str | None) -> Tokenizer:
        t = Tokenizer(models.BPE(vocab=vocab, merges=merges, **({"end_of_word_suffix": end} if end else {})))
        t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return t

    def _reset(self) -> None:
        self.slots = np.full(1 << max(12, (2 * self.words_kept).bit_length()), -1, np.int32)
        self.keys = np.zeros((4096, LOADS), np.uint64)
        self.first, self.count = np.zeros(4096, np.int64), np.zeros(4096, np.int32)
        self.flat, self.used, self.entries = np.zeros(16384, "<u4"), 0, 0
        self.texts: list[bytes] = []
        self.long: dict[bytes, int] = {}
        names = [t.encode() for t in self.special]
        self._add(names, np.array(list(self.special.values()), "<u4"), np.ones(len(names), np.int64), names)

    def _add(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray, texts: list[bytes]) -> None:
        """New entries for words that have none; ids: of all of them, one after the other."""
        if not words:
            return
        e, n = self.entries, len(words)
        while e + n > len(self.first):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)])
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[e : e + n] = self.used + np.cumsum(counts) - counts
        self.count[e : e + n] = counts
        self.used += len(ids)
        self.entries += n
        self.texts += texts
        wide = 8 * LOADS
        long = [i for i, w in enumerate(words) if len(w) > wide]
        self.long |= {words[i]: e + i for i in long}
        self.keys[e : e + n] = np.frombuffer(b"".join([w[:wide].ljust(wide, b"\0") for w in words]), np.uint64).reshape(n, LOADS)
        new = np.setdiff1d(np.arange(e, e + n), e + np.array(long, np.int64)) if long else np.arange(e, e + n)
        at = _slot(self.keys[new], len(self.slots))
        while len(new):
            free = np.flatnonzero(self.slots[at] < 0)
            _, one = np.unique(at[free], return_index=True)  # of several for one slot the first gets it
            self.slots[at[free[one]]] = new[free[one]]
            rest = np.ones(len(new), bool)
            rest[free[one]] = False
            new, at = new[rest], (at[rest] + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        found, at, open_ = np.full(len(keys), -1, np.int64), _slot(keys, len(self.slots)), np.arange(len(keys))
        while len(open_):
            e = self.slots[at]
            full = e >= 0
            open_, at, e = open_[full], at[full], e[full]
            same = (self.keys[e] == keys[open_]).all(1)
            found[open_[same]] = e[same]
            open_, at = open_[~same], (at[~same] + 1) & (len(self.slots) - 1)
        return found

    def plain(self, text: str) -> str:
        """A text of the same words with nothing but ASCII white space between them."""
        if "<|" not in text and not WIDE.search(text):
            return text.lower()  # fewer distinct words; the same pieces
        out: list[str] = []
        for i, p in enumerate(self.split_special.split(text) if self.split_special else [text]):
            out += [p] if i % 2 else filter(None, SPACE.split(p))
        return " ".join(out)

    def pieces(self, words: list[str]) -> list[str]:
        """The pre-tokenizer's pieces of the words, normalised and in byte letters; a line feed ends each word.

        Sorts the list: words in ASCII first.
        """
        plain, other = [w for w in words if w.isascii()], [w for w in words if not w.isascii()]
        words[:] = plain + other
        out = ASCII_PIECES.findall("\n".join([*plain, ""]).lower())  # these bytes are their own letters, but for control characters
        if CONTROL.search("".join(plain)):
            out = [p if p == "\n" else "".join(BYTE_LETTERS[ord(c)] for c in p) for p in out]
        if other:
            last = 0
            for p, (start, end) in self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(" ".join(other))):
                if start > last:
                    out.append("\n")
                last = end
                out.append(p)
            out.append("\n")
        return out

    def learn(self, words: list[str]) -> None:
        """Encodes words that the cache lacks: all inner fragments in one call, all last ones in another."""
        if not words:
            return
        text = " ".join(self.pieces(words))
        letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
        cuts = np.flatnonzero(~self.joined[letters[:-1], letters[1:]]) + 1
        if len(cuts):
            text = np.insert(letters, cuts, ord(CUT)).astype("<u4").tobytes().decode("utf-32-le").replace(CUT, f"{CUT} ")
        frags = text.split(" ")
        ends = np.array([f == "\n" for f in frags])
        of = np.cumsum(ends)  # the word of each fragment
        inner = np.array([f[-1] == CUT for f in frags])
        ids, at = [], []
        for k, own in enumerate((inner, ~inner & ~ends)):
            places = np.flatnonzero(own)
            if len(places):
                text = " ".join([frags[i].rstrip(CUT) for i in places.tolist()])
                if k:  # each last fragment ends in a token that ends a word; the fast call has no other trace of them
                    e = self.encoders[k].encode_batch_fast([text], add_special_tokens=False)[0]
                    ids.append(np.array(e.ids, "<u4"))
                    over = self.ends_word[ids[-1]]
                    at.append(places[np.cumsum(over) - over])
                else:
                    e = self.encoders[k].encode(text, add_special_tokens=False)
                    ids.append(np.array(e.ids, "<u4"))
                    at.append(places[np.array(e.word_ids)])
        at_, ids_ = np.concatenate(at), np.concatenate(ids)
        order = np.argsort(at_, kind="stable")
        ids_ = ids_[order]
        counts = np.bincount(of[at_], minlength=len(words))
        texts: list[bytes] = []
        if self.with_text:
            tokens, start = [self.token[i] for i in ids_.tolist()], 0
            for stop in np.cumsum(counts).tolist():
                texts.append(" ".join(tokens[start:stop]).encode())
                start = stop
        self._add([w.encode() for w in words], ids_, counts, texts)

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray]]:
        """(ids as little-endian 32-bit integers, the words' entries) of each text."""
        lines = [self.plain(t).encode() for t in texts]
        whole = b"\n".join(lines) + b"\n" + bytes(8 * LOADS)
        size = len(whole) - 8 * LOADS
        raw = np.frombuffer(whole, np.uint8)
        kind = KINDS[raw[:size]]  # 1: white space, 2: a letter, 3: a full stop or comma, 0: others
        space = kind == 1
        edge = np.empty(size, bool)  # where a word begins if it is no space
        edge[0] = True
        edge[1:] = space[:-1]
        if size > 2:  # a letter, one such mark, white space: the mark is a word of its own
            edge[1:-1] |= (kind[:-2] == 2) & (kind[1:-1] == 3) & space[2:]
        starts = np.flatnonzero(edge & ~space)
        ends = np.flatnonzero(np.append(edge[1:] | space[1:], True) & ~space) + 1
        length = ends - starts
        loads = np.ndarray((len(whole) - 7,), "<u8", whole, strides=(1,))
        keys = np.empty((len(starts), LOADS), np.uint64)
        for j in range(LOADS):
            keys[:, j] = loads[np.minimum(starts + 8 * j, size)] & MASKS[np.clip(length - 8 * j, 0, 8)]
        entry = self._entries(whole, starts, ends, keys, length > 8 * LOADS)
        if entry is None:  # no room: start anew, with the words of this batch
            self._reset()
            entry = self._entries(whole, starts, ends, keys, length > 8 * LOADS)
        count = self.count[entry].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.first[entry] - upto[:-1], count) + np.arange(upto[-1])]
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield ids[upto[a] : upto[b]].tobytes(), entry[a:b]

    def _entries(self, whole: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, long: np.ndarray) -> np.ndarray | None:
        """The entry of each word, learning what isn't known; None if the table is full and not new."""
        entry = self.find(keys)
        words = [whole[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        entry[long] = [self.long.get(w, -1) for w in words]
        lack = np.flatnonzero(entry < 0)
        if len(lack):
            new = list({whole[a:b] for a, b in zip(starts[lack].tolist(), ends[lack].tolist(), strict=True)})
            if self.entries > len(self.special) and self.entries + len(new) > self.words_kept:
                return None
            if 2 * (self.entries + len(new)) > len(self.slots):  # one batch larger than the table
                self.words_kept = self.entries + len(new)
                self._reset()
                return self._entries(whole, starts, ends, keys, long)
            self.learn([w.decode() for w in new])
            entry[lack] = self.find(keys[lack])
            entry[long] = [self.long[w] for w in words]
        return entry

    def decoded(self, entries: np.ndarray) -> bytes:
        """The decoded text of words just encoded, in UTF-8: this model's decoder joins tokens by spaces."""
        return b" ".join(map(self.texts.__getitem__, entries.tolist()))


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(keys), np.uint64)
    for j in range(LOADS):
        h = (h ^ keys[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


KINDS = np.zeros(256, np.uint8)
KINDS[[9, 10, 11, 12, 13, 32]] = 1
KINDS[97:123] = 2
KINDS[[44, 46]] = 3
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
BYTE_LETTERS = byte_letters()


@cache
def vocabulary(path: str, with_text: bool = False) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path, with_text)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, ids (binary, little-endian 32-bit), decoded (binary, UTF-8).

    As the tokenizers library encodes without added special tokens; special tokens
    that a text holds are recognised, as there. A null text counts as empty and has no
    ids. Rows are independent: repeated rows repeat, an empty table gives no rows, and
    columns other than the two named ones are not looked at.
    """
    return _encoded(docs, path, id_col, text_col, digest=False)


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows with n_tokens, ids_sha256 and decoded_sha256 in place of the contents."""
    return _encoded(docs, path, id_col, text_col, digest=True)


def _encoded(docs: DataFrame, path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary"
    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digest else [("ids", pa.binary()), ("decoded", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, True)
        for b in batches:
            for start, texts in text_slices(b, "_text"):
                out: list[list] = [[] for _ in schema]
                for ids, entries in v.encode(texts):
                    text = v.decoded(entries)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()) if digest else (ids, text)
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
                made = table_of(schema, **dict(zip(schema.names, out, strict=True)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), *made.columns], names=["_id", *schema.names])

    return rows.mapInArrow(trimmed(encode), f"_id {kind.simpleString()}, {fields}").withColumnRenamed("_id", id_col)
