"""Token ids by the ``tokenizers`` library, with a bounded memory of words met before.

Both vocabularies used here split a text at blanks before any merge, so the ids
of a text are the ids of its blank-delimited units one after another.  Arrow
splits a batch into units and finds the distinct ones; a worker asks the library
for each of these once and remembers the answer, since text repeats most of its
words.  The rule that splits runs of white space looks across units, so texts
with such runs, or with white space other than blanks and newlines, go to the
library whole.  So do texts that hold the string of a special token, which the
library reads as that token.  A vocabulary that drops white space and case is asked for units
without the capitals of ASCII and without a last comma or full stop.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units in a worker's younger memory; when it is full it becomes the older one, whose
#: units move back as they are met.  About 200 bytes a unit, twice so many in all.
CACHE_UNITS = 450_000
#: Texts are looked up together until they have so many bytes.
CHUNK_BYTES = 8_000_000
#: Longer units are not remembered.
CACHE_CHARS = 64

#: Marks units that no blank precedes.
_BARE = "\x01"
_WHOLE = r"[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|[ \n]\z"
#: Letters of Latin that keep their number of code points in lower case and are composed.
_LATIN = re.compile("(?s) ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Byte-level vocabularies write printable bytes as themselves and the others as the characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_coders: dict[tuple[str, bool], "Coder"] = {}


@functools.cache
def _ends_in_mark() -> str:
    """Letters and digits that end in something else in lower case or composed form, as a class of RE2: the dotted capital I, and letters that composition takes apart."""
    plain = lambda c: unicodedata.category(c)[0] in "LN"
    last = lambda c: (unicodedata.normalize("NFC", c).lower()[-1], unicodedata.normalize("NFC", c.lower())[-1])
    return "".join(f"\\x{{{i:x}}}" for i in range(128, 0x32000) if plain(c := chr(i)) and not all(map(plain, last(c))))


def _apart(texts: pa.Array) -> pa.Array:
    """The texts with a blank before commas and full stops that end a word; such marks are tokens of their own unless other marks precede them."""
    joined = pc.match_substring_regex(texts, rf"(?:[^\pL\pN]|[{_ends_in_mark()}])[.,](?: |\z)")
    apart = pc.replace_substring(pc.replace_substring(texts, ", ", " , "), ". ", " . ")
    return pc.if_else(joined, texts, apart)


class Coder:
    """``keeps_blanks``: the vocabulary has tokens for white space, as byte-level ones do."""

    def __init__(self, path: str, keeps_blanks: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", t) for t in special)
        self.keeps_blanks = keeps_blanks
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _ask_whole(self, texts: list[str]) -> list[bytes]:
        self.tokenizer.encode_special_tokens = False
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ask(self, texts: list[str]) -> list[bytes]:
        """Words of plain Latin letters are one piece each and go to the merges directly; the others go through the whole tokenizer.  A unit is never a special token."""
        self.tokenizer.encode_special_tokens = True
        out: list = [None] * len(texts)
        merged, other = self.tokenizer.model.tokenize, []
        for i, text in enumerate(texts):
            if _LATIN.fullmatch(text) and (self.keeps_blanks or text[0] != " "):
                piece = (text if self.keeps_blanks else text.lower()).encode().decode("latin-1").translate(_BYTES)
                ids = [t.id for t in merged(piece)]
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                other.append(i)
        if other:
            for i, e in zip(other, self.tokenizer.encode_batch_fast([texts[i] for i in other], add_special_tokens=False)):
                ids = e.ids
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (none null) one after another, and where each text's begin and the last one's end."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ids, ends, at = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        while at < len(texts):
            so_far = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, so_far + CHUNK_BYTES, "right")))
            own, off = self._chunk(texts.slice(at, end - at))
            ends.append(off[1:] + ends[-1][-1])
            ids.append(own)
            at = end
        return np.concatenate(ids), np.concatenate(ends)

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rules = [r for r in (_WHOLE if self.keeps_blanks else "", self.special) if r]
        whole = pc.match_substring_regex(texts, "|".join(rules)) if rules else pa.array(np.zeros(len(texts), bool))
        units = pc.if_else(whole, "", texts)
        if self.keeps_blanks:
            marked = pc.binary_join_element_wise(_BARE, units, "")
            ids, off = self._by_units(pc.replace_substring(marked, "\n", f" \n {_BARE}"))
        else:
            ids, off = self._by_units(_apart(pc.ascii_lower(pc.replace_substring(units, "\n", " "))))
        odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, off
        parts = [ids[a:b] for a, b in zip(off, off[1:])]
        for i, own in zip(odd.tolist(), self._ask_whole(texts.take(pa.array(odd)).to_pylist())):
            parts[i] = np.frombuffer(own, "<u4")
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _by_units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        parts = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int32, len(parts)) >> 2
        flat = np.frombuffer(b"".join(parts), "<u4")
        start = np.cumsum(size, dtype=np.int64) - size
        n = size[codes]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        at = np.repeat((start[codes] - ends[:-1]).astype(np.int32), n) + np.arange(ends[-1], dtype=np.int32)
        offsets = lists.offsets.to_numpy()
        return flat[at], ends[offsets - offsets[0]]

    def _ids_of(self, units: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_UNITS:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        out = list(map(known.get, units))
        new = []
        for i, ids in enumerate(out):
            if ids is None:
                u = units[i]
                if (ids := before.get(u)) is None:
                    new.append(i)
                else:
                    known[u] = out[i] = ids
        texts = [units[i] for i in new]
        if self.keeps_blanks:
            texts = [u[1:] if u[:1] == _BARE else u if u == "\n" else " " + u for u in texts]
        for i, ids in zip(new, self._ask(texts)):
            out[i] = ids
            if len(units[i]) <= CACHE_CHARS:
                known[units[i]] = ids
        return out


def coder(path: str, keeps_blanks: bool) -> Coder:
    """This worker's coder for a vocabulary file."""
    if (path, keeps_blanks) not in _coders:
        _coders[path, keeps_blanks] = Coder(path, keeps_blanks)
    return _coders[path, keeps_blanks]
