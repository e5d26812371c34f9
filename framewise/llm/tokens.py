"""Token ids of whole texts with a public tokenizer, each piece of text looked up once per worker."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .scan import batch_bytes, slices, span_hashes

#: Pieces kept by a worker; beyond it the table is begun anew. Only speed depends on it.
PIECES_KEPT = 4_000_000
#: Before a single blank between two characters that are no white space.
_CUT = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
_BLANK, _BREAK, _LETTER, _DIGIT, _SIGN, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x20], _KIND[0x0A] = _BLANK, _BREAK
_KIND[0x21:0x7F] = _SIGN
_KIND[0x27] = _OTHER  # apostrophes: both tokenizers know contractions
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x80:0xC0] = _KIND[0xC3:0xCA] = _LETTER  # letters from U+00C0 to U+024F in UTF-8

_encoders: dict[str, "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "PieceEncoder":
    """The encoder of this worker process for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path, added_tokens=True)
    return _encoders[path]


class PieceEncoder:
    """Same ids as the library gives for the whole text.

    With ``added_tokens`` the content of an added token, such as ``<|endoftext|>``, becomes its
    id as in the library; without, it is plain text. ``encoder`` asks for the former.

    Both the word and the byte-level tokenizers end a word where letters, signs
    and digits meet and before a blank, so the ids of a text are those of its
    pieces one after the other. Pieces are found and hashed (64 bits) for many
    texts at once. Texts with other characters, or with blanks and line breaks
    in a row, are cut at single blanks only and given to the library, and so
    are texts that hold an added token, which are not cut in or beside it.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # pieces hold no added token, and put together they must not
        added = self.library.get_added_tokens_decoder().values() if added_tokens else []
        self.added = sorted((t.content for t in added if t.content), key=len, reverse=True)
        # what is looked for in the normalized text cannot be found in the bytes
        self.never_cut = self.library.normalizer is not None and any(t.normalized for t in added)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # hashes in order
        self.first = np.zeros(0, np.int32)  # where the ids of each begin
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, self.dtype)
        self.used = 0

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column, in order; null is empty."""
        data, at = batch_bytes(column)
        for a, b in slices(at):
            yield from self._some(data[at[a] : at[b]], at[a : b + 1] - at[a])

    def _some(self, data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        kind = _KIND[data]
        wrong = np.flatnonzero(kind == _OTHER)
        pair = kind[:-1] <= _BREAK
        pair &= kind[1:] <= kind[:-1]  # a blank before a blank, a break before a break
        pair |= (kind[:-1] == _BLANK) & (kind[1:] == _BREAK)
        lead, then = data[:-1], data[1:]
        pair |= (lead == 0xC3) & ((then == 0x97) | (then == 0xB7)) | (lead == 0xC9) & (then >= 0x90)
        held = np.array(self._added_in(data), np.int64)
        wrong = np.concatenate([wrong, np.flatnonzero(pair), held])
        filled = np.flatnonzero(at[1:] > at[:-1])
        plain = np.ones(len(at) - 1, bool)
        plain[filled[kind[at[filled + 1] - 1] == _BLANK]] = False
        plain[np.searchsorted(at, wrong, "right") - 1] = False
        special = np.full(len(at) - 1, self.never_cut)
        special[np.searchsorted(at, held, "right") - 1] = True
        plain &= ~special
        begins = np.empty(len(data), bool)
        begins[1:] = (kind[1:] <= _BREAK) | (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
        begins[at[:-1][at[:-1] < len(data)]] = True
        if not plain.all():
            begins[np.repeat(~plain, np.diff(at))] = False
        starts = np.flatnonzero(begins)
        text_of = np.searchsorted(at, starts, "right") - 1
        ends = np.append(starts[1:], len(data))
        ends = np.minimum(ends, at[text_of + 1]) if len(starts) else ends[:0]
        row = self._rows(data, starts, ends)
        count = self.count[row]
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids[np.repeat(self.first[row] - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(starts, at)]
        for i in range(len(at) - 1):
            if plain[i]:
                yield flat[bounds[i] : bounds[i + 1]]
            else:
                yield self._odd(data[at[i] : at[i + 1]].tobytes().decode(), bool(special[i]))

    def _added_in(self, data: np.ndarray) -> list[int]:
        """Where the bytes of added tokens begin; one that runs on into the next text does no harm."""
        found, raw = [], data.tobytes() if self.added else b""
        for content in self.added:
            content = content.encode()
            i = raw.find(content)
            while i >= 0:
                found.append(i)
                i = raw.find(content, i + 1)
        return found

    def _odd(self, text: str, special: bool = False) -> np.ndarray:
        if not special:
            parts = _CUT.split(text)
        elif self.never_cut:
            parts = [text]
        else:
            parts = self._around_added(text)
        out = []
        self.library.encode_special_tokens = not special
        for i in range(0, len(parts), 10_000):
            found = self.library.encode("".join(parts[i : i + 10_000]), add_special_tokens=False)
            out.append(np.array(found.ids, self.dtype))
        self.library.encode_special_tokens = True
        return np.concatenate(out)

    def _around_added(self, text: str) -> list[str]:
        """``text`` cut at single blanks, but not in an added token or beside it."""
        spans = sorted((m.start(), m.start() + len(c)) for c in self.added for m in re.finditer(f"(?={re.escape(c)})", text))
        starts = np.array([a - 1 for a, _ in spans])
        ends = np.maximum.accumulate(np.array([b for _, b in spans]))
        cuts = np.array([m.start() for m in _CUT.finditer(text)], np.int64)
        before = np.searchsorted(starts, cuts, "right") - 1
        free = cuts[(before < 0) | (cuts > ends[np.maximum(before, 0)])] if len(spans) else cuts
        edges = [0, *free.tolist(), len(text)]
        return [text[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each piece its row in the table, learning new ones."""
        hashes = span_hashes(data, starts, ends)
        different, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, different)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != different if len(self.keys) else np.ones(len(different), bool)
        if new.any():
            if len(self.keys) + new.sum() > PIECES_KEPT:
                self._forget()
                new[:] = True
            self._learn(data, different[new], starts[one[new]], ends[one[new]])
            at = np.searchsorted(self.keys, different)
        return at[which]

    def _learn(self, data, keys, starts, ends) -> None:
        word = (data[starts] == 0x20) & (_KIND[data[np.minimum(starts + 1, len(data) - 1)]] == _LETTER)
        order = np.argsort(~word, kind="stable")  # words with a blank first
        keys, starts, ends, n = keys[order], starts[order], ends[order], int(word.sum())
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids, counts = [], []
        for i in range(0, n, 4000):
            part = pieces[i : min(i + 4000, n)]
            found = self.library.encode("".join(part), add_special_tokens=False)
            at = np.array(found.word_ids)
            sizes = np.diff(np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]]))
            if len(sizes) != len(part):  # never seen; each by itself then
                each = self.library.encode_batch_fast(part, add_special_tokens=False)
                sizes, found_ids = [len(e.ids) for e in each], [x for e in each for x in e.ids]
            else:
                found_ids = found.ids
            ids.append(np.array(found_ids, self.dtype))
            counts.append(np.asarray(sizes, np.int64))
        for i in range(n, len(pieces), 4000):
            each = self.library.encode_batch_fast(pieces[i : i + 4000], add_special_tokens=False)
            ids.append(np.array([x for e in each for x in e.ids], self.dtype))
            counts.append(np.array([len(e.ids) for e in each], np.int64))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = (self.used + np.cumsum(counts) - counts).astype(np.int32)
        self.used += len(ids)
        back = np.argsort(keys)
        place = np.searchsorted(self.keys, keys[back])
        self.keys = np.insert(self.keys, place, keys[back])
        self.first = np.insert(self.first, place, first[back])
        self.count = np.insert(self.count, place, counts[back].astype(np.int32))
