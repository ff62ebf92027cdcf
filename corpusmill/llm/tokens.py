"""Token ids of whole texts, from a public tokenizer file.

A byte-level tokenizer first splits a text into words, each with at most one space before it, and then encodes every
word by itself. A text may be cut before a space, around a line end, and between a Latin letter and a run of marks:
these always part words where at most two white spaces stand together, so the ids of the pieces, joined, are the ids
of the text. Cutting and numbering the pieces run outside Python; each distinct piece is looked up once a batch, and
new ones go to the library in one call. Texts with other white space, or that spell a special token, are encoded by the
library as they stand.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces (about 180 bytes each) and ids that a worker keeps before it forgets the later pieces, or all.
KEPT_PIECES, KEPT_IDS = 900_000, 15_000_000
#: Stands between pieces; a text that holds it is left to the library.
CUT = "\x01"
#: A letter (all of them are, for any regular-expression library) and marks that no word of letters holds; an
#: apostrophe is none, as a contraction holds it.
LETTER_MARKS = r"([a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}])([!-&(-/:-@\[-`{-~]+)"
#: Three white spaces together, two at the end of the text, or whatever any library might call white space.
ODD = r"[ \n]{3}|[ \n]{2}$|[\x00-\x09\x0B-\x1F\x7F-\xA0\x{180E}\x{1680}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}-\x{206F}\x{3000}\x{FEFF}]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """ids_of(texts): for each text its ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]  # the library looks for these first
        self.odd = "|".join([ODD, *(re.sub(r"([^\w\s])", r"\\\1", t) for t in special if t)])
        self.byte_level = "ByteLevel" in str(self.lib.pre_tokenizer) and self.lib.normalizer is None
        self._reset()

    def _reset(self) -> None:
        # the ids of all known pieces, one after the other; a piece's number leads to its start and size there
        self.known: dict[str, int] = {"": 0}
        self.starts, self.sizes = np.zeros(1, np.int32), np.zeros(1, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def plain(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Numbers new pieces in their order."""
        ids = [e.ids for e in self.lib.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + total))
        self.flat[self.used : self.used + total] = np.fromiter((x for e in ids for x in e), np.uint32, total)
        self.starts = np.r_[self.starts, self.used + np.cumsum(sizes, dtype=np.int32) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.used += total
        n = len(self.known)
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def _forget(self) -> None:
        """Keeps the pieces met first, which are the frequent ones."""
        n = KEPT_PIECES // 2
        self.known = {p: i for p, i in self.known.items() if i < n}
        self.starts, self.sizes = self.starts[:n].copy(), self.sizes[:n].copy()
        self.used = int(self.starts[-1] + self.sizes[-1])
        self.flat = self.flat[: self.used].copy()

    def ids_of(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        if not self.byte_level or (pc.sum(pc.binary_length(column)).as_py() or 0) < 2000:
            return [self.plain(t) if t else b"" for t in column.to_pylist()]
        odd = pc.match_substring_regex(column, self.odd)
        cut = pc.replace_substring(pc.if_else(odd, "", column), " ", CUT + " ")
        cut = pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}")
        cut = pc.replace_substring_regex(cut, LETTER_MARKS, rf"\1{CUT}\2")
        split = pc.split_pattern(cut, CUT)
        coded = split.values.dictionary_encode()
        codes, bounds = coded.indices.to_numpy(), split.offsets.to_numpy()
        pieces = coded.dictionary.to_pylist()
        if self.used > KEPT_IDS:
            self._reset()
        elif len(self.known) + len(pieces) > KEPT_PIECES:
            self._forget() if len(pieces) < KEPT_PIECES // 2 < len(self.known) else self._reset()
        known = self.known
        if new := [p for p in pieces if p not in known]:
            self._learn(new)
        number = np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))
        starts, sizes = self.starts[number], self.sizes[number]
        per = sizes[codes]
        ends = np.cumsum(per, dtype=np.int64)
        take = np.repeat((starts[codes] - (ends - per)).astype(np.int32), per)
        take += np.arange(len(take), dtype=np.int32)
        flat = memoryview(self.flat[take]).cast("B")
        cuts = 4 * np.r_[0, ends][bounds]
        out = [bytes(flat[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self.plain(column[k].as_py())
        return out

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]


def runs(column: pa.Array, rows: int = 3000, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a column of texts that hold so many rows and bytes at most (or a single row)."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    a = 0
    while a < len(sizes):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right"))
        b = min(max(b, a + 1), a + rows)
        yield a, min(b, len(sizes))
        a = b


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
