"""Texts to token ids with a public tokenizer, exact and cached by word.

A byte-level pre-tokenizer never lets a token cross from a character that isn't white space to one that is, and what
follows such a place doesn't depend on what came before. So texts are cut at their spaces and line ends, and Arrow finds
the distinct words of a group of texts. A word of letters and marks behind them is two pieces to the pre-tokenizer; each
distinct piece goes once to the library's BPE model, any other word to the whole tokenizer. The ids of words are
gathered from those of pieces, and those of texts from those of words.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps for each encoder, in columns of about 40 bytes a piece; the half that was met last stays.
CACHE_PIECES = 300_000
#: Bytes of the texts that are encoded together; a longer text is a group of its own.
GROUP_BYTES = 4_000_000
#: Pieces of more characters aren't kept.
LONG_PIECE = 64
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")
#: A line end or nothing, letters, and marks that follow them without starting a piece of their own with an apostrophe.
_LETTERS_AND_MARKS = "^(?P<line>\n?)(?P<letters>[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte: itself where it is printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class Encoder:
    """Encodes with one tokenizer file and keeps pieces that it met: their text, with a leading space if they have one, the
    start of their ids in `pool` and the group of texts that met them last."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        how = str(self.tokenizer.pre_tokenizer)
        self.cuttable = "ByteLevel(" in how and self.tokenizer.normalizer is None
        self.pieces = self.cuttable and how.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in how and str(self.tokenizer.model).startswith("BPE(")
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = pa.array([], pa.string())
        self.starts, self.met, self.pool = np.zeros(1, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4")
        self.group = 0
        self.newline = self._whole("\n")

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        return next(self.encode_all(pa.array([text], pa.string())))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The same for each text of a column, in order."""
        for at, n in groups(texts):
            yield from self._together(texts.slice(at, n))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of what the pre-tokenizer leaves whole, a leading space included."""
        if piece.isascii():
            letters = "\u0120" + piece[1:] if piece[0] == " " else piece
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where the ids of each of many distinct pieces start and end in it."""
        self.group += 1
        at = pc.index_in(pieces, value_set=self.known)
        new = pc.is_null(at)
        place, unmet = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).copy(), new.to_numpy(zero_copy_only=False)
        learnt = pieces.filter(new)
        ids = [self._piece(p) for p in strings(learnt)]
        sizes = np.array(list(map(len, ids)), dtype=np.int32) // 4
        self.met[place[~unmet]] = self.group
        place[unmet] = len(self.known) + np.arange(len(learnt), dtype=np.int32)
        pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), dtype="<u4")])
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.known, self.pool, self.starts = pa.concat_arrays([self.known, learnt]), pool, starts
        self.met = np.concatenate([self.met, np.full(len(learnt), self.group, dtype=np.int32)])
        if len(self.known) > CACHE_PIECES:
            self._forget()
        return pool, starts[place], starts[place + 1]

    def _forget(self) -> None:
        """Leaves the half of the cache that was met last; long pieces go too, so that bytes are bounded."""
        short = np.flatnonzero(pc.less_equal(pc.binary_length(self.known), LONG_PIECE).to_numpy(zero_copy_only=False))
        stay = np.sort(short[np.argsort(-self.met[short], kind="stable")[: CACHE_PIECES // 2]])
        sizes = np.diff(self.starts)[stay]
        data, stops = _gathered(self.pool, self.starts[:-1][stay], sizes, np.arange(len(stay)))
        self.pool, self.starts = np.frombuffer(data, dtype="<u4"), np.concatenate([[0], stops]).astype(np.int32)
        self.known, self.met = self.known.take(pa.array(stay)), self.met[stay]

    def _other(self, unit: str, space: str) -> bytes | None:
        """The ids of a word that isn't letters and marks; nothing if there is white space but for a line end before it."""
        line = unit[:1] == "\n"
        word = unit[1:] if line else unit
        if not word or "\n" in word or _OTHER_SPACE.search(word):
            return None
        return self.newline + self._whole(word) if line else self._whole(space + word)

    def _together(self, texts: pa.Array) -> list[bytes]:
        if not self.cuttable:
            return [self._odd(t) for t in texts.to_pylist()]
        units = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        places = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(units), 0).to_numpy(zero_copy_only=False))])
        units = units.flatten().dictionary_encode()
        of, distinct = units.indices.to_numpy(zero_copy_only=False), units.dictionary
        first = places[:-1][np.diff(places) > 0]  # a text's first word has no space before it
        heads = distinct.take(pa.array(of[first]))
        of = of.copy()
        of[first] = len(distinct) + np.arange(len(first))
        spaced = np.arange(len(distinct) + len(heads)) < len(distinct)
        distinct = pa.concat_arrays([distinct, heads])
        pool, starts, sizes, none = self._words(distinct, spaced)
        del units, distinct, heads
        data, stops = _gathered(pool, starts, sizes, of)
        ends = 4 * np.concatenate([[0], stops])[places]
        out = [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        odd = set(np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(none[of])])[places])).tolist())
        for s in self.specials:
            odd.update(np.flatnonzero(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)).tolist())
        for k in odd:
            out[k] = self._odd(texts[k].as_py())
        return out

    def _words(self, words: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words one after the other, where each one's start, how many they are, and which words need the long way."""
        parts = pc.extract_regex(words, _LETTERS_AND_MARKS) if self.pieces else pa.nulls(len(words), pa.struct([(c, pa.string()) for c in ("line", "letters", "marks")]))
        plain = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        line, letters, marks = (pc.struct_field(parts, c).filter(pa.array(plain)) for c in ("line", "letters", "marks"))
        line = pc.equal(line, "\n").to_numpy(zero_copy_only=False)
        space = pc.if_else(pa.array(spaced[plain] & ~line), " ", "")
        letters = pc.binary_join_element_wise(space, letters, "").dictionary_encode()
        marks = marks.dictionary_encode()
        others = np.flatnonzero(~plain)
        found = [self._other(w, " " if s else "") for w, s in zip(words.take(pa.array(others)).to_pylist(), spaced[others].tolist())]
        none = np.zeros(len(words), dtype=bool)
        none[others] = [f is None for f in found]
        pool, from_, to = self._pieces(letters.dictionary)
        rest = [b"", self.newline, *[self._piece(m) if m else b"" for m in marks.dictionary.to_pylist()], *[f or b"" for f in found]]
        stops = len(pool) + np.cumsum([len(r) // 4 for r in rest], dtype=np.int64)
        starts = np.concatenate([from_, [len(pool)], stops[:-1]]).astype(np.int32)
        sizes = np.concatenate([to, stops]).astype(np.int32) - starts
        pool = np.concatenate([pool, np.frombuffer(b"".join(rest), dtype="<u4")])
        n = len(from_)
        three = np.full((len(words), 3), n, dtype=np.int32)
        three[plain, 0] = n + line
        three[plain, 1] = letters.indices.to_numpy(zero_copy_only=False)
        three[plain, 2] = marks.indices.to_numpy(zero_copy_only=False) + (n + 2)
        three[others, 0] = n + 2 + len(marks.dictionary) + np.arange(len(others))
        data, stops = _gathered(pool, starts, sizes, three.reshape(-1))
        stops = stops[2::3]
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int32)
        return np.frombuffer(data, dtype="<u4"), starts, (stops - starts).astype(np.int32), none

    def _odd(self, text: str | None) -> bytes:
        """Texts that the short way doesn't suit: empty, with a special token's string, or with other white space."""
        return self._whole(text) if text else b""


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray, of: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The runs of `pool` that `of` names, one after the other, and where each ends."""
    n = sizes[of]
    stops = np.cumsum(n, dtype=np.int64)
    total = int(stops[-1]) if len(stops) else 0
    at = np.repeat((starts[of] - (stops - n)).astype(np.int32), n)
    at += np.arange(total, dtype=np.int32)
    return pool[at].tobytes(), stops


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of a column's texts of about `most` bytes; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    stops, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(stops[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(stops, before + most, side="right")))
        yield at, stop - at
        at = stop


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; one call for all is far cheaper than one for each."""
    if not len(column):
        return []
    size = pc.sum(pc.binary_length(column)).as_py()
    if size < 1 << 30:
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column), "\0")[0].as_py().split("\0")
        if len(joined) == len(column):
            return joined
    return column.to_pylist()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
