"""Token ids of whole texts, word by word, with a bounded memory of words.

The tokenizer's rules never reach across white space: its normaliser composes
and lower-cases within a word, its pattern holds no white space, and each piece
of that pattern is encoded by itself. So the ids of a text are those of its
white-space separated chunks in order, and a chunk seen before need not be
encoded again. Nor do they reach from a letter or digit to punctuation at the
chunk's end, so what is remembered of a chunk are these two pieces. Plain letters
and plain punctuation go straight to the library's BPE model; anything else goes
through the library's whole pipeline.

Texts are lower-cased before they are split, but the normaliser composes first:
where an ASCII capital is followed by combining marks (U+0300 to U+036F), its
lower case may compose otherwise, so such chunks keep their case till then. So do
chunks that may hold a special token, whose case counts.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np

#: Chunks remembered by one worker process, in each of two generations.
REMEMBERED = 100_000
#: Distinct pieces, and their bytes, after which those that did not recur are forgotten.
KNOWN, KNOWN_BYTES = 700_000, 24 << 20
#: Longer chunks are encoded each time.
LONGEST_KEY = 64
#: Bytes of texts that are split together, and words whose ids are gathered at once.
CHUNK, GATHERED = 12 << 20, 1 << 18
#: Bytes of pieces whose tokens exist at once as the library's objects.
TOKENIZED = 1 << 17

#: Lower-case letters of Latin-1 in UTF-8, then punctuation: the normaliser leaves both as they are.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*+)([!-/:-@\[-`{-~]*)").fullmatch
#: The same, but letters or punctuation alone.
_PURE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*+|[!-/:-@\[-`{-~]*+").fullmatch
#: Chunks that are not lower-cased before the library sees them; in RE2's syntax for Arrow below.
_CASED = re.compile(rb"<\||[A-Z][\x80-\xff]*(?:\xcc[\x80-\xbf]|\xcd[\x80-\xaf])").search
_CASED_RE2 = r"<\||[A-Z][^\x00-\x7F]*[\x{300}-\x{36F}]"
#: What may follow a chunk's last letter or digit.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Last bytes of pieces that marks may follow: of ASCII letters and digits, and of Latin-1's letters after 0xC3.
_ASCII_ENDS, _LATIN_ENDS = np.zeros(256, bool), np.zeros(256, bool)
_ASCII_ENDS[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_LATIN_ENDS[0x80:0xC0] = True
_LATIN_ENDS[[0x97, 0xB7]] = False


def _byte_chars() -> str:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(hidden)) for b in range(256))


class WordIds(dict):
    """Maps a chunk (UTF-8) to its ids as little-endian unsigned 16-bit integers."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        super().__init__()
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.tokenize = self.tokenizer.model.tokenize
        self.table = _byte_chars()
        self.bytes_of = [k.to_bytes(2, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.remembered = remembered
        self.older: dict[bytes, bytes] = {}
        # Distinct pieces of chunks of texts, their ids in ``flat``, and whether a later chunk held them.
        self.known, self.flat = pa.array([], pa.large_string()), np.zeros(0, "<u2")
        self.first, self.sizes, self.again = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool)

    def _piece(self, word: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[t.id] for t in self.tokenize(codecs.charmap_decode(word, "strict", self.table)[0])])

    def _encode(self, chunk: bytes) -> bytes:
        if m := _PLAIN(chunk):
            word, marks = m.groups()
            if not marks:
                return self._piece(chunk)
            # The word may be known without its marks, and the marks recur.
            known = self.get(word) or self.older.get(word) or (self._piece(word) if word else b"")
            return known + (self.get(marks) or self._piece(marks))
        ids = self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self._encode(chunk)
        if len(chunk) <= LONGEST_KEY:
            if len(self) >= self.remembered:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found

    def ids(self, text: bytes) -> np.ndarray:
        """The ids of a whole text, without an end id."""
        words = [x if _CASED(x) else x.lower() for x in text.split()] if _CASED(text) else text.lower().split()
        return np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2").astype("<u4")

    def each(self, texts, end_id: int, chunk: int = CHUNK) -> Iterator[np.ndarray]:
        """The ids of each text of an Arrow string column, with an end id; null counts as empty.

        Texts are split together and each distinct word of about ``chunk`` bytes is
        looked up once; the ids then are gathered by the words' numbers. Larger
        chunks take less time and some ten times their size of memory.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + chunk, "right")))
            yield from self._chunk(texts.slice(at, end - at), end_id)
            pa.default_memory_pool().release_unused()
            at = end

    def _encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some pieces, one after another, and how many each has."""
        sizes, flat, ends = [np.zeros(0, np.int32)], [np.zeros(0, "<u2")], np.cumsum(list(map(len, pieces)))
        at = 0
        while at < len(pieces):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKENIZED, "right")))
            found = [
                self.tokenize(codecs.charmap_decode(x, "strict", self.table)[0]) if _PURE(x) else self.tokenizer.encode(x.decode(), add_special_tokens=False).ids
                for x in pieces[at:end]
            ]
            sizes.append(np.fromiter(map(len, found), np.int32, len(found)))
            flat.append(np.array([t if type(t) is int else t.id for x in found for t in x], "<u2"))
            at = end
        return np.concatenate(flat), np.concatenate(sizes)

    def _forget(self) -> None:
        """Makes room for pieces: those found again since the last time stay, if they leave half of it."""
        import pyarrow as pa

        stay = np.flatnonzero(self.again)
        kept = self.known.take(pa.array(stay))
        if 2 * len(kept) > KNOWN or 2 * kept.nbytes > KNOWN_BYTES:
            stay = stay[:0]
            kept = self.known.take(pa.array(stay))
        sizes = self.sizes[stay]
        self.flat = _gathered(self.flat, self.first[stay], sizes)
        self.known, self.first, self.sizes, self.again = kept, _starts(sizes), sizes, np.zeros(len(stay), bool)

    def _numbers(self, pieces) -> np.ndarray:
        """The number of each of some distinct pieces (an Arrow array) among those with ``first`` and ``sizes``."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > KNOWN or self.known.nbytes > KNOWN_BYTES:
            self._forget()
        at = pc.index_in(pieces, value_set=self.known)
        fresh = pieces.filter(pc.is_null(at))
        flat, sizes = self._encode_all(fresh.cast(pa.large_binary()).to_pylist())
        out = pc.fill_null(at, -1).to_numpy().copy()
        new = out < 0
        self.again[out[~new]] = True
        out[new] = len(self.known) + np.arange(len(sizes), dtype=np.int32)
        self.first = np.append(self.first, _starts(sizes) + np.int32(len(self.flat)))
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, flat)
        self.again = np.append(self.again, np.zeros(len(sizes), bool))
        self.known = pa.concat_arrays([self.known, fresh])
        return out

    def _words(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some distinct words (an Arrow array), one after another, and how many each has."""
        coded = _pieces(words).dictionary_encode()
        of = self._numbers(coded.dictionary)[coded.indices.to_numpy()]
        sizes = self.sizes[of]
        return _gathered(self.flat, self.first[of], sizes), sizes[::2] + sizes[1::2]

    def _chunk(self, texts, end_id: int) -> Iterator[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        special = pc.match_substring_regex(texts, _CASED_RE2)
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(special, "", texts)))
        ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
        coded = words.flatten().dictionary_encode()
        flat, sizes = self._words(coded.dictionary)
        words = coded.indices.to_numpy()
        flat, sizes = np.append(flat, np.uint16(end_id)), np.append(sizes, np.int32(1))
        first = _starts(sizes)
        every = np.insert(words, ends, np.int32(len(sizes) - 1))  # the end id after each text's words
        parts = []
        for at in range(0, len(every), GATHERED):
            some = every[at : at + GATHERED]
            parts.append(_gathered(flat, first[some], sizes[some]))
        ids = np.concatenate(parts)
        stops = np.cumsum(np.r_[0, sizes[words]])[ends] + np.arange(1, len(texts) + 1)
        at = 0
        for stop, odd, text in zip(stops.tolist(), special.to_pylist(), texts, strict=True):
            yield np.append(self.ids(text.as_py().encode()), end_id).astype("<u2") if odd else ids[at:stop]
            at = stop


def _starts(sizes: np.ndarray) -> np.ndarray:
    return (np.cumsum(sizes) - sizes).astype(np.int32)


def _gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``first``, one after another."""
    return flat[np.repeat(first - _starts(sizes), sizes) + np.arange(int(sizes.sum()))]


def _pieces(words):
    """For each word of an Arrow array without nulls: what its last letter or digit ends, and the marks after it.

    A word that ends otherwise is the first piece, and nothing the second.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(words)
    if not n:
        return words
    words = pa.concat_arrays([words])  # from offset 0
    _, offsets, data = words.buffers()
    at, of = np.frombuffer(offsets, "<i8", n + 1), np.append(np.frombuffer(data or b"", "u1"), np.uint8(0))
    size = pc.binary_length(pc.ascii_rtrim(words, characters=_MARKS)).to_numpy()
    cut = at[:-1] + size
    last, before = of[np.maximum(cut - 1, 0)], of[np.maximum(cut - 2, 0)]
    parted = (size == 0) | _ASCII_ENDS[last] | ((before == 0xC3) & _LATIN_ENDS[last])
    ends = np.empty(2 * n + 1, "<i8")
    ends[::2], ends[1::2] = at, np.where(parted, cut, at[1:])
    return pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(ends), data)


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One instance a worker process and vocabulary file."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = WordIds(path)
    return _KEPT[path]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)
