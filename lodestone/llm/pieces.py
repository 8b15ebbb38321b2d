"""SentencePiece encoding and decoding by a shared-prefix Viterbi search.

Distinct marked words (a word with the mark of the space before it) are sorted,
which makes them a trie in depth-first order: a word keeps the forward entries
of the prefix that it shares with the one before and only adds its own. The
entry of a prefix is the score of its best path, the sum of its pieces' scores,
with the path's last piece.

In a unigram vocabulary the best path is the one of highest score. In one of
the BPE kind, as the one at hand, it is the one that greedy merging takes: the
prefixes before a piece boundary are encoded as in the whole, and a sequence of
pieces is the encoding of its text exactly if each two neighbours are the
encoding of theirs. So there a piece extends a path only if it may follow the
path's last piece, and one path a prefix is left. Characters without a piece
are coded by their bytes, at ``UNKNOWN`` below the least score.

Words are encoded once a worker and kept in a bounded memory; nothing is
shuffled.

Defined results: a null text is empty and an empty text has no ids; repeated
rows each get a row; an empty table gives an empty table; further columns are
ignored. Decoding restores the text, but for the mark U+2581 itself, which
stands for a space.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame

from lodestone.llm.wordids import LONGEST_KEY, crc_of, vocabulary

MARK = "▁"
REMEMBERED = 700_000
#: Characters of text whose words are sorted together.
TOGETHER = 4_000_000
#: What a character without a piece scores below the worst piece (fixed value).
UNKNOWN = 10.0
UNIGRAM, BPE = 1, 2  # kinds of models, as their files number them (fixed values)
_SHORT = (2, 1)
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(data: bytes):
    """(number, value) of a serialised message's fields: integers and bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            value, shift, at = value | (b & 127) << shift, shift + 7, at + 1
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def kind_of(model: bytes) -> int:
    """A model file's kind: the third field of its second one, the trainer's settings; unigram where it is not said."""
    return next((v for n, settings in _fields(model) if n == 2 for k, v in _fields(settings) if k == 3), UNIGRAM)


class Pieces:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = kind_of(model.serialized_model_proto())
        if kind not in (UNIGRAM, BPE):
            raise ValueError("the model is neither unigram nor BPE")
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [model.unk_id()] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.bytes_of.append(piece.encode())
        if any(MARK in p.lstrip(MARK) for p in self.ids) or len(self.bytes_of) > 1 << 16:
            raise ValueError("pieces must hold the mark at their start only, and ids fit 16 bits")
        self._set_up(kind == UNIGRAM, remembered)

    @classmethod
    def of(cls, scores: dict[str, float], unigram: bool, remembered: int = REMEMBERED) -> Pieces:
        """From pieces with their scores, numbered as they come after the 256 bytes."""
        out = cls.__new__(cls)
        out.score, out.ids = dict(scores), {p: 256 + k for k, p in enumerate(scores)}
        out.byte_ids, out.bytes_of = list(range(256)), [bytes([b]) for b in range(256)] + [p.encode() for p in scores]
        out._set_up(unigram, remembered)
        return out

    def _set_up(self, unigram: bool, remembered: int) -> None:
        self.unigram, self.unknown = unigram, min(self.score.values()) - UNKNOWN
        # Of each three characters, how long the pieces are that end in them; any two or one may be a piece.
        sizes: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 2:
                sizes.setdefault(p[-3:], set()).add(len(p))
        self.sizes = {tail: (*sorted(found, reverse=True), *_SHORT) for tail, found in sizes.items()}
        self.whole_newline = any("\n" in p for p in self.ids)
        self.follows: dict[tuple[str, str], bool] = {}
        self.remembered, self.words, self.older = remembered, {}, {}

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best pair first, of equals the leftmost."""
        return self._merge(list(text), 0)

    def _merge(self, parts: list[str], edge: int) -> list[str]:
        """Merges ``parts``; with an edge, a number of parts, gives none if a merge goes over it."""
        get, none = self.score.get, -math.inf
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > none:
            k = pairs.index(best)
            if edge:
                if k == edge - 1:
                    return []
                edge -= k < edge
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k < len(pairs):
                pairs[k] = get(parts[k] + parts[k + 1], none)
            if k:
                pairs[k - 1] = get(parts[k - 1] + parts[k], none)
        return parts

    def may_follow(self, before: str, piece: str) -> bool:
        key = (before, piece)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 500_000:
                self.follows.clear()
            merged = self._merge([*before, *piece], len(before))
            known = self.follows[key] = merged == ([before, piece] if before else [piece])
        return known

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Ids of each of ``words``, which are sorted and distinct."""
        # Of the best path of the first d characters: its score forward[d] and its last piece last[d].
        forward: list[float] = [0.0]
        last: list[str] = [""]
        before, out = "", []
        ids, score_of, unknown, unigram, sizes_of = self.ids, self.score.get, self.unknown, self.unigram, self.sizes.get
        follows, may_follow = self.follows, self.may_follow
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], forward[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, own = -math.inf, ""
                for size in sizes_of(word[end - 3 : end], _SHORT) if end > 2 else _SHORT:
                    start = end - size
                    if start < 0:
                        continue
                    piece = word[start:end]
                    score = score_of(piece)
                    if score is None:
                        if size > 1:
                            continue
                        score = unknown
                    if unigram:
                        if forward[start] + score > best:
                            best, own = forward[start] + score, piece
                        continue
                    key = (last[start], piece)
                    ok = follows.get(key)
                    if may_follow(*key) if ok is None else ok:
                        best, own = forward[start] + score, piece
                        break
                if not own:
                    raise AssertionError(f"no piece ends {word[:end]!r}")
                forward.append(best)
                last.append(own)
            pieces, end = [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            found: list[int] = []
            for p in reversed(pieces):
                i = ids.get(p)
                if i is None:
                    found += [self.byte_ids[b] for b in p.encode()]
                else:
                    found.append(i)
            out.append(found)
            before = word
        return out

    def units(self, text: str) -> list[str]:
        """Marked words whose encodings in a row are the text's encoding."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            units = _UNIT.findall(MARK + text.replace(" ", MARK))
        else:
            units = [MARK + w for w in text.split(" ")]
        if "\n" not in text or self.whole_newline:
            return units
        out = []
        for u in units:  # no piece holds a line's end with anything else
            if "\n" in u:
                out += [x for x in re.split("(\n)", u) if x]
            else:
                out.append(u)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        units = [self.units(t) for t in texts]
        distinct = set().union(*units)
        missing = distinct - self.words.keys()
        if len(self.words) + len(missing) > self.remembered:
            self.older, self.words = self.words, {}
            missing = distinct
        kept = {u: self.older[u] for u in missing & self.older.keys()}
        new = sorted(missing - kept.keys())
        kept |= {u: np.array(i, "<u2").tobytes() for u, i in zip(new, self.encode_sorted(new), strict=True)}
        known = self.words | kept if any(len(u) > LONGEST_KEY for u in kept) else self.words
        self.words.update((u, i) for u, i in kept.items() if len(u) <= LONGEST_KEY)
        return [np.frombuffer(b"".join(map(known.__getitem__, us)), "<u2") for us in units]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = data.decode(errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One instance a worker process and model file."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def together(texts: list[str]):
    """Runs of texts of about ``TOGETHER`` characters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= TOGETHER:
            yield some
            some, size = [], 0
    if some:
        yield some


def _map(docs: DataFrame, make, schema: str, model: str | None) -> DataFrame:
    path = model or vocabulary("piece_bpe_32k.model")

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            keys, at = b.column(0), 0
            for some in together([t or "" for t in b.column(1).to_pylist()]):
                rows = [make(p, t, ids) for t, ids in zip(some, p.encode(some), strict=True)]
                columns = [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), *columns], names=names)
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids) of each row of ``docs`` (doc_id, text)."""
    return _map(docs, lambda p, t, ids: (ids.astype("i4"),), "doc_id long, ids array<int>", model)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of each row of ``encoded`` (doc_id, ids); null ids give a null text."""
    path = model or vocabulary("piece_bpe_32k.model")

    def run(batches):
        import pyarrow as pa

        p = pieces(path)
        for b in batches:
            texts = [None if i is None else p.decode(np.array(i, "i4")) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, restored): restored tells if decoding the ids gives the text."""

    def row(p, text, ids):
        return len(ids), crc_of(ids), p.decode(ids) == text.replace(MARK, " ")

    return _map(docs, row, "doc_id long, n_tokens long, ids_crc32 long, restored boolean", model)
