"""Texts cut where public tokenizers always end a token, so that each distinct piece is encoded once.

A cut stands before a space or a line feed that follows no white space and that stands before a visible character. The
byte-level tokenizer's pattern ends a match there: of a run of white space it leaves the last sign to what follows, or
matches it alone. The piece tokenizer has no piece with a space behind another character, and none with a line feed
beside the single byte's. A byte that could begin white space of other scripts counts as not visible: there is no cut.

Chunks that begin at a cut and end in no white space can stand one behind another in one text that is encoded as a
whole; its ids are dealt back to the chunks by the lengths of their bytes. The others are encoded alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from talentlake.llm._util import _SPACE

#: First bytes of UTF-8 sequences among which there is white space.
_UNSURE = np.zeros(256, bool)
_UNSURE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_VISIBLE = ~_SPACE & ~_UNSURE
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True


def cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of chunks, chunks per text) of texts, given by their bytes and offsets. Empty texts have no chunk."""
    n = len(raw)
    begin = np.zeros(n, bool)
    if n > 2:
        begin[1:-1] = _GAP[raw[1:-1]] & ~_SPACE[raw[:-2]] & _VISIBLE[raw[2:]]
    filled = offsets[:-1] < offsets[1:]
    ends = offsets[1:][filled] - 1  # a text's last byte has nothing visible behind it
    begin[ends] = False
    begin[offsets[:-1][filled]] = True
    at = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(at, offsets))
    return np.append(at, n), counts


def strings(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The chunks as an Arrow array over the same bytes."""
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def joinable(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Which chunks can stand among others in one text."""
    size = np.diff(cuts)
    first, second, last = raw[cuts[:-1]], raw[np.minimum(cuts[:-1] + 1, len(raw) - 1)], raw[cuts[1:] - 1]
    return (size > 1) & _GAP[first] & _VISIBLE[second] & ~_SPACE[last]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of runs of given starts and lengths, one run after another."""
    upto = np.cumsum(counts, dtype=np.int64) - counts
    return np.repeat(starts - upto, counts) + np.arange(int(counts.sum()))


class ByteTokens:
    """The byte-level tokenizer: ids of text, and the bytes of each id."""

    def __init__(self, path: str, special: bool):
        """special: whether strings of special tokens inside texts are those tokens."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        signs = byte_signs()
        entries = [b""] * self.tokenizer.get_vocab_size()
        for entry, i in self.tokenizer.get_vocab().items():
            entries[i] = bytes(signs[c] for c in entry) if all(c in signs for c in entry) else entry.encode()
        self.bytes = Bytes(entries)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)


class PieceTokens:
    """The piece tokenizer, which adds a space to its text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.space = self.model.piece_to_id("▁")
        self.bytes = Bytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.model.id_to_piece, range(n)))])

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text that begins with a space or a line feed."""
        if text[0] == " ":
            return np.array(self.model.encode(text[1:], num_threads=1), np.int32)
        out = np.array(self.model.encode(text, num_threads=1), np.int32)
        if out[0] != self.space:
            raise ValueError("the piece model joins its space with a line feed")
        return out[1:]


class Bytes:
    """The bytes of ids."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.start[ids], self.size[ids])]


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin bytes are themselves, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}
