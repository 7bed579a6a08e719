"""Exact, fast token ids from the ``tokenizers`` library inside Python workers.

Both public vocabularies cut text with a pattern whose matches never run from
a visible character into following white space, nor from a letter or digit into
following punctuation (other than an apostrophe).  A text may therefore be cut
at these places and each chunk encoded alone: the ids of the text are the ids
of its chunks in order.  Cuts are found on the bytes of an Arrow column, whose
chunks are then dictionary-encoded, so a chunk that recurs in a batch is met
once; a bounded memo answers those that recur across batches, and only unseen
ones reach the library.  Texts with the lead-in of special tokens are passed
whole to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The lead-in of special tokens, which sends a text to the library whole.
_SPECIAL = "<|"
#: Punctuation before which a chunk may be cut; no apostrophe, which begins contractions.
_PUNCTUATION = b".,!?;:*&%$#|\"()-/"
#: Words that go to the library in one line.
_LINE = 64
#: Bytes of text encoded together.
BYTES_AT_ONCE = 8 << 20

#: Chunks in one generation of the memo; two generations are held (about 200
#: bytes a chunk).
MEMO_ENTRIES = 300_000


def _flags(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE = _flags([*range(9, 14), 32])
_ALNUM = _flags(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PUNCT = _flags(_PUNCTUATION)
#: Last bytes of white space outside ASCII, and separators that some take for it.
_MAYBE_SPACE = _flags([*range(0x1C, 0x20), *range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
#: Second bytes of U+00C0 to U+00FF that are letters.
_LATIN = _flags(x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7))


def _after_space(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places follow white space outside ASCII or a separator."""
    a, b, c = raw[at - 1], raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    pair = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    triple = ((c == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((c == 0xE1) & (b == 0x9A)) | ((c == 0xE3) & (b == 0x80))
    return (a < 0x20) | pair | triple


def chunk_starts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where chunks begin in the bytes of texts that end at ``ends``."""
    begin = np.zeros(len(raw) + 1, bool)
    space = _SPACE[raw]
    at = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    doubt = np.flatnonzero(_MAYBE_SPACE[raw[at - 1]])
    begin[at] = True
    if len(doubt):
        begin[at[doubt[_after_space(raw, at[doubt])]]] = False
    at = np.flatnonzero(_PUNCT[raw[1:]]) + 1
    a, b = raw[at - 1], raw[np.maximum(at - 2, 0)]
    # U+0100 to U+017F are letters, but a normaliser turns U+0130 into a letter and a mark.
    further = ((b == 0xC4) & (a >= 0x80) & (a != 0xB0)) | ((b == 0xC5) & (a >= 0x80))
    begin[at[_ALNUM[a] | ((b == 0xC3) & _LATIN[a]) | further]] = True
    begin[ends[ends < len(raw)]] = True
    begin[:1] = True
    return np.flatnonzero(begin[: len(raw)])


class _Places(dict):
    """Places of known chunks; -1 for others."""

    def __missing__(self, chunk: str) -> int:
        return -1


class ChunkEncoder:
    """Encode texts to ``numpy.uint32`` ids, equal to the library's own ids.

    ``spaces_matter`` is true for byte-level vocabularies, whose tokens carry
    their leading space, and false where the normaliser drops white space.
    Chunks used in the running or the previous generation stay known.
    """

    def __init__(self, path: str, spaces_matter: bool, memo_entries: int = MEMO_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.no_padding()
        self._tok.no_truncation()
        self._spaces = spaces_matter
        self._room = memo_entries
        # Byte-level tokens that begin a word carry a mark, or those that end one do.
        self.size = self._tok.get_vocab_size(with_added_tokens=True)
        names = [self._tok.id_to_token(k) or "" for k in range(self.size)]
        self._mark = np.array([x[:1] == "Ġ" if spaces_matter else x.endswith("</w>") for x in names])
        self._old: tuple[_Places, np.ndarray, np.ndarray] = (_Places(), np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._young = self._old
        self._turn()

    def _turn(self) -> None:
        """Start a generation: the running one becomes the previous one."""
        self._old = self._young
        self._young = (_Places(), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def settle(self) -> None:
        """Let the previous generation go, as at a task's end: an idle worker holds one generation."""
        self._old = (_Places(), np.zeros(0, np.uint32), np.zeros(1, np.int64))

    def _learn(self, chunks: list[str]) -> None:
        """Make distinct chunks known, from the previous generation or the library."""
        old = self._old[0]
        at = np.fromiter(map(old.__getitem__, chunks), np.int64, len(chunks))
        moved = np.flatnonzero(at >= 0).tolist()
        words: list[str] = []
        keys: list[str] = []
        rest: list[str] = []
        for k in np.flatnonzero(at < 0).tolist():
            c = chunks[k]
            w = self._word(c)
            if w:
                keys.append(c)
                words.append(w)
            else:
                rest.append(c)
        done, sizes, new = self._encode_words(words)
        rest += [keys[k] for k in np.flatnonzero(~done).tolist()]
        ids: list[list[int]] = []
        for lo in range(0, len(rest), 4096):
            ids += [e.ids for e in self._tok.encode_batch_fast(rest[lo : lo + 4096], add_special_tokens=False)]
        known = at[moved]
        old_n = self._old[2][known + 1] - self._old[2][known]
        n = np.concatenate([old_n, sizes, np.fromiter(map(len, ids), np.int64, len(ids))])
        flat = [_gather(self._old[1], self._old[2][known], old_n), new, np.fromiter(chain.from_iterable(ids), np.uint32)]
        self._add([*(chunks[k] for k in moved), *(keys[k] for k in np.flatnonzero(done).tolist()), *rest], np.concatenate(flat), n)

    def _word(self, chunk: str) -> str:
        """What stands for the chunk in a line of words, each of which has one mark; or nothing.

        Where spaces matter: one space and then no other white space at either
        end; the first token of such a chunk, and no other, begins with a space.
        Else: letters only, which are one cut of the tokenizer's pattern.
        """
        if self._spaces:
            return chunk if chunk[:1] == " " and len(chunk) > 1 and not chunk[1].isspace() and not chunk[-1].isspace() else ""
        word = chunk.strip(" \t\n\v\f\r")
        return word if word.isalpha() else ""

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encode words a line at a time; marks in the vocabulary tell them apart.

        Every word has a mark at least, so a line with as many marks as words has one each.
        Returns which words are done, their numbers of ids, and the ids.
        """
        glue = "" if self._spaces else " "
        lines = [words[lo : lo + _LINE] for lo in range(0, len(words), _LINE)]
        done, sizes, flat = np.ones(len(words), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for k, (line, e) in enumerate(zip(lines, self._tok.encode_batch_fast([glue.join(x) for x in lines], add_special_tokens=False))):
            ids = np.array(e.ids, np.uint32)
            marks = np.flatnonzero(self._mark[ids])
            if len(marks) == len(line):
                cuts = np.append(marks, len(ids)) if self._spaces else np.concatenate([[0], marks + 1])
                sizes.append(np.diff(cuts))
                flat.append(ids)
            else:  # these words are encoded one by one
                done[k * _LINE : k * _LINE + len(line)] = False
        return done, np.concatenate(sizes), np.concatenate(flat)

    def _add(self, chunks: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        known, flat, ends = self._young
        used, rows = int(ends[len(known)]), len(known)
        known.update(zip(chunks, range(rows, rows + len(chunks))))
        if used + len(ids) > len(flat):
            flat = np.concatenate([flat[:used], np.zeros(used // 2 + len(ids), np.uint32)])
        if len(known) + 1 > len(ends):
            ends = np.concatenate([ends[: rows + 1], np.zeros(rows // 2 + len(chunks), np.int64)])
        flat[used : used + len(ids)] = ids
        ends[rows + 1 : rows + 1 + len(chunks)] = used + np.cumsum(n)
        self._young = (known, flat, ends)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as the empty text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_ended(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode_column`` with ``end_id`` after each text."""
        ids, ends = self.encode_column(texts)
        return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin and end; null counts as empty."""
        texts = texts.fill_null("")
        special = pc.match_substring(texts, _SPECIAL)
        if not pc.any(special).as_py():
            return self._plain(texts)
        whole = {i: np.array(self._tok.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in np.flatnonzero(special).tolist()}
        ids, ends = self._plain(pc.if_else(special, "", texts))
        parts = [whole[i] if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = _bytes_of(texts)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = chunk_starts(raw, ends)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        keys = chunks.dictionary.to_pylist()
        which = chunks.indices.to_numpy(zero_copy_only=False)
        known = self._young[0]
        at = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(known) + len(new) > self._room:
                self._turn()
                known, new = self._young[0], np.arange(len(keys))
            self._learn([keys[i] for i in new.tolist()])
            at[new] = np.fromiter((known[keys[i]] for i in new.tolist()), np.int64, len(new))
        _, flat, stops = self._young
        first, n = stops[at], stops[at + 1] - stops[at]
        n = n[which]
        ids = _gather(flat, first[which], n)
        upto = np.concatenate([[0], np.cumsum(n)])
        return ids, upto[np.searchsorted(starts, ends)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column without nulls, and where each text begins and ends."""
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: int, most: int = BYTES_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``most`` bytes; a longer text has its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``flat[start:start+length]`` one after another."""
    total = int(lengths.sum())
    if not total:
        return flat[:0]
    kind = np.int32 if max(len(flat), total) < 1 << 31 else np.int64
    before = np.cumsum(lengths) - lengths
    at = np.repeat((starts - before).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return flat[at]


_held: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, spaces_matter: bool) -> ChunkEncoder:
    """The worker's own encoder; Python workers are reused between tasks."""
    key = (path, spaces_matter)
    if key not in _held:
        _held.clear()  # one memo a worker
        _held[key] = ChunkEncoder(path, spaces_matter)
    return _held[key]
