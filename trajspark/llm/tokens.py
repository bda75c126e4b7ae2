"""Token ids of whole texts by a public byte-level BPE, with each distinct word encoded once.

A byte-level BPE first cuts a text into pre-tokens, and no id reaches over a cut. If white space never stands
next to white space, these places are cuts: before a space, before and after a newline, and between a letter or
digit and the punctuation after it. So a text is a row of chunks: words with the space before them (none at
the start of a text or line), punctuation with what follows it, and newlines. The bytes of a slice of texts tell the
places of all cuts, and its chunks are ranges of these bytes, which Arrow numbers without a copy of the texts;
only chunks that the worker has not met go to the tokenizer, joined to one text: words by the spaces that begin
them, others by newlines. Texts with neighbouring white space, and texts with a special token, which the library finds
before it cuts, are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed value: characters that some regex engine takes as white space.
WHITE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
UNSAFE = f"{WHITE}{WHITE}"
PUNCTUATION = b".,;:!?)]\"*#$%&|"
#: Chunks that a worker remembers, about 200 bytes each; with more it starts anew.
CACHED_CHUNKS = 700_000
#: Bytes of texts that are encoded at a time.
SLICE_BYTES = 4 << 20
#: Chunks that are joined for the tokenizer at a time.
JOINED = 500
#: Why a byte is the first of a chunk: it is a space or newline, the byte before it is a newline, it is punctuation after
#: an ASCII letter or digit, or after another character, which must be looked at. BEFORE is of the byte, AFTER of the one before it.
SPACE, NEWLINE, PLAIN, OTHER = 1, 2, 4, 8


def _byte_table(kinds: dict[int, bytes], always: int) -> np.ndarray:
    table = np.full(256, always, np.uint8)
    for kind, those in kinds.items():
        table[list(those)] |= kind
    return table


BEFORE = _byte_table({SPACE: b" \n", PLAIN | OTHER: PUNCTUATION}, NEWLINE)
AFTER = _byte_table({NEWLINE: b"\n", PLAIN: bytes(i for i in range(128) if chr(i).isalnum()), OTHER: bytes(range(128, 256))}, SPACE)


@cache
def _letters() -> np.ndarray:
    """Which characters under 2^16 are letters or digits."""
    points = [i for i in range(1 << 16) if not 0xD800 <= i < 0xE000]
    out = np.zeros(1 << 16, bool)
    out[points] = pc.match_substring_regex(pa.array(map(chr, points), pa.string()), r"[\pL\pN]").to_numpy(zero_copy_only=False)
    return out


def _after_letter(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter or digit of two or three bytes stands before each place; longer ones are none."""
    last, middle, first = (b[np.maximum(at - k, 0)].astype(np.int32) for k in (1, 2, 3))
    two = (middle & 0xE0) == 0xC0
    three = ~two & ((first & 0xF0) == 0xE0)
    point = np.where(two, (middle & 31) << 6, (first & 15) << 12 | (middle & 63) << 6) | (last & 63)
    return (two | three) & _letters()[point]


def cuts(b: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the chunks' first bytes in the bytes of texts, which begin at ``starts``."""
    why = BEFORE[b[1:]]
    why &= AFTER[b[:-1]]
    first = np.zeros(len(b) + 1, bool)
    np.not_equal(why, 0, out=first[1:-1])
    unsure = np.flatnonzero(why == OTHER) + 1
    if len(unsure):
        first[unsure] = _after_letter(b, unsure)
    first[starts] = True  # of empty texts at the end: behind the last byte
    return np.flatnonzero(first[:-1])


class Chunks:
    """Ids of the chunks met so far, in one growing array."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        n = tokenizer.get_vocab_size()
        self.spaced = np.fromiter(((tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(n)), bool, n)
        self.newline = tokenizer.token_to_id("Ċ")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int32)
        self.ids = np.zeros(1 << 14, np.int32)
        self.count, self.used = 0, 0

    def _add(self, sizes: np.ndarray, ids: np.ndarray) -> range:
        first = self.count
        for name, least in (("start", first + len(sizes)), ("size", first + len(sizes)), ("ids", self.used + len(ids))):
            a = getattr(self, name)
            if len(a) < least:
                grown = np.zeros(max(least, len(a) * 3 // 2), a.dtype)
                grown[: len(a)] = a
                setattr(self, name, grown)
        self.count += len(sizes)
        self.size[first : self.count] = sizes
        self.start[first : self.count] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return range(first, self.count)

    def _encode(self, texts: list[str]) -> range:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._add(np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32))

    def _joined(self, chunks: list[str], between: str) -> np.ndarray:
        texts = [between.join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)]
        return np.concatenate([np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _encode_words(self, words: list[str]) -> range:
        """Of chunks that begin with a space and have more."""
        ids = self._joined(words, "")
        starts = np.flatnonzero(self.spaced[ids])
        if len(starts) != len(words):  # not met yet: a word with an id within that begins with a space
            return self._encode(words)
        return self._add(np.diff(starts, append=len(ids)), ids)

    def _encode_bare(self, chunks: list[str]) -> range:
        """Of ASCII chunks with no white space at either end."""
        ids = self._joined([f"{c}\n" for c in chunks], "")
        ends = np.flatnonzero(ids == self.newline)
        if len(ends) != len(chunks):  # not met yet: a chunk with the id of a newline
            return self._encode(chunks)
        return self._add(np.diff(ends, prepend=-1) - 1, ids[ids != self.newline])

    def numbers(self, chunks: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.known.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            kind = np.array([0 if c[0] == " " and c != " " else 1 if c.isascii() and c[0] > " " and c[-1] > " " else 2 for c in new])
            for k, encode in enumerate((self._encode_words, self._encode_bare, self._encode)):
                at = np.flatnonzero(kind == k)
                if len(at):
                    own = [new[i] for i in at.tolist()]
                    numbers = encode(own)
                    self.known.update(zip(own, numbers, strict=True))
                    found[missing[at]] = numbers
        return found

    def gather(self, numbers: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks numbers[codes] one after the other, number of ids up to each chunk's end)"""
        sizes = self.size.take(numbers).take(codes)
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if self.used + total < 1 << 31 else np.int64
        at = self.start.take(numbers).astype(kind).take(codes)
        at -= (ends - sizes).astype(kind)
        at = np.repeat(at, sizes)
        at += np.arange(total, dtype=kind)
        return self.ids.take(at), ends


class Encoder:
    def __init__(self, path: str, cached_chunks: int, special_as_text: bool = False) -> None:
        """special_as_text: a special token in a text is encoded as any other characters."""
        self.cached_chunks = cached_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        whole = [] if special_as_text else [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = "|".join([UNSAFE, *whole])
        self.chunks = Chunks(self.tokenizer)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); a null text is an empty one."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._encode_safe(texts)
        whole = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(unsafe)).to_pylist(), add_special_tokens=False))
        ids, n = self._encode_safe(texts.filter(pa.array(~unsafe)))
        safe = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        rows = [np.array(next(whole).ids, np.int32) if u else next(safe) for u in unsafe]
        return np.concatenate(rows), np.fromiter(map(len, rows), np.int64, len(rows))

    def _encode_safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
        begin, end = int(bounds[0]), int(bounds[-1])
        if begin == end:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = cuts(np.frombuffer(texts.buffers()[2], np.uint8)[begin:end], bounds[:-1] - begin)
        offsets = np.append(first + begin, end).astype(kind)
        flat = pa.Array.from_buffers(texts.type, len(first), [None, pa.py_buffer(offsets), texts.buffers()[2]]).dictionary_encode()
        distinct = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.chunks.count > self.cached_chunks:
            self.chunks.clear()
        ids, ends = self.chunks.gather(self.chunks.numbers(distinct), flat.indices.to_numpy().astype(np.intp))
        return ids, np.diff(np.append(0, ends)[np.searchsorted(offsets, bounds)])


@cache
def encoder(path: str, cached_chunks: int = CACHED_CHUNKS, special_as_text: bool = False) -> Encoder:
    """One for each worker."""
    return Encoder(path, cached_chunks, special_as_text)


def slices(batch: pa.RecordBatch, text_column: int = 1, size: int = SLICE_BYTES):
    """Row ranges of a batch of about ``size`` bytes of text."""
    n = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(n) - n) // size
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(int(a), int(z - a))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
