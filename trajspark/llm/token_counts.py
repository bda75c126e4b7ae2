"""Token counts by dynamic programming over a trie of distinct pre-tokens.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, each with the space mark before it. The pieces of a
public sentencepiece vocabulary, which it lists by falling frequency, are read as a unigram model by Zipf's law
(the file's own scores are merge ranks, whose sums are no probabilities). A pre-token's segmentation is the one
of greatest summed log-probability, and of equal ones the one whose last piece is longest. A character in no piece costs
the least score less 10 and counts as its UTF-8 bytes.

The words of a batch that a worker hasn't met are sorted, which lays out their trie: a node is the first word
that has a prefix. Forward scores go from depth to depth over all nodes at once, so each shared prefix is
scored once, and the count at a word's last node is stored for it. Substrings are looked up by rolling hashes
in a bit table first; what passes is compared character by character. Texts are summed where they are:
nothing is shuffled or collected.

Edge cases: a null or empty text, or one of white space, has 0 words and 0 tokens. Words of over
``LONG_WORD`` characters are scored one by one by the same rule. Repeated rows are counted one by one. Null ids
are kept. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from trajspark.llm.common import id_and_text, release_memory
from trajspark.llm.tokens import slices
from trajspark.shipping import ship

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG_WORD = 48
CACHED_WORDS = 1_000_000
BASE = 0x9E3779B97F4A7C15
TABLE_BITS = 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a vocabulary by length, with their scores."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.longest = max(map(len, scores), default=0)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(1, self.longest + 1):
            own = [p for p in scores if len(p) == k]
            if own:
                chars = np.array([[ord(c) for c in p] for p in own], np.uint32)
                h = np.zeros(len(own), np.uint64)
                for j in range(k):
                    h = h * np.uint64(BASE) + chars[:, j]
                order = np.argsort(h)
                bits = np.zeros(1 << TABLE_BITS, bool)
                bits[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
                self.by_length[k] = h[order], chars[order], np.array([scores[p] for p in own])[order], bits

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        skipped = (m.is_unknown, m.is_control, m.is_byte, m.is_unused)
        names = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not any(f(i) for f in skipped)]
        return cls(zipf_scores(names))


def zipf_scores(names: list[str]) -> dict[str, float]:
    """Log-probabilities of pieces in falling order of frequency: the r-th has 1 / r of the first's."""
    total = sum(1 / r for r in range(1, len(names) + 1))
    return {p: -math.log(r * total) for r, p in enumerate(names, 1)}


def one_count(word: str, pieces: Pieces) -> int:
    """The same rule for one pre-token, mark included."""
    best, count = [0.0], [0]
    for d in range(1, len(word) + 1):
        top, n = -np.inf, 0
        for k in range(min(d, pieces.longest), 0, -1):
            score = pieces.scores.get(word[d - k : d])
            if score is None and k == 1 and word[d - 1] not in pieces.scores:
                if best[d - 1] + pieces.unknown > top:
                    top, n = best[d - 1] + pieces.unknown, count[d - 1] + len(word[d - 1].encode("utf-8", "replace"))
            elif score is not None and best[d - k] + score > top:
                top, n = best[d - k] + score, count[d - k] + 1
        best.append(top)
        count.append(n)
    return count[-1]


def trie_counts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Tokens of each distinct pre-token, mark included, of at most LONG_WORD characters."""
    if not words:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max())
    order = np.argsort(np.array(words, f"U{width}"), kind="stable")
    chars = np.array(words, f"U{width}")[order].view(np.uint32).reshape(len(words), width)
    size = size[order]
    # characters that a word shares with the one before: its own nodes lie deeper
    differs = np.ones((len(words), width + 1), bool)
    differs[1:, :width] = chars[1:] != chars[:-1]
    differs[0, 0] = True
    shared = differs.argmax(axis=1)
    shared[0] = 0
    rows = np.arange(len(words))
    best = np.zeros((width + 1, len(words)))
    count = np.zeros((width + 1, len(words)), np.int64)
    prefix = np.zeros((width + 1, len(words)), np.uint64)
    powers = np.array([pow(BASE, k, 1 << 64) for k in range(pieces.longest + 1)], np.uint64)
    for d in range(1, width + 1):
        prefix[d] = prefix[d - 1] * np.uint64(BASE) + chars[:, d - 1]
        node = (shared < d) & (d <= size)
        at = np.flatnonzero(node)
        top = np.full(len(at), -np.inf)
        n = np.zeros(len(at), np.int64)
        single = np.zeros(len(at), bool)
        for k in range(min(d, pieces.longest), 0, -1):
            if k not in pieces.by_length:
                continue
            hashes, forms, scores, bits = pieces.by_length[k]
            h = prefix[d, at] - prefix[d - k, at] * powers[k]
            maybe = np.flatnonzero(bits[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
            same = (forms[place] == chars[at[maybe], d - k : d]).all(axis=1)
            hit, place = maybe[same], place[same]
            score = best[d - k, at[hit]] + scores[place]
            better = score > top[hit]
            top[hit[better]] = score[better]
            n[hit[better]] = count[d - k, at[hit[better]]] + 1
            if k == 1:
                single[hit] = True
        score = best[d - 1, at] + pieces.unknown
        better = ~single & (score > top)
        code = chars[at[better], d - 1]
        top[better] = score[better]
        n[better] = count[d - 1, at[better]] + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        best[d, at], count[d, at] = top, n
        # words under a node take its numbers
        owner = np.maximum.accumulate(np.where(shared < d, rows, 0))
        best[d], count[d] = best[d, owner], count[d, owner]
    out = np.empty(len(words), np.int64)
    out[order] = count[size, rows]
    return out


class Counter:
    """Counts of the words that a worker has met."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces.load(path)
        self.known: dict[str, int] = {"": 0}

    def counts(self, words: list[str]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS and len(self.known) > 1:
            self.known = {"": 0}
            return self.counts(words)
        short = [w for w in new if len(w) < LONG_WORD]
        for i in range(0, len(short), 50_000):
            own = short[i : i + 50_000]
            self.known.update(zip(own, trie_counts([MARK + w for w in own], self.pieces).tolist(), strict=True))
        self.known.update((w, one_count(MARK + w, self.pieces)) for w in new if len(w) >= LONG_WORD)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each text"""
        cut = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), r"[\t\n\v\f\r]", " "), " ")
        flat = cut.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy()
        tokens = self.counts(distinct)[codes]
        words = np.fromiter((w != "" for w in distinct), np.int64, len(distinct))[codes]
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        return np.add.reduceat(words, starts), np.add.reduceat(tokens, starts)


@cache
def counter(path: str) -> Counter:
    """One for each worker."""
    return Counter(path)


def token_counts(docs: DataFrame, *, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens)"""
    ship(docs.sparkSession)
    path = vocabulary or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            for part in slices(batch):
                words, tokens = own.texts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])
        release_memory()

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
