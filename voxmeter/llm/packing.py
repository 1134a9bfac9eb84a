"""Hierarchical multi-length packing.

Documents become token ids and go to context-size tiers; each tier's windows are
filled, gaps in long windows from shorter tiers first, and windows of one tier are
dealt into step groups of the same number of tokens.

A task packs the documents of its own partition, so nothing is shuffled, no key can
be hot and a lost task is redone alone. What a task holds is bounded: a pool of at
most ``POOL`` remainders, each shorter than the longest window.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

POOL = 8192
#: Words, and pre-tokens of words that are not letters alone, that a worker remembers.
CACHE = 400_000
#: White space next to a space: there the split at single spaces would not be the tokenizer's. The space comes first, as a search for one character is fast.
AWKWARD = re.compile(r" (?:(?=\s)|(?<=\s ))")
#: Marks that end words.
MARKS = frozenset(".,;:!?")
#: To little-endian 32-bit bytes, by the number of ids.
PACKED = [struct.Struct(f"<{n}I").pack for n in range(65)]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group string"


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself if it has one, else those from U+0100 on in turn."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def little(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """Key -> bytes in two generations of half of ``CACHE`` each: what the younger one lacks it takes over from the older one, so frequent keys stay."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.made(key)
        if len(self) >= CACHE // 2:
            self.older = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = ids
        return ids


class PieceCache(Remembered):
    """Pre-token -> its ids by the tokenizer's model, as little-endian 32-bit bytes."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.letters = model.tokenize, byte_letters()

    def made(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            # Of these only the space has another letter.
            written = piece.replace(" ", "\u0120")
        else:
            written = piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tokenize(written)]
        return PACKED[len(ids)](*ids) if len(ids) < len(PACKED) else little(ids)


class WordCache(Remembered):
    """Word (after a space, if ``lead``) -> its ids, put together from its pre-tokens'."""

    def __init__(self, encode, pieces: PieceCache, pattern: regex.Pattern, lead: str):
        super().__init__()
        self.encode, self.pieces, self.pattern, self.lead = encode, pieces, pattern, lead

    def made(self, word: str) -> bytes:
        whole = self.lead + word
        if word.isascii():
            # Letters alone are one pre-token, which is remembered as a word only; so is a last mark after them.
            if word.isalpha():
                return self.pieces.made(whole)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self[word[:-1]] + self.pieces[word[-1]]
        # Of newer letters two libraries may think differently: there the tokenizer cuts by itself.
        elif max(word) >= "\u0500":
            return little(self.encode(whole))
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(whole)))


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, without special tokens of its own.

    A single space between two non-spaces always starts a new pre-token, so words are put
    together once and looked up afterwards. Texts with an added token are encoded whole:
    those tokens have their own ids, or with ``added`` false are ordinary text.
    """

    def __init__(self, path: str, pattern: str, added: bool = True):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.added = re.compile("|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        pieces, pattern = PieceCache(tokenizer.model), regex.compile(pattern)
        self.first, self.next = (WordCache(self.encode, pieces, pattern, lead) for lead in ("", " "))

    def ids(self, text: str) -> bytes:
        if AWKWARD.search(text) or self.added.search(text):
            return little(self.encode(text))
        words = text.split(" ")
        return self.first[words[0]] + b"".join(map(self.next.__getitem__, words[1:]))


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, added: bool) -> ByteBpe:
    """The tokenizer of a Python worker, which its later tasks find with its caches."""
    import public_tokenizers

    return ByteBpe(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, added)


class Packer:
    """Packs pieces (length, doc, start, doc_tokens, bytes) of one partition."""

    def __init__(self, part: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.part, self.sequences = part, 0
        self.windows = dict.fromkeys(tiers, 0)
        self.pool: list[tuple] = []  # sorted by length
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        """One window of these pieces, gapless; its tier is its length."""
        total = sum(p[0] for p in pieces)
        k = self.windows[total] = self.windows.get(total, 0) + 1
        group = f"{total}-{self.part}-{(k - 1) // max(1, self.step_tokens // total)}"
        at, seq = 0, (self.part << 36) + self.sequences
        self.sequences += 1
        for n, doc, start, tokens, ids in pieces:
            self.rows.append((doc, start, n, zlib.crc32(ids), tokens, seq, at, total, group))
            at += n

    def add(self, doc, ids: bytes) -> None:
        tokens, window = len(ids) // 4, self.tiers[0]
        full = tokens - tokens % window
        for s in range(0, full, window):
            self.emit([(window, doc, s, tokens, ids[4 * s : 4 * (s + window)])])
        if full < tokens:
            insort(self.pool, (tokens - full, doc, full, tokens, ids[4 * full :]), key=lambda p: p[0])

    def take(self, gap: int) -> tuple:
        """The longest piece that fits, else a cut of the shortest piece that doesn't."""
        i = bisect_right(self.pool, gap, key=lambda p: p[0])
        if i:
            return self.pool.pop(i - 1)
        n, doc, start, tokens, ids = self.pool.pop(0)
        insort(self.pool, (n - gap, doc, start + gap, tokens, ids[4 * gap :]), key=lambda p: p[0])
        return gap, doc, start, tokens, ids[: 4 * gap]

    def pack(self, last: bool) -> None:
        """Fills windows from the longest tier down; a rest shorter than the longest window stays, at the end as power-of-two windows."""
        left = sum(p[0] for p in self.pool)
        while self.pool and left >= self.tiers[0]:
            head = self.pool[-1][0]
            tier = next(t for t in reversed(self.tiers) if t >= head)
            window, gap = [], tier
            while gap:
                piece = self.pool.pop() if not window else self.take(gap)
                window.append(piece)
                gap -= piece[0]
            left -= tier
            self.emit(window)
        while last and left:
            tier = 1 << (left.bit_length() - 1)
            window, gap = [], tier
            while gap:
                window.append(self.take(gap))
                gap -= window[-1][0]
            left -= tier
            self.emit(window)


def pack(docs: DataFrame, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", added: bool = True) -> DataFrame:
    """Packs every document into windows of at most ``tiers[0]`` tokens.

    Null and empty texts are one end token; repeated rows are packed each on their own;
    a text of any length is cut into full windows and one remainder; other columns are
    not used; an empty table gives no rows. ``tiers`` are powers of two, longest first.
    Every window but a partition's last few is full at its tier; those last ones have
    power-of-two lengths too, so no window needs padding. Added tokens of the tokenizer file
    ``vocabulary`` get their own ids; with ``added`` false their strings are ordinary text.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
        raise ValueError("tiers must be distinct powers of two, longest first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary, added)
        packer, end = Packer(TaskContext.get().partitionId(), tiers, step_tokens), np.array([end_id], dtype="<u4").tobytes()

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, (bpe.ids(t) if (t := text.as_py()) else b"") + end)
                if len(packer.pool) >= POOL:
                    packer.pack(last=False)
                if len(packer.rows) >= POOL:
                    yield out()
        packer.pack(last=True)
        if packer.rows:
            yield out()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(task, SCHEMA)
