"""Hierarchical packing of token ids into windows of several lengths.

Every document is its token ids and an end id. A document is routed to the shortest tier
(``TIERS``) that holds it; of longer ones, whole windows of the longest tier are cut off
first. Tiers are packed from the longest down: a window of the tier takes its longest
documents first, and what is left open is filled with the longest documents of shorter
tiers that fit, then with the head of the shortest one that does not. So all windows are
full. What a block of documents leaves over at its end is cut into sequences of powers
of two, which need no padding either. The sequences of a tier are dealt to step groups
of equal tokens, those of many pieces first, so that groups hold about as many pieces.

Tasks work through their documents in blocks of about ``BLOCK_TOKENS`` tokens, with no
shuffle; a sequence's id holds its partition and its number there.

Words between white space are encoded on their own, each different one once in a long while:
the tokenizer's own splitting never joins across white space. Words of plain letters go
to its vocabulary directly, all others through its whole pipeline.

Defined cases: a null or empty text is the end id alone; a null doc_id stays null;
repeated rows are packed each; an empty table gives no rows; bytes that are no text are
encoded as replacement characters.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from shelfmark.llm.common import chunks, utf8

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BLOCK_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16
#: Words whose ids a task keeps, give or take those of a chunk.
CACHED_WORDS = 400_000

PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write a byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts by a tokenizer that drops white space and lower-cases."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[str, list[int]] = {}
        self.forget()

    def part(self, lowered: str) -> list[int]:
        raw = lowered
        if not lowered.isascii():
            raw = "".join(map(self.letters.__getitem__, lowered.encode()))
        found = self.known[lowered] = [t.id for t in self.model.tokenize(raw)]
        return found

    def words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        known, marks = self.known, {m: self.part(m) for m in ".,"}
        out: list[list[int] | None] = []
        others, places = [], []
        for text in b" ".join(words).decode(errors="replace").split(" ") if words else ():
            mark = marks.get(text[-1])
            core = text[:-1] if mark else text
            if core.isascii() and core.isalpha() or PLAIN.fullmatch(core):
                core = core.lower()
                ids = known.get(core) or self.part(core)
                out.append(ids + mark if mark else ids)
            else:
                places.append(len(out))
                others.append(text)
                out.append(None)
        found = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        for place, encoding in zip(places, found, strict=True):
            out[place] = encoding.ids
        return out

    def texts(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, with ``end`` after each text; and each text's number of ids."""
        if len(self.number) > CACHED_WORDS:
            self.forget()
        before, at, sizes = len(self.number), [], []
        for raw in texts:
            words = raw.split()
            at.extend(map(self.number.__getitem__, words))
            at.append(-1)
            sizes.append(len(words) + 1)
        new = self.words(list(islice(self.number, before, None)))
        many = np.fromiter(map(len, new), np.int64, len(new))
        self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(new), np.uint32, int(many.sum()))]
        self.length = np.r_[self.length, many]
        # the last word of all is the end
        length = np.r_[self.length, 1]
        flat, start = np.r_[self.flat, np.uint32(end)], np.cumsum(length) - length
        at = np.fromiter(at, np.int64, len(at))
        many = length[at]
        upto = np.cumsum(many)
        take = np.repeat(start[at] - (upto - many), many) + np.arange(int(many.sum()))
        return flat[take], np.diff(np.r_[0, upto[np.cumsum(sizes) - 1]])

    def forget(self) -> None:
        """Drop all words that were seen."""
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)


class Stock:
    """Pieces of documents by length; the shorter and the longer neighbour of a length."""

    def __init__(self):
        self.pieces: dict[int, list[tuple[int, int]]] = {}
        self.have = 0

    def put(self, length: int, doc: int, start: int) -> None:
        self.pieces.setdefault(length, []).append((doc, start))
        self.have |= 1 << length

    def take(self, length: int) -> tuple[int, int]:
        piece = self.pieces[length].pop()
        if not self.pieces[length]:
            del self.pieces[length]
            self.have &= ~(1 << length)
        return piece

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``, 0 if there is none."""
        return max(0, (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self, over: int) -> int:
        """The least length above ``over``, 0 if there is none."""
        rest = self.have >> (over + 1)
        return (rest & -rest).bit_length() + over if rest else 0


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length), each a full tier or a power of two."""
    top, stock, sequences = tiers[-1], Stock(), []
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= top:
            sequences.append([(doc, start, top)])
            start += top
        if length > start:
            stock.put(length - start, doc, start)
    for tier, shorter in zip(tiers[::-1], (*tiers[-2::-1], 0), strict=True):
        while (length := stock.longest(tier)) > shorter:
            window, gap = [(*stock.take(length), length)], tier - length
            while gap and stock.have:
                if fits := stock.longest(gap):
                    window.append((*stock.take(fits), fits))
                    gap -= fits
                else:
                    whole = stock.shortest(gap)
                    doc, start = stock.take(whole)
                    window.append((doc, start, gap))
                    stock.put(whole - gap, doc, start + gap)
                    gap = 0
            sequences += [window] if not gap else powers_of_two(window)
    return sequences


def powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of a window cut into sequences of powers of two, the longest first."""
    left = sum(length for _, _, length in window)
    queue, out = list(window[::-1]), []
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        sequence = []
        while room:
            doc, start, length = queue.pop()
            used = min(room, length)
            sequence.append((doc, start, used))
            if used < length:
                queue.append((doc, start + used, length - used))
            room -= used
        out.append(sequence)
    return out


def step_groups(sequences: list[list[tuple[int, int, int]]]) -> tuple[list[int], list[int]]:
    """Each sequence's length, and its step group: equal lengths, equal tokens, like pieces."""
    sizes = [sum(length for _, _, length in s) for s in sequences]
    groups, first = [0] * len(sequences), 0
    for size in sorted(set(sizes)):
        own = [i for i, s in enumerate(sizes) if s == size]
        own.sort(key=lambda i: (-len(sequences[i]), i))
        count = -(-len(own) * size // STEP_TOKENS)
        for rank, i in enumerate(own):
            turn, place = divmod(rank, count)
            groups[i] = first + (count - 1 - place if turn % 2 else place)
        first += count
    return sizes, groups


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long"
)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of the sequences of all rows of ``docs`` (doc_id, text)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        base = TaskContext.get().partitionId() << 40
        held, ids, lengths, made, grouped = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal made, grouped
            flat = np.concatenate(ids).astype("<u4")
            first = np.cumsum(lengths) - lengths
            sequences = pack(lengths)
            sizes, groups = step_groups(sequences)
            rows = []
            for number, (sequence, size, group) in enumerate(
                zip(sequences, sizes, groups, strict=True)
            ):
                offset = 0
                for doc, start, length in sequence:
                    at = first[doc] + start
                    rows.append((
                        held[doc], start, length, zlib.crc32(flat[at : at + length].tobytes()),
                        lengths[doc], base + made + number, offset, size, base + grouped + group,
                    ))
                    offset += length
            made += len(sequences)
            grouped += max(groups) + 1
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            for x in (held, ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        tokens = 0
        for part in chunks(batches, "text"):
            flat, sizes = encoder.texts(utf8(part.column("text")), END_ID)
            held += part.column("doc_id").to_pylist()
            ids.append(flat)
            lengths += sizes.tolist()
            tokens += len(flat)
            if tokens >= BLOCK_TOKENS:
                yield flush()
                tokens = 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
