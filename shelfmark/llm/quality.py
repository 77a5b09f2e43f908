"""Quality rules: a conditional random field over lines, and counts of words.

A text's lines are a sequence; each is content or boilerplate. The field is trained on a
bounded sample of labelled documents (``SAMPLE`` of each quality), whose lines have the
label of their document. Since such lines never change their label, documents of both
kinds are spliced, one within the other, and trained on too: that teaches the field where
content ends and boilerplate begins. Viterbi decoding labels all lines of every text. A text is
kept if its content lines hold at least ``CONTENT_SHARE`` of the bytes in its words, and
the base rules do not fail it.

Defined cases: a null or empty text has no words and fails the base rules; lines without
a word have no label and count nowhere; without labelled rows of both kinds every line
is content; a document labelled more than once counts by each of its labels; repeated
rows have equal results; labels of unknown documents are not used; bytes that are no text
are words like others, a code point for each broken run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import crf
from shelfmark.llm.common import chunks, utf8

#: Labelled documents of each quality that the field is trained on.
SAMPLE = 600
#: Lines of a document that training uses; longer documents are left out of the sample.
SAMPLE_LINES = 200
CONTENT_SHARE = 0.5
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
ENDS = (b".", b"!", b"?", b":", b";")

CUTS = {
    "symbols per word": (1e-9, 0.1, 0.5),
    "capitals per byte": (0.02, 0.15, 0.4),
    "digits per byte": (1e-9, 0.05, 0.2),
    "marks per word": (1e-9, 0.3, 0.8),
    "different words": (0.3, 0.6, 0.9),
    "equal neighbours": (1e-9, 0.2, 0.5),
    "words": (3, 8, 20, 60),
    "bytes per word": (3, 5, 8, 14),
}
WIDTHS = [len(x) + 1 for x in CUTS.values()]
OFFSETS = np.cumsum([0, *WIDTHS])
#: A line's flags: equal to an earlier line, ends a sentence, first, last.
FLAGS, FIRST, LAST = 4, 2, 3
N_FEATURES = int(OFFSETS[-1]) + 2 * FLAGS + 1
MARKS = re.compile(rb"!!|\?\?|\.\.\.")


def line_numbers(line: bytes, words: list[bytes]) -> tuple[float, ...]:
    n, size = len(words), len(line)
    count = lambda chars: size - len(line.translate(None, chars))
    same = sum(map(bytes.__eq__, words, words[1:]))
    return (
        count(SYMBOLS) / n, count(UPPER) / size, count(DIGITS) / size,
        len(MARKS.findall(line)) / n, len(set(words)) / n, same / n, n, size / n,
    )


def line_features(numbers: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Feature numbers, a slot for each number, each flag and the constant."""
    slots = [
        OFFSETS[i] + np.searchsorted(np.array(cuts), numbers[:, i], side="right")
        for i, cuts in enumerate(CUTS.values())
    ]
    slots += [OFFSETS[-1] + 2 * i + flags[:, i] for i in range(FLAGS)]
    slots.append(np.full(len(numbers), N_FEATURES - 1))
    return np.stack(slots, axis=1).astype(np.int64)


def lines_of(raw: bytes) -> tuple[list[tuple], list[tuple], list[int], int]:
    """For lines with a word: numbers, flags, bytes in words; and how many lines repeat."""
    numbers, flags, sizes, seen = [], [], [], set()
    lines = raw.split(b"\n")
    repeated = 0
    for i, line in enumerate(lines):
        words = line.split()
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeated += again
        numbers.append(line_numbers(line, words))
        flags.append((again, line.rstrip().endswith(ENDS), i == 0, i == len(lines) - 1))
        sizes.append(sum(map(len, words)))
    return numbers, flags, sizes, repeated


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    have = 1
    while have < window:  # ranks of twice as many words, exact at every step
        step = min(have, window - have)
        pair = ids[: len(ids) - step] * (len(words) + 1) + ids[step:]
        _, ids, many = np.unique(pair, return_inverse=True, return_counts=True)
        if len(many) == len(pair):
            return 0
        have += step
    twice = many[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def sampled_labels(labels: DataFrame, sample: int) -> DataFrame:
    """Up to ``sample`` labelled ids of each quality, in an order by hash."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    of = labels.filter("doc_id is not null").select("doc_id", "quality").distinct()
    parts = [of.filter(F.col("quality") == q).orderBy(*order).limit(sample) for q in (0, 1)]
    return parts[0].unionByName(parts[1])


def train_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> crf.Field | None:
    """The field over lines, None without labelled texts of both kinds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            rows = []
            for raw, quality, doc_id in zip(
                utf8(part.column("text")), part.column("quality").to_pylist(),
                part.column("doc_id").to_pylist(), strict=True,
            ):
                numbers, flags, _, _ = lines_of(raw)
                if 0 < len(numbers) <= SAMPLE_LINES:
                    slots = line_features(np.array(numbers), np.array(flags, np.int64))
                    rows.append((doc_id, quality, slots.astype("<i2").tobytes()))
            if rows:
                ids, kinds, slots = zip(*rows, strict=True)
                yield pa.record_batch({
                    "doc_id": pa.array(ids, pa.int64()), "quality": pa.array(kinds, pa.int32()),
                    "slots": pa.array(slots, pa.binary()),
                })

    chosen = sampled_labels(labels, sample)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 x sample rows
        .mapInArrow(run, "doc_id long, quality int, slots binary")
        .groupBy("doc_id", "quality").agg(F.min("slots").alias("slots"))
        .orderBy("doc_id", "quality").collect()
    )
    width = len(CUTS) + FLAGS + 1
    slots = [np.frombuffer(r.slots, "<i2").reshape(-1, width) for r in rows]
    if len({r.quality for r in rows}) < 2:
        return None
    sequences = [(x, np.full(len(x), r.quality)) for x, r in zip(slots, rows, strict=True)]
    kinds = [[x for x, r in zip(slots, rows, strict=True) if r.quality == q] for q in (1, 0)]
    shorter, longer = sorted(kinds, key=len)
    for i, one in enumerate(longer):
        other = shorter[i % len(shorter)]
        sequences += spliced(*((one, other) if longer is kinds[0] else (other, one)))
    lengths = np.array([len(x) for x, _ in sequences])
    features = np.concatenate([x for x, _ in sequences]).astype(np.int64)
    return crf.train(features, np.concatenate([y for _, y in sequences]), lengths, N_FEATURES)


def spliced(good: np.ndarray, bad: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and labels of each document's lines around the other's."""
    found = []
    for outer, inner, label in ((good, bad, 1), (bad, good, 0)):
        cut = (len(outer) + 1) // 2
        slots = np.concatenate([outer[:cut], inner, outer[cut:]])
        for flag, at in ((FIRST, 0), (LAST, len(slots) - 1)):
            slots[:, len(CUTS) + flag] = OFFSETS[-1] + 2 * flag
            slots[at, len(CUTS) + flag] += 1
        labels = np.full(len(slots), label)
        labels[cut : cut + len(inner)] = 1 - label
        found.append((slots, labels))
    return found


NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_content_lines",
)


def points_of(words: list[bytes]) -> int:
    """Code points of all words; bytes that are no text count as one for each broken run."""
    return len(b" ".join(words).decode(errors="replace")) - max(len(words) - 1, 0)


def judged(
    texts: list[bytes], field: crf.Field | None, content_share: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts (a column for each of ``NAMES``), content share, base failed, kept."""
    counts, numbers, flags, sizes, lengths = [], [], [], [], []
    for raw in texts:
        words = raw.split()
        n, f, s, repeated = lines_of(raw)
        counts.append((
            len(words), points_of(words), len(raw) - len(raw.translate(None, SYMBOLS)),
            repeated, repeated_words(words), len(n),
        ))
        numbers += n
        flags += f
        sizes += s
        lengths.append(len(n))
    lengths = np.array(lengths, np.int64)
    label = np.ones(len(numbers), np.int64)
    if field is not None and numbers:
        slots = line_features(np.array(numbers), np.array(flags, np.int64))
        label = crf.viterbi(field, slots, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    held = np.array(sizes, np.float64)
    content = np.bincount(owner, held * label, len(lengths))
    share = content / np.maximum(np.bincount(owner, held, len(lengths)), 1)
    lines = np.bincount(owner, label, len(lengths)).astype(np.int64)
    table = np.c_[np.array(counts, np.int64).reshape(len(lengths), -1), lines]
    failed = (table[:, 0] < LEAST_WORDS) | (100 * table[:, 4] > MOST_REPEATED * table[:, 0])
    return table, share, failed, ~failed & (share >= content_share)


def judge(
    docs: DataFrame, field: crf.Field | None, content_share: float = CONTENT_SHARE
) -> DataFrame:
    """Base counts and verdict for each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            table, share, failed, kept = judged(utf8(part.column("text")), field, content_share)
            columns = {"doc_id": part.column("doc_id")}
            columns |= {name: pa.array(table[:, i]) for i, name in enumerate(NAMES)}
            columns |= {
                "content_share": pa.array(share), "base_failed": pa.array(failed),
                "kept": pa.array(kept),
            }
            yield pa.record_batch(columns)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)
    schema += ", content_share double, base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(
    docs: DataFrame, field: crf.Field | None, content_share: float = CONTENT_SHARE
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            *_, kept = judged(utf8(part.column("text")), field, content_share)
            yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
