"""Counts over whole texts, taken from the raw bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillveil.llm import textkernel as tk

#: Words in a window that counts as repeated when the text has it twice.
WINDOW = 8

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_UPPER = tk._mask([(65, 90)])
_LOWER = tk._mask([(97, 122)])
_DIGIT = tk._mask([(48, 57)])
_PUNCT = tk._mask([(0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)])
_CONTINUATION = tk._mask([(0x80, 0xBF)])

#: The base counts, and further ones that the classifier takes.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars", "n_upper", "n_lower", "n_digits", "n_punct", "n_exclaim", "n_lines", "n_distinct_words", "n_long_words", "n_wide"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return hashes ^ tk.mix64(doc.astype(np.uint64) + np.uint64(1))


def counts(part: tk.Slice, more: bool = False) -> dict[str, np.ndarray]:
    """The counts of each text of a slice, by name."""
    n, buf, offsets = len(part), part.buf, part.offsets
    found = tk.words(part)
    inside = ~tk.SPACES[buf]
    starts_char = ~_CONTINUATION[buf]
    hashes = found.hashes()

    # lines with a word, equal to an earlier one of their text
    cuts = np.flatnonzero(buf == 10)
    line_starts = np.union1d(offsets[:-1], cuts + 1)
    line_starts = line_starts[line_starts < len(buf)]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    stops = np.append(line_starts[1:], len(buf))
    # a line ends at its break, or where its text ends
    line_ends = np.minimum(stops, offsets[line_doc + 1])
    broken = (line_ends > line_starts) & (buf[np.maximum(line_ends - 1, 0)] == 10) if len(buf) else np.zeros(0, bool)
    line_ends = line_ends - broken
    ink = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum(inside, out=ink[1:])
    wordy = ink[line_ends] > ink[line_starts]
    line_starts, line_ends, line_doc = line_starts[wordy], line_ends[wordy], line_doc[wordy]
    lines = np.bincount(line_doc, minlength=n)
    _, first = np.unique(_salted(tk.hash_spans(buf, line_starts, line_ends), line_doc), return_index=True)
    distinct_lines = np.bincount(line_doc[first], minlength=n)

    # words in windows that their text has at least twice
    doc, at, window = tk.grams(found, WINDOW, hashes)
    _, inverse, times = np.unique(_salted(window, doc), return_inverse=True, return_counts=True)
    again = times[inverse] > 1
    place = (found.firsts[doc] + at)[again]
    cover = np.zeros(len(hashes) + WINDOW + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + WINDOW, -1)
    covered = np.cumsum(cover)[: len(hashes)] > 0

    out = {
        "n_words": found.counts,
        "word_chars": _per_text(inside & starts_char, offsets),
        "n_symbols": _per_text(_SYMBOL[buf], offsets),
        "n_dup_lines": lines - distinct_lines,
        "n_repeat_words": _per_text(covered, found.firsts),
        "n_lines": lines,
    }
    if more:
        word_doc = found.docs()
        _, first = np.unique(_salted(hashes, word_doc), return_index=True)
        out |= {
            "n_chars": _per_text(starts_char, offsets),
            "n_upper": _per_text(_UPPER[buf], offsets),
            "n_lower": _per_text(_LOWER[buf], offsets),
            "n_digits": _per_text(_DIGIT[buf], offsets),
            "n_punct": _per_text(_PUNCT[buf], offsets),
            "n_exclaim": _per_text(buf == 33, offsets),
            "n_distinct_words": np.bincount(word_doc[first], minlength=n),
            "n_long_words": _per_text((found.ends - found.starts) > 20, found.firsts),
            "n_wide": _per_text(buf >= 0xC0, offsets),
        }
    return {k: v.astype(np.int64) for k, v in out.items()}


def with_counts(docs: DataFrame, id_col: str, text_col: str, keys: list[str], more: bool = False, also: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its id, the key columns, and the counts of its text (null: all 0).

    ``also`` names counts beside the base that ``counts`` gives without ``more``.
    """
    names = BASE + MORE if more else [*BASE, *also]
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keys)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text"] + [f"{x} long" for x in names])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [counts(p, more) for p in tk.slices(batch.column("text"))]
            kept = [x for x in batch.schema.names if x != "text"]
            values = [pa.array(np.concatenate([p[x] for p in parts]) if parts else np.zeros(0, np.int64)) for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in kept] + values, names=kept + names)

    return narrow.mapInArrow(count, schema)
