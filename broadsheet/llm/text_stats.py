"""Counts over whole texts, vectorised: words, characters, symbols, letters, repeated lines and windows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.packed import runs
from broadsheet.llm.shared import chunks, small_batches
from broadsheet.llm.words import U64, Words, mix

#: Characters that count as symbols (fixed by the contract of the quality rules).
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
#: All of type long; of a null text all are 0.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_punct", "n_bars", "n_bangs", "n_distinct_words", "n_stops", "n_long_words", "n_chars_all", "n_end_lines")
_WHITE = b" \t\n\v\f\r"
_tables: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """Code point -> 1 letter, 2 upper-case letter, 3 digit, 0 other; made once in each process."""
    if not _tables:
        kind = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            s = chr(c)
            if s.isalpha():
                kind[c] = 2 if s.isupper() else 1
            elif s.isdecimal():
                kind[c] = 3
        _tables.append(kind)
    return _tables[0]


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _byte_flags(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_SYMBOL, _BAR, _BANG = _byte_flags(SYMBOLS), _byte_flags("|"), _byte_flags("!")
_PUNCT = _byte_flags("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum()))


def count(texts: pa.Array) -> dict[str, np.ndarray]:
    """Every count of COLUMNS for a batch of texts."""
    n = len(texts)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    w = Words(texts)
    data, edges = w.data, w.offsets
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.concatenate([[0], np.cumsum(lengths)])
    strings = texts.to_pylist()
    kind = _kinds()[np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)]
    solid = np.zeros(len(data), bool)
    lead = (data & 0xC0) != 0x80
    space = np.isin(data, np.frombuffer(_WHITE, np.uint8))
    solid = lead & ~space
    out = {
        "n_words": w.counts.astype(np.int64),
        "word_chars": _sums(solid, edges),
        "n_symbols": _sums(_SYMBOL[data], edges),
        "n_letters": _sums((kind == 1) | (kind == 2), points),
        "n_upper": _sums(kind == 2, points),
        "n_digits": _sums(kind == 3, points),
        "n_punct": _sums(_PUNCT[data], edges),
        "n_bars": _sums(_BAR[data], edges),
        "n_bangs": _sums(_BANG[data], edges),
        "n_chars_all": lengths,
    }
    # Words covered by a window that the same text holds twice.
    h, bounds, at = w.windows(REPEAT_WINDOW)
    covered = np.zeros(len(w.hash) + 1, np.int32)
    if len(h):
        doc = np.repeat(np.arange(n), np.diff(bounds))
        key = h + mix(doc.astype(U64) + U64(12345))
        order = np.argsort(key, kind="stable")
        starts = runs(key[order])
        sizes = np.diff(np.append(starts, len(key)))
        twice = at[order[np.repeat(sizes > 1, sizes)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered)[:-1] > 0, w.bounds)
    owner = w.owners().astype(U64)
    key = np.sort(w.hash + mix(owner + U64(999)))
    # Distinct words: keys are unique to a text, so first occurrences are counted through a second key.
    first = np.zeros(len(w.hash), bool)
    if len(key):
        order = np.argsort(w.hash + mix(owner + U64(999)), kind="stable")
        first[order[runs(key)]] = True
    out["n_distinct_words"] = _sums(first, w.bounds)
    size = w.ends - w.starts
    out["n_stops"] = _sums(size <= 4, w.bounds)
    out["n_long_words"] = _sums(size >= 16, w.bounds)
    dup, lines, ended = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(strings):
        if text:
            full = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
            lines[i] = len(full)
            dup[i] = len(full) - len(set(full))
            ended[i] = sum(x.rstrip(" \t\v\f\r")[-1] in ".!?" for x in full)
    out["n_dup_lines"], out["n_lines"], out["n_end_lines"] = dup, lines, ended
    return {c: out[c] for c in COLUMNS}


def _rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, at):
        got = count(batch.column(at))
        columns = [c for k, c in enumerate(batch.columns) if k != at]
        names = [f.name for k, f in enumerate(batch.schema) if k != at]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, pa.int64()) for v in got.values())], names=[*names, *COLUMNS])


def with_stats(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The key columns and COLUMNS of every row."""
    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = source.drop("_text").schema
    for c in COLUMNS:
        schema = schema.add(c, "long")
    return source.mapInArrow(lambda it: _rows(it, len(keys)), schema)
