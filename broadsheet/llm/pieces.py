"""SentencePiece encoding and decoding with a distinct-chunk table.

No piece of the supported models crosses from a visible character into a whitespace marker, so a text falls into marked
words (a run of markers and what follows it) that are segmented independently of each other. Each task keeps a table of
the distinct marked words it has met: a word is segmented once, and the ids of a text are joined back by position. The
words of a chunk that the table lacks go to the library in one call.

The table is one per task rather than one per corpus: a corpus-wide table would ship every word occurrence, or every
text, through a shuffle, while this plan is a single map over the scan. It is bounded in bytes: when it is beyond
``TABLE_BYTES`` it starts anew before the next chunk, which changes no result. Texts come in chunks of ``CHUNK`` bytes;
ids lie in flat integer arrays, and a decoding is kept only for words that do not decode to themselves.

Cases: a null or empty text gives no ids and an empty decoding. A text without spaces is one word. Repeated rows are
encoded alike. Input columns named n_tokens, ids or decoded give way to those of the result; other columns stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.shared import chunks, small_batches

TABLE_BYTES = 32 << 20
#: Bytes of an entry besides the characters of the word and its ids.
ENTRY_BYTES = 180
CHUNK = 1 << 20
MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def _check(path: str) -> bool:
    """Whether words can be segmented one by one: no piece has a marker after a visible character, and text is not rewritten."""
    sp = _model(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    plain = all(MARK not in p.lstrip(MARK) for p in pieces)
    probe = "  a  b\tc\nd é① "
    return plain and sp.decode(sp.encode(probe)) == probe and sp.id_to_piece(sp.encode("a")[0]).startswith(MARK)


class Encoder:
    """Encodes whole texts through a table of distinct marked words."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        self.sp, self.whole, self.most = _model(path), not _check(path), table_bytes
        self.digits = [str(i) for i in range(self.sp.get_piece_size())]
        self._empty()

    def _empty(self) -> None:
        #: Marked word -> number; the ids of word k are flat[starts[k] : starts[k + 1]].
        self.numbers: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)
        #: Decodings other than the word itself, by number.
        self.odd: dict[int, str] = {}
        self.bytes = 0

    def _words(self, text: str) -> list[str]:
        """The marked words of a text. The model itself puts a marker before the text.

        A run of k markers opens a word: the model adds the last of them, so a word is sent with k - 1 leading spaces.
        The empty word is a single marker at the end of a text.
        """
        if not text:
            return []
        if self.whole:
            return [text]
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, lead, last = [], 0, len(parts) - 1
        for at, part in enumerate(parts):
            if not part and at < last:
                lead += 1
            else:
                out.append(" " * lead + part if lead else part)
                lead = 0
        return out

    def _add(self, words: list[str]) -> None:
        """Segments words that the table lacks. The library drops the single marker of the empty word."""
        ids = self.sp.encode(words, num_threads=1)
        ids = [x if w else [self.sp.piece_to_id(MARK)] for w, x in zip(words, ids)]
        back = self.sp.decode(ids, num_threads=1)
        first = len(self.numbers)
        self.numbers.update(zip(words, range(first, first + len(words))))
        self.odd.update((first + k, b) for k, (w, b) in enumerate(zip(words, back)) if w != b)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.bytes += ENTRY_BYTES * len(words) + sum(map(len, words)) + 4 * int(counts.sum())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, their bounds (text k has ids[bounds[k] : bounds[k + 1]]), and the decoded texts."""
        if self.bytes > self.most:
            self._empty()
        split = [self._words(t or "") for t in texts]
        words = [w for part in split for w in part]
        known = list(map(self.numbers.get, words))
        if None in known:
            self._add(list(dict.fromkeys(w for w, n in zip(words, known) if n is None)))
            known = list(map(self.numbers.get, words))
        number = np.array(known, np.int64)
        counts = self.starts[number + 1] - self.starts[number]
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[number] - ends[:-1], counts)]
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))])
        if self.odd:
            odd = self.odd
            for a, part in zip(edges.tolist(), split):
                for k in range(len(part)):
                    back = odd.get(known[a + k])
                    if back is not None:
                        part[k] = back
        return ids, ends[edges], [" ".join(part) for part in split]


def encode(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` other than the text, then n_tokens, ids array<int> and decoded (from the ids)."""
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in chunks(batches, len(rest), CHUNK):
            ids, bounds, decoded = encoder.encode(batch.column(len(rest)).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.diff(bounds)), lists, pa.array(decoded, pa.string())], names=[*rest, "n_tokens", "ids", "decoded"])

    small_batches(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`").cast("string").alias(text_col))
    schema = T.StructType(source.schema.fields[:-1]).add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return source.mapInArrow(run, schema)


def encode_digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the encoding of :func:`encode`, reduced to digests where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in chunks(batches, 1, CHUNK):
            ids, bounds, decoded = encoder.encode(batch.column(1).to_pylist())
            digit = encoder.digits.__getitem__
            joined = [",".join(map(digit, ids[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(list(map(sha, joined)), pa.string()), pa.array(list(map(sha, decoded)), pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
