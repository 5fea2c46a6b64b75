"""Packing documents into sequences of a fixed number of tokens: first-fit decreasing in randomised groups.

Each document becomes its token ids and an end id. Full pieces of `capacity` ids are cut off its front and are sequences by
themselves; what is left, shorter than a sequence, goes to a random group of some `group_pieces` pieces of all
documents. Within a group pieces are placed longest first, each into the first sequence with room, found by
descending a tournament tree of what is left in the sequences. Groups are independent, so a lost one is packed anew alone, and its
result does not depend on the order in which its rows arrive.

A piece's number is that of its row in the written table of pieces, not a hash of the document: copies, however many, spread
over all groups. Only lengths and checksums are shuffled; the ids of a piece are those of the document's tokens from start on.

Words are cut at ASCII white space, across which the tokenizer never joins, and every different word of a batch is tokenized once;
a bounded cache keeps words between batches. Special tokens written in a text are ordinary text.

Defined results: a null or blank text is the end id alone; repeated rows are packed each; a null doc_id stays null. Other columns are
not read. An empty table gives no pieces. A word of any length is tokenized whole.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import small_arrow_batches, stage
from weftline.llm.kernel import SPACE, _pieces, text_bytes

CAPACITY, GROUP_PIECES, END_ID = 2048, 2048, 1
#: Bytes of text tokenized at once, and words and ids that a worker's cache keeps.
CHUNK, CACHED_WORDS, CACHED_IDS = 4 << 20, 1_500_000, 12_000_000
#: ASCII punctuation without the apostrophe, which the tokenizer joins to letters.
_TAIL = np.array([33 <= c < 127 and not chr(c).isalnum() and c != 39 for c in range(256)])
_OPEN: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of texts by way of their different words.

    For tokenizers of lower case that split at white space, and between a letter and what is neither letter nor digit. A word's
    ASCII punctuation behind its last letter (but for the apostrophe) is a word of its own here, and A to Z become a to z first, except
    beside combining marks: all of this gives the ids of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._tok.encode_special_tokens = True
        self._model = self._tok.model
        #: Whether words of a to z go to the model as they are, without the steps before it.
        self._plain = all([x.id for x in self._model.tokenize(w)] == self._tok.encode(w, add_special_tokens=False).ids for w in ("a", "the", "shorter", "interwoven"))
        self._clear()

    def _encode(self, words: list[str]) -> list[list[int]]:
        plain = [self._plain and w.isascii() and w.isalpha() and w.islower() for w in words]
        rest = iter(self._tok.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        return [[x.id for x in self._model.tokenize(w)] if p else next(rest).ids for w, p in zip(words, plain, strict=True)]

    def _clear(self) -> None:
        self._at: dict[str, int] = {}
        self._start, self._ids, self._used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _known(self, words: list[str]) -> np.ndarray:
        if len(self._at) > CACHED_WORDS or self._used > CACHED_IDS:
            self._clear()
        at = self._at
        new = [w for w in words if w not in at]
        for i in range(0, len(new), 4096):
            ids = self._encode(new[i : i + 4096])
            n, ends = len(at), self._used + np.cumsum([len(x) for x in ids])
            self._start = _room(self._start, n + 1 + len(ids))
            self._ids = _room(self._ids, int(ends[-1]))
            self._start[n + 1 : n + 1 + len(ids)] = ends
            self._ids[self._used : ends[-1]] = np.fromiter((x for each in ids for x in each), np.uint32, int(ends[-1]) - self._used)
            self._used = int(ends[-1])
            at |= {w: n + k for k, w in enumerate(new[i : i + 4096])}
        return np.fromiter(map(at.__getitem__, words), np.int64, len(words))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids end)."""
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        bound = np.asarray(words.offsets, np.int64) - words.offsets[0].as_py()
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        parts = _two_parts(_lower(flat.dictionary)).dictionary_encode()
        at = self._known(parts.dictionary.to_pylist())[np.asarray(parts.indices, np.int64)]
        ids, ends = _gather(self._ids, self._start[at], self._start[at + 1])
        ends = np.append(0, ends[1::2])
        at = np.asarray(flat.indices, np.int64)
        ids, ends = _gather(ids, ends[at], ends[at + 1])
        return ids, np.append(0, ends)[bound[1:]]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.append(a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype))


def _gather(values: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of values from first to stop behind each other, where each ends)."""
    n = stop - first
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(first - (ends - n), n)
    return values[at], ends


def _lower(words: pa.Array) -> pa.Array:
    low = pc.ascii_lower(words)
    marked = pc.match_substring_regex(words, "[\u0300-\u036f]") if (text_bytes(words)[0] & 0xFE == 0xCC).any() else None
    return low if marked is None else pc.if_else(marked, words, low)


def _two_parts(words: pa.Array) -> pa.Array:
    """Each word as two strings: up to its last letter, and the ASCII punctuation behind it (both lie in the words' own buffer)."""
    data, off = text_bytes(words)
    data = np.append(data, np.uint8(0))
    first, cut = off[:-1], off[1:].copy()
    live = np.flatnonzero(cut > first)
    while len(live):
        live = live[_TAIL[data[cut[live] - 1]] & (cut[live] > first[live])]
        cut[live] -= 1
        live = live[cut[live] > first[live]]
    last, lead = data[np.maximum(cut - 1, 0)], data[np.maximum(cut - 2, 0)]
    ascii_letter = (last >= 97) & (last <= 122)
    latin_letter = (lead == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
    cut = np.where((cut > first) & (ascii_letter | latin_letter & (cut > first + 1)), cut, off[1:])
    bounds = np.empty(2 * len(words) + 1, np.int64)
    bounds[0::2], bounds[1::2] = off, cut
    return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(bounds), pa.py_buffer(data))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """(first row, row after the last, parts): rows of up to CHUNK bytes together, or one longer row in parts cut at white space."""
    data, off = text_bytes(texts)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        if off[j] - off[i] > CHUNK:
            yield i, j, [pa.array([bytes(x).decode()], pa.large_string()) for x in _pieces(data[off[i] : off[j]], SPACE)]
        else:
            yield i, j, [texts.slice(i, j - i)]
        i = j


def _cutter(path: str, capacity: int, end_id: int) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _OPEN:  # kept by the worker from task to task
            _OPEN[path] = WordTokenizer(path)
        tok = _OPEN[path]
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
            row, start, size, crc, total = [], [], [], [], []
            for i, j, parts in _chunks(texts):
                found = [tok(x) for x in parts]
                ids = np.concatenate([x for x, _ in found])
                ends = found[0][1] if len(found) == 1 else np.array([len(ids)])
                ids = np.insert(ids, ends, np.uint32(end_id)).astype("<u4")
                ends = ends + np.arange(1, j - i + 1)
                for r, a, b in zip(range(i, j), np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                    for s in range(a, b, capacity):
                        piece = ids[s : min(s + capacity, b)]
                        row.append(r)
                        start.append(s - a)
                        size.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(b - a)
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return cut


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, piece): every document's ids in pieces of capacity and a rest; written once, so that numbers stay."""
    small_arrow_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(_cutter(tokenizer, capacity, end_id), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return stage(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length: longest first, ties as given, each into the first bin with room.

    The leaves of the tree are what is left in the bins, a node the larger of its two; at most as many bins as lengths are opened.
    """
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    left = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[i], 1
        if need > capacity:
            raise ValueError(f"a piece of {need} does not fit into {capacity}")
        while at < leaves:
            at *= 2
            if left[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - left[at]
        left[at] -= need
        while at > 1:
            at //= 2
            best = max(left[2 * at], left[2 * at + 1])
            if left[at] == best:
                break
            left[at] = best
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """cut(piece, length, ...) with sequence_id and offset added. piece: a different long for each row, drawn on for the groups."""
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / group_pieces))
    full = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col("piece") * 2, "offset": F.lit(0).cast("long")})
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), capacity)
        return rows.drop(columns="__group").assign(sequence_id=((key[0] << 32) + np.array(bins, np.int64)) * 2 + 1, offset=np.array(offsets, np.int64))

    dealt = rest.withColumn("__group", F.pmod(F.xxhash64("piece", F.lit(17)), F.lit(groups)))
    return full.unionByName(dealt.groupBy("__group").applyInPandas(place, f"{kinds}, sequence_id long, offset long"))


def pack_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(pieces(docs, tokenizer)).drop("piece")
