"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text, behind one space as the library's dummy prefix, is segmented into the vocabulary's pieces with the largest sum
of their scores.  The search reads characters in order and keeps scores and back pointers of a window only: a later
piece begins at most the longest piece's length back, and when the back pointers of all places where one could begin
lead through one boundary, the ids before it are final and leave.

No piece has a space after another character, so all paths meet before a space that follows one.  Between such
boundaries lie short segments, mostly words, which repeat: each distinct one is searched once in a worker and its ids
are then placed by array operations.

Ties go to the path found first, starts ascending and lengths ascending, as in the library's unigram search, with which
the ids agree as long as its 32-bit sums are exact; sums here are integers, of scores in units of 2^-20 where a file's
aren't whole numbers.  Characters without a piece are spelt in byte pieces.  A literal U+2581, which the library would
turn into a space, is spelt in bytes as well, so that decoding gives every text back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CHUNK_BYTES, column, flat_bytes, numbered, text_chunks

SPACE = "▁"  # fixed value: how pieces write a space
#: Scores that aren't whole numbers are counted in parts of one over this.
FINE = 1 << 20


class Vocabulary:
    """Pieces with integer scores, `unit` to one of the file's, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: dict[str, tuple[int, int]], byte_ids: list[int], texts: list[bytes], unit: int = 1):
        self.pieces = pieces
        self.byte_ids = byte_ids
        self.texts = texts
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0) - 10 * unit
        self.has_line_feed = any("\n" in p for p in pieces)
        if any(" " in p.lstrip(" ") for p in pieces):
            raise ValueError("a piece has a space after another character")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """From a model file of the library; the scores are the file's."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, texts = {}, [0] * 256, []
        unit = 1 if all(float(model.get_score(i)).is_integer() for i in range(model.get_piece_size())) else FINE
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            text = b""
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                byte_ids[value], text = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain = piece.replace(SPACE, " ")
                pieces[plain], text = (i, round(model.get_score(i) * unit)), plain.encode()
            texts.append(text)
        return cls(pieces, byte_ids, texts, unit)


class Search:
    """The streaming search.  feed characters, then finish; ids come out as soon as they are final."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.text = ""  # from the last committed boundary on
        self.best: list[int | None] = [0]
        self.back: list[int] = [-1]
        self.step: list[int] = [-1]  # the piece that ends here, or -1 for a character in bytes
        self.done = 0  # starts below this have been extended
        self.widest = 1

    def feed(self, more: str) -> list[int]:
        self.text += more
        return self._advance(len(self.text) - self.v.longest)

    def finish(self) -> list[int]:
        out = self._advance(len(self.text)) + self._path(len(self.text))
        self.reset()
        return out

    def _advance(self, upto: int) -> list[int]:
        """Extend all starts below upto; a start is safe to extend once its longest piece would be in the text."""
        out: list[int] = []
        pieces, longest = self.v.pieces, self.v.longest
        while self.done < upto:
            i, text = self.done, self.text
            best, back, step = self.best, self.back, self.step
            n = len(text)
            while len(best) < min(n, i + longest) + 1:
                best.append(None)
                back.append(-1)
                step.append(-1)
            base = best[i]
            if base is not None:
                single = False
                for j in range(i + 1, min(n, i + longest) + 1):
                    found = pieces.get(text[i:j])
                    if found is not None:
                        single = single or j == i + 1
                        score = base + found[1]
                        if best[j] is None or score > best[j]:
                            best[j], back[j], step[j] = score, i, found[0]
                if not single:
                    score = base + self.v.unknown
                    if best[i + 1] is None or score > best[i + 1]:
                        best[i + 1], back[i + 1], step[i + 1] = score, i, -1
            self.done = i + 1
            self.widest = max(self.widest, len(best))
            if self.done >= 2 * longest:
                held = len(self.text)
                out += self._commit()
                upto -= held - len(self.text)
        return out

    def _commit(self) -> list[int]:
        """Give out what lies before the boundary on which all surviving paths agree."""
        # a place ahead can be reached from here on only, or has been already: both begin in alive
        alive = {p for p in range(self.done, len(self.best)) if self.best[p] is not None}
        while len(alive) > 1:
            top = max(alive)
            alive.discard(top)
            alive.add(self.back[top])
        meet = alive.pop() if alive else 0
        if meet <= 0:
            return []
        out = self._path(meet)
        self.text = self.text[meet:]
        self.best, self.back, self.step = self.best[meet:], [b - meet for b in self.back[meet:]], self.step[meet:]
        base = self.best[0] or 0
        self.best = [None if b is None else b - base for b in self.best]
        self.done -= meet
        return out

    def _path(self, end: int) -> list[int]:
        steps = []
        while end > 0:
            start = self.back[end]
            if self.step[end] >= 0:
                steps.append([self.step[end]])
            else:
                steps.append([self.v.byte_ids[b] for b in self.text[start:end].encode()])
            end = start
        return [i for s in reversed(steps) for i in s]


class Encoder:
    """Ids of whole columns, and texts of ids."""

    KEPT = 1_500_000

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.search = Search(vocabulary)
        self.text_ends = np.cumsum([len(t) for t in vocabulary.texts])
        self.text_flat = np.frombuffer(b"".join(vocabulary.texts), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint16 if len(self.v.texts) <= 1 << 16 else np.int32), np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, rows end to end, and each row's number of them."""
        rows, sizes = len(offsets) - 1, np.diff(offsets)
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64)
        data = np.insert(data, offsets[filled], 32)
        offsets = offsets + np.append(0, np.cumsum(sizes > 0))
        space = data == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[offsets[filled]] = True
        if not self.v.has_line_feed:  # then all paths meet on both sides of one
            line = data == 10
            begin |= line
            begin[1:] |= line[:-1]
        starts = np.flatnonzero(begin)
        segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        kinds = segments.dictionary.to_pylist()
        if len(self.known) > self.KEPT:
            self.forget()
        fresh = [k for k in kinds if k not in self.known]
        if fresh:
            found = [self._segment(k.decode()) for k in fresh]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(f) for f in found]))
            self.flat = np.append(self.flat, np.fromiter((i for f in found for i in f), self.flat.dtype))
        which = np.fromiter(map(self.known.__getitem__, kinds), np.int64, len(kinds))[np.asarray(segments.indices, dtype=np.int64)]
        count = self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1])) + np.repeat(self.ends[which] - ends + count, count)
        upto, first = np.append(0, ends), np.searchsorted(starts, offsets)
        return self.flat[at].astype(np.int32), upto[first[1:]] - upto[first[:-1]]

    def _segment(self, text: str) -> list[int]:
        out: list[int] = []
        for i in range(0, len(text), 64):  # a segment of any length goes through the window in steps
            out += self.search.feed(text[i : i + 64])
        return out + self.search.finish()

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' UTF-8 bytes end to end, without the dummy prefix, and their offsets."""
        stop = self.text_ends[ids]
        count = stop - np.append(0, self.text_ends)[ids]
        ends = np.cumsum(count)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(stop - ends, count)
        data = self.text_flat[at]
        upto = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
        drop = upto[:-1][lengths > 0]
        return np.delete(data, drop), upto - np.append(0, np.cumsum(lengths > 0))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, with the segments it has met."""
    return Encoder(Vocabulary.load(path))


def encode_column(docs: DataFrame, path: str, keep: int = Encoder.KEPT, forget: bool = False) -> DataFrame:
    """docs' columns (but those named like results) with ids, n_ids and decoded_crc32, that of the bytes decoded from ids.

    A worker keeps up to about `keep` segments' ids for later tasks, or with `forget` until its task ends, which takes more
    time and less memory.  A null or empty text has no ids.  Repeated rows are encoded alike; nulls elsewhere stay, and so
    do other columns whatever their names.  A long text is encoded whole; among segmentations of one score the search
    keeps the one it met first.  An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("ids", "n_ids", "decoded_crc32")]
    source, names = numbered(docs.select(*[column(c) for c in kept]))
    text = names["text"]
    schema = T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("decoded_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, text, limit=3 * CHUNK_BYTES):
            tool = encoder(path)
            tool.KEPT = keep
            ids, n = tool.encode(*flat_bytes(batch.column(text)))
            data, offsets = tool.decode(ids, n)
            view = memoryview(np.ascontiguousarray(data))
            checks = [zlib.crc32(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(n, pa.int64()), pa.array(checks, pa.int64())], names=[*names.values(), "ids", "n_ids", "decoded_crc32"])
        if forget:
            encoder(path).forget()

    return source.mapInArrow(run, schema).toDF(*kept, "ids", "n_ids", "decoded_crc32")


def decode_column(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with the text of ids in column text; null ids give null, no ids the empty text.

    A column of docs named text is replaced, others stay whatever their names and nulls.  Equal lists give equal texts,
    repeated rows repeat, a long list is decoded whole, and an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c != text]
    source, names = numbered(docs.select(*[column(c) for c in kept]))
    schema = T.StructType([*source.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(names[ids])
            flat = np.asarray(lists.flatten(), dtype=np.int64)
            n = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], dtype=np.int64)
            data, offsets = encoder(path).decode(flat, n)
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names.values(), "text"])

    return source.mapInArrow(run, schema).toDF(*kept, text)


def ids_of(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids, decoded_crc32) of every row."""
    return encode_column(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path).select("doc_id", "n_ids", "ids", "decoded_crc32")
