"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .job import ship

ship(__name__)

END = 1
MARKS = ".,;:!?%&$#*|"
MOST_KNOWN, LONGEST_KNOWN, AT_ONCE = 1_000_000, 64, 100
SCHEMA = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


class Words(dict):
    """Ids of each piece of text without blanks, as bytes.

    The tokenizer never joins text across blanks, nor a letter with the marks
    after it unless its normal form ends in a mark itself, and it lower-cases;
    so pieces are known by their lower-cased words, which are far fewer.  New words of letters alone are encoded many at
    a time, each being one word to the tokenizer too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def __missing__(self, word: str) -> bytes:
        return self.encoded(word).tobytes()

    def parts(self, word: str) -> list[str]:
        start = word.rstrip(MARKS)
        apart = start and start != word and start[-1].isalpha()
        if apart and not start[-1].isascii():
            apart = unicodedata.normalize("NFC", start[-1]).lower()[-1].isalpha()
        parts = [start, word[len(start) :]] if apart else [word]
        if parts[0].isascii() and "<" not in parts[0]:
            parts[0] = parts[0].lower()
        return parts

    def learn(self, words: set[str]) -> None:
        """Know all words but very long ones; all are forgotten when they become too many."""
        if len(self) > MOST_KNOWN:
            self.clear()
        new = {w: self.parts(w) for w in words if len(w) <= LONGEST_KNOWN and w not in self}
        plain = [p for p in {p for ps in new.values() for p in ps} if p.isalpha() and p not in self]
        if plain:
            told = self.tokenizer.encode(" ".join(plain), add_special_tokens=False)
            data, word = np.array(told.ids, "<u4").tobytes(), np.array(told.word_ids)
            starts = (np.flatnonzero(np.append(True, word[1:] != word[:-1])) * 4).tolist()
            if len(starts) == len(plain):
                self.update(zip(plain, (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])), strict=True))
        for word, parts in new.items():
            for p in parts:
                if p not in self:
                    self[p] = self[p]
            self[word] = b"".join(map(self.__getitem__, parts))

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        split = [(t or "").replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        self.learn(set().union(*split))
        for words in split:
            yield np.frombuffer(b"".join([*map(self.__getitem__, words), END.to_bytes(4, "little")]), "<u4")


def known_words(path: str) -> Words:
    """The words that this worker process knows already, from its earlier tasks too; at most ``MOST_KNOWN``."""
    import tokenizers

    shared = vars(tokenizers).setdefault("_known_words", {})
    if path not in shared:
        shared[path] = Words(path)
    return shared[path]


class Windows:
    """Partly filled windows by fill level, and their counts in a level array.

    A piece goes to the level, an empty window included, that makes the sum of
    the squared counts least; full windows do not count.  Of equals the fullest.
    """

    def __init__(self, size: int):
        self.size, self.counts = size, np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}

    def put(self, piece: tuple) -> list | None:
        """Place a piece (its third field its ids); returns the window if that filled it."""
        n = len(piece[2])
        last = self.size - n
        after = self.counts[n : self.size + 1] * 2 + 1
        after[last] = 0
        change = after - (2 * self.counts[: last + 1] - 1)
        change[0] = after[0]
        change[1:][self.counts[1 : last + 1] == 0] = np.iinfo(np.int64).max
        level = last - int(np.argmin(change[::-1]))
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + n == self.size:
            return window
        self.counts[level + n] += 1
        self.open.setdefault(level + n, []).append(window)
        return None

    def rest(self) -> Iterator[list]:
        """What is still open, in new windows that are full but for the last; pieces are cut at their ends."""
        window, used = [], 0
        for level in sorted(self.open, reverse=True):
            for key, start, ids, tokens in (p for w in self.open[level] for p in w):
                while len(ids):
                    part = ids[: self.size - used]
                    window.append((key, start, part, tokens))
                    used, start, ids = used + len(part), start + len(part), ids[len(part) :]
                    if used == self.size:
                        yield window
                        window, used = [], 0
        if window:
            yield window


def pack(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", size: int = 2048) -> DataFrame:
    """Rows (``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``), one per piece.

    Each task packs the rows of its own partition as they come, so nothing is
    shuffled and memory holds the open windows alone.  A document of ``size``
    tokens and more gives full windows of its own first; what remains is one
    piece, placed by sum of squares.  At a task's end the open windows are
    poured into new ones, so each partition pads one window at most.  A
    sequence's id is its partition's number times 2**32 plus its own.  A null
    text is empty and still has the end id; repeated rows are packed each.
    ``tokenizer`` is a file of the tokenizers library.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows = known_words(tokenizer), Windows(size)
        sequence, rows = TaskContext.get().partitionId() << 32, []

        def done(window: list) -> None:
            nonlocal sequence
            offset = 0
            for key_, start, ids, tokens in window:
                rows.append((key_, start, len(ids), zlib.crc32(ids.tobytes()), tokens, sequence, offset))
                offset += len(ids)
            sequence += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names
            )

        def read(got: pa.RecordBatch) -> Iterator[tuple]:
            for part in (got.slice(i, AT_ONCE) for i in range(0, got.num_rows, AT_ONCE)):
                yield from zip(part.column(0).to_pylist(), words.ids(part.column(1).to_pylist()), strict=True)

        names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]
        types = [pa.int64()] * len(names)
        for got in batches:
            types[0] = got.schema.field(0).type
            for key_, ids in read(got):
                full = len(ids) // size * size
                for at in range(0, full, size):
                    done([(key_, at, ids[at : at + size], len(ids))])
                if full < len(ids) and (window := windows.put((key_, full, ids[full:].copy(), len(ids)))):
                    done(window)
            yield batch()
        for window in windows.rest():
            done(window)
            if len(rows) >= 10_000:
                yield batch()
        yield batch()

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
