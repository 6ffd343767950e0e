"""Token counts with a shortcut for words that are one token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .job import ship

ship(__name__)

BLANK = "▁"
# Spaces belong to the word after them; a line break stands alone.
WORD = re.compile(" +[^ \n]*|[^ \n]+")
MOST_KNOWN, LONGEST_KNOWN, TEXTS_AT_ONCE, MERGED_AT_ONCE = 500_000, 64, 100, 1 << 16


class Counts(dict):
    """Number of tokens of each word of a text, for a sentencepiece model of merged pairs.

    A merge makes a piece of the vocabulary, so where no piece goes across a
    boundary the parts on both sides are encoded each for itself.  ``proven``
    shows that this holds before every space and around every line break, and
    finds the pieces that, standing alone, are encoded as themselves: one
    token, counted without a merge.  The others are merged by the library,
    each once, many in one call.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.break_id = self.library.encode("\n")[-1]
        self.whole = self.proven()

    def proven(self) -> dict[str, int]:
        """The words that are one token; raises if the model's pieces go across the boundaries."""
        model = self.library
        usable = [
            i for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        pieces = [model.id_to_piece(i) for i in usable]
        across = any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces)
        # Blanks are kept, one more is put before the text, and letters stay as they are.
        kept = [model.id_to_piece(i) for i in model.encode(" a  b\n")[:-1]]
        plain = "".join(kept) == f"{BLANK}{BLANK}a{BLANK}{BLANK}b" and self.changed("Ａﬁé\t　") is False
        if across or not plain:
            raise ValueError("the model's pieces go across spaces or line breaks, or it changes the text first")
        self.line_break = len(model.encode("\n\n")) - len(model.encode("\n"))
        words = [p.replace(BLANK, " ") for p in pieces]
        return {w: 1 for w, n in zip(words, self.merged(words), strict=True) if n == 1}

    def changed(self, text: str) -> bool:
        """Does the model change the text, but for blanks, before it encodes it?"""
        return self.library.decode(self.library.encode(text)) != text

    def merged(self, words: list[str]) -> list[int]:
        """Tokens of each word, by the library; the words are told apart by line breaks."""
        out: list[int] = []
        held: list[str] = []
        size = 0
        for word in [*words, None]:
            if word is None or (held and size + len(word) > MERGED_AT_ONCE):
                ids = self.library.encode("\n" + "\n".join(held) + "\n") if held else []
                ends = [i for i, x in enumerate(ids) if x == self.break_id]
                out += [b - a - 1 for a, b in zip(ends, ends[1:])]
                held, size = [], 0
            if word is not None:
                held.append(word)
                size += len(word)
        return out

    def of(self, texts: list[str | None]) -> list[int]:
        if len(self) > MOST_KNOWN:
            self.clear()
        split, breaks, long = [], [], {}
        for text in texts:
            text = f" {text.replace(BLANK, ' ')}" if text else ""
            split.append(WORD.findall(text))
            breaks.append(text.count("\n"))
        new = [w for w in set().union(*split) if w not in self]
        rest = []
        for word in new:
            if word in self.whole:
                self[word] = 1
            else:
                rest.append(word)
        for word, n in zip(rest, self.merged(rest), strict=True):
            (self if len(word) <= LONGEST_KNOWN else long)[word] = n
        known = self.__getitem__
        if long:
            known = lambda w: long[w] if len(w) > LONGEST_KNOWN and w in long else self[w]
        return [sum(map(known, words)) + self.line_break * n for words, n in zip(split, breaks, strict=True)]


def known_counts(path: str) -> Counts:
    """The counts that this worker process knows already; proven once in each."""
    import sentencepiece

    shared = vars(sentencepiece).setdefault("_known_counts", {})
    if path not in shared:
        shared[path] = Counts(path)
    return shared[path]


def tokens(text: Column | str, model: str) -> Column:
    """The number of tokens of a text column, as the sentencepiece library counts them without begin and end.

    Null and empty texts have none.  ``model`` is a file that every executor
    has.  What a worker remembers is bounded: words of up to ``LONGEST_KNOWN``
    letters, ``MOST_KNOWN`` of them and those of one batch of texts.
    """

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = known_counts(model)
        for texts in batches:
            out: list[int] = []
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                out += counts.of(texts.iloc[at : at + TEXTS_AT_ONCE].tolist())
            yield pd.Series(out, dtype="int64")

    return count(text)


def with_tokens(df: DataFrame, model: str, text: str = "text", name: str = "n_tokens", limit: int | None = None) -> DataFrame:
    """Every row with its number of tokens in ``name`` and, with a ``limit``, whether it is over in ``over_limit``.

    Nothing is shuffled and only the text goes to Python.  Whole texts are
    counted, repeated rows each; an empty table stays empty.  Columns that
    have the new names already are replaced; all others stay as they are.
    """
    counted = df.withColumn(name, tokens(F.col(f"`{text}`"), model))
    return counted if limit is None else counted.withColumn("over_limit", F.col(f"`{name}`") > limit)
