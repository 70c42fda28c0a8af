"""Sizes of texts in tokens of public tokenizers, whose vocabulary files are read from a folder given as a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files on every node.
VOCABULARIES = "/opt/tokenizers"
#: Splits text before the merges of the rank files (fixed value, as published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = "byte_bpe_50k.tiktoken"
#: One file for each public vocabulary.
ALL = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model")
#: Texts above this many characters are counted in slices that end before a space or a line end.
SLICE = 200_000


@lru_cache(maxsize=8)
def counter(name: str = DEFAULT, folder: str = VOCABULARIES) -> Callable[[str], int]:
    """A function from a text to its number of tokens; loaded once per Python worker."""
    path = os.path.join(folder, name)
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = lambda text: len(coding.encode_ordinary(text))
    elif name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda text: len(pieces.encode(text))
    else:
        from tokenizers import Tokenizer

        words = Tokenizer.from_file(path)
        words.encode_special_tokens = True
        count = lambda text: len(words.encode(text, add_special_tokens=False).ids)

    def sliced(text: str) -> int:
        """Whole text; very long ones slice by slice, which keeps the time linear."""
        return count(text) if len(text) <= SLICE else sum(map(count, slices(text, SLICE)))

    return sliced


def slices(text: str, most: int) -> Iterator[str]:
    """The text in parts of at most `most` characters that end before a space or a line end where there is one."""
    at = 0
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text):
            cut = max(text.rfind("\n", at + 1, end), text.rfind(" ", at + 1, end))
            end = cut if cut > at else end
        yield text[at:end]
        at = end


def exceeds(text: str, capacity: int, size: Callable[[str], int]) -> bool:
    """Whether a text has more tokens than capacity. Counting in parts stops where the parts leave no doubt, as they
    may differ from the whole by a few tokens at their seams; a text they leave in doubt is counted as a whole."""
    total = 0
    for n, part in enumerate(slices(text, 4 * capacity), 1):
        total += size(part)
        if total > 1.25 * capacity + 8 * n:
            return True
    return size(text) > capacity


def n_tokens(text: Column, name: str = DEFAULT, folder: str = VOCABULARIES) -> Column:
    """Tokens of a text; 0 for null and for the empty text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = counter(name, folder)
        for texts in batches:
            yield pd.Series([size(t) if t else 0 for t in texts], dtype="int64")

    return count(text)


def above_in_all(df: DataFrame, text: str, capacity: int, names: tuple[str, ...] = ALL, folder: str = VOCABULARIES) -> DataFrame:
    """The rows whose text has more tokens than capacity, whichever of the tokenizers counts."""

    @F.pandas_udf("boolean")
    def above(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = [counter(n, folder) for n in names]
        for texts in batches:
            yield pd.Series([bool(t) and all(exceeds(t, capacity, size) for size in sizes) for t in texts], dtype="bool")

    # Marked so that the optimizer doesn't count all texts before a join that leaves few.
    return df.where(above.asNondeterministic()(F.col(text)))
