"""Sizes of texts in tokens by the name of a tokenizer; others can be registered under a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeseam.functions import columns as C

TOKENIZERS: dict[str, Callable[[Column], Column]] = {"bytes-3": C.tokens, "bytes-4": C.read_tokens}


def register(name: str, count: Callable[[Column], Column]) -> None:
    """Add a tokenizer: a function from a text column to a column of counts. A name is given once."""
    if name in TOKENIZERS:
        raise ValueError(f"tokenizer {name} is there")
    TOKENIZERS[name] = count


def count_tokens(text: Column, name: str = "bytes-3") -> Column:
    """The number of tokens of a text, 0 for null; raises ValueError for a name that isn't known."""
    if name not in TOKENIZERS:
        raise ValueError(f"no tokenizer {name}, there are {', '.join(sorted(TOKENIZERS))}")
    return F.coalesce(TOKENIZERS[name](text), F.lit(0)).cast("long")
