"""Encoders of text to vectors of length 1, by name; the default hashes words and needs no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"[^\W_]+")


def hashing(dim: int) -> Callable[[], Encode]:
    """Signed hashes of words and pairs of words, weighted by the root of their number."""

    def load() -> Encode:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in zip(out, texts):
                words = [w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", text or ""))]
                for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                    h = xxhash.xxh64_intdigest(w)
                    row[h % dim] += 1.0 if h >> 63 else -1.0
                np.copyto(row, np.sign(row) * np.sqrt(np.abs(row)))
                row /= max(float(np.linalg.norm(row)), 1e-9)
            return out

        return encode

    return load


#: name -> a function that loads the encoder, once in each worker; add others (say, a transformer) here.
ENCODERS: dict[str, Callable[[], Encode]] = {"hash-96": hashing(96), "hash-384": hashing(384)}


class Preset(NamedTuple):
    dim: int
    chunk_chars: int


# Models that are known by name; any other is taken to be as the last.
PRESETS = {"minilm": Preset(384, 1500), "codebert": Preset(768, 2000), "starencoder": Preset(768, 2000)}
OTHER = Preset(768, 2000)


def preset(name: str) -> Preset:
    """The length of a model's vectors and of the chunks that it takes."""
    return PRESETS.get(name.lower(), OTHER)


def add_encoder(name: str, load: Callable[[], Encode] | None = None) -> None:
    """Make an encoder known under a name; without one, words are hashed to vectors of the length of the model's preset."""
    ENCODERS[name] = load or hashing(preset(name).dim)


def encode(text: Column, name: str = "hash-384") -> Column:
    """The vector of a text; of nothing but zeros for null and for texts without words."""
    load = ENCODERS[name]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model([t or "" for t in texts])))

    return run(text)
