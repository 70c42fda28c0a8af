"""Problem 3: the most similar vectors of every vector, by additive quantisation and exact reranking.

An index is fitted on a bounded sample: cells and, for what remains of a vector after its cell's centre, additive
codebooks over the full dimension. The number of cells grows with that of the vectors, the index does not: beyond
MAX_CELLS centroids a cell is a centroid plus a code of each of one or more shared books, found by the same beam search.
Every vector is stored in its nearest cell with its codes and the norms that its codes leave. A query visits its nearest
cells, is scored against all their vectors by lookup tables, and what may be similar enough by the stored norms is
compared exactly. Models are never compared with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.session import parts_for, salt, small_side

#: Vectors a cell should hold, and the most centroids of a model; more cells are made of centroids and codes.
CELL_VECTORS, MAX_CELLS, FINE_CODES = 400, 2048, 256
#: At most so many vectors of a model fit its index: per cell, and in all; of these so many fit the codebooks.
SAMPLE_PER_CELL, SAMPLE_MAX, SAMPLE_CODES = 20, 40_960, 8_192
#: At most so many vectors of all models together (but 256 of each).
SAMPLE_ALL = 200_000
#: How many vectors are placed to find the cells that hold too many, where the sample says too little; only counts leave the tasks.
COUNT_SAMPLE, COUNT_HITS = 4_000_000, 16
#: Codebooks, codes in each, beam of the search.
BOOKS, CODES, BEAM = 12, 64, 4
#: A cell whose share of the sample says it holds more than this many vectors is stored in blocks of half as many.
BLOCK_FROM = 4 * CELL_VECTORS
#: Copies of one vector above this number keep the first KEEP ids as candidates; none after them can be among ten.
COPIES_FROM, KEEP = 1_000, 11
#: Slack for the single precision of scores by lookup.
ROUNDING = 1e-4


class Index(NamedTuple):
    """What is fitted for one model; of fixed size whatever the number of vectors."""

    dim: int
    cells: np.ndarray  # (L, dim), directions of length 1
    means: np.ndarray  # (L, dim), mean of the vectors nearest to a centroid
    fine: np.ndarray  # (levels, F, dim), codes that divide what is near a centroid; no levels while centroids suffice
    books: np.ndarray  # (BOOKS, CODES, dim)
    large: np.ndarray  # the cells that are stored in blocks, in order
    n_blocks: np.ndarray  # in how many

    def centres(self, cells: np.ndarray) -> np.ndarray:
        """The centre of each cell (n, dim)."""
        rest, out = cells, 0
        for book in self.fine[::-1]:
            out = out + book[rest % len(book)]
            rest = rest // len(book)
        return self.means[rest] + out

    def blocks(self, cells: np.ndarray) -> np.ndarray:
        """In how many blocks each cell is stored."""
        if not len(self.large):
            return np.ones(len(cells), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.large, cells), len(self.large) - 1)
        return np.where(self.large[at] == cells, self.n_blocks[at], 1)

    def nearest(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """(n, at most probes) cells nearest to each vector, the nearest first."""
        near = unit @ self.cells.T
        wide = min(near.shape[1], probes if not len(self.fine) else max(2 * probes, 16))
        cells = np.argpartition(-near, wide - 1, axis=1)[:, :wide] if wide < near.shape[1] else np.tile(np.arange(wide), (len(unit), 1))
        if not len(self.fine):
            return np.take_along_axis(cells, np.argsort(-np.take_along_axis(near, cells, 1), axis=1, kind="stable"), 1)
        out = [self._refine(unit[lo : lo + 2000], cells[lo : lo + 2000], probes) for lo in range(0, len(unit), 2000)]
        return np.concatenate(out) if out else cells

    def _refine(self, unit: np.ndarray, cells: np.ndarray, probes: int) -> np.ndarray:
        """From the nearest centroids to the nearest cells, level by level, by distance."""
        rest = unit[:, None, :] - self.means[cells]
        error = (rest**2).sum(2)
        for level, book in enumerate(self.fine, 1):
            keep = probes if level == len(self.fine) else max(2 * probes, 16)
            branch, code, error, rest = _extend(rest, error, book, keep)
            cells = np.take_along_axis(cells, branch, 1) * len(book) + code
        return np.take_along_axis(cells, np.argsort(error, axis=1, kind="stable"), 1)


# --- fitting ----------------------------------------------------------------------------------------------------------


def _sums(x: np.ndarray, a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows of each of k classes, and their number."""
    n = np.bincount(a, minlength=k)
    out = np.zeros((k, x.shape[1]), dtype=np.float32)
    some = np.flatnonzero(n)
    starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
    out[some] = np.add.reduceat(x[np.argsort(a, kind="stable")], starts, axis=0)
    return out, n


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = (x @ c.T - (0 if unit else 0.5 * (c**2).sum(1))).argmax(1)
        s, n = _sums(x, a, k)
        empty = n == 0
        c = np.where(empty[:, None], x[rng.integers(len(x), size=k)], s / np.maximum(n, 1)[:, None])
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c.astype(np.float32)


def _fit_cells(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centroids in two levels: each coarse cell gets as many as its share of the sample, so that cells fill evenly."""
    if k <= 16:
        return _k_means(x, k, 10, rng, True)
    coarse = _k_means(x, int(k**0.5) + 1, 8, rng, True)
    a = (x @ coarse.T).argmax(1)
    parts = [x[a == j] for j in range(len(coarse))]
    return np.vstack([_k_means(p, max(1, round(k * len(p) / len(x))), 8, rng, True) for p in parts if len(p)])


def _extend(rest: np.ndarray, error: np.ndarray, book: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of a beam search: the `keep` best (branch, code) of each row, what they leave as squared error and as vector.

    rest: (n, beam, dim), error: (n, beam).
    """
    n, wide, dim = rest.shape
    # |r - c|^2 = |r|^2 - 2 r.c + |c|^2 for every branch of the beam and every code
    now = (error[:, :, None] - 2 * (rest.reshape(n * wide, dim) @ book.T).reshape(n, wide, -1) + (book**2).sum(1)).reshape(n, -1)
    keep = min(keep, now.shape[1])
    best = np.argpartition(now, keep - 1, axis=1)[:, :keep] if keep < now.shape[1] else np.tile(np.arange(keep), (n, 1))
    branch, code = best // len(book), best % len(book)
    rows = np.arange(n)[:, None]
    return branch, code, now[rows, best], rest[rows, branch] - book[code]


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(n, BOOKS) codes whose vectors add up to nearly x: beam search, codebook by codebook, over the full dimension."""
    n, m = len(x), len(books)
    codes = np.zeros((n, 1, m), dtype=np.uint8)
    rest = x[:, None, :]
    error = (x**2).sum(1)[:, None]
    for j, book in enumerate(books):
        branch, code, error, rest = _extend(rest, error, book, beam if j < m - 1 else 1)
        codes = np.take_along_axis(codes, branch[:, :, None], 1)
        codes[:, :, j] = code
    return codes[:, 0]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return books[np.arange(len(books))[None, :], codes].sum(1)


def fit_books(x: np.ndarray, rng: np.random.Generator, rounds: int = 2) -> np.ndarray:
    """Codebooks: each begins on what the ones before leave, then all are solved together for the codes found, by least squares."""
    rest, books = x.copy(), []
    for _ in range(BOOKS):
        book = _k_means(rest, CODES, 6, rng, False)
        if len(book) < CODES:
            book = np.vstack([book, np.zeros((CODES - len(book), x.shape[1]), dtype=np.float32)])
        books.append(book)
        rest = rest - book[(rest @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
    out = np.stack(books)
    for _ in range(rounds if len(x) >= 4 * CODES else 0):
        hot = encode(x, out).astype(np.int64) + np.arange(BOOKS) * CODES
        chosen = np.zeros((len(x), BOOKS * CODES), dtype=np.float32)
        np.put_along_axis(chosen, hot, 1, axis=1)
        gram, target = chosen.T @ chosen, chosen.T @ x
        gram[np.diag_indices_from(gram)] += 0.1 + 1e-3 * len(x) / CODES
        out = np.linalg.solve(gram.astype(float), target.astype(float)).reshape(BOOKS, CODES, -1).astype(np.float32)
    return out


def _blocks(cells: np.ndarray, hits: np.ndarray, each: float) -> tuple[np.ndarray, np.ndarray]:
    """The cells that hold too many vectors, and in how many blocks they go; few hits tell nothing."""
    held = hits * each
    large = (held > BLOCK_FROM) & (hits >= COUNT_HITS)
    return cells[large], np.ceil(held[large] / (BLOCK_FROM / 2)).astype(np.int64)


def fit_index(sample: np.ndarray, vectors: int) -> Index:
    """An index for about `vectors` vectors, from a sample of them (of length 1)."""
    rng = np.random.default_rng(11)
    wanted = max(1, -(-vectors // CELL_VECTORS))
    cells = _fit_cells(sample, min(MAX_CELLS, wanted, len(sample)), rng)
    home = (sample @ cells.T).argmax(1)
    sums, n = _sums(sample, home, len(cells))
    means = sums / np.maximum(n, 1)[:, None]
    fine = np.zeros((0, 1, sample.shape[1]), dtype=np.float32)
    more = wanted / MAX_CELLS if wanted > MAX_CELLS else 1.0
    if more > 1:
        levels = max(1, math.ceil(math.log(more) / math.log(FINE_CODES) - 1e-9))
        codes = max(2, min(math.ceil(more ** (1 / levels)), len(sample)))
        books, rest = [], sample - means[home]
        for _ in range(levels):
            books.append(_k_means(rest, codes, 8, rng, False))
            rest = rest - books[-1][(rest @ books[-1].T - 0.5 * (books[-1] ** 2).sum(1)).argmax(1)]
        fine = np.stack(books)
    none = np.zeros(0, dtype=np.int64)
    index = Index(sample.shape[1], cells, means, fine, np.zeros((0, 1, sample.shape[1]), dtype=np.float32), none, none)
    home = index.nearest(sample, 1)[:, 0]
    large, n_blocks = _blocks(*np.unique(home, return_counts=True), vectors / len(sample))
    part = slice(0, SAMPLE_CODES)
    return index._replace(books=fit_books(sample[part] - index.centres(home[part]), rng), large=large, n_blocks=n_blocks)


# --- tables -----------------------------------------------------------------------------------------------------------


def valid_vectors(rows: DataFrame, models: DataFrame, item: str, model: str, vector: str) -> DataFrame:
    """(id, model, vector) of the rows whose vector has the length of its model; zeros and NaN are left out later on."""
    dims = small_side(models.where(F.col(model).isNotNull()).groupBy(F.col(model).alias("model")).agg(F.max("dim").alias("dim")))
    known = rows.select(
        F.col(item).cast("long").alias("id"), F.col(model).alias("model"), F.col(vector).cast("array<float>").alias("vector")
    ).where("id is not null and vector is not null")
    return known.join(dims, "model").where("size(vector) = dim").select("id", "model", "vector")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a batch (all of one length) as a matrix, and which of them are valid."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = values.reshape(len(column), -1)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    return x, np.isfinite(size) & (size > 0)


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def _drawn(parts: dict[str, float], seed: int) -> Column:
    """Whether a vector is in the sample of its model, by the hash of its id."""
    within = F.lit(False)
    for m, part in parts.items():
        within = within | ((F.col("model") == m) & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(part * (1 << 40)) + 1))
    return within


def fit(vectors: DataFrame, seed: int = 3) -> dict[str, Index]:
    """model -> Index. The driver gets a sample by hash of the ids: at most SAMPLE_MAX vectors of a model and SAMPLE_ALL of all."""
    counts = {r["model"]: r["n"] for r in vectors.groupBy("model").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    most = min(SAMPLE_MAX, max(256, SAMPLE_ALL // len(counts)))
    share = {m: min(1.0, min(most, max(SAMPLE_PER_CELL * -(-n // CELL_VECTORS), SAMPLE_CODES)) / n) for m, n in counts.items()}
    drawn = vectors.where(_drawn(share, seed)).select("id", "model", "vector").toArrow()
    found = {}
    for m, n in counts.items():
        mine = drawn.filter(pa.compute.equal(drawn["model"], m)).sort_by("id")
        if len(mine):
            x, ok = _matrix(mine["vector"].combine_chunks())
            if ok.any():
                found[m] = fit_index(_unit(x[ok]), n)
    return _count_cells(vectors, found, counts, share, seed)


def _count_cells(vectors: DataFrame, indexes: dict[str, Index], counts: dict[str, int], share: dict[str, float], seed: int) -> dict[str, Index]:
    """The indexes with the blocks of models so large that COUNT_HITS of the sample would be more than a cell may hold.

    The driver gets the cells with COUNT_HITS vectors or more among COUNT_SAMPLE: at most COUNT_SAMPLE / COUNT_HITS rows a model.
    """
    again = {m: min(1.0, COUNT_SAMPLE / counts[m]) for m in indexes if COUNT_HITS / share[m] > BLOCK_FROM}
    if not again:
        return indexes
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model in pa.compute.unique(batch["model"]).to_pylist():
                x, ok = _matrix(batch.filter(pa.compute.equal(batch["model"], model))["vector"])
                cells = shared.value[model].nearest(_unit(x[ok]), 1)[:, 0] if ok.any() else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([model] * len(cells), pa.string()), pa.array(cells.astype(np.int64))], names=["model", "cell"])

    placed = vectors.where(_drawn(again, seed + 1)).select("model", "vector").mapInArrow(run, "model string, cell long")
    hits = placed.groupBy("model", "cell").agg(F.count("*").alias("n")).where(F.col("n") >= COUNT_HITS).toPandas()
    for m, part in again.items():
        mine = hits[hits["model"] == m].sort_values("cell")
        large, n_blocks = _blocks(mine["cell"].to_numpy(), mine["n"].to_numpy(), 1 / part)
        indexes[m] = indexes[m]._replace(large=large, n_blocks=n_blocks)
    return indexes


_PLACED = "model string, cell long, block int, id long, member boolean, asks boolean, vec binary, codes binary, norm float, along float, across float"


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    step = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * step).astype(np.int32)), pa.py_buffer(x)])


def place(vectors: DataFrame, indexes: dict[str, Index], probes: int, asking_every: int = 1, aside: DataFrame | None = None) -> DataFrame:
    """Every vector once as a member of its cell, and every asking one once for each other cell (and block) that it visits.

    Asking are those whose id is divisible by asking_every. aside holds the ids (id) that are no candidates.
    """
    if aside is not None:
        vectors = vectors.join(aside.select("id", F.lit(True).alias("aside")), "id", "left")
    else:
        vectors = vectors.withColumn("aside", F.lit(None).cast("boolean"))
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)  # of fixed size, see Index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model in pa.compute.unique(batch["model"]).to_pylist():
                index = shared.value.get(model)
                if index is None:
                    continue
                rows = batch.filter(pa.compute.equal(batch["model"], model))
                x, ok = _matrix(rows["vector"])
                ids, x = rows["id"].to_numpy()[ok], x[ok]
                out = pa.compute.fill_null(rows["aside"], False).to_numpy(zero_copy_only=False)[ok]
                if not len(ids):
                    continue
                unit = _unit(x)
                visits = index.nearest(unit, probes)
                p = visits.shape[1]
                home = visits[:, 0]
                base = index.centres(home)
                left = unit - base
                codes = encode(left, index.books)
                coded = decode(codes, index.books)
                norm = ((left**2).sum(1) / np.maximum((left * coded).sum(1), 1e-3)).clip(0, 8).astype(np.float32)
                # What the code and its cell say of the vector: their part along it, and the length of what lies across.
                said = base + coded
                along = (unit * said).sum(1)
                across = np.sqrt(np.maximum((said**2).sum(1) - along**2, 0))
                asks = ids % asking_every == 0
                own_block = (ids * 2654435761 % 2**32) % index.blocks(home)
                r, k = np.nonzero(np.repeat(asks[:, None], p, axis=1))
                cells = visits[r, k]
                n_blocks = index.blocks(cells)
                again = np.repeat(np.arange(len(r)), n_blocks)
                block = np.concatenate([np.arange(b) for b in n_blocks]) if len(n_blocks) else np.zeros(0, dtype=int)
                r, cells = r[again], cells[again]
                other = ~((cells == home[r]) & (block == own_block[r]) & ~out[r])
                r, cells, block = r[other], cells[other], block[other]
                m = np.nonzero(~out)[0]
                take = np.concatenate([m, r])
                codes_all = pa.concat_arrays([_binary(codes[m]), pa.nulls(len(r), pa.binary())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([model] * len(take), pa.string()), pa.array(np.concatenate([home[m], cells]).astype(np.int64)), pa.array(
                            np.concatenate([own_block[m], block]).astype(np.int32)
                        ), pa.array(ids[take]),
                        pa.array(np.arange(len(take)) < len(m)), pa.array(asks[take]), _binary(x[take]), codes_all, pa.array(norm[take]), pa.array(
                            along[take].astype(np.float32)
                        ), pa.array(
                            across[take].astype(np.float32)
                        ),
                    ],
                    names=[c.split()[0] for c in _PLACED.split(", ")],
                )

    return vectors.select("id", "model", "vector", "aside").mapInArrow(run, _PLACED)


def _least_score(along: np.ndarray, across: np.ndarray, similarity: float) -> np.ndarray:
    """The least that lookup can score a query of that similarity, or a greater one, to a vector x; so none is lost.

    A query of similarity s is s x + r u with r = sqrt(1 - s^2) and u across x, so it scores s along + r (u . said), at
    least s along - r across. From the given similarity on this rises, unless along is far below 0: then the length of
    what the code says bounds it.
    """
    rest = math.sqrt(max(0.0, 1 - similarity**2))
    return np.where(along * rest + similarity * across >= 0, similarity * along - rest * across, -np.hypot(along, across))


def _scan(k: int, at_least: float | None, rerank: int, shared):
    """The search of one block of one cell: lookup tables, then exact similarity of what scores high."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        index = shared.value[key[0]]
        members = frame[frame["member"]].drop_duplicates("id")
        asking = frame[frame["asks"]].drop_duplicates("id")
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if members.empty or asking.empty:
            return empty
        x = np.frombuffer(b"".join(members["vec"]), dtype=np.float32).reshape(len(members), -1)
        codes = np.frombuffer(b"".join(members["codes"]), dtype=np.uint8).reshape(len(members), -1)
        norm, ids, asking_ids = members["norm"].to_numpy(), members["id"].to_numpy(), asking["id"].to_numpy()
        wide = x.astype(np.float64)
        wide /= np.linalg.norm(wide, axis=1, keepdims=True)
        single = wide.astype(np.float32)
        centre = index.centres(np.array([key[1]]))[0]
        if at_least is not None:
            least = _least_score(members["along"].to_numpy(), members["across"].to_numpy(), at_least) - ROUNDING
        flat = index.books.reshape(-1, index.dim)
        column = codes.astype(np.int64) + np.arange(len(index.books)) * CODES
        out = []
        step = max(1, 4_000_000 // max(1, len(members)))
        for lo in range(0, len(asking), step):
            q = np.frombuffer(b"".join(asking["vec"].iloc[lo : lo + step]), dtype=np.float32).reshape(-1, index.dim).astype(np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            narrow = q.astype(np.float32)
            table = flat @ narrow.T  # a code's row holds its part of the score of every query
            score = np.zeros((len(members), len(narrow)), dtype=np.float32)
            for m in range(len(index.books)):
                score += table[column[:, m]]
            if at_least is None:
                score *= np.sqrt(norm)[:, None]  # by the root of the stored norm a score is nearest to the truth, as ranks need
            score += narrow @ centre
            here = asking_ids[lo : lo + step]
            if at_least is not None:
                b, a = np.nonzero(score >= least[:, None])
            else:
                score = score.T
                score[here[:, None] == ids[None, :]] = -9
                r = min(rerank, len(members))
                b = (np.argpartition(-score, r - 1, axis=1)[:, :r] if r < len(members) else np.tile(np.arange(r), (len(here), 1))).ravel()
                a = np.repeat(np.arange(len(here)), r)
            same = here[a] == ids[b]
            a, b = a[~same], b[~same]
            if at_least is not None:  # in single precision first, which leaves few
                near = np.empty(len(a), dtype=np.float32)
                for s in range(0, len(a), 50_000):
                    near[s : s + 50_000] = np.einsum("ij,ij->i", narrow[a[s : s + 50_000]], single[b[s : s + 50_000]])
                high = near >= at_least - ROUNDING
                a, b = a[high], b[high]
            exact = np.empty(len(a))
            for s in range(0, len(a), 100_000):
                exact[s : s + 100_000] = (q[a[s : s + 100_000]] * wide[b[s : s + 100_000]]).sum(1)
            exact = exact.round(9)
            if at_least is not None:
                high = exact >= at_least
                a, b, exact = a[high], b[high], exact[high]
            order = np.lexsort((ids[b], -exact, a))
            a, b, exact = a[order], b[order], exact[order]
            first = np.searchsorted(a, a)  # a is sorted: where its run begins
            near = np.arange(len(a)) - first < k
            out.append(pd.DataFrame({"id": here[a[near]], "other": ids[b[near]], "similarity": exact[near]}))
        return pd.concat(out) if out else empty

    return run


def best_of(edges: DataFrame, k: int, salts: int = 16) -> DataFrame:
    """The k best of each id (similarity descending, other ascending) with their rank; in two stages, so that no task gets all rows of an id."""
    order = [F.col("similarity").desc(), F.col("other").asc()]
    once = edges.groupBy("id", "other").agg(F.max("similarity").alias("similarity")).withColumn("s", salt(F.col("other"), salts))
    few = once.withColumn("rank", F.row_number().over(Window.partitionBy("id", "s").orderBy(*order))).where(F.col("rank") <= k)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k).select("id", "other", "similarity", "rank")


def surplus_copies(vectors: DataFrame) -> DataFrame | None:
    """The ids, of vectors that occur more than COPIES_FROM times, after the first KEEP; None if no vector does."""
    marked = vectors.select("id", "model", F.xxhash64("vector").alias("v"))
    many = marked.groupBy("model", "v").agg(F.count("*").alias("n")).where(F.col("n") > COPIES_FROM).select("model", "v")
    if many.isEmpty():
        return None
    copies = marked.join(small_side(many), ["model", "v"]).dropDuplicates(["id"]).withColumn("s", salt(F.col("id"), 256))
    few = copies.withColumn("r", F.row_number().over(Window.partitionBy("model", "v", "s").orderBy("id"))).where(F.col("r") <= KEEP)
    first = few.withColumn("r", F.row_number().over(Window.partitionBy("model", "v").orderBy("id"))).where(F.col("r") <= KEEP).select("id")
    return copies.select("id").join(first, "id", "left_anti")


def search(vectors: DataFrame, k: int, probes: int, at_least: float | None = None, asking_every: int = 1, rerank: int = 224) -> DataFrame:
    """(id, other, similarity): candidates for the k most similar others of each asking id, at most k per visited block.

    vectors: see valid_vectors. With at_least only pairs of that cosine similarity or more. Ties go to the smaller id. Of
    more than COPIES_FROM identical vectors those after the first KEEP ids can't be among anyone's ten best (ties) and
    only ask. Ids that occur twice count once; vectors of zeros, NaN or a wrong length take no part.
    """
    if k > KEEP - 1:
        raise ValueError(f"k is at most {KEEP - 1}")
    indexes = fit(vectors)
    schema = "id long, other long, similarity double"
    spark = vectors.sparkSession
    if not indexes:
        return spark.createDataFrame([], schema)
    placed = place(vectors, indexes, probes, asking_every, surplus_copies(vectors))
    return placed.groupBy("model", "cell", "block").applyInPandas(_scan(k, at_least, rerank, spark.sparkContext.broadcast(indexes)), schema)


def search_exact(vectors: DataFrame, k: int, at_least: float | None = None, asking_every: int = 1, block_rows: int = 20_000) -> DataFrame:
    """(id, other, similarity) as search, by comparing every asking vector with every other one of its model.

    Nothing is missed, at the price of n * asking comparisons. Members and asking ones go in blocks of about block_rows; a
    vector travels once for each block of the other kind, so that a task holds two blocks however large a model is.
    """
    counts = {r["model"]: r["n"] for r in vectors.groupBy("model").agg(F.count("*").alias("n")).collect()}
    schema = "id long, other long, similarity double"
    if not counts:
        return vectors.sparkSession.createDataFrame([], schema)
    sizes = [(m, parts_for(n, block_rows), parts_for(-(-n // asking_every), block_rows)) for m, n in counts.items()]
    rows = vectors.join(F.broadcast(vectors.sparkSession.createDataFrame(sizes, "model string, mine int, theirs int")), "model")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = rows.withColumns({"block": salt(F.col("id"), F.col("mine")).cast("int"), "asks": F.lit(False)}).withColumn("turn", every("theirs"))
    asking = rows.where(F.pmod("id", F.lit(asking_every)) == 0)
    asking = asking.withColumns({"turn": F.pmod(F.xxhash64("id", F.lit(1)), F.col("theirs")).cast("int"), "asks": F.lit(True)}).withColumn("block", every("mine"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["id", "asks"])
        x = np.array(frame["vector"].tolist(), dtype=np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            size = np.linalg.norm(x, axis=1)
        ok = np.isfinite(size) & (size > 0)
        x, ids, asks = x[ok] / size[ok][:, None], frame["id"].to_numpy()[ok], frame["asks"].to_numpy(dtype=bool)[ok]
        member, member_ids, out = x[~asks], ids[~asks], []
        for i, q in zip(ids[asks], x[asks]):
            s = (member @ q).round(9)
            near = np.flatnonzero((member_ids != i) & (s >= (-2 if at_least is None else at_least)))
            near = near[np.lexsort((member_ids[near], -s[near]))[:k]]
            out.append(pd.DataFrame({"id": i, "other": member_ids[near], "similarity": s[near]}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "similarity": []})

    columns = ["model", "block", "turn", "id", "asks", "vector"]
    return members.select(columns).unionByName(asking.select(columns)).groupBy("model", "block", "turn").applyInPandas(run, schema)


def mutual(edges: DataFrame, k: int) -> DataFrame:
    """(a, b), a < b: pairs in which each is among the k best of the other; a pair found from one side counts for both."""
    both = edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "similarity"))
    best = best_of(both, k)
    pairs = best.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2").select("a", "b")
