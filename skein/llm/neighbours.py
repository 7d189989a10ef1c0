"""Most similar vectors for every vector: randomly rotated one-bit codes over an inverted file of cells.

1. The latest row of each file counts; vectors that are null, all zero, not finite or of the wrong length drop out. Files
   with equal vectors of a model become one class, so copies, however many, are compared once. All models go through one
   pass: their cells are numbered one after the other, and no vector meets those of another model.
2. Per model, cell centres are fitted in two levels on a bounded sample (SAMPLE vectors, or PER_CENTRE for each centre);
   every vector is compared with all centres, indexed in its nearest cell and searches its PROBES nearest cells at first.
   Cells hold about CELL classes, up to MAX_CELLS cells a model, that is up to 16.7 million classes; beyond that cells grow
   in proportion. Crowded cells are dealt into blocks of vectors and of searches, so no task gets a whole one.
3. Vectors are one-bit codes of the randomly rotated residual to their cell's centre, packed in bytes, with correction
   scalars. In the own cell, the best estimates are reranked first, and then all vectors whose estimate with its error
   bound reaches the k-th cosine so found. That cosine is the floor for the other cells, which are searched by codes alone:
   what travels there is the search vector in four bits per number, and what comes back are the pairs whose error bound
   reaches the floor. Only for these are vectors fetched and cosines computed.
4. The more cells there are, the more neighbours lie in cells not asked. So, for models with more than PROBES cells, the
   vectors that are linked to one vector meet there and are compared; and a sample of the searches is compared with all
   vectors of the model by brute force, which says what share of the neighbours is known. Rounds of meetings go on until it
   is ENOUGH; where they bring little, twice as many cells are asked, up to all of them.
5. The k best of all cells per class are spread to the files of the classes; equal cosines are ordered by path.

Recall against brute force: see README; the tests hold it at 0.95 or more. Defined cases: null or empty paths and models are
values like others (a null path is no file); rows with null created_at are older than all others; ties in created_at take
the greatest (model, dimensions, hash of the vector); models, and dimensions of one model, are never mixed; a model with
one file gives no pair; more than MAX_MODELS models are an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.operators.skew import salted_join
from skein.session import cut

K = 5
#: Vectors per model on which centres are fitted, at least; and per centre, if that is more.
SAMPLE, PER_CENTRE = 20_000, 4
CELL, MAX_CELLS, PROBES = 256, 65_536, 12
#: Up to so many cells, centres are fitted in one level. Centres are compared in runs of so many.
FLAT, RUN = 1_024, 32
#: Models are numbered on the driver; their number is checked.
MAX_MODELS = 1_000
#: Rows of a block of a cell's vectors, and of its searches.
BLOCK, SEARCH_BLOCK = 2_048, 16_384
#: Share of the neighbours that must be there, by brute force for so many searches of a model; a round that closes less than
#: LITTLE of what is missing is the last before further cells are asked.
ENOUGH, MEASURED, LITTLE = 0.995, 400, 0.25
#: Vectors, nearest first, that meet at one of which they are searches.
LINKS = 32
#: Width of the error bound of an estimate, in standard deviations.
WIDTH = 1.9


def latest(rows: DataFrame) -> DataFrame:
    """(path, model, h1, h2) of each file's latest row, if its vector takes part; h1 and h2 stand for the vector. Vectors themselves are
    not moved."""
    r = rows.where(F.col("file_path").isNotNull()).select("file_path", F.struct("created_at", "model", "dimensions", *_key(), _good().alias("good"), _model().alias("kind")).alias("r"))
    return r.groupBy("file_path").agg(F.max("r").alias("r")).where("r.good").select(F.col("file_path").alias("path"), F.col("r.kind").alias("model"), "r.h1", "r.h2")


def _good() -> Column:
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vector").isNotNull() & (F.size("vector") == F.col("dimensions")) & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _model() -> Column:
    return F.concat_ws("/", F.coalesce("model", F.lit("")), F.size("vector"))


def _key() -> list[Column]:
    """128 bits for a model's vector."""
    return [F.xxhash64("vector", _model()).alias("h1"), F.xxhash64(_model(), "vector").alias("h2")]


def rotation(d: int, seed: int = 20) -> np.ndarray:
    """A random orthogonal matrix; the same on every worker."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _fit(sample: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """n centres by k-means on unit vectors."""
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = _best(sample, c, 1)[:, 0]
        total = np.zeros_like(c, dtype=np.float64)
        np.add.at(total, home, sample)
        size = np.bincount(home, minlength=len(c))
        empty = size == 0
        total[~empty] /= size[~empty, None]
        total[empty] = sample[rng.integers(0, len(sample), empty.sum())]
        c = total.astype(np.float32)
    return c


class Cells:
    """The cells of a model: centres, in two levels beyond FLAT of them; `first` numbers them among the cells of all models."""

    def __init__(self, sample: np.ndarray, n: int, first: int = 0, rounds: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.first, self.upper = first, None
        if n <= FLAT:
            self.c = _fit(sample, n, rounds, rng)
            return
        self.upper = _fit(sample, math.ceil(math.sqrt(n)), rounds, rng)
        home = _best(sample, self.upper, 1)[:, 0]
        size = np.bincount(home, minlength=len(self.upper))
        share = np.maximum(1, np.rint(n * size / len(sample))).astype(int)
        below = [_fit(sample[home == i], share[i], rounds, rng) if size[i] else self.upper[i : i + 1] for i in range(len(self.upper))]
        self.c = np.concatenate(below)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The numbers (from 0) of the n nearest centres of each vector, nearest first. All centres are compared: upper ones say
        too little about where a vector's neighbours are."""
        return _best(x, self.c, min(n, len(self.c)))


def _best(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each vector, nearest first."""
    out = []
    half = 0.5 * (c * c).sum(axis=1)
    runs = len(c) // RUN if len(c) >= 4 * RUN * n else 0
    rows = max(16, min(2048, 8_388_608 // max(len(c), 1)))
    for i in range(0, len(x), rows):
        s = x[i : i + rows] @ c.T - half
        if runs:  # the n best are in the n runs of centres with the best, or after the last whole run
            best = s[:, : runs * RUN].reshape(len(s), runs, RUN).max(axis=2)
            run = np.argpartition(-best, n - 1, axis=1)[:, :n]
            among = (run[:, :, None] * RUN + np.arange(RUN)).reshape(len(s), -1)
            among = np.concatenate([among, np.broadcast_to(np.arange(runs * RUN, len(c)), (len(s), len(c) - runs * RUN))], axis=1)
            few = np.take_along_axis(s, among, 1)
            top = np.take_along_axis(among, np.argpartition(-few, n - 1, axis=1)[:, :n], 1)
        else:
            top = np.argpartition(-s, min(n, s.shape[1]) - 1, axis=1)[:, :n]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, n), dtype=np.int64)


def encode(x: np.ndarray, c: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, norm of the residual, correction: inner product of the code's vector with the residual's direction)."""
    r = x - c
    norm = np.linalg.norm(r, axis=1)
    o = (r / np.maximum(norm, 1e-12)[:, None]) @ rot.T
    fix = np.abs(o).sum(axis=1) / math.sqrt(x.shape[1])
    return np.packbits(o > 0, axis=1), norm, np.where(norm < 1e-6, 1, fix)  # a vector that is its centre needs no correction


def levels(q: np.ndarray, rot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(four bit planes of the rotated vectors, packed; lowest value; step between the 16 levels)."""
    t = q @ rot.T
    low = t.min(axis=1)
    step = np.maximum((t.max(axis=1) - low) / 15, 1e-12)
    level = np.clip(np.rint((t - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    return np.concatenate([np.packbits(level >> j & 1, axis=1) for j in range(4)], axis=1), low.astype(np.float32), step.astype(np.float32)


def _words(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, -x.shape[1] % 8)))).view(np.uint64)


def estimate(d: int, codes: np.ndarray, norm: np.ndarray, fix: np.ndarray, planes: np.ndarray, low: np.ndarray, step: np.ndarray, at_centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds of their errors) of the cosines of the vectors behind the codes with the search vectors behind the
    planes; at_centre: the inner products of the search vectors with the cell's centre."""
    words, size = _words(codes), codes.shape[1]
    count = np.zeros((len(planes), len(codes)), dtype=np.uint16)
    total = np.zeros(len(planes), dtype=np.float32)
    for j in range(4):
        plane = _words(planes[:, j * size : (j + 1) * size])
        total += (np.bitwise_count(plane).sum(axis=1) << j).astype(np.float32)
        for w in range(words.shape[1]):
            count += np.left_shift(np.bitwise_count(plane[:, w, None] & words[None, :, w]), j, dtype=np.uint16)
    ones = np.bitwise_count(words).sum(axis=1).astype(np.float32)
    dot = (2 * (step[:, None] * count + low[:, None] * ones[None, :]) - (total * step + d * low)[:, None]) / np.float32(math.sqrt(d))
    est = dot * (norm / fix)[None, :].astype(np.float32) + at_centre[:, None].astype(np.float32)
    spread_ = (np.sqrt(np.maximum(1 - fix**2, 0)) / fix * (WIDTH / math.sqrt(max(d - 1, 1))) * norm)[None, :]
    return est, (spread_ + norm[None, :] * (math.sqrt(d) / 40 * step)[:, None]).astype(np.float32)


def search_own(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, fix: np.ndarray, q_ids: np.ndarray, q: np.ndarray, c: np.ndarray, rot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(search id, found id, cosine) of the k best of a cell for each search: the k + 3 best estimates are reranked, and then
    whatever else may reach the k-th cosine of these."""
    found = []
    rows = max(16, 65_536 // max(len(ids), 1))  # estimates of so many searches stay in the cache
    for i in range(0, len(q), rows):
        part, part_ids = q[i : i + rows], q_ids[i : i + rows]
        est, bound = estimate(q.shape[1], codes, norm, fix, *levels(part, rot), part @ c)
        est[part_ids[:, None] == ids[None, :]] = -np.inf
        upper = est + bound
        n = min(k + 3, len(ids))
        first = np.argpartition(-est, n - 1, axis=1)[:, :n]
        cosine = np.einsum("ij,ikj->ik", part.astype(np.float64), x[first].astype(np.float64))
        cosine[~np.isfinite(np.take_along_axis(est, first, 1))] = -np.inf
        floor = -np.partition(-cosine, k - 1, axis=1)[:, k - 1] if n >= k else np.full(len(part), -np.inf)
        np.put_along_axis(upper, first, -np.inf, axis=1)
        a, b = np.nonzero((upper >= floor[:, None]) & np.isfinite(upper))
        more = np.einsum("ij,ij->i", part[a].astype(np.float64), x[b].astype(np.float64))
        a, b, exact = np.r_[np.repeat(np.arange(len(part)), n), a], np.r_[first.ravel(), b], np.r_[cosine.ravel(), more]
        a, b, exact = a[np.isfinite(exact)], b[np.isfinite(exact)], exact[np.isfinite(exact)]
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        start = np.r_[0, np.flatnonzero(np.diff(a)) + 1] if len(a) else np.zeros(0, dtype=int)
        keep = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < k
        found.append((part_ids[a[keep]], ids[b[keep]], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, step, norm of what the rounding takes away) of each vector."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    code = np.rint(x / step[:, None]).astype(np.int8)
    return code, step.astype(np.float32), np.linalg.norm(x - code * step[:, None], axis=1).astype(np.float32)


def search_codes(
    ids: np.ndarray, codes: np.ndarray, norm: np.ndarray, fix: np.ndarray, x8: np.ndarray, x_lost: np.ndarray, q_ids: np.ndarray, q8: np.ndarray, q_lost: np.ndarray, c: np.ndarray, rot: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(search id, found id, lower and upper bound of the cosine) of the pairs of a cell that may reach both the search's
    floor and the k-th best of this cell. x8, q8: the vectors as rounded to bytes; x_lost, q_lost: what that took away."""
    found = []
    rows = max(16, 65_536 // max(len(ids), 1))
    for i in range(0, len(q_ids), rows):
        q, lost, least = q8[i : i + rows], q_lost[i : i + rows], floor[i : i + rows]
        est, bound = estimate(q.shape[1], codes, norm, fix, *levels(q, rot), q @ c)
        bound += lost[:, None]
        if len(ids) > k:
            least = np.maximum(least, -np.partition(bound - est, k - 1, axis=1)[:, k - 1])
        a, b = np.nonzero(est + bound >= least[:, None])
        s = np.einsum("ij,ij->i", q[a], x8[b])
        off = lost[a] + x_lost[b] * (1 + lost[a]) + 1e-6
        low, high = s - off, s + off
        order = np.lexsort((-low, a))
        start = np.searchsorted(a[order], np.arange(len(q) + 1))
        has = np.flatnonzero(np.diff(start) >= k)
        least = least.copy()
        least[has] = np.maximum(least[has], low[order[start[has] + k - 1]])
        keep = high >= least[a]
        found.append((q_ids[i : i + rows][a[keep]], ids[b[keep]], low[keep], high[keep]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def meetings(m: np.ndarray, ids: np.ndarray, x: np.ndarray, lost: np.ndarray, floor: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(search id, found id, lower and upper bound of the cosine) of the pairs of vectors with the same m that may reach the
    floor of the search and are not among what is known of it. m ascends; x: the vectors as rounded to bytes."""
    n = np.searchsorted(m, m, "right") - np.arange(len(m)) - 1
    found, ends = [], np.cumsum(n)
    for first in range(0, int(ends[-1]) if len(ends) else 0, 65_536):
        pair = np.arange(first, min(first + 65_536, ends[-1]))
        i = np.searchsorted(ends, pair, "right")
        j = i + 1 + pair - (ends[i] - n[i])
        s = np.einsum("ij,ij->i", x[i], x[j])
        for a, b in ((i, j), (j, i)):
            off = lost[a] + lost[b] * (1 + lost[a]) + 1e-6
            keep = (s + off >= floor[a]) & ~(known[a] == ids[b][:, None]).any(axis=1) & (ids[a] != ids[b])
            found.append((ids[a][keep], ids[b][keep], (s - off)[keep], (s + off)[keep]))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))


def _cells(files: DataFrame, vectors: DataFrame, cell: int) -> dict[str, Cells]:
    """The cells of each model, fitted on a sample of its rows. files: model, h1, h2; vectors: model, vector."""
    count = lambda df: {r.model: r.n for r in df.groupBy("model").agg(F.count(F.lit(1)).alias("n")).limit(MAX_MODELS + 1).collect()}
    sizes, rows = count(files.select("model", "h1", "h2").distinct()), count(vectors)  # copies fill no cell
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    n_cells = {m: max(1, min(MAX_CELLS, math.ceil(n / cell))) for m, n in sizes.items()}
    fractions = {m: min(1.0, max(SAMPLE, PER_CENTRE * n_cells[m]) / rows[m]) for m in sizes}
    picked = vectors.sampleBy("model", fractions, 11).toPandas() if sizes else None
    out, first = {}, 0
    for model in sorted(sizes):
        own = _unit(np.array(picked["vector"][picked["model"] == model].tolist(), dtype=np.float32))
        out[model] = Cells(own, min(n_cells[model], len(own)), first)
        first += len(out[model].c)
    return out


def _numpy(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _search(classes: DataFrame, cells: dict[str, Cells], k: int, probes: int, enough: float) -> tuple[DataFrame, DataFrame]:
    """(placed classes with id, h1, h2, size; (a, b, cosine) of the k best of every class). classes: model, h1, h2, size, vector."""
    spark = classes.sparkSession
    shared = spark.sparkContext.broadcast(cells)  # at most MAX_CELLS centres a model

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                own, x = shared.value[model], _unit(np.array(part["vector"].tolist(), dtype=np.float32))
                rot = rotation(x.shape[1])
                near = own.nearest(x, probes)
                codes, norm, fix = encode(x, own.c[near[:, 0]], rot)
                bytes_, step, lost = rounded(x)
                yield pd.DataFrame({
                    "id": part["id"], "h1": part["h1"], "h2": part["h2"], "size": part["size"], "model": model, "cells": list((near + own.first).astype(np.int64)), "x": [r.tobytes() for r in x],
                    "code": [r.tobytes() for r in codes], "norm": norm.astype(np.float32), "fix": fix.astype(np.float32), "x8": [r.tobytes() for r in bytes_], "step": step, "lost": lost,
                })

    kinds = "id long, h1 long, h2 long, size long, model string, cells array<long>, x binary, code binary, norm float, fix float, x8 binary, step float, lost float"
    placed = cut(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "size", "model", "vector").mapInPandas(place, kinds))
    home = F.element_at("cells", 1).alias("cell")

    def blocks(tries: DataFrame) -> DataFrame:
        """(cell, nb, nq): the blocks of vectors and of searches of each cell that has both. tries: cell, a row per search."""
        homes = placed.groupBy(home).agg(F.count(F.lit(1)).alias("n_home"))
        tried = tries.groupBy("cell").agg(F.count(F.lit(1)).alias("n_try"))
        return F.broadcast(homes.join(tried, "cell").select("cell", F.ceil(F.col("n_home") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("n_try") / SEARCH_BLOCK).cast("int").alias("nq")))  # a row per cell

    def deal(df: DataFrame, parts: DataFrame, by: str, over: str, dealt: str, repeated: str) -> DataFrame:
        return df.join(parts, "cell").withColumn(dealt, F.pmod(F.xxhash64("id"), by).cast("int")).withColumn(repeated, F.explode(F.sequence(F.lit(0), F.col(over) - 1)))

    def own_cell(key: tuple, t: pa.Table) -> pa.Table:
        ask, model = t.column("ask").to_numpy(), shared.value[t.column("model")[0].as_py()]
        d = model.c.shape[1]
        x, ids = _numpy(t.column("x"), np.float32, d), t.column("id").to_numpy()
        own = ask != 1
        a, b, s = search_own(
            ids[own], x[own], _numpy(t.column("code").filter(pa.array(own)), np.uint8, (d + 7) // 8), t.column("norm").to_numpy()[own], t.column("fix").to_numpy()[own],
            ids[ask > 0], x[ask > 0], model.c[key[0].as_py() - model.first], rotation(d), k,
        )
        return pa.table({"a": a, "b": b, "cosine": s})

    # ask: 0 a vector, 1 a search, 2 both, in cells of one block, where each vector is sent once.
    p1 = blocks(placed.select(home))
    columns = ["cell", "block", "part", "ask", "model", "id", "x", "code", "norm", "fix"]
    rows = placed.select(home, "model", "id", "x", "code", "norm", "fix")
    single = rows.join(p1.where("nb = 1 and nq = 1").select("cell"), "cell").select("*", F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(2).alias("ask"))
    crowded = p1.where("nb > 1 or nq > 1")
    many = deal(rows, crowded, "nb", "nq", "block", "part").withColumn("ask", F.lit(0)).select(*columns).unionByName(
        deal(rows.withColumn("code", F.lit(None).cast("binary")), crowded, "nq", "nb", "part", "block").withColumn("ask", F.lit(1)).select(*columns)
    )
    found = single.select(*columns).unionByName(many).groupBy("cell", "block", "part").applyInArrow(own_cell, "a long, b long, cosine double")
    w = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    best = lambda hits: cut(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    first = best(found)
    _release(spark)

    def by_codes(key: tuple, t: pa.Table) -> pa.Table:
        ask, model = t.column("ask").to_numpy(), shared.value[t.column("model")[0].as_py()]
        own = ask == 0
        if own.all() or not own.any():
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "low": np.zeros(0, np.float32), "high": np.zeros(0, np.float32)})
        d = model.c.shape[1]
        v = {c: t.column(c).to_numpy() for c in ("id", "lost", "norm", "fix", "floor")}
        x = _numpy(t.column("x8"), np.int8, d) * t.column("step").to_numpy()[:, None]
        code = _numpy(t.column("code").filter(pa.array(own)), np.uint8, (d + 7) // 8)
        a, b, low, high = search_codes(v["id"][own], code, v["norm"][own], v["fix"][own], x[own], v["lost"][own], v["id"][~own], x[~own], v["lost"][~own], model.c[key[0].as_py() - model.first], rotation(d), v["floor"][~own], k)
        return pa.table({"a": a, "b": b, "low": low.astype(np.float32), "high": high.astype(np.float32)})

    none = F.lit(None).cast("float")
    bounds = "a long, b long, low float, high float"
    floors = lambda hits: hits.where(F.col("rank") == k).select(F.col("a").alias("id"), F.col("cosine").cast("float").alias("floor"))

    def through_cells(known: DataFrame, tries: DataFrame) -> DataFrame:
        """(a, b, low, high) of what may be better than what is known. tries: id, model, x8, step, lost, cell."""
        asking = tries.join(floors(known), "id", "left")
        asking = asking.select("cell", "model", "id", "x8", "step", "lost", F.lit(None).cast("binary").alias("code"), none.alias("norm"), none.alias("fix"), F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        p2 = blocks(tries.select("cell"))
        columns = ["cell", "block", "part", "ask", "model", "id", "x8", "step", "lost", "code", "norm", "fix", "floor"]
        codes = placed.select(home, "model", "id", "x8", "step", "lost", "code", "norm", "fix", none.alias("floor"))
        both = deal(codes, p2, "nb", "nq", "block", "part").withColumn("ask", F.lit(0)).select(*columns).unionByName(deal(asking, p2, "nq", "nb", "part", "block").withColumn("ask", F.lit(1)).select(*columns))
        return both.groupBy("cell", "block", "part").applyInArrow(by_codes, bounds)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            width = pc.binary_length(t.column("x8")).to_numpy()
            for d in np.unique(width):
                own = t.filter(pa.array(width == d))
                v = {c: own.column(c).to_numpy() for c in ("m", "id", "step", "lost", "floor")}
                x = _numpy(own.column("x8"), np.int8, d) * v["step"][:, None]
                seen = np.concatenate([z.flatten().to_numpy() for z in own.column("seen").chunks]).reshape(-1, k)
                a, b, low, high = meetings(v["m"], v["id"], x, v["lost"], v["floor"], seen)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(low.astype(np.float32)), pa.array(high.astype(np.float32))], names=["a", "b", "low", "high"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                m = t.column("m").to_numpy()
                whole = int(np.searchsorted(m, m[-1]))  # the last m may go on in the next batch
                rest = t.slice(whole)
                yield from pairs_of(t.slice(0, whole))
        if rest is not None:
            yield from pairs_of(rest)

    def through_neighbours(known: DataFrame, members: DataFrame) -> DataFrame:
        """As through_cells, of the neighbours of one vector among each other, seen from both sides. members: rows of placed."""
        hits = known.join(members.select(F.col("id").alias("a")), "a", "left_semi")
        back = Window.partitionBy("m").orderBy(F.col("cosine").desc(), "id")
        asked_by = hits.select(F.col("b").alias("m"), F.col("a").alias("id"), "cosine").withColumn("r", F.row_number().over(back)).where(F.col("r") <= LINKS).select("m", "id")
        links = hits.select(F.col("a").alias("m"), F.col("b").alias("id")).unionByName(asked_by).unionByName(members.select(F.col("id").alias("m"), "id")).distinct()
        seen = hits.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("seen")).select("id", F.concat("seen", F.array_repeat(F.lit(-1).cast("long"), F.lit(k) - F.size("seen"))).alias("seen"))
        no = F.array_repeat(F.lit(-1).cast("long"), k)
        able = members.select("id", "x8", "step", "lost").join(seen, "id", "left").join(floors(hits), "id", "left").select("id", "x8", "step", "lost", F.coalesce("seen", no).alias("seen"), F.coalesce("floor", F.lit(-2.0).cast("float")).alias("floor"))
        groups = salted_join(links, able, "id", [F.col("m")], "inner").select("m", "id", "x8", "step", "lost", "seen", "floor")
        met = groups.repartition("m").sortWithinPartitions("m").mapInArrow(meet, bounds)
        return met.groupBy("a", "b").agg(F.max("low").alias("low"), F.max("high").alias("high"))  # a pair meets at several vectors

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            s = np.array([np.dot(np.frombuffer(u, np.float32).astype(np.float64), np.frombuffer(v, np.float32).astype(np.float64)) for u, v in zip(t.column("xa").to_pylist(), t.column("xb").to_pylist())], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b"), pa.array(s)], names=["a", "b", "cosine"])

    # Of all cells together, too, only what reaches the k-th lower bound may be among the k best.
    all_of = Window.partitionBy("a").orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def better(known: DataFrame, pairs: DataFrame) -> DataFrame:
        """The k best of what is known and of further pairs (a, b, low, high)."""
        pairs = cut(pairs.withColumn("least", F.nth_value("low", k).over(all_of)).where(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("a", "b"))
        there = salted_join(pairs, placed.select(F.col("id").alias("b"), F.col("x").alias("xb")), "b", [F.col("a")], "inner")
        more = there.join(placed.select(F.col("id").alias("a"), F.col("x").alias("xa")), "a").select("a", "b", "xa", "xb").mapInArrow(cosines, "a long, b long, cosine double")
        known = best(known.drop("rank").unionByName(more))
        del there, more
        _release(spark)
        return known

    def asked(batches: Iterator[pd.DataFrame], start: int, stop: int) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                own = shared.value[model]
                near = own.nearest(_numpy(pa.array(part["x"]), np.float32, own.c.shape[1]), stop)[:, start:]
                yield part.drop(columns="x").assign(cells=list((near + own.first).astype(np.int64)))

    known = better(first, through_cells(first, placed.select("id", "model", "x8", "step", "lost", F.explode(F.slice("cells", 2, probes)).alias("cell"))))
    # Where cells are left out, brute force for a sample of the searches says what share of the neighbours is there.
    open_ = {m for m in cells if len(cells[m].c) > probes}
    true = _truth(placed, open_, k) if open_ else []
    share = _share(known, true)
    met = False  # neighbours meet once at least
    while open_ := {m for m in open_ if not met or share[m] < enough}:
        members = placed.where(F.col("model").isin(*open_))
        gain = 1.0
        while not met or gain >= LITTLE and min(share[m] for m in open_) < enough:
            known = better(known, through_neighbours(known, members))
            met, before, share = True, share, _share(known, true)
            gain = max((share[m] - before[m]) / max(1 - before[m], 1e-9) for m in open_)
        open_ = {m for m in open_ if share[m] < enough and probes < len(cells[m].c)}
        if open_:
            kinds = "id long, model string, x8 binary, step float, lost float, cells array<long>"
            tries = placed.where(F.col("model").isin(*open_)).select("id", "model", "x", "x8", "step", "lost").mapInPandas(lambda z, a=probes, b=2 * probes: asked(z, a, b), kinds)
            tries = cut(tries).withColumn("cell", F.explode("cells")).drop("cells")
            known = better(known, through_cells(known, tries).join(known.select("a", "b"), ["a", "b"], "left_anti"))
            probes, share = 2 * probes, _share(known, true)
    return placed, known.drop("rank")


def _release(spark: SparkSession) -> None:
    """Shuffle files go once the driver has collected its garbage; left to itself it may do so only after the last round."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _truth(placed: DataFrame, models: set[str], k: int) -> list[tuple[str, int, float, int]]:
    """(model, id, least cosine of the k best, their number) of a sample of the vectors of each model, by brute force."""
    spark, here = placed.sparkSession, placed.where(F.col("model").isin(*models))
    n = {r.model: r.n for r in here.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(50, min(MEASURED, 40_000 // len(n)))
    picked = here.sampleBy("model", {m: min(1.0, each / n[m]) for m in n}, 5).select("model", "id", "x").collect()
    own = {m: ([r for r in picked if r.model == m]) for m in n}
    asks = spark.sparkContext.broadcast({m: (np.array([r.id for r in rows]), np.array([np.frombuffer(r.x, np.float32) for r in rows])) for m, rows in own.items() if rows})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops: dict[str, np.ndarray] = {}
        for pdf in batches:
            for model, part in pdf.groupby("model"):
                if model in asks.value:
                    ids, q = asks.value[model]
                    s = q @ _numpy(pa.array(part["x"]), np.float32, q.shape[1]).T
                    s[ids[:, None] == part["id"].to_numpy()[None, :]] = -np.inf
                    tops[model] = -np.partition(-np.concatenate([tops.get(model, np.full((len(q), k), -np.inf, np.float32)), s], axis=1), k - 1, axis=1)[:, :k]
        for model, top in tops.items():
            yield pd.DataFrame({"model": model, "id": np.repeat(asks.value[model][0], k), "cosine": top.ravel()})

    w = Window.partitionBy("model", "id").orderBy(F.col("cosine").desc())
    best = here.select("model", "id", "x").mapInPandas(compare, "model string, id long, cosine float").where(F.col("cosine") >= -2).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return [tuple(r) for r in best.groupBy("model", "id").agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")).collect()]


def _share(known: DataFrame, true: list[tuple[str, int, float, int]]) -> dict[str, float]:
    """The share of the sample's neighbours that is known, by model; equal cosines count as equal."""
    if not true:
        return {}
    wanted = F.broadcast(known.sparkSession.createDataFrame(true, "model string, a long, least double, n long"))  # at most a sample of each model
    hits = {r.model: r.hits for r in known.join(wanted, "a").where(F.col("cosine") >= F.col("least") - 2e-6).groupBy("model").agg(F.count(F.lit(1)).alias("hits")).collect()}
    return {m: hits.get(m, 0) / sum(t[3] for t in true if t[0] == m) for m in {t[0] for t in true}}


def nearest(rows: DataFrame, k: int = K, cell: int = CELL, probes: int = PROBES, enough: float | None = None) -> DataFrame:
    """(path, other, cosine, rank): the k most similar other files of every file."""
    files = cut(latest(rows))
    good = rows.where(_good())
    # Copies of a vector are gone before rows are joined; a class is then one row, whose vector is moved once.
    sizes = files.groupBy("h1", "h2").agg(F.first("model").alias("model"), F.count(F.lit(1)).alias("size"))
    vectors = good.select(*_key(), "vector").groupBy("h1", "h2").agg(F.first("vector").alias("vector"))
    placed, found = _search(sizes.join(vectors, ["h1", "h2"]), _cells(files, good.select(_model().alias("model"), "vector"), cell), k, probes, ENOUGH if enough is None else enough)
    # The least k + 1 paths of a class are all of it that any file can need.
    leads = placed.select("id", "h1", "h2").join(_least_members(files, k + 1), ["h1", "h2"]).select("id", "member")
    near = found.join(leads.select(F.col("id").alias("b"), "member"), "b").select(F.col("a").alias("id"), "member", "cosine")
    same = leads.join(placed.where("size > 1").select("id"), "id", "left_semi").select("id", "member", F.lit(1.0).alias("cosine"))
    w = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "member")
    wanted = near.unionByName(same).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("id").agg(F.collect_list(F.struct(F.negative("cosine").alias("minus"), "member")).alias("list"))
    by_class = placed.select("id", "h1", "h2").join(wanted, "id").select("h1", F.col("h2").alias("other_h2"), F.array_sort("list").alias("list"))
    out = salted_join(files.select("path", "h1", "h2"), by_class, "h1", [F.col("path")], "inner").where("h2 = other_h2")
    out = out.select("path", F.slice(F.filter("list", lambda x: x["member"] != F.col("path")), 1, k).alias("list"))
    return out.select("path", F.posexplode("list").alias("pos", "x")).select("path", F.col("x.member").alias("other"), F.negative("x.minus").alias("cosine"), (F.col("pos") + 1).alias("rank"))


def _least_members(files: DataFrame, n: int) -> DataFrame:
    """(h1, h2, member): the n least paths of each class; found per slice of a class first, so no class is sorted in one
    task."""
    sliced = files.select("h1", "h2", "path", F.pmod(F.xxhash64("path"), F.lit(64)).alias("slice"))
    w1, w2 = Window.partitionBy("h1", "h2", "slice").orderBy("path"), Window.partitionBy("h1", "h2").orderBy("path")
    few = sliced.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= n)
    return few.withColumn("r", F.row_number().over(w2)).where(F.col("r") <= n).select("h1", "h2", F.col("path").alias("member"))


def near_pairs(rows: DataFrame, k: int = K) -> DataFrame:
    """(path_a, path_b), the smaller path first: files of which one is among the k most similar of the other."""
    return nearest(rows, k).select(F.least("path", "other").alias("path_a"), F.greatest("path", "other").alias("path_b")).distinct()
