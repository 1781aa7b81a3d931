"""Embedding whitening by polarisation covariance.

The covariance of two dimensions follows from three variances: Cov(i, j) = (Var(i + j) - Var(i) -
Var(j)) / 2. So one pass sums exact squares, of every dimension and of the sum of every pair of
dimensions, and no product of two dimensions is made. Entries are fixed-point integers, centred before
they are squared: by the integer nearest to the dimension's mean, and the rest, under a half, is
taken out of the sums exactly. Sums are integers, added up in limbs of 60 bits, so neither the
number of rows nor their order rounds anything; the first rounding is that of the finished matrix
to doubles, which goes to eigh.

Sums are a row per task and pair of dimensions at most, added up by Spark; the driver gets a row
per pair, which `max_dims` bounds.

Inputs with defined results: rows whose vector is null or holds a null or non-finite entry go, and
so do vectors of another length than most have (the shorter on a tie); an entry that isn't finite
when scaled counts as non-finite; zero vectors and rows with equal or null ids stay, each by
itself; components whose eigenvalue isn't above `least` times the largest have no direction and are left
out, all of them if all rows are equal, which gives no row; an empty table gives an empty table; a
deviation beyond 38 digits is null; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map
from .vectors import matrix

#: Bits of a limb, limbs of a sum: sums of up to 180 bits, each limb adds up 2^40 rows within a decimal.
LIMB, LIMBS = 60, 3
#: Rows that a task squares at a time.
BLOCK = 2048


def fixed_point(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """floor(scale * x) + shift, exact: int64, or Python integers where that could overflow."""
    y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**52:
        return y.astype(np.int64) + shift
    return np.array([int(v) + shift for v in y.ravel()], dtype=object).reshape(y.shape)


def _wide(x: np.ndarray, bits: int) -> np.ndarray:
    """x as it is if results of so many bits fit 64, else as Python integers."""
    return x.astype(object) if bits > 62 else x


def _bits(x: np.ndarray) -> int:
    return int(np.abs(x).max()).bit_length() if x.size else 0


def _limbs(total: int) -> list[int]:
    """Signed limbs, lowest first."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << LIMB) - 1))
        total >>= LIMB
    return [*out, total]


@dataclass(frozen=True)
class Centre:
    """n rows, exact sums by dimension; the integer nearest to each mean and n times the rest."""

    n: int
    sums: tuple[int, ...]

    @property
    def near(self) -> list[int]:
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]

    @property
    def rest(self) -> list[int]:
        return [s - self.n * m for s, m in zip(self.sums, self.near)]

    def minus_near(self, x: np.ndarray) -> np.ndarray:
        near = self.near
        if x.dtype == object or max(map(abs, near), default=0) >= 1 << 61:
            return x.astype(object) - np.array(near, dtype=object)
        return x - np.array(near, dtype=np.int64)


def _totals(df: DataFrame, add: Callable[[Iterator[pa.RecordBatch]], dict], names: tuple[str, ...]) -> DataFrame:
    """Sums over all rows: `add` turns an iterator of Arrow batches into {key: integer}, once per task; limbs are added up by Spark."""
    schema = ", ".join([f"{n} int" for n in names] + [f"l{i} decimal(20,0)" for i in range(LIMBS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, ...], int] = add(batches)
        keys, values = [*found], [_limbs(v) for v in found.values()]
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            columns = [pa.array([k[i] for k in keys[part]], pa.int32()) for i in range(len(names))]
            columns += [pa.array([Decimal(v[i]) for v in values[part]], pa.decimal128(20, 0)) for i in range(LIMBS)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(f"l{i}" for i in range(LIMBS))])

    return df.mapInArrow(run, schema).groupBy(*names).agg(*[F.sum(f"l{i}").cast("decimal(38,0)").alias(f"l{i}") for i in range(LIMBS)])


def _collected(sums: DataFrame, names: tuple[str, ...]) -> dict[tuple[int, ...], int]:
    """On the driver, a row per key."""
    found = sums.toArrow()
    limbs = [found[f"l{i}"].to_pylist() for i in range(LIMBS)]
    return {key: sum(int(v) << (LIMB * i) for i, v in enumerate(row)) for key, row in zip(zip(*(found[n].to_pylist() for n in names)), zip(*limbs))}


def centre(rows: DataFrame, scale: int, shift: int) -> Centre:
    """Number of rows(vec) and exact sums of their fixed-point entries, in one pass."""

    def add(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, ...], int]:
        out: dict[tuple[int, ...], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = fixed_point(matrix(batch.column(0)), scale, shift)
            sums = _wide(x, _bits(x) + len(x).bit_length()).sum(0)
            for i, s in enumerate([len(x), *sums.tolist()]):
                out[i - 1,] = out.get((i - 1,), 0) + int(s)
        return out

    found = _collected(_totals(rows, add, ("i",)), ("i",))
    return Centre(found.get((-1,), 0), tuple(found[i,] for i in range(len(found) - 1)))


def squares(rows: DataFrame, around: Centre, scale: int, shift: int) -> dict[tuple[int, int], int]:
    """n times the exact sum of squares, centred at the mean, of dimension i (as (i, i)) and of the sum of dimensions i and j > i."""
    d = len(around.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, ...], int]:
        total = np.zeros((d, d), dtype=object)
        held, bound = np.zeros((d, d), dtype=np.int64), 0  # no sum in it is larger
        for batch in batches:
            every = around.minus_near(fixed_point(matrix(batch.column(0)), scale, shift)) if batch.num_rows else np.zeros((0, d), np.int64)
            for at in range(0, len(every), BLOCK):
                y = every[at : at + BLOCK]
                most = 4 * int(np.abs(y).max()) ** 2 * len(y)
                if bound + most >= 1 << 62:
                    total += held.astype(object)
                    held[:], bound = 0, 0
                y = np.ascontiguousarray(_wide(y, most.bit_length()).T)
                into = held if y.dtype != object else total
                bound += most if into is held else 0
                for i in range(d):
                    into[i, i] += (y[i] * y[i]).sum()
                    pair = y[i + 1 :] + y[i]
                    into[i, i + 1 :] += np.einsum("kr,kr->k", pair, pair) if into is held else (pair * pair).sum(1)
        total += held.astype(object)
        return {(i, j): int(total[i, j]) for i in range(d) for j in range(i, d)}

    found = _collected(_totals(rows, add, ("i", "j")), ("i", "j"))
    r = around.rest
    return {(i, j): around.n * q - (r[i] if i == j else r[i] + r[j]) ** 2 for (i, j), q in found.items()}


def covariance(of: dict[tuple[int, int], int], n: int) -> np.ndarray:
    """The matrix by polarisation, each entry an exact quotient rounded once."""
    d = 1 + max((i for i, _ in of), default=-1)
    out = np.zeros((d, d))
    for (i, j), q in of.items():
        out[i, j] = out[j, i] = (q if i == j else q - of[i, i] - of[j, j]) / ((1 if i == j else 2) * n * n)
    return out


@dataclass(frozen=True)
class Whitening:
    """Components (rows) by falling variance, their variances and shares of the whole."""

    around: Centre
    components: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    scale: int
    shift: int

    def whiten(self, vectors: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Projections of unit variance, and the exact sum over dimensions of (n x - S)^2."""
        c, rest = self.around, self.around.rest
        y = c.minus_near(fixed_point(vectors, self.scale, self.shift))
        w = (y.astype(np.float64) - np.array([r / c.n for r in rest])) @ self.components.T / np.sqrt(self.variances)
        # |n y - r|^2 = n^2 |y|^2 - 2 n (y . r) + |r|^2
        wide = _wide(y, _bits(y) + max(_bits(y), max(map(abs, rest), default=0).bit_length()) + len(rest).bit_length())
        squared, crossed = (wide * wide).sum(1), (wide * np.array(rest, dtype=wide.dtype)).sum(1)
        fixed = sum(r * r for r in rest)
        return w, [c.n * (c.n * int(a) - 2 * int(b)) + fixed for a, b in zip(squared, crossed)]


def usable(df: DataFrame, id_col: str, vec_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, vectors as doubles, and their length."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * float(scale)) < float("inf"))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(F.coalesce((F.size("vec") > 0) & F.forall("vec", fine), F.lit(False)))
    most = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "d").first()
    d = most["d"] if most else 0
    return rows.where(F.size("vec") == d), d


def fit(rows: DataFrame, d: int, components: int = 8, scale: int = 1024, shift: int = 100_000, least: float = 1e-12, max_dims: int = 2048) -> Whitening:
    """Components of all rows(vec), which have d dimensions; the driver holds d x d sums."""
    if d > max_dims:
        raise ValueError(f"{d} dimensions, more than {max_dims}")
    around = centre(rows.select("vec"), scale, shift) if d else Centre(0, ())
    if not around.n:
        return Whitening(around, np.zeros((0, d)), np.zeros(0), np.zeros(0), scale, shift)
    v = covariance(squares(rows.select("vec"), around, scale, shift), around.n)
    values, vectors = np.linalg.eigh(v)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > least * max(values.max(), 0.0)]
    found = vectors[:, order].T
    sign = np.sign(found[np.arange(len(order)), np.abs(found).argmax(1)]) if order else np.zeros(0)  # the largest entry is positive
    return Whitening(around, found * sign[:, None], values[order], values[order] / np.trace(v), scale, shift)


def _identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    of = F.col("whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.covar_pop(of[i], of[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max((abs(v - (i == j)) for (i, j), v in zip(pairs, found)), default=0.0)


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row per usable row and component: id, component (from 1), n, deviation decimal(38,0), whitened, explained, identity_error."""
    scratch = Scratch(df.sparkSession, "whitening")
    rows, d = usable(df, id_col, vec_col, scale)
    model = fit(rows, d, components, scale, shift)
    kind, k = df.schema[id_col].dataType.simpleString(), len(model.components)

    def project(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows or not k:
            return None
        w, deviations = model.whiten(matrix(batch.column(1)))
        exact = [Decimal(x) if x < 10**38 else None for x in deviations]
        return {"id": batch.column(0), "deviation": pa.array(exact, pa.decimal128(38, 0)), "whitened": w.tolist()}

    found = scratch.table(arrow_map(rows, project, f"id {kind}, deviation decimal(38,0), whitened array<double>"), "whitened")
    error = _identity_error(found, k) if k else 0.0
    shares = F.array(*[F.lit(float(s)) for s in model.shares]) if k else F.array(F.lit(0.0))
    return found.select("id", "deviation", F.posexplode("whitened").alias("at", "w")).select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.around.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")
    )
