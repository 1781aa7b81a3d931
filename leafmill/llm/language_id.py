"""Language identification: multinomial naive Bayes over hashed character n-grams.

The n-grams of lower-cased letters (runs of anything else are one space) are hashed to a
fixed number of buckets. Workers count buckets per language over labelled texts; the summed
counts, of a size fixed by buckets and languages, become a matrix of log-probabilities that is
broadcast. A batch of texts becomes a sparse matrix of (text, bucket, count), which is multiplied
with it in one product for all its texts; only very long texts go in several parts.

Inputs with defined results: a null text, an empty one or one without a letter gets language
"und" and score 0; a text in n-grams never seen is scored by the smoothed matrix; with no
labelled rows every text is "und"; more than `max_languages` distinct labels are an error;
repeated rows give repeated rows; an empty table gives an empty table; other columns of the input
are ignored or, where asked for, carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import arrow_map, bounded_batches, text_or_empty

#: Code points that are hashed at a time, to bound a worker's memory.
CHUNK = 1 << 18


@dataclass(frozen=True)
class LanguageModel:
    """Log-probabilities by bucket and language, log-priors, and the n-gram sizes they hold for."""

    languages: tuple[str, ...]
    log_prob: np.ndarray
    log_prior: np.ndarray
    sizes: tuple[int, ...]


def _letters(text: str) -> str:
    """The lower-cased letters of a text (Unicode's letter classes; numerals aren't), other runs as one space."""
    import regex

    global _not_letters
    if _not_letters is None:
        _not_letters = regex.compile(r"[^\p{L}]+")
    return _not_letters.sub(" ", text.lower()).strip()


_not_letters = None


def _ngrams(codes: np.ndarray, rows: np.ndarray, starts: np.ndarray, sizes: tuple[int, ...], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of each n-gram that lies within one row's stretch of code points, and starts where one may."""
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(codes) < n:
            return
        h = (h[: len(codes) - n + 1] if n > 1 else h) * np.uint32(0x9E3779B1) + codes[n - 1 :]
        if n in sizes:
            inside = np.flatnonzero(starts[: len(h)] & (rows[: len(h)] == rows[n - 1 :]))
            mixed = (h[inside] ^ (h[inside] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            yield rows[inside], ((mixed >> np.uint32(7)) & np.uint32(n_buckets - 1)).astype(np.int64)


def _parts(texts: Iterable[str], reach: int) -> Iterator[list[tuple[int, str, int]]]:
    """Runs of texts of at most about CHUNK code points together, as (number, part, places where n-grams may start); a longer text in parts that overlap by `reach`."""
    held: list[tuple[int, str, int]] = []
    size = 0
    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - reach), CHUNK):
            part = text[start : start + CHUNK + reach]
            if size and size + len(part) > CHUNK:
                yield held
                held, size = [], 0
            held.append((i, part, len(part) if start + CHUNK >= len(text) - reach else CHUNK))
            size += len(part)
    if held:
        yield held


def counts_by_row(texts: list[str], sizes: tuple[int, ...], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sparse counts (row, bucket, count) of the n-grams of texts, in runs of rows; the n-grams of a long row may come in several runs."""
    padded = (f" {own} " if (own := _letters(t)) else "" for t in texts)
    for held in _parts(padded, max(sizes) - 1):
        codes = np.frombuffer("".join(x for _, x, _ in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        numbers, lengths = [i for i, _, _ in held], [len(x) for _, x, _ in held]
        # parts of one long text are told apart, as no n-gram spans two
        places = np.repeat(np.arange(len(held)), lengths)
        starts = np.arange(len(codes)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths) < np.repeat([k for _, _, k in held], lengths)
        found = [at * n_buckets + b for at, b in _ngrams(codes, places, starts, sizes, n_buckets)]
        keys, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
        yield np.array(numbers, dtype=np.int64)[keys // n_buckets], keys % n_buckets, n


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", where: Column | None = None, max_docs: int = 20_000, n_buckets: int = 1 << 16, sizes: tuple[int, ...] = (2, 3), max_languages: int = 1000) -> LanguageModel:
    """Fits on labelled rows for which `where` holds.

    At most about `max_docs` rows are used, drawn by a hash of their text with one rate for
    all: the bound of the classifier's sample. Its result, n_buckets counts for each language,
    is all that reaches the driver.
    """
    bounded_batches(df.sparkSession)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.lit(True) if where is None else where))
    total = rows.count()
    rate = min(1.0, max_docs / max(1, total))
    if rate < 1:
        rows = rows.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def counts(batch: pa.RecordBatch) -> dict:
        labels = batch.column(1).to_pylist()
        names = sorted(set(labels))
        at = np.array([names.index(x) for x in labels], dtype=np.int64)
        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for rows_, buckets, n in counts_by_row(text_or_empty(batch.column(0)), sizes, n_buckets):
            keys, places = np.unique(np.concatenate([sums[0], at[rows_] * n_buckets + buckets]), return_inverse=True)
            sums = keys, np.bincount(places, np.concatenate([sums[1], n]), len(keys)).astype(np.int64)
        docs = np.bincount(at, minlength=len(names))
        lang = [names[i] for i in sums[0] // n_buckets] + names
        return {"lang": lang, "bucket": np.concatenate([sums[0] % n_buckets, np.full(len(names), -1)]), "n": np.concatenate([sums[1], docs])}

    counted = arrow_map(rows.select(text_col, lang_col), counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most a row for each language and bucket
    found = counted.limit(max_languages * (n_buckets + 1) + 1).toArrow()
    lang, bucket, n = found["lang"].to_pylist(), found["bucket"].to_numpy(), found["n"].to_numpy()
    languages = tuple(sorted(set(lang)))
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    place = {x: i for i, x in enumerate(languages)}
    at = np.array([place[x] for x in lang], dtype=np.int64)
    table, docs = np.zeros((n_buckets, len(languages))), np.zeros(len(languages))
    inside = bucket >= 0
    table[bucket[inside], at[inside]] = n[inside]
    docs[at[~inside]] = n[~inside]
    log_prob = np.log(table + 0.5) - np.log((table + 0.5).sum(0, keepdims=True))
    return LanguageModel(languages, log_prob.astype(np.float32), np.log(np.maximum(docs, 1)) - np.log(max(1, docs.sum())), sizes)


def _scored(texts: list[str], m: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """The language and score of each text."""
    total, seen = np.tile(m.log_prior.astype(np.float64), (len(texts), 1)), np.zeros(len(texts), dtype=np.int64)
    for rows, buckets, n in counts_by_row(texts, m.sizes, len(m.log_prob)) if m.languages else ():
        if not len(rows):
            continue
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])  # rows come in order
        for k in range(len(m.languages)):
            total[rows[first], k] += np.add.reduceat(n * m.log_prob[buckets, k].astype(np.float64), first)
        seen[rows[first]] += np.add.reduceat(n, first)
    told = seen > 0
    langs, scores = np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
    if told.any():
        best = total[told].max(1, keepdims=True)
        scores[told] = 1 / np.exp(total[told] - best).sum(1)
        langs[told] = np.array(m.languages, dtype=object)[total[told].argmax(1)]
    return langs, scores


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, lang_pred and score (the language's share of the posterior), and the columns in `carry`."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> dict:
        langs, scores = _scored(text_or_empty(batch.column(1)), shared.value)
        return {id_col: batch.column(0), **{c: batch.column(2 + i) for i, c in enumerate(carry)}, "lang_pred": langs, "score": scores}

    fields = [df.schema[c] for c in (id_col, *carry)]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return arrow_map(df.select(id_col, text_col, *carry), score, schema)


def keep_known(df: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, with all their columns, whose language is told with a score of at least `least`."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    at = df.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> dict:
        rows = batch.column(0)
        langs, scores = _scored(text_or_empty(rows.field(at)), shared.value)
        return {"row": rows.filter(pa.array((langs != "und") & (scores >= least), type=pa.bool_()))}

    return arrow_map(packed, keep, packed.schema).select(*[F.col("row")[c].alias(c) for c in df.columns])
