"""Sequence packing: shortest-pack-first over the length histogram.

Texts become token ids with an end id, documents longer than a sequence are cut into full
sequences and a rest. The histogram of piece lengths, with at most as many bins as a sequence
has tokens, is packed on the driver: lengths longest first, each onto the pack with most room
as long as it fits, and counts of equal packs are kept as one pattern. Patterns then are joined
back to pieces by the piece's rank among those of its length.

Ranks come from a range partitioning on length and place, which spreads a length that a third
of all pieces have over many partitions.

Inputs with defined results: a null or empty text is its end id alone, a piece of length 1;
repeated rows are packed each; an empty table gives an empty table; other columns of the input
are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import Scratch, arrow_map, bounded_batches, prefix_sums

#: Words that a worker keeps the ids of, twice: those of late and those before. About 50 MB at most.
KEEP = 100_000
#: Longer words are encoded each time.
LONG = 200
#: A run of Latin letters and the marks after it, which the tokenizer splits there and nowhere else.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:#&%$*]*)")


class _WordIds(dict):
    """Ids of words between white space, as little-endian bytes; the tokenizer drops white space, so words count apart.

    Words in use stay, as those that are looked up move from the older to the newer half.
    """

    def __init__(self, name: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.keep = keep
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.split = self.tokenizer.model.tokenize
        plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.letters = {b: 256 + i for i, b in enumerate(rest)}  # how a byte-level vocabulary writes bytes
        self.older: dict[str, bytes] = {}

    def _run(self, part: str) -> bytes:
        """Ids of one lower-case run of letters or marks."""
        written = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.split(written)]).tobytes()

    def _encode(self, word: str) -> bytes:
        if not word:
            return b""
        m = _PLAIN.fullmatch(word)
        if not m:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        letters = m[1].lower()
        if letters == word:
            return self._run(word)
        return self[letters] + (self._run(m[2]) if m[2] else b"")

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self._encode(word)
        if len(word) <= LONG:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_word_ids: dict[str, _WordIds] = {}


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, and `ids` if asked for."""

    def cut(batch: pa.RecordBatch) -> dict:
        if tokenizer not in _word_ids:
            _word_ids[tokenizer] = _WordIds(tokenizer)
        words = _word_ids[tokenizer]
        end = np.array([end_id], dtype="<u4").tobytes()
        out: dict[str, list] = {k: [] for k in (id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []))}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = words.of(text.as_py() or "") + end
            n = len(ids) // 4
            for start in range(0, n, length):
                own = ids[4 * start : 4 * (start + length)]
                row = (key, start, len(own) // 4, zlib.crc32(own), n) + ((np.frombuffer(own, dtype="<u4").astype(np.int64),) if keep_ids else ())
                for k, v in zip(out, row):
                    out[k].append(v)
        return out

    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), cut, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids)


def pack_histogram(counts: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths, longest first) and how many packs have each.

    Shortest pack first: a length goes onto the packs with most room, if it fits there, several
    times where there is room; else it opens new packs.
    """
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for size in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[size]
        while left:
            room = max((r for r in by_room if r >= size), default=None)
            if room is None:
                pattern, packs, fit = (), -(-left // (length // size)), length // size
                room = length
            else:
                pattern, packs = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                fit = 1
            used = min(packs, -(-left // fit))
            if used < packs and pattern:
                by_room.setdefault(room, []).append((pattern, packs - used))
            whole, rest = divmod(left, fit)
            full = min(used, whole)
            if full:
                by_room.setdefault(room - fit * size, []).append((pattern + (size,) * fit, full))
                left -= full * fit
            if full < used and left:
                by_room.setdefault(room - rest * size, []).append((pattern + (size,) * rest, 1))
                left -= rest
    merged: Counter = Counter()
    for found in by_room.values():
        for pattern, n in found:
            merged[pattern] += n
    return sorted(merged.items(), reverse=True)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks and the sequences and offsets they go to; sorted by length and rank."""
    ranks: Counter = Counter()
    rows, base = [], 0
    for pattern, packs in patterns:
        at = 0
        for size, times in sorted(Counter(pattern).items(), reverse=True):
            rows.append((size, ranks[size], base, times, at))
            ranks[size] += packs * times
            at += size * times
        base += packs
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("length", "rank", "base", "times", "offset"))}


def pack(found: DataFrame, scratch: Scratch, length: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (id, start, length, ids_crc32, ...)."""
    # equal pieces of one document id are alike wherever they go
    ranked = prefix_sums(found.withColumn("one", F.lit(1).cast("long")), ["length"], ["id", "start", "ids_crc32"], "one", "rank", scratch)
    histogram = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `length` rows
    places = found.sparkSession.sparkContext.broadcast(_places(pack_histogram(histogram, length)))
    names = found.columns
    schema = StructType(list(found.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())

    def place(batch: pa.RecordBatch) -> dict:
        p = places.value
        size, rank = batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy()
        span = np.int64(1) << 40  # over the ranks of a length
        at = np.searchsorted(p["length"] * span + p["rank"], size * span + rank, "right") - 1
        inside = rank - p["rank"][at]
        return {n: batch.column(i) for i, n in enumerate(names)} | {"sequence_id": p["base"][at] + inside // p["times"][at], "offset": p["offset"][at] + inside % p["times"][at] * size}

    return arrow_map(ranked.select(*names, "rank"), place, schema)


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    scratch = Scratch(df.sparkSession, "packing")
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = scratch.table(pieces(slim, "id", "text", tokenizer, length, end_id, keep_ids), "pieces")
    out = pack(found, scratch, length)
    scratch.drop(found)  # the result reads the ranked ones
    return out.select(F.col("id").alias(id_col), *out.columns[1:])
