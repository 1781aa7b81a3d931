"""Cross-tokenizer alignment: where the tokens of two tokenizers end together.

Both tokenizers cut the bytes of space+text. Dictionaries from cumulative byte ends to token indexes
are made for both; the ends that both have, sorted, slice the two id lists into groups. Inside a
slice every stretch between neighbouring ends of either side lies in one token of each, which
is one link: no two tokens that overlap are missed or named twice.

A text is first cut where both tokenizers are certain to cut: before a single space or line end
between two characters that no engine takes for white space. These units repeat, so a worker
keeps their alignments in a bounded table; a text's is the concatenation of its units'.

How often two ids are linked in the whole corpus is counted per chunk of documents first: a
chunk is one row with its distinct pairs and, for each document, numbers of units. Counts come
back as a row per chunk and pair, to where the chunk is, so that a pair that every document
holds costs a row per chunk.

Inputs with defined results: a null or empty text, or one that a tokenizer doesn't give back byte
by byte (as with U+2581), has no tokens: zeros and an empty digest; repeated rows are aligned and
counted each; a text without certain cuts is one unit, however long; null ids stay null; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain, groupby
from operator import add

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, arrow_map, text_or_empty

#: Units, and links of them, that a worker keeps; code points that it takes up at a time; units of a chunk.
KEEP_UNITS, KEEP_LINKS, SLICE, CHUNK = 240_000, 3_000_000, 1 << 20, 2_000_000
#: Fixed value: how the byte-level BPE splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Units of letters and marks that all engines class alike, for the faster of two encoders.
_PLAIN = re.compile("[ \n][!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Not white space for any engine: Python's class, and what some engines class differently.
_SOLID = r"[^\s᠎​-‏⁠﻿]"
_CUT = re.compile(rf"(?<={_SOLID})([ \n])(?={_SOLID})")
#: White space but the space and the line end, for Python, and what some engines take for it.
_OTHER_WHITE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


class Aligner:
    """Alignments of units, for a byte-level BPE file and a sentencepiece file with byte fallback."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        path = public_tokenizers.path(a)
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        plain = [i for r in ((33, 127), (161, 173), (174, 256)) for i in range(*r)]
        back = {chr(i): i for i in plain} | {chr(256 + k): i for k, i in enumerate(sorted({*range(256)} - {*plain}))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # units are certain only if no piece runs across a space or line end, and the other splits words by itself
        splits = (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.cuts = splits and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.plain = self._plain_encoder(spec) if splits else None
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = [*map(str, range(len(self.bytes_a)))], [*map(str, range(len(self.bytes_b)))]
        self.forget()

    def _plain_encoder(self, spec: dict):
        """The same vocabulary in an encoder that takes ids for the order of merges, if they are; it is several times faster on short units."""
        import tiktoken

        vocab, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens") or ()}
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(order, order[1:])) or spec.get("normalizer"):
            return None
        ranks = {self.bytes_a[i]: i for token, i in vocab.items() if token not in special}
        return tiktoken.Encoding("plain", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def forget(self) -> None:
        self.table: dict[str, int] = {}
        self.text: list[str] = []
        self.keys = array("q")  # pairs of all links, unit after unit
        self.n_a, self.n_b, self.n_groups, self.n_links = (array("q") for _ in range(4))

    @property
    def full(self) -> bool:
        return len(self.table) > KEEP_UNITS or len(self.keys) > KEEP_LINKS

    def units(self, text: str) -> list[str]:
        """Stretches of space+text that both tokenizers encode apart; each starts with its space or line end."""
        if not self.cuts:
            return [" " + text]
        # where no white space stands beside other, or at an end, every space and line end is a certain cut
        if not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _OTHER_WHITE.search(text)):
            return [u if u[0] == "\n" else " " + u for u in text.replace("\n", " \n").split(" ")]
        parts = _CUT.split(" " + text)
        return [parts[0], *map(add, parts[1::2], parts[2::2])]

    def _flat_a(self, units: list[str]) -> list[int]:
        """The first tokenizer's ids, unit after unit: plain units that follow each other as one text, which is cut between them."""
        out: list[int] = []
        for plain, run in groupby(units, lambda u: bool(self.plain and _PLAIN.fullmatch(u))):
            if plain:
                out += self.plain("".join(run))
            else:
                out += chain.from_iterable(e.ids for e in self.a.encode_batch([*run], add_special_tokens=False))
        return out

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of a, ids of b, bytes of each unit, which units count): ids of all units that both tokenizers give back byte by byte."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u[0] != " ":  # the space that the second tokenizer adds stands before the line end
                found[i] = found[i][1:] if found[i][:1] == [self.space] else []
        b = np.fromiter(chain.from_iterable(found), np.int64)
        raw = [u.encode() for u in units]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum([len(f) for f in found])
        total = np.concatenate([[0], np.cumsum(self.size_b[b])])[ends]
        if b"".join(map(self.bytes_b.__getitem__, b.tolist())) == b"".join(raw) and (total == np.cumsum(sizes)).all():
            return np.array(self._flat_a(units), np.int64), b, sizes, np.ones(len(units), bool)
        good = np.array([b"".join(map(self.bytes_b.__getitem__, f)) == r for f, r in zip(found, raw)], bool)
        kept = [u for u, ok in zip(units, good) if ok]
        b = np.fromiter(chain.from_iterable(f for f, ok in zip(found, good) if ok), np.int64)
        return np.array(self._flat_a(kept), np.int64), b, sizes[good], good

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Ends in bytes of the groups, where each ends in a and in b; and ends in bytes of the links, with their indexes in a and b."""
        at_a, at_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends_a = dict(zip(at_a.tolist(), range(1, len(a) + 1)))
        ends_b = dict(zip(at_b.tolist(), range(1, len(b) + 1)))
        common = sorted(ends_a.keys() & ends_b.keys())
        every = np.unique(np.concatenate([at_a, at_b]))  # every stretch between neighbouring ends is a link of its slice
        return common, [*map(ends_a.__getitem__, common)], [*map(ends_b.__getitem__, common)], every, np.searchsorted(at_a, every), np.searchsorted(at_b, every)

    def learn(self, units: list[str]) -> None:
        """Adds units to the table."""
        a, b, sizes, good = self.encode(units)
        kept = [u for u, ok in zip(units, good) if ok]
        common, to_a, to_b, every, link_a, link_b = self.align(a, b)
        text_a, text_b = [*map(self.text_a.__getitem__, a.tolist())], [*map(self.text_b.__getitem__, b.tolist())]
        groups = [
            f"{text_a[i]}|{text_b[j]}" if k - i == 1 == m - j else f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}"
            for i, k, j, m in zip([0, *to_a], to_a, [0, *to_b], to_b)
        ]
        ends = np.cumsum(sizes)
        per_unit = lambda x: np.diff(np.searchsorted(x, ends, "right"), prepend=0)
        counts = [per_unit(x) for x in (np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.array(common, np.int64), every)]
        self.keys.frombytes((a[link_a] << 32 | b[link_b]).tobytes())
        to = np.cumsum(counts[2]).tolist()
        bad = [u for u, ok in zip(units, good) if not ok]
        self.table.update(zip([*kept, *bad], range(len(self.text), len(self.text) + len(units))))
        self.text += [";".join(groups[x:y]) for x, y in zip([0, *to], to)]
        self.text += [""] * len(bad)
        for column, n in zip((self.n_a, self.n_b, self.n_groups, self.n_links), counts):
            column.frombytes(np.concatenate([n, np.zeros(len(bad), np.int64)]).astype(np.int64).tobytes())

    def pairs_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the units' links, unit after unit, and how many each has."""
        n = np.array(self.n_links, dtype=np.int64)
        first, sizes = (np.cumsum(n) - n)[units], n[units]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array(self.keys, dtype=np.int64)[np.repeat(first, sizes) + inside], sizes

    def learn_all(self, units: set[str]) -> None:
        """Adds those units that the table lacks, plain ones first, some at a time."""
        missing = [u for u in units if u not in self.table]
        missing.sort(key=lambda u: _PLAIN.fullmatch(u) is None)
        part, n = [], 0
        for unit in missing:
            part.append(unit)
            n += len(unit)
            if n > SLICE // 4:
                self.learn(part)
                part, n = [], 0
        if part:
            self.learn(part)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner for two tokenizer files, read once."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


class _Chunk:
    """Documents with their digests, as numbers of units of this chunk."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.columns: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_units")}
        self.units: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, found: list[tuple[tuple, np.ndarray]]) -> None:
        self.ids.append(ids)
        for values, units in found:
            for k, v in zip(self.columns, values):
                self.columns[k].append(v)
            self.units.append(units)
            self.size += len(units)

    def row(self, number: int, known: Aligner) -> dict:
        """The chunk's row: pairs and how many links hold them here, units as numbers of pairs, documents as numbers of units."""
        used, at, times = _by_frequency(np.concatenate([*self.units, np.zeros(0, np.int64)]))
        keys, sizes = known.pairs_of(used)
        pairs, spot, _ = _by_frequency(keys)
        counts = np.bincount(spot, weights=np.repeat(times, sizes), minlength=len(pairs)) if len(pairs) else np.zeros(0)
        return {"chunk": number, "id": pa.concat_arrays(self.ids), **self.columns, "units": _packed(at), "unit_links": _packed(sizes), "links": _packed(spot), "pairs": pairs, "counts": counts.astype(np.int64)}


def _by_frequency(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the most frequent first; the place of each value among them; how often each stands in x."""
    values, at, times = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return values[order], place[at], times[order]


def _packed(x: np.ndarray) -> bytes:
    """Small numbers, compressed byte by byte of equal weight."""
    return zstandard.ZstdCompressor(1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _chunks(df: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """df(id, text) to chunk rows."""
    many = f"id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_units array<long>"
    schema = StructType.fromDDL(f"chunk long, {many}, units binary, unit_links binary, links binary, pairs array<long>, counts array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        known, number = aligner(a, b), TaskContext.get().partitionId() << 32

        def written(chunk: _Chunk) -> pa.RecordBatch:
            row = chunk.row(number, known)
            column = lambda v, t: pa.array([v], type=t) if not isinstance(v, pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v).cast(t)
            return pa.RecordBatch.from_arrays([column(row[f.name], f.type) for f in arrow], schema=arrow)

        chunk = _Chunk()
        for batch in batches:
            for at, texts in _slices(batch.column(1)):
                if known.full or chunk.size > CHUNK:
                    if chunk.ids:
                        yield written(chunk)
                        number, chunk = number + 1, _Chunk()
                    if known.full:
                        known.forget()
                lists = [known.units(t) if t else [] for t in texts]
                known.learn_all({u for units in lists for u in units})
                n = [np.array(x) for x in (known.n_a, known.n_b, known.n_groups, known.n_links)]
                found = []
                for units in lists:
                    where = [*map(known.table.__getitem__, units)]
                    own = np.array(where, dtype=np.int64)
                    sums = [int(x[own].sum()) for x in n] if where and n[0][own].all() else None
                    if sums:
                        found.append(((*sums, hashlib.sha256(";".join(map(known.text.__getitem__, where)).encode()).hexdigest(), len(own)), own))
                    else:
                        found.append(((0, 0, 0, 0, "", 0), own[:0]))
                chunk.add(batch.column(0).slice(at, len(texts)), found)
        if chunk.ids:
            yield written(chunk)

    return df.mapInArrow(run, schema)


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch, some at a time, with the place of the first."""
    texts, n, first = [], 0, 0
    for i, text in enumerate(column):
        texts.append(text.as_py() or "")
        n += len(texts[-1])
        if n > SLICE:
            yield first, texts
            texts, n, first = [], 0, i + 1
    if texts:
        yield first, texts


def _scored(chunk: pa.Table, found: pa.Table, names: list[str], schema: pa.Schema) -> pa.Table:
    """Documents of a chunk with sums over their links, from the corpus-wide counts of the chunk's pairs."""
    if not chunk.num_rows:
        return schema.empty_table()
    at, sizes, links = (_unpacked(chunk[c][0].as_py()) for c in ("units", "unit_links", "links"))
    count, best = np.zeros(found.num_rows, np.int64), np.zeros(found.num_rows, np.int64)
    place = found["pos"].to_numpy()
    count[place], best[place] = found["n"].to_numpy(), found["best"].to_numpy()
    sums = lambda x, n: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(n)])])
    docs = {c: chunk[c].combine_chunks().flatten() for c in (*names, "n_units")}
    n_units = docs.pop("n_units").to_numpy()
    of_unit = {"n_best": sums(best[links], sizes), "count_sum": sums(count[links], sizes)}
    docs |= {c: pa.array(sums(x[at], n_units)) for c, x in of_unit.items()}
    return pa.table([docs[f.name].cast(f.type) for f in schema], schema=schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold an id pair, and 1 if that is the most of its second id."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # a row for each id of the second vocabulary at most
    most = each.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return each.join(F.broadcast(most), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best"))


def alignment_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose id pair is the most frequent, in the corpus, of those with its second id;
    count_sum: the sum of the links' corpus-wide counts; groups_sha256: digest of the ids by group.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scratch = Scratch(df.sparkSession, "alignment")
    kind = df.schema[id_col].dataType.simpleString()
    chunks = scratch.table(_chunks(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), a, b, kind), "chunks")
    counts = scratch.table(pair_counts(chunks), "pairs")
    spots = chunks.select("chunk", F.posexplode("pairs").alias("pos", "pair"))
    scores = spots.join(counts, "pair").select(F.col("chunk").alias("of"), "pos", "n", "best")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = StructType.fromDDL(f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    arrow = to_arrow_schema(schema)
    whole = chunks.select("chunk", *names, "n_units", "units", "unit_links", "links")
    out = whole.groupBy("chunk").cogroup(scores.groupBy("of")).applyInArrow(lambda x, y: _scored(x, y, names, arrow), schema)
    return out.withColumnRenamed("id", id_col)


def alignments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per input row: id, the ids of both tokenizers, groups (from and to in both lists) and links (index in both lists)."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, a_ids array<int>, b_ids array<int>, groups array<struct<a_from: int, a_to: int, b_from: int, b_to: int>>, links array<struct<a: int, b: int>>"

    def align(batch: pa.RecordBatch) -> dict:
        known = aligner(a, b)
        out: dict[str, list] = {"a_ids": [], "b_ids": [], "groups": [], "links": []}
        for text in text_or_empty(batch.column(1)):
            x, y, _, good = known.encode(known.units(text)) if text else (np.zeros(0, np.int64),) * 4
            if not good.all():
                x = y = x[:0]
            _, to_a, to_b, _, link_a, link_b = known.align(x, y)
            groups = [dict(zip(("a_from", "a_to", "b_from", "b_to"), g)) for g in zip([0, *to_a], to_a, [0, *to_b], to_b)]
            rows = (x.tolist(), y.tolist(), groups, [{"a": i, "b": j} for i, j in zip(link_a.tolist(), link_b.tolist())])
            for column, v in zip(out.values(), rows):
                column.append(v)
        return {id_col: batch.column(0)} | out

    return arrow_map(df.select(id_col, text_col), align, schema)
