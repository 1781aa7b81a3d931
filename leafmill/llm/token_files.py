"""Token ids in files: a wavelet matrix per shard.

A shard's ids are stored as bit planes, highest bit first; each plane is the bits of the ids in the
order in which the planes above have dealt them, zeros before ones. With counts of ones before
every block of a plane, rank and select on planes give the token at a place, the number of a
token's occurrences in a stretch, and their places, all from the one file, whose blocks are
compressed one by one, so that a question reads a few blocks of each plane.

Documents are dealt to ranges of their ids, sorted, encoded in that order, and cut into shards of
`shard_tokens` in the task that has them: no ids are shuffled, only texts, once. Spark's own writer
puts the files in place (one record each, so one line end follows the data), so they are
committed as any table is and may stand in any store; folders name part, shard and tokens, so the
place of every shard is known from the list of files alone. A document longer than a shard goes on
in the next ones.

File: magic, length of the header, header (JSON), counts of ones before each block, sizes of the
blocks, the directory of documents (Arrow), the blocks.

Inputs with defined results: a null or empty text is its end id alone; null ids come first; rows
with one id come in the order of their texts' hashes, each as a document of its own, and equal ones, spread
by their place in the input, are alike; an empty table gives no file and an empty table; other
columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch, arrow_map, shuffles_removed
from .packing import _WordIds

MAGIC = b"WMX1"
#: Bytes of a plane that are compressed together; code points that are encoded in one go, about.
BLOCK, LIMIT = 8192, 1 << 18
#: Marks of plain text, runs of which the library takes as one. Else it has letters of Latin alphabets, spaces and line ends.
_MARKS = re.escape("!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~")
_RUN = re.compile(f"[{_MARKS}]+")
_ODD = re.compile(rf"[^A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff{_MARKS} \n]")


def build(ids: np.ndarray, planes: int, directory: pa.Table) -> bytes:
    """A file's bytes: ids, all under 2^planes, and a table of the documents that they belong to."""
    x = pa.array(ids.astype(np.uint16 if planes <= 16 else np.uint32))
    press, zeros, before, blocks = zstandard.ZstdCompressor(3), [], [], []
    bitmap = lambda packed: pa.Array.from_buffers(pa.bool_(), len(ids), [None, pa.py_buffer(packed)])
    for plane in reversed(range(planes)):
        packed = np.packbits((x.to_numpy() >> plane) & 1 == 1, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), BLOCK), dtype=np.int64) if len(packed) else np.zeros(0, np.int64)
        before.append(np.cumsum(ones) - ones)
        zeros.append(len(ids) - int(ones.sum()))
        data = packed.tobytes()
        blocks += [press.compress(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK)]
        x = pa.concat_arrays([x.filter(bitmap(~packed)), x.filter(bitmap(packed))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, directory.schema) as out:
        out.write_table(directory)
    docs = press.compress(sink.getvalue().to_pybytes())
    counts, sizes = np.concatenate(before).astype("<u8").tobytes(), np.array([len(b) for b in blocks], "<u4").tobytes()
    header = json.dumps({"n": len(ids), "planes": planes, "zeros": zeros, "counts": len(counts), "sizes": len(sizes), "docs": len(docs)}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, counts, sizes, docs, *blocks])


class WaveletMatrix:
    """Reads a file's bytes; blocks are decompressed as they are asked for. All places may be arrays."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        self.data, at = memoryview(data), 8 + int.from_bytes(data[4:8], "little")
        head = json.loads(data[8:at])
        self.n, self.planes, self.zeros = head["n"], head["planes"], head["zeros"]
        self.before = np.frombuffer(data, "<u8", head["counts"] // 8, at).astype(np.int64).reshape(self.planes, -1)
        at += head["counts"]
        sizes = np.frombuffer(data, "<u4", head["sizes"] // 4, at).astype(np.int64)
        self.docs_at, self.docs_size = at + head["sizes"], head["docs"]
        self.starts = (self.docs_at + self.docs_size + np.concatenate([[0], np.cumsum(sizes)])).tolist()
        self.press = zstandard.ZstdDecompressor()
        self.held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def directory(self) -> pa.Table:
        raw = self.press.decompress(self.data[self.docs_at : self.docs_at + self.docs_size])
        return pa.ipc.open_stream(raw).read_all()

    def _packed(self, level: int, block: int) -> bytes:
        i = level * self.before.shape[1] + block
        return self.press.decompress(self.data[self.starts[i] : self.starts[i + 1]])

    def _block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Bits of a block and the ones before each of them; the last 64 blocks stay."""
        if (level, block) not in self.held:
            if len(self.held) >= 64:
                self.held.pop(next(iter(self.held)))
            bits = np.unpackbits(np.frombuffer(self._packed(level, block), np.uint8), bitorder="little")
            self.held[level, block] = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self.held[level, block]

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Rank: ones of a plane before each place."""
        out, block = np.zeros(len(at), np.int64), np.minimum(at // (8 * BLOCK), self.before.shape[1] - 1)
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = self.before[level, b] + self._block(level, b)[1][at[here] - b * 8 * BLOCK]
        return out

    def find(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Select: the places of the k-th ones (or zeros) of a plane, from 0."""
        first = np.arange(self.before.shape[1]) * 8 * BLOCK
        before = self.before[level] if bit else first - self.before[level]
        out, block = np.zeros(len(k), np.int64), np.searchsorted(before, k, "right") - 1
        for b in np.unique(block).tolist():
            here = block == b
            out[here] = first[b] + np.flatnonzero(self._block(level, b)[0] == bit)[k[here] - before[b]]
        return out

    def _down(self, level: int, bit: int | np.ndarray, at: np.ndarray) -> np.ndarray:
        ones = self.ones(level, at)
        return np.where(bit, self.zeros[level] + ones, at - ones)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at places."""
        out, at = np.zeros(len(at), np.int64), np.asarray(at, np.int64)
        for level in range(self.planes):
            ones = self.ones(level, at)
            bit = self.ones(level, at + 1) - ones
            out, at = out << 1 | bit, np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> np.ndarray:
        ends = np.array([lo, hi], np.int64)
        if not self.n or token >> self.planes:
            return ends * 0
        for level in range(self.planes):
            ends = self._down(level, token >> (self.planes - 1 - level) & 1, ends)
        return ends

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a token in [lo, hi)."""
        first, last = self._range(token, lo, self.n if hi is None else hi)
        return int(last - first)

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of a token in [lo, hi), ascending."""
        first, last = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(first, last)
        for level in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - level) & 1
            at = self.find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids: the planes are undone from the lowest up."""
        x = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            raw = b"".join(self._packed(level, b) for b in range(self.before.shape[1]))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            x[self.zeros[level] :] |= x.dtype.type(1 << (self.planes - 1 - level))
            up = np.empty_like(x)
            up[~ones], up[ones] = x[: self.zeros[level]], x[self.zeros[level] :]
            x = up
        return x.astype("<u4")


class _Encoder:
    """Ids of texts, in one go wherever the encoder for ranks tells words as the library does.

    It takes the vocabulary with a mark of its own for the end of a word, a byte that no plain text holds: the
    ids of a word's last byte with its end come before all merges, so that the mark is joined to it
    first, as the library does from the start. Words with other characters go to the library, with a
    bounded table of them.
    """

    MARK = "\x01"

    def __init__(self, name: str):
        import tiktoken

        self.odd = _WordIds(name)
        back = {chr(i): b for b, i in self.odd.letters.items()}
        ranks: dict[bytes, int] = {}
        for token, i in self.odd.tokenizer.get_vocab().items():
            body, end = (token[:-4], self.MARK) if token.endswith("</w>") else (token, "")
            if not token.startswith("<|"):
                ranks[bytes(back.get(c, ord(c)) for c in body) + end.encode()] = i
        self.together = tiktoken.Encoding("words", pat_str=f"[^{self.MARK}]*{self.MARK}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> bytes:
        """Ids of a stretch of plain words: every run of letters or of marks ends with the sign for its end."""
        mark = self.MARK
        text = _RUN.sub(f"{mark}\\g<0>{mark}", text.lower())
        text = text.replace(" ", mark).replace("\n", mark) + mark
        while mark + mark in text:
            text = text.replace(mark + mark, mark)
        return array("I", self.together(text.lstrip(mark))).tobytes()

    def stretches(self, text: str) -> Iterator[tuple[str, str]]:
        """Plain stretches and the odd word after each."""
        at = 0
        for m in _ODD.finditer(text):
            if m.start() < at:
                continue
            start = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), at - 1) + 1
            end = min((e for e in (text.find(" ", m.end()), text.find("\n", m.end())) if e >= 0), default=len(text))
            yield text[at:start], text[start:end]
            at = end
        while len(text) - at > LIMIT and (cut := text.find(" ", at + LIMIT)) >= 0:
            yield text[at:cut], ""
            at = cut
        yield text[at:], ""

    def of(self, text: str) -> bytes:
        return b"".join(ids for plain, odd in self.stretches(text) for ids in (self.plain(plain), self.odd[odd]))


_encoders: dict[str, _Encoder] = {}


class _Shards:
    """Cuts a stream of documents into shards."""

    def __init__(self, id_type: pa.DataType, planes: int, size: int):
        self.schema = pa.schema([("id", id_type), ("start", pa.int64()), ("done", pa.int64()), ("length", pa.int64())])
        self.planes, self.size, self.start, self.number = planes, size, 0, 0
        self._open()

    def _open(self) -> None:
        self.held, self.n = [], 0
        self.docs: dict[str, list] = {name: [] for name in self.schema.names}

    def close(self) -> Iterator[tuple[int, int, bytes]]:
        if self.n:
            directory = pa.table({name: pa.array(v, type=self.schema.field(name).type) for name, v in self.docs.items()}, schema=self.schema)
            yield self.number, self.n, build(np.frombuffer(b"".join(self.held), "<u4"), self.planes, directory)
            self.number += 1
        self._open()

    def add(self, key: object, ids: bytes) -> Iterator[tuple[int, int, bytes]]:
        n, done = len(ids) // 4, 0
        while done < n:
            own = min(n - done, self.size - self.n)
            for column, v in zip(self.docs.values(), (key, self.start, done, own)):
                column.append(v)
            self.held.append(ids[4 * done : 4 * (done + own)])
            self.n, done = self.n + own, done + own
            if self.n == self.size:
                yield from self.close()
        self.start += n


def write_tokens(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = 1 << 22) -> None:
    """Writes token files to a new folder, in the order of ids: part=/shard=/tokens=/one file."""
    spark = df.sparkSession
    # equal rows are told apart by their place, so that they spread over ranges
    keys = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("row")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(*keys, F.col(text_col).alias("text")).repartitionByRange(parts, "id", "h", "row").sortWithinPartitions("id", "h", "row").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = _Encoder(tokenizer)
        encoder, shards = _encoders[tokenizer], None
        planes = max(encoder.odd.tokenizer.get_vocab_size() - 1, end_id).bit_length()
        end, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()

        def rows(found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            for number, n, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "shard", "tokens", "value"])

        for batch in batches:
            shards = shards or _Shards(batch.schema.field(0).type, planes, shard_tokens)
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from rows(shards.add(key, encoder.of(text.as_py() or "") + end))
        if shards:
            yield from rows(shards.close())

    files = dealt.mapInArrow(run, "part int, shard int, tokens long, value binary")
    with shuffles_removed(spark):
        files.select("part", "shard", "tokens", F.col("value").cast("string").alias("value")).write.partitionBy("part", "shard", "tokens").text(folder)


class TokenFiles:
    """A folder of token files."""

    def __init__(self, spark: SparkSession, folder: str):
        found = spark.read.format("binaryFile").load(folder)
        places = [F.col(c) if c in found.columns else F.lit(None) for c in ("part", "shard", "tokens")]  # a folder without files has no such columns
        self.spark, self.files = spark, found.select("content", *[c.cast(k).alias(n) for c, k, n in zip(places, ("int", "int", "long"), ("part", "shard", "tokens"))])
        # from the list of files, which the driver has anyway; no file is opened
        found = self.files.groupBy("part").agg(F.sum("tokens").alias("n"), F.max("tokens").alias("most")).toArrow().sort_by("part")
        self.parts, sizes = found["part"].to_numpy(), found["n"].to_numpy()
        self.firsts = np.cumsum(sizes) - sizes
        self.n, self.size = int(sizes.sum()), max(found["most"].to_pylist(), default=1)  # a full shard, where any part has two

    def _each(self, fn: Callable[[int, WaveletMatrix], dict], schema: StructType | str) -> DataFrame:
        """Maps (first place, file) of every shard to columns."""
        first = {p: f for p, f in zip(self.parts.tolist(), self.firsts.tolist())}
        size = self.size

        def run(batch: pa.RecordBatch) -> dict | None:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))
            found = [fn(first[part] + shard * size, WaveletMatrix(data.as_py())) for part, shard, data in rows]
            return {k: pa.concat_arrays([f[k] for f in found]) for k in found[0]} if found else None

        return arrow_map(self.files.select("part", "shard", "content"), run, schema)

    def documents(self, id_type: str = "long", id_name: str = "doc_id") -> DataFrame:
        """(id, start, n_tokens, ids_crc32) of every document, from the files' ids."""

        def read(first: int, m: WaveletMatrix) -> dict:
            ids, docs = m.tokens().tobytes(), m.directory()
            ends = np.cumsum(docs["length"].to_numpy())
            crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), docs["length"].to_pylist())]
            # a piece's document starts as many ids before it as earlier shards hold
            start = first + ends - docs["length"].to_numpy() - docs["done"].to_numpy()
            return {"id": docs["id"].combine_chunks(), "start": pa.array(start), "done": docs["done"].combine_chunks(), "length": docs["length"].combine_chunks(), "crc": pa.array(crc, pa.int64())}

        pieces = self._each(read, f"id {id_type}, start long, done long, length long, crc long")
        # as many rows as shards that the document reaches
        found = pieces.groupBy("id", "start").agg(F.sum("length").alias("n_tokens"), F.min("crc").alias("one"), F.collect_list(F.struct("done", "length", "crc")).alias("pieces"))

        def joined(batch: pa.RecordBatch) -> dict:
            crc, pieces = batch.column(3).to_pylist(), batch.column(4)
            for i in np.flatnonzero(pa.compute.list_value_length(pieces).to_numpy() > 1).tolist():
                crc[i] = 0
                for p in sorted(pieces[i].as_py(), key=lambda p: p["done"]):
                    crc[i] = crc_of_both(crc[i], p["crc"], 4 * p["length"])
            return {"id": batch.column(0), "start": batch.column(1), "n_tokens": batch.column(2), "ids_crc32": crc}

        return arrow_map(found, joined, f"id {id_type}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_name)

    def counts(self, tokens: list[int]) -> DataFrame:
        """(token, n): occurrences in all files, by rank."""

        def read(_: int, m: WaveletMatrix) -> dict:
            return {"token": pa.array(tokens, pa.int64()), "n": pa.array([m.count(t) for t in tokens], pa.int64())}

        return self._each(read, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))

    def occurrences(self, token: int) -> DataFrame:
        """(place): where a token stands, counted from the first id of the first file, by select."""
        return self._each(lambda first, m: {"place": pa.array(first + m.occurrences(token))}, "place long")

    def tokens_at(self, places: DataFrame) -> DataFrame:
        """(place, token) of the places in the one column of `places`, by access; places beyond the files give no row."""
        firsts, parts, size = self.firsts, self.parts, self.size

        def locate(batch: pa.RecordBatch) -> dict:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(firsts, place, "right") - 1
            inside = place - firsts[at]
            return {"place": pa.array(place), "of_part": pa.array(parts[at]), "of_shard": pa.array(inside // size), "inside": pa.array(inside % size)}

        def read(asked: pa.Table, files: pa.Table) -> pa.Table:
            if not asked.num_rows or not files.num_rows:
                return pa.table({"place": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
            return pa.table({"place": asked["place"], "token": pa.array(WaveletMatrix(files["content"][0].as_py()).access(asked["inside"].to_numpy()))})

        name = F.col(places.columns[0])
        known = places.where((name >= 0) & (name < self.n)).select(name.cast("long")).distinct()  # at most a shard's tokens go to a task
        asked = arrow_map(known, locate, "place long, of_part int, of_shard int, inside long")
        files = self.files.select("part", "shard", "content")
        return asked.groupBy("of_part", "of_shard").cogroup(files.groupBy("part", "shard")).applyInArrow(read, "place long, token long")


def crc_of_both(first: int, second: int, size: int) -> int:
    """crc32 of two stretches together, from the crc32 of each and the bytes of the second: the first one's is moved over `size` zero bytes by squared matrices over GF(2)."""
    step = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    bits = 8 * size
    while bits:
        if bits & 1:
            first = _product(step, first)
        step, bits = [_product(step, row) for row in step], bits >> 1
    return first ^ second


def _product(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector, i = vector >> 1, i + 1
    return out


def token_file_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 2, shard_tokens: int = 1 << 22) -> DataFrame:
    """Writes all texts as token files in the shared folder and reads them back: id, start, n_tokens, ids_crc32."""
    scratch = Scratch(df.sparkSession, "tokens")
    folder = f"{scratch.folder}/files"
    write_tokens(df, folder, id_col, text_col, tokenizer, end_id, shard_tokens)
    return TokenFiles(df.sparkSession, folder).documents(df.schema[id_col].dataType.simpleString(), id_col)
