"""URL filters by a sorted array of digests.

A rule's key is its host and path prefix. The 64-bit xxhash digests of all keys are written
sorted to one file, the keys themselves to another; Spark ships both to every executor, whose
workers map them into memory. A URL is probed with those suffixes of its host that have as many
labels, and those prefixes of its path that have the length, of some rule's, by one vectorised
binary search a batch, and each hit is confirmed on the stored string, so that colliding digests
do no harm. Rules come as a list or as a table (verdict, host, path) of at most `max_rules` rows,
as the digests of all of them are kept on every executor's disk.

Inputs with defined results: a null URL or one without "://" has empty host and path and meets
no rule; an empty rule list gives the default verdict everywhere; of rules with one host and path
block counts; of fitting rules of one length that with the longer host; repeated rows give repeated
rows; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

_HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)")
_UPPER = {c: c + 32 for c in range(65, 91)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    m = _HOST_PATH.search(url) if url else None
    return (m[1].translate(_UPPER), m[2]) if m else ("", "")


def write_digests(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Ships the sorted digests and strings of rules (verdict, host, path) to the executors; returns the files' name.

    The files are made on the driver only to be added to the application's files, which
    Spark's own server hands to each executor, including those that start later.
    """
    from xxhash import xxh64_intdigest

    strings = [f"{host}\n{path}\n{verdict}".encode() for verdict, host, path in rules]
    digests = np.array([xxh64_intdigest(s.rsplit(b"\n", 1)[0]) for s in strings], dtype=np.uint64)
    order = np.argsort(digests, kind="stable")
    ends = np.cumsum([0, *(len(strings[i]) for i in order)]).astype(np.uint64)
    lengths = np.unique(np.array([len(p) for _, _, p in rules], dtype=np.uint64))
    labels = np.unique(np.array([h.count(".") + 1 for _, h, _ in rules], dtype=np.uint64))
    name = f"digests-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp()
    np.save(f"{folder}/{name}.npy", np.concatenate([np.array([len(rules), len(lengths), len(labels)], dtype=np.uint64), digests[order], ends, lengths, labels]))
    with open(f"{folder}/{name}.txt", "wb") as f:
        f.write(b"".join(strings[i] for i in order))
    for kind in ("npy", "txt"):
        spark.sparkContext.addFile(f"{folder}/{name}.{kind}")
    return name


class _Digests:
    """A worker's view of the mapped files."""

    def __init__(self, name: str):
        mapped = np.load(SparkFiles.get(f"{name}.npy"), mmap_mode="r")
        n, k, m = map(int, mapped[:3])
        self.digests, self.ends, rest = mapped[3 : 3 + n], mapped[3 + n : 4 + 2 * n], mapped[4 + 2 * n : 4 + 2 * n + k + m].tolist()
        self.lengths, self.labels = rest[:k], rest[k:]
        self.text = np.memmap(SparkFiles.get(f"{name}.txt"), dtype=np.uint8, mode="r") if n else None

    def find(self, keys: list[bytes]) -> list[str | None]:
        """The verdict stored for each key, or None."""
        from xxhash import xxh64_intdigest

        out: list[str | None] = [None] * len(keys)
        if self.text is None or not keys:
            return out
        probes = np.fromiter((xxh64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        lo, hi = np.searchsorted(self.digests, probes, "left"), np.searchsorted(self.digests, probes, "right")
        for i in np.flatnonzero(hi > lo):
            for at in range(lo[i], hi[i]):
                key, _, verdict = self.text[int(self.ends[at]) : int(self.ends[at + 1])].tobytes().rpartition(b"\n")
                if key == keys[i]:
                    out[i] = verdict.decode()
                    break
        return out


_open: dict[str, _Digests] = {}


def _candidates(host: str, path: str, labels: list[int], lengths: list[int]) -> list[tuple[str, str]]:
    """Host suffixes of the rules' numbers of labels with path prefixes of the rules' lengths, longest first, of equally long ones the longer host."""
    hosts, at, n = [], len(host), 0
    for k in labels:
        while n < k and at >= 0:
            at, n = host.rfind(".", 0, at), n + 1
        if n < k:
            break
        hosts.append(host[at + 1 :])
        if at < 0:
            break
    paths = [path[:n] for n in lengths if n <= len(path)]
    return sorted(((h, p) for h in hosts for p in paths), key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 20_000_000) -> DataFrame:
    """One row per input row: id, host, path, rule (host and path of the longest rule that fits, else null) and verdict."""
    if isinstance(rules, DataFrame):
        found = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).limit(max_rules + 1).toArrow()
        rules = list(zip(*(found[c].to_pylist() for c in ("verdict", "host", "path"))))
    settled: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        settled[host, path] = max(verdict, settled.get((host, path), verdict))  # block comes after allow
    rules = [(verdict, host, path) for (host, path), verdict in settled.items()]
    if len(rules) > max_rules:
        raise ValueError(f"more than {max_rules} rules")
    name = write_digests(df.sparkSession, rules)

    def judge(batch: pa.RecordBatch) -> dict:
        if name not in _open:
            _open.clear()
            _open[name] = _Digests(name)
        digests = _open[name]
        parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
        tried = [_candidates(h, p, digests.labels, digests.lengths) if h else [] for h, p in parts]
        found = iter(digests.find([f"{h}\n{p}".encode("utf-8", "surrogatepass") for c in tried for h, p in c]))
        hits = [next(((h + p, v) for (h, p), v in [(x, next(found)) for x in c] if v), (None, default)) for c in tried]
        return {id_col: batch.column(0), "host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": [r for r, _ in hits], "verdict": [v for _, v in hits]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, url_col), judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
