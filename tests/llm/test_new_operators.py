"""Alignment, token files and whitening against brute force, and on odd inputs."""

import hashlib
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafmill.llm import alignment, token_files, whitening
from leafmill.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "word", "Word word", "é ß 漢字\n\nx\t y", "a" * 3000, "the cat sat on the mat " * 400, "Same line\nother", "Same line\nother", "<|endoftext|> x", "x▁y z", "\n start", "tail \n", "<s> </s> <0x41>", "a\x00b c", "​ x ​y", "a\x1cb \x1c c", "hello\n\nworld  two", " lead", "🙂 z🙂\n🙂"]


def docs(spark, texts=ODD):
    rows = [(i, t, "s", "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, chunk string, id int")


WORDS = Tokenizer.from_file(P.path("word_bpe_49k.json"))
A = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def whole_ids(text):
    """Ids of both tokenizers for the whole text, and their bytes."""
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    known = alignment.aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    return a, b, [known.bytes_a[i] for i in a], [known.bytes_b[i] for i in b]


def brute(texts):
    """Digest columns by comparing all token occurrences with each other."""
    every, total = [], Counter()
    for text in texts:
        a, b, xa, xb = whole_ids(text or "")
        if not text or not b"".join(xa) == (" " + text).encode() == b"".join(xb):
            every.append(None)
            continue
        at_a, at_b = np.cumsum([0, *map(len, xa)]), np.cumsum([0, *map(len, xb)])
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if at_a[i] < at_b[j + 1] and at_b[j] < at_a[i + 1]]
        ends, groups, i, j = sorted({*at_a[1:]} & {*at_b[1:]}), [], 0, 0
        for e in ends:
            k, m = int(np.searchsorted(at_a, e)), int(np.searchsorted(at_b, e))
            groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
            i, j = k, m
        total.update(links)
        every.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = {}
    for (_, y), n in total.items():
        most[y] = max(n, most.get(y, 0))
    return [(x[0], x[1], x[2], len(x[3]), sum(total[p] == most[p[1]] for p in x[3]), sum(total[p] for p in x[3]), x[4]) if x else (0, 0, 0, 0, 0, 0, "") for x in every]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture
def small(monkeypatch):
    """Many chunks and tables that are emptied."""
    for name, n in (("CHUNK", 20), ("SLICE", 60), ("KEEP_UNITS", 30)):
        monkeypatch.setattr(alignment, name, n)


def test_alignment_equals_all_pairs(spark):
    texts = [t[:2000] if t and len(t) > 2000 else t for t in ODD] + [r["text"][:1500] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect() if r["text"]]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.alignment_digests(docs(spark, texts).repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_alignment_in_small_chunks(small):
    """Chunks and emptied tables give the same rows; run in this process, where the limits are set."""
    texts = [t[:200] if t else t for t in ODD] * 3
    known = alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    total, most, seen = Counter(), Counter(), []
    for at, part in alignment._slices(pa.array(texts)):
        if known.full:
            known.forget()
        known.learn_all({u for t in part if t for u in known.units(t)})
        for t in part:
            where = [known.table[u] for u in known.units(t)] if t else []
            ok = where and all(known.n_a[w] for w in where)
            seen.append(known.pairs_of(np.array(where))[0].tolist() if ok else [])
    for keys in seen:
        total.update(keys)
    for k, n in total.items():
        most[k & 0xFFFFFFFF] = max(most[k & 0xFFFFFFFF], n)
    want = brute(texts)
    assert [len(k) for k in seen] == [w[3] for w in want] and [sum(total[x] for x in k) for k in seen] == [w[5] for w in want]
    assert [sum(total[x] == most[x & 0xFFFFFFFF] for x in k) for k in seen] == [w[4] for w in want]


parts = st.lists(st.sampled_from(["don't", " ", "  ", "\n", "\t", "é", "漢", "12", "²", "!'s", "<|endoftext|>", "<s>", "hello", "The", "\x1c", "​", "\x85", "\xa0", "a\n\nb", "\n ", "🙂", "<0x0A>", "▁"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(parts)
def test_units_are_encoded_as_in_the_whole_text(text):
    known = alignment.aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    a, b, xa, xb = whole_ids(text)
    if not text:
        return
    found = known.encode(known.units(text))
    assert found[3].all() == (b"".join(xa) == (" " + text).encode() == b"".join(xb))
    if found[3].all():
        assert (found[0].tolist(), found[1].tolist()) == (a, b)


def test_alignments_give_groups_and_links(spark):
    row = alignment.alignments(docs(spark, ["hello tokenizers", None])).orderBy("doc_id").collect()
    assert row[0]["groups"][-1]["a_to"] == len(row[0]["a_ids"]) and row[0]["links"][0] == (0, 0) and row[1]["groups"] == []


def test_alignment_of_empty_and_repeated_rows(spark):
    assert alignment.alignment_digests(docs(spark, [])).count() == 0
    df = docs(spark, ["one two", "one two"]).withColumn("doc_id", F.lit(None).cast("long"))
    got = alignment.alignment_digests(df).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["doc_id"] is None and got[0]["count_sum"] == 2 * got[0]["n_links"]
    assert alignment.alignment_digests(docs(spark, [None, ""])).agg(F.sum("n_links")).first()[0] == 0


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=200), st.integers(0, 300))
def test_wavelet_matrix(ids, token):
    m = token_files.WaveletMatrix(token_files.build(np.array(ids, "<u4"), 9, pa.table({"id": [1]})))
    where = [i for i, x in enumerate(ids) if x == token]
    lo, hi = len(ids) // 3, len(ids) - len(ids) // 4
    assert m.tokens().tolist() == ids == m.access(np.arange(len(ids))).tolist()
    assert m.count(token) == len(where) and m.occurrences(token).tolist() == where
    assert m.count(token, lo, hi) == sum(lo <= i < hi for i in where) and m.occurrences(token, lo, hi).tolist() == [i for i in where if lo <= i < hi]


def test_wavelet_matrix_over_many_blocks():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 49_407).astype("<u4")
    data = token_files.build(ids, 16, pa.table({"id": [1]}))
    m = token_files.WaveletMatrix(data)
    assert (m.tokens() == ids).all() and len(data) < 2 * len(ids)
    at = rng.integers(0, len(ids), 500)
    assert (m.access(at) == ids[at]).all()
    for token in (1, 2, 77, 49_407, 1 << 20):
        assert (m.occurrences(token) == np.flatnonzero(ids == token)).all() and m.count(token, 1000, 200_000) == (ids[1000:200_000] == token).sum()


def stream(texts):
    """Ids of all documents in a row by the library, and where each begins."""
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    return ids, np.cumsum([0, *map(len, ids)])


@pytest.mark.parametrize("size", [50, 1 << 22])
def test_token_files_round_trip(spark, size, tmp_path):
    texts = ODD + ["long text of words " * 200]
    df = docs(spark, texts).repartition(3)
    ids, at = stream(texts)
    token_files.write_tokens(df, f"{tmp_path}/t", shard_tokens=size)
    files = token_files.TokenFiles(spark, f"{tmp_path}/t")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in files.documents().collect()}
    assert got == {i: (int(at[i]), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}
    flat = [i for x in ids for i in x]
    assert {r["token"]: r["n"] for r in files.counts([2, flat[20], 49_000]).collect()} == {t: flat.count(t) for t in (2, flat[20], 49_000)}
    assert sorted(r["place"] for r in files.occurrences(2).collect()) == [i for i, x in enumerate(flat) if x == 2]
    asked = spark.createDataFrame([(i,) for i in (0, 7, 7, len(flat) - 1, len(flat), -1)], "p long")
    assert sorted((r["place"], r["token"]) for r in files.tokens_at(asked).collect()) == [(i, flat[i]) for i in (0, 7, len(flat) - 1)]


def test_token_files_of_empty_tables_ties_and_nulls(spark):
    assert token_files.token_file_documents(docs(spark, [])).count() == 0
    df = docs(spark, ["b", "a", "a", None]).withColumn("doc_id", F.when(F.col("text").isNull(), None).otherwise(F.lit(5).cast("long")))
    rows = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.token_file_documents(df).collect())
    assert rows == [(0, None, 1), (1, 5, 2), (3, 5, 2), (5, 5, 2)]


@given(st.binary(max_size=40), st.binary(max_size=90))
def test_crc_of_both(a, b):
    assert token_files.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_op12_orders_the_supplied_documents(spark):
    rows = QUERIES["op12_token_files"](spark, DATA).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[0]["start"] == 0


# whitening


def fixed(v):
    return np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in row] for row in v], dtype=object)


def check_whitening(got, vectors, k=8):
    x = fixed(vectors)
    n, s = len(x), x.sum(0)
    exact = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    z = np.array([[float(Fraction(int(n * a - b), n)) for a, b in zip(row, s)] for row in x])
    v = np.array([[float(Fraction(int(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x)), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, u = np.linalg.eigh(v)
    k = min(k, int((e > 1e-12 * e[-1]).sum()))
    assert len(got) == n * k
    rows = {}
    for r in got:
        rows.setdefault(r["vec_id"], {})[r["component"]] = r
    for c in range(1, k + 1):
        w = np.array([rows[i][c]["whitened"] for i in range(n)])
        want = z @ u[:, -c] / np.sqrt(e[-c])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-7
        assert all(abs(rows[i][c]["explained"] - e[-c] / np.trace(v)) < 1e-9 for i in range(n))
    assert [int(rows[i][1]["deviation"]) for i in range(n)] == exact
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-6


def vectors_table(spark, vectors):
    rows = [(i, v, 3, "clash") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, id string")


def test_whitening_equals_exact_arithmetic(spark):
    v = np.random.default_rng(3).standard_normal((300, 9)) @ np.random.default_rng(4).standard_normal((9, 9))
    check_whitening(whitening.whiten(vectors_table(spark, v.tolist()).repartition(5)).collect(), v)


def test_whitening_of_large_and_flat_entries(spark):
    v = np.random.default_rng(5).standard_normal((40, 4)) * [1e3, 1e7, 1.0, 0.0] + [0, 3e15, 0, 2.0]
    check_whitening(whitening.whiten(vectors_table(spark, v.tolist()).repartition(3)).collect(), v)


def test_whitening_drops_what_has_no_vector(spark):
    v = np.random.default_rng(6).standard_normal((30, 3)).tolist()
    odd = [None, [None, 1.0, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], []]
    got = whitening.whiten(vectors_table(spark, v + odd)).collect()
    assert {r["vec_id"] for r in got} == {*range(30)} and {r["n"] for r in got} == {30} and len(got) == 90
    zero = whitening.whiten(vectors_table(spark, v + [[0.0, 0.0, 0.0], v[0]]).withColumn("vec_id", F.lit(None).cast("long"))).collect()
    assert len(zero) == 3 * 32 and {r["vec_id"] for r in zero} == {None}


def test_whitening_of_empty_and_equal_rows(spark):
    assert whitening.whiten(vectors_table(spark, [])).count() == 0
    assert whitening.whiten(vectors_table(spark, [None])).count() == 0
    assert whitening.whiten(vectors_table(spark, [[1.0, 2.0]] * 4)).count() == 0


def test_op13_on_the_supplied_embeddings(spark):
    rows = QUERIES["op13_whitening"](spark, DATA).collect()
    held = spark.read.parquet(f"{DATA}/embeddings.parquet").where("embedding IS NOT NULL").orderBy("vec_id").toPandas()
    v = np.array(held["embedding"].tolist(), dtype=float)
    n, x = len(v), np.floor(1024 * v).astype(int) + 100_000
    s = x.sum(0)
    assert len(rows) == 8 * n and {r["n"] for r in rows} == {n}
    want = {i: int(((n * r.astype(object) - s) ** 2).sum()) for i, r in zip(held["vec_id"], x)}
    assert all(want[r["vec_id"]] == r["deviation"] for r in rows) and rows[0]["identity_error"] < 1e-4


words = st.lists(st.sampled_from(["don't", " ", "  ", "\n", "\t", "é", "漢", "12", "²", "!'s", "...", "|", "<|endoftext|>", "<|", "|>", "hello", "The", "ÑAß", "\x1c", "\x01", "​", "\x85", "🙂", "--", "a_b", "#$%", "unbelievableness"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(words)
def test_texts_are_encoded_as_by_the_library(text):
    encoder = token_files._encoders.setdefault("word_bpe_49k.json", None) or token_files._Encoder("word_bpe_49k.json")
    token_files._encoders["word_bpe_49k.json"] = encoder
    assert np.frombuffer(encoder.of(text), "<u4").tolist() == WORDS.encode(text, add_special_tokens=False).ids


def test_supplied_texts_are_encoded_as_by_the_library(spark):
    encoder = token_files._Encoder("word_bpe_49k.json")
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encoder.of(r["text"] or "") == np.array(WORDS.encode(r["text"] or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    encoder = token_files._Encoder("word_bpe_49k.json")
    text = "some words, again and again! " * 300
    whole = encoder.of(text)
    monkeypatch.setattr(token_files, "LIMIT", 50)
    assert encoder.of(text) == whole == np.array(WORDS.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
