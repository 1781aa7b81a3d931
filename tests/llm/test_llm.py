"""The training-data operators against brute force, and on odd inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leafmill.llm import common, language_id, line_dedup, mixing, packing, pii, similar_texts, simhash, token_counts, url_filter, vector_dedup, vector_search
from leafmill.llm.common import Scratch, connected_components
from leafmill.llm.queries import URL_RULES

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "word", "Word word", "é ß 漢字\n\nx\t y", "a" * 3000, "the cat sat on the mat " * 400, "Same line\nother", "Same line\nother", "<|endoftext|> x", "mail a.b@c.de, +1 (555) 010-9999 10.0.0.256 4111 1111 1111 1111"]


def docs(spark, texts=ODD, sources="ab"):
    rows = [(i, t, "en" if i % 3 else None, None if i % 7 == 6 else sources[i % len(sources)], len(t or ""), "clash", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _hash string, fp double")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


pieces = st.lists(st.sampled_from(["don't", "we're", " ", "  ", "\n", "\t", "é", "漢", "12", "²", "!'", "<|endoftext|>", "<|endof", "hello", "The", "\x1c", "​"]), max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(pieces)
def test_prefix_counts_are_exact(text):
    c, t = token_counts.counter("byte_bpe_50k.json"), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = [len(t.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    c.learn([text])
    assert c.every_prefix(text) == want and c.count(text) == want[-1]
    assert c.longest_within(text, 3) == max(i for i, n in enumerate(want) if n <= 3)


def test_token_counts_on_odd_texts(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = by_id(token_counts.token_counts(docs(spark)))
    for i, text in enumerate(ODD):
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (n, n > 512, len((text or "").encode()))
    assert len(token_counts.prefix_counts(docs(spark)).where("doc_id = 3").first()["counts"]) == 5


def test_line_dedup(spark):
    rows = [(i, f"unique {i}\nAll rights reserved.\nsome", "s%d" % i) for i in range(5)] + [(9, None, None), (10, "", "s1"), (11, "All rights reserved.", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(line_dedup.remove_spread_lines(df, min_sites=5))
    assert got[0]["text"] == rows[0][1] and got[0]["lines_removed"] == 0
    assert got[3]["text"] == "unique 3" and got[3]["lines_removed"] == 2
    assert got[11]["text"] == "" and got[9]["text"] is None and got[10]["text"] == ""


def base_brute(text):
    def luhn(s):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(s[::-1])) % 10 == 0

    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return [(pii.KINDS[k], s, e) for s, k, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a.b", "@", "c", ".d", "1", "23", "456", ".", "-", " ", "+", "(", ")", "4111111111111111", "255", "é"]), max_size=25).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == base_brute(text)


def test_pii_query(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = by_id(pii.find_spans(df.unionByName(docs(spark, [None, ""]).select(df.columns).withColumn("doc_id", F.col("doc_id") - 9)), pii.fit(df)))
    for r in df.collect():
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base_brute(r["text"]))
        assert got[r["doc_id"]]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[r["doc_id"]]["spans"].split(","))
    assert got[-9]["spans"] == "" and pii.redact("x a@b.cd y", "email:2:8") == "x [email] y"
    assert pii.fit(df.limit(0)) is None


def reach(linked, ids):
    comp = np.array(ids)
    while True:
        following = np.minimum(comp, np.where(linked, comp[None, :], 1 << 60).min(1))
        if (following == comp).all():
            return comp.tolist()
        comp = following


@pytest.mark.parametrize("blocks", [40, 1500])
def test_vector_groups(spark, blocks):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 16))
    near = np.concatenate([base, base[:60] + 0.03 * rng.standard_normal((60, 16)), np.repeat(base[:1], 30, 0), base[1] + 0.02 * rng.standard_normal((60, 16))])
    rows = [(i, [float(x) for x in v], i % 2 if i < 180 else 0) for i, v in enumerate(near)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, rows[0][1], None), (905, [1.0], 0), (906, [], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))
    got = by_id(vector_dedup.vector_groups(df, leaf_rows=blocks), "vec_id")
    x = near / np.linalg.norm(near, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    linked = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    assert np.mean([got[i]["n_links"] == want[i] for i in range(len(rows))]) > 0.95
    assert all(got[i]["n_links"] <= want[i] for i in range(len(rows)))
    assert np.mean([got[i]["component_id"] == c for i, c in enumerate(reach(linked, range(len(rows))))]) > 0.95
    assert all(got[i[0]]["n_links"] == 0 and got[i[0]]["kept"] for i in odd)
    assert vector_dedup.vector_groups(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["https://WWW.Example.com/en/x?q#f", "http://a.example.com/en/", "http://net/es/", "http://x.net/fr", "ftp://y.com", "no url", None, "http://com/#", "http://notexample.com/en/", "http://b.example.com/enx"]
    got = by_id(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES), "page_id")
    assert [(got[i]["rule"], got[i]["verdict"]) for i in range(10)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/", "allow"), ("com/", "allow"), ("com/", "allow")]
    assert (got[0]["host"], got[0]["path"], got[6]["host"]) == ("www.example.com", "/en/x", "")


def test_urls_odd(spark):
    page = lambda rows: spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    long = "http://" + "a." * 20_000 + "net/es/x"
    got = url_filter.filter_urls(page([(1, long, "clash", "clash"), (2, long, None, None), (2, long, None, None)]), URL_RULES).collect()
    assert [(r["rule"], r["verdict"]) for r in got] == [("net/es/", "block")] * 3
    assert url_filter.filter_urls(page([]), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(page([(1, "http://x.net/es/", "", "")]), []).collect()} == {"allow"}
    table = spark.createDataFrame([("block", "net", "/es/")], "verdict string, host string, path string")
    assert url_filter.filter_urls(page([(1, "http://x.net/es/", "", "")]), table).first()["verdict"] == "block"


def test_colliding_digests(spark, monkeypatch):
    name = url_filter.write_digests(spark, URL_RULES)
    d = url_filter._Digests(name)
    d.digests = np.full(len(d.digests), d.digests[0])  # as if all keys had one digest
    keys = [f"{h}\n{p}".encode() for _, h, p in URL_RULES]
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda k: int(d.digests[0]))
    assert d.find([*keys, b"other\n/"]) == [v for v, _, _ in URL_RULES] + [None]


NAMES = ["_key", "_id", "_doc", "_gone", "_tie", "_size", "_at", "_source", "taken", "lines_removed", "_p", "_before", "_k0", "_amount", "_part", "_inside", "row", "id", "size", "copy", "pieces", "name", "node", "component", "h1", "rank", "one"]


def test_clashing_names_travel_along(spark):
    texts = [f"unique {i}\nAll rights reserved." for i in range(6)] + ["a word " * 40] * 2 + [None, ""]
    df = docs(spark, texts, "abcdefgh").withColumns({n: F.concat(F.lit(n), "doc_id") for n in NAMES})
    kept = line_dedup.remove_spread_lines(df)
    assert sorted(set(kept.columns)) == sorted({*df.columns}) and len(kept.columns) == len(df.columns)
    mixed = mixing.mix_documents(df)
    for out, added in ((kept, "lines_removed"), (mixed, "taken")):
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES if n != added)
    assert sum(r["lines_removed"] for r in kept.collect()) == 5
    counts, groups, packed = mixing.mix_counts(df), similar_texts.similar_groups(df), packing.pack_documents(df)
    assert counts.count() == groups.count() == len(texts) and {r[0] for r in packed.select("doc_id").collect()} == set(range(len(texts)))
    for found in (token_counts.token_counts(df), simhash.simhash_groups(df), pii.find_spans(df, None), language_id.predict(df, language_id.fit(df))):
        assert found.count() == len(texts)
    known = language_id.keep_known(df, language_id.fit(df), 0.5)
    assert known.columns == df.columns and known.count() >= 8 and all(r["row"] == f"row{r['doc_id']}" for r in known.collect())


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    for found in (token_counts.token_counts(none), line_dedup.remove_spread_lines(none), pii.find_spans(none, pii.fit(none)), language_id.predict(none, language_id.fit(none)), packing.pack_documents(none), simhash.simhash_groups(none), mixing.mix_counts(none), mixing.mix_documents(none)):
        assert found.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_search.nearest(vectors, F.col("vec_id") % 20 == 0).count() == 0


def test_line_dedup_by_the_sketch_alone(spark):
    rows = [(i, f"own {i}\nspread\nrare", f"s{i}") for i in range(60)] + [(60 + i, "near\nnear", None if i == 0 else f"t{i}") for i in range(5)] + [(70, "four", f"s{i}") for i in range(4)]
    got = line_dedup.remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=5).collect()
    assert sum("spread" in r["text"] for r in got) == 1 and [r["text"] for r in got if r["doc_id"] == 60] == ["near"]  # the place of a line counts, not the line
    assert all(r["text"] == "" for r in got if 60 < r["doc_id"] < 70) and all(r["text"] == "four" for r in got if r["doc_id"] == 70)


def test_pii_adds_what_formats_miss(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit(df)
    assert model.precision >= 0.99 and model.recall >= 0.9
    rng, rows = random.Random(5), []
    for i, r in enumerate(df.where("text <> ''").orderBy("doc_id").limit(600).collect()):
        before, value, after, personal = pii.planted(rng)
        head = r["text"][:300].rsplit(" ", 1)[0]
        rows.append((i, f"{head} {before}{value}{after} {r['text'][300:600]}", len(head) + 1 + len(before), len(value), personal))
    got = by_id(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string, at int, n int, personal boolean"), model))
    hit = {True: [], False: []}
    for i, text, at, n, personal in rows:
        spans = [x.split(":") for x in filter(None, got[i]["spans"].split(","))]
        hit[personal].append(any(int(s) < at + n and int(e) > at for _, s, e in spans))
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in base_brute(text))
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
    assert np.mean(hit[True]) > 0.95 and np.mean(hit[False]) < 0.05


def language_brute(model, text):
    """Scores n-gram by n-gram, by the definition of the hash."""
    words = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
    s, total = f" {' '.join(words)} ", model.log_prior.astype(float).copy()
    if not words:
        return "und", 0.0
    for n in model.sizes:
        for i in range(len(s) - n + 1):
            h = 0
            for c in s[i : i + n]:
                h = (h * 0x9E3779B1 + ord(c)) % (1 << 32)
            h = (h ^ (h >> 15)) * (0x85EBCA6B + 2 * n) % (1 << 32)
            total += model.log_prob[(h >> 7) % len(model.log_prob)]
    share = np.exp(total - total.max())
    return model.languages[int(total.argmax())], 1 / share.sum()


def test_language_id_by_brute_force(spark, monkeypatch):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(df)
    texts = ["½ ² Ⅷ 12", None, "", "a", "é", "the and of in the", "la de que el en los", "𝔘𝔫𝔦 漢字"] + [r["text"] for r in df.orderBy("doc_id").limit(12).collect()]
    got = by_id(language_id.predict(docs(spark, texts * 2), model))
    for i, t in enumerate(texts * 2):
        want = language_brute(model, t)
        assert got[i]["lang_pred"] == want[0] and got[i]["score"] == pytest.approx(want[1], abs=1e-6), t
    monkeypatch.setattr(language_id, "CHUNK", 50)  # long texts come in parts
    parts = list(language_id.counts_by_row([texts[-1], "", texts[-2]], (2, 3), 1 << 16))
    monkeypatch.undo()
    whole = list(language_id.counts_by_row([texts[-1], "", texts[-2]], (2, 3), 1 << 16))
    total = lambda ps: {(r, b): n for r, b, n in zip(*(np.concatenate(x).tolist() for x in zip(*ps)))} if len(ps) == 1 else sum_up(ps)
    assert sum_up(parts) == total(whole)


def sum_up(parts):
    out = {}
    for rows, buckets, n in parts:
        for r, b, k in zip(rows.tolist(), buckets.tolist(), n.tolist()):
            out[r, b] = out.get((r, b), 0) + k
    return out


def test_vector_groups_split_large_leaves(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 16))
    x[3000:] = x[:1000] + 0.02 * rng.standard_normal((1000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = by_id(vector_dedup.vector_groups(df, leaf_rows=25, max_sample=300), "vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert all(got[i]["n_links"] <= want[i] for i in range(4000))
    assert sum(got[i]["n_links"] for i in range(4000)) / want.sum() > 0.95


def mix_brute(rows, seed=7, block_words=256):
    """Words taken by document: sources laid out word by word, blocks taken slot by slot."""
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, str(s)))
    words = {s: [i for i, t, x in sorted(rows, key=lambda r: r[0]) if x == s for _ in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for s in sources}
    aims, taken = mixing.targets([len(words[s]) for s in sources]), {}
    for k, s in enumerate(sources):
        block = max(1, min(block_words, int(aims[k] / 1000)))
        blocks = [words[s][i : i + block] for i in range(0, len(words[s]), block)]
        best, held, slots = abs(aims[k]), [], []
        while blocks and len(slots) < 4 * len(blocks):
            no = int(mixing.permuted(np.array([len(slots) % len(blocks)]), len(blocks), seed * 1_000_003 + k)[0])
            slots.append(no)
            held += blocks[no]
            if abs(len(held) - aims[k]) < best - 1e-9:
                best, right = abs(len(held) - aims[k]), list(held)
        for i in right if blocks else []:
            taken[i] = taken.get(i, 0) + 1
    return taken


def test_mixing_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdef", k=rng.choice([0, 1, 5, 40, 700]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(df).collect()}
    want = mix_brute(rows)
    assert got == {i: want.get(i, 0) for i, _, _ in rows}
    pieces = [r.asDict() for r in mixing.mix_pieces(df, shards=5).collect()]
    other = [r.asDict() for r in mixing.mix_pieces(df, shards=5, seed=8).collect()]
    assert {p["shard"] for p in pieces} == set(range(5))
    places = {(p["shard"], p["position"]) for p in pieces}
    for s in range(5):  # positions are without gaps
        assert sorted(q for t, q in places if t == s) == list(range(sum(t == s for t, _ in places)))
    assert sorted(map(str, pieces)) == sorted(str(r.asDict()) for r in mixing.mix_pieces(df, shards=5).collect()) != sorted(map(str, other))
    sums = lambda ps: sum(p["hi"] - p["lo"] for p in ps)
    assert abs(sums(pieces) - sums(other)) < 20
    repeated = df.unionAll(df)
    assert mixing.mix_counts(repeated).count() == 240


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = language_id.fit(df, where=~held)
    got = language_id.predict(df.where(held), model, carry=("lang",))
    assert got.where("lang = lang_pred").count() / got.count() > 0.99
    odd = by_id(language_id.predict(docs(spark, [None, "", "123 !!", "the of and"]), model))
    assert [odd[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and 0 <= odd[3]["score"] <= 1
    assert language_id.predict(docs(spark), language_id.fit(df.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_packing(spark):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(docs(spark), length=64).collect()
    ids = [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], dtype="<u4") for x in ODD]
    for i, own in enumerate(ids):
        mine = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert [s for s, _ in mine] == np.cumsum([0] + [n for _, n in mine])[:-1].tolist() and sum(n for _, n in mine) == len(own)
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    seqs = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seqs.get(r["sequence_id"], 0)
        seqs[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(seqs.values()) <= 64


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), max_size=12))
def test_histogram_packing_places_every_piece(counts):
    found = {}
    for pattern, packs in packing.pack_histogram(counts, 50):
        assert sum(pattern) <= 50
        for n in pattern:
            found[n] = found.get(n, 0) + packs
    assert found == counts


def test_simhash(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    texts = ODD + [" ".join(rng.choices(words, k=300)) for _ in range(30)]
    texts += [t + " w1" for t in texts[-30:]] + [texts[-1]] * 20
    got = by_id(simhash.simhash_groups(docs(spark, texts)))

    def brute(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = np.array([brute(t) for t in texts], dtype=np.uint64)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{int(x):016x}" for x in f]
    assert [got[i]["component_id"] for i in range(len(texts))] == reach(np.bitwise_count(f[:, None] ^ f[None]) <= 3, range(len(texts)))


def jaccard(a, b, k=5):
    wa, wb = ((x or "").lower().split() for x in (a, b))
    sa, sb = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (wa, wb))
    return len(sa & sb) / len(sa | sb)


def test_similar_groups(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    texts = list(ODD)
    for _ in range(25):
        base = rng.choices(words, k=300)
        for changes in (0, 0, 1, 3, 12, 40):
            own = list(base)
            for at in rng.sample(range(300), changes):
                own[at] = rng.choice(words)
            texts.append(" ".join(own))
    got = by_id(similar_texts.similar_groups(docs(spark, texts)))
    alike = np.array([[jaccard(a, b) >= 0.8 for b in texts] for a in texts])
    want = reach(alike, range(len(texts)))
    own = [got[i]["component_id"] for i in range(len(texts))]
    assert np.mean([a == b for a, b in zip(own, want)]) > 0.97
    assert all(want[a] == want[i] for i, a in enumerate(own))  # nothing below the similarity is linked
    nulls = docs(spark, ["some words here"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted(similar_texts.similar_groups(nulls).collect(), key=str) == [(1, 1), (2, 1), (None, None)]
    assert similar_texts.similar_groups(nulls.limit(0)).count() == 0


def groups_by_jaccard(texts):
    return reach(np.array([[jaccard(a, b) >= 0.8 for b in texts] for a in texts]), range(len(texts)))


def test_similar_groups_at_the_similarity(spark):
    rng = random.Random(8)
    words, texts = [f"w{i}" for i in range(5000)], []
    for k in range(40):
        base = rng.choices(words, k=300)
        texts.append(" ".join(base))
        texts.append(" ".join(base[:242]))  # a cut tail
        texts.append(" ".join(base[:270] + rng.choices(words, k=30)) if k % 2 else " ".join(rng.choices(words, k=55) + base))  # a replaced tail, a new head
        own = list(base)
        for at in rng.sample(range(300), 6):
            own[at] = "x"
        texts.append(" ".join(own))
    got = by_id(similar_texts.similar_groups(docs(spark, texts)))
    assert [got[i]["component_id"] for i in range(len(texts))] == groups_by_jaccard(texts)


def test_similar_groups_with_repeated_passages(spark):
    rng = random.Random(9)
    words, texts = [f"w{i}" for i in range(5000)], []
    for k in (2, 3, 10, 30) * 5:
        p, q = rng.choices(words, k=200), rng.choices(words, k=200)
        texts += [" ".join(p * k + q), " ".join(p + q)]
    got = by_id(similar_texts.similar_groups(docs(spark, texts)))
    assert [got[i]["component_id"] for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))] == groups_by_jaccard(texts)


def test_rows_without_ids(spark):
    df = spark.createDataFrame([(i % 50 if i else None, f"x{i}") for i in range(200)], "id long, maybe string")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "gone long")
    got = sorted((r["id"] is None, r["id"], r["maybe"]) for r in common.without(df, "id", gone).collect() if r["id"] is not None)
    assert got == sorted((False, i % 50, f"x{i}") for i in range(1, 200) if i % 50 % 3) and common.without(df, "id", gone).where("id IS NULL").count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24)).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("inf")] * 24)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 21)) and np.allclose([v for _, _, v in own], s[[i for _, i, _ in own]])
        hits += len({i for _, i, _ in own} & set(best.tolist()))
    assert hits / (75 * 20) >= 0.9 and {r["query_id"] for r in got} <= set(range(0, 1500, 20))
    few = vector_search.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4


def test_nearest_among_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[rng.choice(3000, 1500, replace=False)] = x[0]
    x[rng.choice(3000, 60, replace=False)] = x[1] = x[0] * np.float32(0.999)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = vector_search.nearest(df, F.col("vec_id") % 20 == 0).collect()
    copies = [q for q in range(0, 3000, 20) if (x[q] == x[0]).all()]
    assert len(copies) > 50
    want = np.flatnonzero((x == x[0]).all(1)).tolist()
    for q in copies:
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for i in want if i != q][:20]


def test_mixing(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (mixing.mix_counts(df).collect() for _ in range(2))
    assert sorted(a) == sorted(b)
    by = {}
    for r, s in zip(sorted(a, key=lambda r: r["doc_id"]), df.orderBy("doc_id").collect()):
        assert r["taken"] <= 3 * r["size"]
        x = by.setdefault(s["source"], [0, 0, r["target"]])
        x[0], x[1] = x[0] + r["size"], x[1] + r["taken"]
    assert all(abs(t / w - 1) < 0.01 for _, t, w in by.values())
    assert mixing.targets([10, 1000, 10]) == pytest.approx([30.0, 960.0, 30.0])
    texts = {r["doc_id"]: r["text"] for r in mixing.mix_documents(df).collect()}
    assert all(len(texts.get(r["doc_id"], "").split()) == r["taken"] for r in a)
    assert sorted(mixing.permuted(np.arange(77), 77, 5).tolist()) == list(range(77))
    odd = by_id(mixing.mix_counts(docs(spark)))
    assert odd[1]["size"] == 0 and odd[1]["taken"] == 0 and mixing.mix_counts(docs(spark).limit(0)).count() == 0


def test_mixing_takes_the_last_block(spark):
    rows = [(i, " ".join(f"w{i}" for _ in range(n)), "a") for i, n in enumerate([1500, 2, 700, 1296, 3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_counts(df).collect()} == {0: 1500, 1: 2, 2: 700, 3: 1296, 4: 3}
    for n, aim in ((3501, 3501 * 3), (3501, 2000), (3501, 5000.4), (999, 1998), (1, 3), (257, 256)):
        for block in (1, 3, 256):
            blocks, slots = -(-n // block), mixing._quota(aim, n, block, 5)
            times = np.bincount(mixing.permuted(np.arange(slots) % blocks, blocks, 5), minlength=blocks)
            assert abs(int((times * np.minimum(block, n - np.arange(blocks) * block)).sum()) - aim) <= block / 2 + 1
    assert (mixing.permuted(mixing.permuted(np.arange(77), 77, 5), 77, 5, back=True) == np.arange(77)).all()


def test_pipeline(spark):
    docs_in, names = spark.read.parquet(f"{DATA}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_in, DATA)
        assert out.columns == docs_in.columns, name
        if name == "simhash_near_dedup":
            groups = similar_texts.similar_groups(docs_in)
            assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in groups.where("doc_id = component_id").select("doc_id").collect()}
        spark_rows = out.collect()
        docs_in = spark.createDataFrame(spark_rows, docs_in.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_in, DATA)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in spark_rows}


def test_pipeline_keeps_one_of_each_group_by_jaccard(spark):
    rng = random.Random(10)
    words, texts = [f"w{i}" for i in range(3000)], list(ODD)
    for k in range(30):
        base = rng.choices(words, k=300)
        texts += [" ".join(base), " ".join(base[: 240 + k % 5]), " ".join(base[:266] + rng.choices(words, k=34)), " ".join(base[:100] * 4 + base)]
    sims = [jaccard(texts[i], texts[j]) for i in range(len(texts)) for j in range(i)]
    assert sum(0.8 <= s < 0.85 for s in sims) > 30
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(spark, texts), DATA).collect()}
    assert kept == {i for i, c in enumerate(groups_by_jaccard(texts)) if i == c}
