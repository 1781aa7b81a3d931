"""Personal data: candidate generators and gradient-boosted trees.

Four formats (email, ip, card, phone) with their validity checks give the base spans, which
always stay. High-recall generators propose further, overlapping spans: runs of digits with any
usual separators, words around an at sign or its spellings, and strings that may be keys or
passwords. Boosted trees score them on format and context features, and a threshold calibrated
on held-out candidates selects those of kind "other" or "secret" that touch no base span.

No labels exist, so the trees learn from values set into texts of the corpus itself, at places
drawn by a hash of the text: values in spellings that the base formats don't cover (addresses
spelled out, local phone numbers, other separators) and keys, tokens and passwords as personal;
look-alikes (dates, prices, versions, file names, numbers with a wrong checksum) as not. The
corpus's own candidates count as not personal, but for those that a first fit on all takes for
personal: these are left out of the second, as they may well be.

Inputs with defined results: a null or empty text has no spans; a table without texts adds no
spans; repeated rows give repeated rows; an empty table gives an empty table; candidates are as long
as what they stand for, however long that is; of overlapping candidates the best is taken, the
first of equally good ones; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

#: The base formats, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "other", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Generators of further candidates: runs with many digits, words around an at sign or its spellings, strings of letters and digits, and what follows a word for secrets.
_MANY_DIGITS = re.compile(r"[+(]?[0-9](?:[\x20().\-/\n\[\]]{0,3}[0-9]){5,}")
_AROUND_AT = re.compile(r"(?<![\w.+%-])[\w.+%-]++[\x20]?(?:@|[(\[]at[)\]]|(?<=\x20)at(?=\x20))[\x20]?[\w-]+(?:(?:\.|\x20\.\x20|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[\w-]+)+", re.I)
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{12,}")
_AFTER_CUE = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|credentials?)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,})")
_AT_SIGNS = re.compile(r"@|[(\[]at[)\]]| at ", re.I)
#: Words that often stand before personal data.
_CUES = re.compile(r"(?i)(phone|tel|call|mobile|fax|mail|contact|card|visa|account|host|server|addr|login|user|ssn|born)")
_SECRET_CUES = re.compile(r"(?i)(password|passwd|pwd|secret|token|key|credential|auth|bearer)\W{0,6}$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, "@" and dotted domain, found from their "@"."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the valid base spans, by start and then kind."""
    found = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of spans that may be personal data or secrets, overlapping ones included."""
    found: dict[tuple[int, int], str] = {}
    if _DIGIT.search(text):
        found |= {m.span(): "other" for m in _MANY_DIGITS.finditer(text)}
        for m in _KEY.finditer(text):
            if _DIGIT.search(m[0]) and any(c.isalpha() for c in m[0]):
                found[m.span()] = "secret"
    if _AT_SIGNS.search(text):
        found |= {m.span(): "other" for m in _AROUND_AT.finditer(text)}
    found |= {m.span(1): "secret" for m in _AFTER_CUE.finditer(text)}
    return sorted((s, e, k) for (s, e), k in found.items())


def features(text: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    s = text[start:end]
    plain = re.sub(r"[^0-9]", "", s)
    digits, letters = len(plain), sum(c.isalpha() for c in s)
    upper, lower = sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    context = text[max(0, start - 40) : start]
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    return [
        len(s), digits, letters, digits / len(s), len(groups), max(groups), min(groups), groups[0], groups[-1],
        s.count("."), s.count("-"), s.count(" "), s.count("(") + s.count(")"), s.count("@"), s.count("/"),
        float(before.isalnum()), float(after.isalnum()), float(not before or before.isspace()), float(not after or after.isspace()),
        float(before in "\"'=:#" and before != ""), float(bool(_CUES.search(context))), sum("0" <= c <= "9" for c in context), len(set(s)),
        float(s[0] == "+"), float(12 <= digits <= 19 and _luhn(plain)), float(s.count(".") == 3 and max(groups) <= 3),
        upper, lower, float(upper > 0 and lower > 0), turns, turns / len(s), float(not re.search(r"[^0-9a-fA-F]", s)), float(bool(_SECRET_CUES.search(context))),
        s.count("_") + s.count("+") + s.count("="), s.count("\n"), float(bool(_AT_SIGNS.search(s))), float(bool(re.search(r"(?i)[ (\[]dot[ )\]]|\.[a-z]{2,6}$", s))), s.count("["), len(set(s)) / len(s),
        max((len(x) for x in re.split(r"[^A-Za-z]+", s)), default=0),
    ]


_LOWER, _HEX, _MIXED = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _with_checksum(digits: str) -> str:
    return next(digits[:-1] + d for d in "0123456789" if _luhn(digits[:-1] + d))


def planted(rng: random.Random) -> tuple[str, str, str, bool]:
    """(what stands before, value, what stands after, personal or not) for one value to set into a text."""
    word = lambda a, b: "".join(rng.choices(_LOWER, k=rng.randint(a, b)))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    quote = rng.choice(["", "", "\"", "'"])
    cue = rng.choice(["password", "secret", "token", "api_key", "access_key", "auth token", "Password", "TOKEN"]) + rng.choice(["=", " = ", ": ", ":"])
    card, sep = _with_checksum(num(16)), rng.choice([".", "/", "\n", " - "])
    ip = ".".join(str(rng.randint(1, 254)) for _ in range(4))
    user, host, top = word(2, 9) + rng.choice(["", ".", "_"]) + word(2, 8), word(3, 10), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
    call = rng.choice(["", "", "call ", "phone: ", "tel. ", "fax "])
    key = lambda letters, a, b: "".join(rng.choices(letters, k=rng.randint(a, b)))
    yes = [
        ("", f"{user}{rng.choice([' (at) ', ' [at] ', '(at)', '[at]', ' at '])}{host}{rng.choice([' (dot) ', ' [dot] ', ' dot '])}{top}", ""),
        ("", f"{user}{rng.choice([' (at) ', ' [at] ', ' @ ', '[at]'])}{host}.{top}", ""),
        (call, f"({num(3)}) {num(3)}-{num(4)}", ""), (call, f"{num(3)}-{num(3)}-{num(4)}", ""), (call, f"{num(3)}.{num(3)}.{num(4)}", ""), (call, f"0{num(2)}/{num(7)}", ""),
        ("", sep.join(card[i : i + 4] for i in range(0, 16, 4)), ""), ("", ip.replace(".", rng.choice(["[.]", " . ", "(.)"])), ""),
        (cue + quote, key(_HEX, 32, 64), quote), (cue + quote, key(_MIXED, 16, 48), quote), (cue + quote, key(_LOWER, 3, 8) + num(rng.randint(2, 6)), quote), (cue + quote, key(_HEX, 12, 24), quote),
        ("", key(_LOWER.upper(), 4, 4) + key(_LOWER.upper() + "0123456789", 16, 16), ""), (rng.choice(["key ", "key: ", ""]), key(_MIXED, 32, 48), ""), ("\"", key(_HEX, 40, 40), "\""),
    ]
    wrong = next(c for c in iter(lambda: num(16), None) if not _luhn(c))
    no = [
        ("", f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", ""), ("", f"{rng.randint(1, 28):02d}/{rng.randint(1, 12):02d}/{rng.randint(1900, 2099)}", ""),
        ("", f"{rng.randint(1900, 2099)}-01-01T{num(2)}:00:00Z", ""), ("$", f"{rng.randint(1, 99)} {num(3)} {num(3)}.{num(2)}", ""), ("", f"{rng.randint(0, 9)}.{num(rng.randint(6, 12))}", ""),
        ("", wrong, ""), ("", " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), ""), ("", num(rng.randint(6, 11)), ""), ("No. ", num(rng.randint(6, 9)), ""), ("", f"{rng.randint(256, 999)}.{num(2)}.{num(3)}.{num(1)}", ""),
        ("version ", f"{num(1)}.{num(1)}.{num(2)}-{num(6)}", ""), ("pages ", f"{num(3)}-{num(3)} {num(3)}", ""), ("", f"IMG_{num(8)}_{num(6)}", rng.choice([".jpg", ".png", ""])), ("", f"{word(4, 9)}-{word(4, 9)}-{word(3, 9)}-{num(rng.choice([1, 2, 4]))}", ""),
        ("", f"{word(4, 8).title()}{word(4, 8).title()}{num(1)}{word(3, 8).title()}", ""), ("", f"{word(4, 8)}_{word(4, 8)}_{num(2)}", rng.choice([".py", ".txt", "()"])), ("https://x.org/", f"{word(4, 8)}/{num(4)}/{word(4, 9)}-{word(4, 9)}", ""),
        ("", f"{word(3, 8)} at {word(3, 8)}.{word(4, 8).title()}", ""), ("", f"{num(2)} @ {num(2)}.{num(2)}", ""), (rng.choice(["token", "password", "secret"]) + ": ", word(7, 12), ""), (rng.choice(["key", "token"]) + " = ", rng.choice(["undefined", "settings.get", "required", "changes"]), ""),
    ]
    personal = rng.random() < 0.5
    return (*rng.choice(yes if personal else no), personal)


def example_rows(text: str, values: int) -> list[tuple[list[float], int]]:
    """(features, sort) of a text's own candidates (sort -1) and of `values` set into it (0 or 1 for look-alike or personal)."""
    covered = _Covered(base_spans(text))
    out = [(features(text, s, e), -1) for s, e, _ in candidates(text) if not covered.touches(s, e)]
    rng = random.Random(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest())
    for _ in range(values):
        before, value, after, personal = planted(rng)
        at = text.find(" ", rng.randrange(len(text) + 1))
        head, tail = (text[:at], text[at:]) if at >= 0 else (text, "")
        head, tail = head[-200:], tail[:200]
        near = f"{head} {before}{value}{after}{tail if tail.startswith(' ') else ' ' + tail}"
        s, e = len(head) + 1 + len(before), len(head) + 1 + len(before) + len(value)
        base = _Covered(base_spans(near))
        for cs, ce, _ in candidates(near):
            share = max(0, min(e, ce) - max(s, cs)) / (max(e, ce) - min(s, cs))
            if share >= 0.5 and not base.touches(cs, ce):
                out.append((features(near, cs, ce), int(personal and share >= 0.8)))
    return out


class _Covered:
    """Which stretches of a text spans cover; spans come by start."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts = [s for _, s, _ in spans]
        self.reach = list(accumulate((e for _, _, e in spans), max))

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


@dataclass(frozen=True)
class BoostedTrees:
    """Additive depth-2 regression trees on log-odds: (feature, cut, (feature, cut), (feature, cut), four leaves)."""

    start: float
    trees: tuple[tuple, ...]
    threshold: float
    precision: float = 0.0  # on held-out planted values, as calibrated
    recall: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, c, (fl, cl), (fr, cr), leaves in self.trees:
            right = x[:, f] > c
            deeper = np.where(right, x[:, fr] > cr, x[:, fl] > cl)
            out += np.asarray(leaves)[2 * right + deeper]
        return out


def _best_cut(bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    """The feature and cut with the largest gain in the second-order approximation of the loss; bins: for each feature and row how many cuts are below."""
    best, at = 0.0, (0, np.inf)
    gs, hs = g[rows], h[rows]
    g_all, h_all = gs.sum(), hs.sum()
    whole = g_all**2 / (h_all + 1.0)
    for f, values in enumerate(cuts):
        own = bins[f, rows]
        gl, hl = np.bincount(own, gs, len(values) + 1).cumsum()[:-1], np.bincount(own, hs, len(values) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) - whole
        if len(gain) and gain.max() > best:
            best, at = gain.max(), (f, float(values[gain.argmax()]))
    return at


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, rate: float) -> BoostedTrees:
    b = y.astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
    start = float(np.log(b.mean() / (1 - b.mean())))
    score, trees, everything = np.full(len(b), start), [], np.arange(len(b))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = b - p, p * (1 - p)
        f, c = _best_cut(bins, cuts, g, h, everything)
        sides = [everything[x[:, f] <= c], everything[x[:, f] > c]]
        lower = [_best_cut(bins, cuts, g, h, s) if len(s) else (0, np.inf) for s in sides]
        leaves = []
        for s, (lf, lc) in zip(sides, lower):
            for part in (s[x[s, lf] <= lc], s[x[s, lf] > lc]):
                leaves.append(float(rate * g[part].sum() / (h[part].sum() + 1.0)))
        trees.append((f, c, lower[0], lower[1], tuple(leaves)))
        score = BoostedTrees(start, tuple(trees[-1:]), 0.0).log_odds(x) - start + score
    return BoostedTrees(start, tuple(trees), 0.0)


def fit_trees(x: np.ndarray, sort: np.ndarray, rounds: int = 80, rate: float = 0.3, precision: float = 0.99) -> BoostedTrees | None:
    """Boosts trees on three quarters of the rows; on the rest, takes the lowest threshold that holds the precision.

    sort: 1 personal, 0 not, -1 a text's own candidate. Of these, those that a first fit ranks with the personal ones are left out.
    """
    held = np.arange(len(sort)) % 4 == 3
    if min((sort[~held] == 1).sum(), (sort[~held] == 0).sum(), (sort[held] == 1).sum()) < 5:
        return None
    first = _boost(x[~held], sort[~held] == 1, rounds // 2, rate).log_odds(x)
    keep = (sort >= 0) | (first < np.quantile(first[held & (sort == 1)], 0.1))
    model = _boost(x[~held & keep], sort[~held & keep] == 1, rounds, rate)
    score, truth = model.log_odds(x[held & keep]), sort[held & keep] == 1
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(truth[order])
    good = np.flatnonzero(right / np.arange(1, len(order) + 1) >= precision)
    if not len(good):
        return None
    at = good[-1]
    return BoostedTrees(model.start, model.trees, float(score[order][at]), float(right[at] / (at + 1)), float(right[at] / truth.sum()))


def fit(df: DataFrame, text_col: str = "text", max_docs: int = 5_000, max_candidates: int = 40_000) -> BoostedTrees | None:
    """Fits on candidates of at most about `max_docs` texts, drawn by a hash of the text; `max_candidates` bounds what reaches the driver."""
    rows = df.where(F.length(text_col) > 0)
    n = rows.count()
    rate, values = min(1.0, max_docs / max(1, n)), max(2, min(20, 10_000 // max(1, n)))
    if rate < 1:
        rows = rows.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(rate * (1 << 30)))

    def examples(batch: pa.RecordBatch) -> dict:
        found = [(x, sort, i) for t in text_or_empty(batch.column(0)) for i, (x, sort) in enumerate(example_rows(t, values))]
        at = [int.from_bytes(hashlib.blake2b(repr((x, i)).encode(), digest_size=7).digest(), "big") for x, _, i in found]
        return {"x": [x for x, _, _ in found], "sort": [s for _, s, _ in found], "at": at}

    found = arrow_map(rows.select(text_col), examples, "x array<double>, sort int, at long").orderBy("at", "x", "sort").limit(max_candidates).toArrow()
    if not found.num_rows:
        return None
    return fit_trees(np.array(found["x"].to_pylist()), found["sort"].to_numpy())


def find_spans(df: DataFrame, model: BoostedTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts by base kind, n_other and n_secret, base_sha256, and spans (kind:start:end, comma-joined)."""

    def spans(batch: pa.RecordBatch) -> dict:
        all_base, all_spans = [], []
        for text in text_or_empty(batch.column(1)):
            base = base_spans(text)
            more: list[tuple[str, int, int]] = []
            covered = _Covered(base)
            tried = [c for c in candidates(text) if not covered.touches(*c[:2])] if model else []
            if tried:
                score = model.log_odds(np.array([features(text, s, e) for s, e, _ in tried]))
                taken: list[tuple[int, int]] = []
                for i in np.argsort(-score, kind="stable"):
                    s, e, kind = tried[i]
                    k = bisect_left(taken, (s, e))
                    free = (k == 0 or taken[k - 1][1] <= s) and (k == len(taken) or taken[k][0] >= e)
                    if score[i] >= model.threshold and free:
                        taken.insert(k, (s, e))
                        more.append((kind, s, e))
            all_base.append(base)
            all_spans.append(sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))))
        written = lambda found: ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        out = {f"n_{k}": [sum(x[0] == k for x in found) for found in all_spans] for k in KINDS}
        return out | {id_col: batch.column(0), "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in all_base], "spans": [written(s) for s in all_spans]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), spans, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_other long, n_secret long")


def redact(text: str, spans: str) -> str:
    """The text with each span, as find_spans writes them, replaced by its kind in brackets."""
    out, at = [], 0
    for item in filter(None, spans.split(",")):
        kind, s, e = item.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], f"[{kind}]"]
        at = max(at, int(e))
    return "".join(out) + text[at:]
