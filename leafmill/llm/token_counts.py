"""Token counts by prefix dynamic programming.

A byte-level BPE splits a text into pieces that are encoded apart. Inside a piece the count
of every prefix follows from shorter ones: the encoding of a prefix ends with the one
vocabulary token that may follow the last token of what stands before it, where two tokens
may follow each other if they are the encoding of their own concatenation. So one pass over
a piece stores the exact count of all its prefixes, and running sums over pieces store that
of all prefixes of the text. Truncation and budget questions are then look-ups.

Pieces repeat, so a worker keeps their prefix counts in a bounded table.

Inputs with defined results: a null text counts as empty (0 tokens, 0 bytes), an empty text
has 0 tokens, repeated rows give repeated rows, an empty table gives an empty table, other
columns of the input are ignored whatever their names.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, text_or_empty

#: How the byte-level BPE splits a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and pieces or token pairs, that a worker keeps at most.
KEEP_WORDS, KEEP = 1_000_000, 500_000
#: Longer ones are counted each time.
LONG = 200


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where printable, else from 256 on."""
    plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Exact token counts of all prefixes, for one tokenizer file."""

    def __init__(self, name: str):
        import regex
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        back = {c: bytes([b]) for b, c in enumerate(letters)}
        raw = lambda token: b"".join(back[c] for c in token)
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if all(c in back for c in t)}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for (a, b), i in self.ranks.items()}
        self.byte = (-1, b"", b"")
        self.longest = max(map(len, self.vocab))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.find = regex.compile(PIECES)
        self.white = regex.compile(r"\s")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.total = _Totals(self)
        self.words: dict[str, int | None] = {}
        # how the library itself classes characters: one stand-in per class
        self.classes = {self._class_of(c): c for c in "b2#\t"}
        self.known: dict[str, str] = {}

    def _class_of(self, c: str) -> str:
        return str([at for _, at in self.split(f"a{c}a 1{c}1 !{c}!  {c} {c}")])

    def _like_library(self, text: str) -> str:
        """The text with stand-ins for characters that the two regular-expression engines class differently."""
        for c in set(text) - self.known.keys():
            own = str([m.span() for m in self.find.finditer(f"a{c}a 1{c}1 !{c}!  {c} {c}")])
            there = self._class_of(c)
            self.known[c] = c if own == there else self.classes.get(there, c)
        changed = {ord(c): self.known[c] for c in set(text) if self.known[c] != c}
        return text.translate(changed) if changed else text

    def _may_follow(self, a: bytes, b: bytes) -> bool:
        """Whether the pair is the encoding of its concatenation.

        Takes the merges that made the two tokens back, last first, and looks for a merge
        across their border that the encoder would have made earlier.
        """
        ranks, made = self.ranks, self.made
        before = len(ranks)
        while True:
            if ranks.get((a, b), before) < before:
                return False
            (rank_a, _, right), (rank_b, left, _) = made.get(a, self.byte), made.get(b, self.byte)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                before, a = rank_a, right
            else:  # of equal merges the left one comes first
                before, b = rank_b + 1, left

    def pieces(self, words: list[bytes]):
        """Yields the token counts of word[:0], word[:1], ... for each word, by dynamic programming over prefixes.

        Sorted words share the table up to where they differ from the word before.
        """
        counts, last, previous = [0], [b""], b""
        vocab, follows, longest = self.vocab, self.follows, self.longest
        for word in words:
            same = min(len(previous), len(word))
            while not word.startswith(previous[:same]):
                same -= 1
            del counts[same + 1 :], last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    if token not in vocab:
                        continue
                    before = last[start]
                    if before:
                        ok = follows.get((before, token))
                        if ok is None:
                            if len(follows) > KEEP:
                                follows.clear()
                            ok = follows[before, token] = self._may_follow(before, token)
                        if not ok:
                            continue
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
            previous = word
            yield counts

    def learn(self, texts: list[str]) -> None:
        """Fills the table of words, with those of the texts that it lacks."""
        seen: set[str] = set()
        for text in texts:
            for start, end, special in self.segments(text):
                if not special:
                    seen.update(self._units(text[start:end]))
        if len(self.words) + len(seen) > KEEP_WORDS:
            self.words.clear()
        missing = sorted(w for w in seen - self.words.keys() if len(w) <= LONG)
        for i in range(0, len(missing), 20_000):
            self._learn_words(missing[i : i + 20_000])

    def _learn_words(self, missing: list[str]) -> None:
        joined = "".join(missing)
        like = self._like_library(joined) == joined
        split = {}
        for word in missing:
            name = word[1:] if word[:1] == "\n" else word
            if not like or not name or self.white.search(name):
                self.words[word] = None
            else:
                split[word] = self.find.findall(" " + word if name is word else word)
        lacking = {p for found in split.values() for p in found} - self.total.keys()
        if len(self.total) + len(lacking) > KEEP:
            self.total.clear()
            lacking = {p for found in split.values() for p in found}
        by_bytes = sorted((p.encode("utf-8", "surrogatepass"), p) for p in lacking)
        for (_, p), counts in zip(by_bytes, self.pieces([b for b, _ in by_bytes])):
            self.total[p] = counts[-1]
        for word, found in split.items():
            self.words[word] = sum(map(self.total.__getitem__, found))

    @staticmethod
    def _units(part: str) -> list[str]:
        """Words between single spaces and line ends, which are certain ends of pieces; a line's first with the line end."""
        return f"\n{part}".replace("\n", " \n").split(" ")[1:]

    def segments(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, special) of the stretches between special strings, and of these."""
        out, at = [], 0
        for m in self.special_at.finditer(text) if self.special_at and self.special[0][:2] in text else ():
            out += [(at, m.start(), False)] * (m.start() > at) + [(m.start(), m.end(), True)]
            at = m.end()
        return out + [(at, len(text), False)] * (at < len(text))

    def boundaries(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """For each piece its end in the text, its token count, and the running count after it."""
        ends, own = [], []
        for start, end, special in self.segments(text):
            if special:
                ends.append(end)
                own.append(1)
                continue
            part = text[start:end]
            shape = part if part.isascii() else self._like_library(part)
            pieces = self.find.findall(shape)
            stops = list(accumulate(map(len, pieces), initial=start))
            if shape is not part and shape != part:
                pieces = [text[a:b] for a, b in zip(stops, stops[1:])]
            ends += stops[1:]
            own += map(self.total.__getitem__, pieces)
        return ends, own, list(accumulate(own))

    def count(self, text: str) -> int:
        """Exact token count of the whole text; `learn` has to have seen it for speed, not for the result."""
        n = 0
        for start, end, special in self.segments(text):
            if special:
                n += 1
                continue
            part = text[start:end]
            try:
                n += sum(map(self.words.__getitem__, self._units(part))) - 1
            except (KeyError, TypeError):  # not learned, or other white space
                n += self.boundaries(part)[2][-1]
        return n

    def _inside(self, text: str, start: int, end: int) -> list[int]:
        """Token counts that the prefixes ending in (start, end] of one piece add to what stands before the piece."""
        piece = text[start:end]
        by_byte = next(self.pieces([piece.encode("utf-8", "surrogatepass")]))
        at = list(accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece))
        counts = [by_byte[i] for i in at]
        if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
            counts[1] = 2  # cut after its first letter it is no contraction, but an apostrophe and a letter
        return counts

    def every_prefix(self, text: str) -> list[int]:
        """Exact token counts of text[:0], text[:1], ..., text."""
        out, opened = [0], 0
        for start, end, special in self.segments(text):
            if special:
                # cut short, the special string is ordinary text in one stretch with what stands before it
                out += [out[opened] + self.count(text[opened:i]) for i in range(start + 1, end)] + [out[start] + 1]
                opened = end
                continue
            shape = self._like_library(text[start:end])
            at, total, run = start, out[start], None
            for stop, n in zip(*self.boundaries(text[start:end])[:2]):
                stop += start
                for i, inside in enumerate(self._inside(text, at, stop), at):
                    if not self.white.match(shape[i - start]):
                        run = None
                        out.append(total + inside)
                        continue
                    run = i if run is None else run
                    # white space that ends a prefix is one piece
                    out.append(out[run] + self.total[text[run : i + 1]])
                at, total = stop, total + n
        return out

    def longest_within(self, text: str, budget: int) -> int:
        """Code points in the longest prefix of at most `budget` tokens."""
        reach = 4 * budget + 16
        try:
            return self._within_words(text[:reach], budget, reach >= len(text))
        except (KeyError, TypeError, IndexError):  # not learned, other white space, special strings, or not within reach
            pass
        while True:
            head = text[:reach]
            ends, _, running = self.boundaries(head)
            if reach >= len(text) or len(running) > 4 and running[-4] > budget and not self.white.match(head[ends[-4] - 1 :][:1]):
                break
            reach *= 4
        k = bisect_right(running, budget)
        if k == len(ends):
            return len(text)
        # count on from an end that no later text can move: after a special string or a non-space
        at = ends[k - 1] if k else 0
        back = max((b for _, b, special in self.segments(head) if special and b <= at), default=0)
        back = next((e for e in reversed(ends[:k]) if e > back and not self.white.match(head[e - 1])), back)
        counts = self.every_prefix(head[back : ends[k]])
        base = dict(zip(ends, running)).get(back, 0)
        return back + max(i for i, c in enumerate(counts) if base + c <= budget)


    def _within_words(self, head: str, budget: int, whole: bool) -> int:
        """longest_within by the table of words; IndexError if the budget isn't reached before the last word."""
        if self.special and self.special[0][:2] in head:
            raise IndexError
        units = self._units(head)
        running = list(accumulate(map(self.words.__getitem__, units if whole else units[:-1]), initial=-1))
        k = bisect_right(running, budget) - 1
        if k + 1 == len(running) and whole:
            return len(head)
        texts = [u if u[:1] == "\n" else " " + u for u in units[: k + 1]]
        at = sum(map(len, texts[:k])) - 1
        if k == 0:
            texts[0], at, running[0] = texts[0][1:], 0, 0
        return at + max(i for i, c in enumerate(self.every_prefix(texts[k])) if running[k] + c <= budget)


class _Totals(dict):
    """Token counts of pieces, computed on first use."""

    def __init__(self, owner: PrefixCounter):
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        if len(self) > KEEP:
            self.clear()
        n = next(self.owner.pieces([piece.encode("utf-8", "surrogatepass")]))[-1]
        if len(piece) <= LONG:
            self[piece] = n
        return n


_counters: dict[str, PrefixCounter] = {}


def counter(name: str) -> PrefixCounter:
    """The worker's counter for a tokenizer file, read once."""
    if name not in _counters:
        _counters[name] = PrefixCounter(name)
    return _counters[name]


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, and cut_chars, the code points within the limit."""

    def count(batch: pa.RecordBatch) -> dict:
        c = counter(tokenizer)
        texts = text_or_empty(batch.column(1))
        c.learn(texts)
        n = [c.count(t) for t in texts]
        return {
            id_col: batch.column(0),
            "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
            "n_tokens": n,
            "over_limit": [x > limit for x in n],
            "cut_chars": [c.longest_within(t, limit) if x > limit else len(t) for t, x in zip(texts, n)],
        }

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")


def prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per input row: id and `counts`, the exact token count at every prefix of the text by code points."""

    def table(batch: pa.RecordBatch) -> dict:
        c = counter(tokenizer)
        return {id_col: batch.column(0), "counts": [c.every_prefix(t) for t in text_or_empty(batch.column(1))]}

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text_col), table, f"`{id_col}` {kind}, counts array<int>")
