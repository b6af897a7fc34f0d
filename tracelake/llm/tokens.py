"""Exact token counts at every prefix by dynamic programming (operator 7), and token ids per document.

The vocabulary file is a BPE with an end-of-word suffix over text that is NFC-normalised,
lower-cased and stripped of white space. No token spans white space, so a text is the
sequence of its white-space-free chunks, each of which is cut into words by ``WORDS``.

**The recurrence.** A token sequence is the BPE encoding of its text exactly if every two
neighbours encode to themselves when put together. So each prefix of a word has one last token
``t`` that is compatible with the last token of the prefix before ``t``; walking the prefixes
from left to right fixes ``last[i]`` and ``count[i] = count[i - len(t)] + 1`` for each of them.
The end-of-word form of a symbol is a separate symbol, so "the prefix taken as a whole text"
is one more step from the same table. Counts of later prefixes reuse those of earlier ones;
nothing is encoded twice.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the vocabulary file: its pattern for words and its special strings.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPECIALS = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
#: Characters that str.split() takes for white space and the library doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
CHUNKS = re.compile("[^\t-\r \x85\xa0  -     　]+")
END, STOP = "</w>", "\0"


def normal(text: str) -> str:
    """NFC, then lower case by character (the final sigma is no exception)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def chunks(text: str) -> list[str]:
    return CHUNKS.findall(text) if any(c in text for c in ODD_SPACES) else text.split()


class PrefixCounter:
    """Token counts of every prefix of a text under one vocabulary file."""

    def __init__(self, path: str, remember: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.pairs = [tuple(p) for p in pairs]
        self.ranks = {p: i for i, p in enumerate(self.pairs)}
        self.made = {a + b: i for i, (a, b) in enumerate(self.pairs)}
        if len(self.made) < len(self.pairs):
            raise ValueError("two merges make one token")
        self.own = _Memo(lambda t: self._merge(self._parts(t)) == [t], len(self.vocab))
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.symbols = self._symbols()
        #: Finds the tokens that end at each place of a word and its STOP, which stands for the end of a word.
        self.ending = ahocorasick.Automaton()
        for token in self.vocab:
            form = token.removesuffix(END) + STOP if token.endswith(END) else token
            self.ending.add_word(form, (token, len(form)))
        self.ending.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.remember = remember
        self.words = _Memo(self._count_word, 2 * remember)
        self.counts = _Memo(self._count_chunk, remember)

    @staticmethod
    def _symbols() -> list[str]:
        """The printable stand-in of each byte in byte-level vocabularies."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        return [rest.get(b) or chr(b) for b in range(256)]

    def _merge(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked pair first, from the left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _parts(self, token: str) -> list[str]:
        body = token.removesuffix(END)
        return [*body[:-1], token[len(body) - 1 :]]

    def _fit(self, a: str, b: str) -> bool:
        """Whether a and b stay as they are when encoded together."""
        if (known := self.fits.get((a, b))) is None:
            if len(self.fits) >= self.remember:
                self.fits.clear()
            known = self.fits[a, b] = self.own[a] and self.own[b] and self._apart(a, b)
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border between two tokens that are made as ever.

        The pieces at the border are taken apart again, the one that was made last first. While
        two pieces were neighbours, until a merge of rank ``limit`` took one of them, theirs would
        have gone first had it a lower rank; of equal ranks the left one goes first.
        """
        limit = len(self.pairs)
        while self.ranks.get((a, b), limit) >= limit:
            of_a, of_b = self.made.get(a, -1), self.made.get(b, -1)
            if of_a < 0 and of_b < 0:
                return True
            if of_a > of_b:
                limit, a = of_a, self.pairs[of_a][1]
            else:
                limit, b = of_b + 1, self.pairs[of_b][0]
        return False

    def _step(self, s: str, i: int, last: list[str], end: str) -> tuple[int, str]:
        """The last token of the prefix s[:i] (``end``: as a whole word) and where it starts."""
        for start in range(max(0, i - self.longest), i):
            token = s[start:i] + end
            if token in self.vocab and (not start or self._fit(last[start], token)):
                return start, token
        raise ValueError(f"no token ends {s[:i]!r}")

    def word_table(self, s: str) -> tuple[list[str], list[int]]:
        """last and count for every prefix of a word's symbols that goes on."""
        last, count = [""], [0]
        for i in range(1, len(s)):
            start, token = self._step(s, i, last, "")
            last.append(token)
            count.append(count[start] + 1)
        return last, count

    def _spell(self, word: str) -> str:
        return "".join(map(self.symbols.__getitem__, word.encode()))

    def _count_word(self, word: str) -> int:
        """The recurrence along the word: of the tokens that end at each place the one that fits."""
        s = self._spell(word) + STOP
        last, count = [""] + [None] * len(s), [0] * (len(s) + 1)
        for end, (token, size) in self.ending.iter(s):
            i, start = end + 1, end + 1 - size
            if last[i] is None and last[start] is not None and (not start or self._fit(last[start], token)):
                last[i], count[i] = token, count[start] + 1
        if last[-1] is None:
            raise ValueError(f"no token ends {word!r}")
        return count[-1]

    def _count_chunk(self, chunk: str) -> int:
        return sum(map(self.words.__getitem__, WORDS.findall(chunk)))

    def count(self, text: str) -> int:
        """Tokens of a whole text, the special strings inside it included."""
        if "<|" in text and (found := SPECIALS.findall(text)):
            return len(found) + sum(map(self.count, SPECIALS.split(text)))
        return sum(map(self.counts.__getitem__, chunks(normal(text))))

    def _chunk_prefixes(self, chunk: str) -> list[int]:
        """The tokens of chunk[:1], chunk[:2], ..., each as a text of its own.

        Cutting a chunk changes no word but the last, and of that one's table each prefix has its
        entry. Only a chunk that isn't NFC, or in which special strings may start, is cut anew for each.
        """
        if "<|" in chunk or chunk.endswith("<") or not (chunk.isascii() or unicodedata.is_normalized("NFC", chunk)):
            return [self.count(chunk[:i]) for i in range(1, len(chunk) + 1)]
        low = [normal(c) for c in chunk]
        ends = list(accumulate(map(len, low)))  # of each character, in the lower-cased chunk
        out, before = [], 0
        for m in WORDS.finditer("".join(low)):
            word, upto = m[0], m.end()
            while len(out) < len(ends) and ends[len(out)] <= m.start():
                out.append(before)
            split = len(word) > 1 and word[0] == "'" and word[1].isalpha()  # of such a word a prefix is two words
            s = self._spell(word)
            last, count = self.word_table(s)
            while len(out) < len(ends) and ends[len(out)] <= upto:
                part = word[: ends[len(out)] - m.start()]
                if split:
                    out.append(before + self._count_chunk(part))
                else:
                    out.append(before + count[self._step(s, len(part.encode()), last, END)[0]] + 1)
            before += self.words[word]
        return out + [before] * (len(ends) - len(out))

    def prefix_counts(self, text: str) -> list[int]:
        """Entry p: the tokens of text[:p] taken as a text of its own, for p = 0 .. len(text).

        Each word's table is built once and serves all its prefixes.
        """
        out, base, done = [0], 0, 0
        for m in CHUNKS.finditer(text):
            out += [base] * (m.start() - done)
            out += [base + n for n in self._chunk_prefixes(m[0])]
            base, done = out[-1], m.end()
        return out + [base] * (len(text) - done)

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens (a shorter prefix can hold more tokens)."""
        counts = self.prefix_counts(text)
        return text[: max(p for p, n in enumerate(counts) if n <= budget)]


class _Memo(dict):
    """Results by key; emptied when full, which costs little as frequent keys return at once."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per Python worker; the worker's later tasks find its tables filled."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``: map-only, no shuffle.

    Null and empty texts have 0 bytes and tokens; texts of any length are counted whole; a null key is
    kept; repeated rows are counted each; other columns are ignored. No rows: no rows. ``tokenizer``: path of the vocabulary file on the workers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = counter(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            n = np.fromiter((tables.count(t.as_py() or "") for t in texts), np.int64, len(texts))
            size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key].alias("doc_id"), docs[text].alias("text")).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


class Merger:
    """BPE of many words at once, by the merge table of the vocabulary file.

    Words of one length are the rows of a matrix of symbols. Each step merges, in every row that
    still has a pair of the table, its pair of the lowest rank (the first of equal ones), which is
    what the library does word by word. ``rank`` holds the rank of the pair that starts at a
    position; ``after`` and ``before`` link the positions still in use. Each row ends with a
    position of its own that pairs with nothing; it also stands before the next row.
    """

    NONE, EDGE, GONE, SLOTS = 1 << 30, 65_535, 65_534, 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        vocab, pairs = spec["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        if max(vocab.values()) >= self.GONE or len(pairs) > 1 << (self.SLOTS - 1):
            raise ValueError("the vocabulary is too large for 16-bit symbols")
        symbols = PrefixCounter._symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int32)
        self.final = np.array([vocab[c + END] for c in symbols], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys = np.full((1 << self.SLOTS) + 64, -1, np.int64)
        self.ranks = np.full((1 << self.SLOTS) + 64, self.NONE, np.int32)
        for rank, (a, b) in enumerate(pairs):
            key = (vocab[a] << 16) | vocab[b]
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] not in (-1, key):
                at += 1
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - self.SLOTS)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, from a hash table with linear probing."""
        key = (a.astype(np.int64) << 16) | b
        slot = self._slot(key)
        there = self.keys[slot]
        found = self.ranks[slot]  # NONE in an empty slot
        left = np.flatnonzero((there != key) & (there != -1))
        while len(left):
            slot[left] += 1
            there = self.keys[slot[left]]
            found[left] = self.ranks[slot[left]]
            left = left[(there != key[left]) & (there != -1)]
        return found

    def _rows(self, raw: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Ids of words of one length, given as rows of bytes: end to end, and the number of each word's."""
        n, length = raw.shape
        wide = length + 1
        symbol = np.full((n, wide), self.EDGE, np.int32)
        symbol[:, : length - 1] = self.inner[raw[:, :-1]]
        symbol[:, length - 1] = self.final[raw[:, -1]]
        rank = np.full((n, wide), self.NONE, np.int32)
        rank[:, :-1] = self._rank(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, length)
        table, symbol, flat = rank, symbol.ravel(), rank.ravel()
        after, before = np.arange(1, n * wide + 1), np.arange(-1, n * wide - 1)
        rows = np.arange(n)
        while True:
            some = table[rows]
            at = some.argmin(1)
            low = some[np.arange(len(rows)), at]
            on = low < self.NONE
            rows, i, new = rows[on], (rows * wide + at)[on], self.merged[low[on]]
            if not len(rows):
                break
            j = after[i]
            k, h = after[j], before[i]
            symbol[i], symbol[j], flat[j] = new, self.GONE, self.NONE
            after[i], before[k] = k, i
            flat[i] = self._rank(new, symbol[k])
            flat[h] = self._rank(symbol[h], new)
        kept = symbol < self.GONE
        return symbol[kept].astype("<u4").tobytes(), kept.reshape(n, wide).sum(1)

    def encoded(self, words: list[str], most: int = 1 << 19) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each word; no word is empty or holds white space. ``most``: symbols in a matrix."""
        out: dict[str, bytes] = {}
        if not words:
            return out
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        sizes = ends - starts
        for length in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == length)
            for which in np.array_split(same, -(-len(same) * length // most)):
                ids, counts = self._rows(raw[starts[which][:, None] + np.arange(length)])
                to = (np.cumsum(counts) * 4).tolist()
                out.update(zip(map(words.__getitem__, which.tolist()), map(ids.__getitem__, map(slice, [0, *to], to)), strict=True))
        return out


class Ids:
    """Token ids of texts, looked up by white-space-free chunk.

    New chunks of plain small letters, which normalisation leaves alone and which are one word
    each, go to ``Merger``; a tail of ASCII punctuation after them is one more word. All others
    go to the tokenizers library.
    """

    PLAIN = re.compile("[a-zß-öø-ÿ]{1,48}")
    TAILED = re.compile(r"([a-zß-öø-ÿ]{1,48})([!-/:-@\[-`{-~]{1,16})")

    def __init__(self, path: str, remember: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.merger = Tokenizer.from_file(path), Merger(path)
        self.known, self.older, self.remember = {}, {}, remember

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _lowered(text: str) -> str:
        """Lower case, for fewer different chunks, unless that would change what the library makes of it."""
        if "<|" in text:
            return text
        low = normal(text)
        return low if low.isascii() or unicodedata.is_normalized("NFC", low) else text

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """Little-endian unsigned 32-bit ids per text; chunks that are new are encoded together."""
        cut = [chunks(self._lowered(t)) for t in texts]
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        plain, others, tailed = set(), set(), {}
        for chunk in set().union(*cut).difference(known):
            if chunk in older:
                known[chunk] = older[chunk]
            elif self.PLAIN.fullmatch(chunk):
                plain.add(chunk)
            elif found := self.TAILED.fullmatch(chunk):
                tailed[chunk] = body, tail = found.groups()
                for part, new in ((body, plain), (tail, others)):
                    if part in older:
                        known[part] = older[part]
                    elif part not in known:
                        new.add(part)
            else:
                others.add(chunk)
        known.update(self.merger.encoded(list(plain)))
        rest = list(others)
        known.update(zip(rest, self._encoded(rest), strict=True))
        known.update({c: known[body] + known[tail] for c, (body, tail) in tailed.items()})
        return [np.frombuffer(b"".join(map(known.__getitem__, row)), "<u4") for row in cut]


_ids: dict[str, Ids] = {}


def ids(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]
