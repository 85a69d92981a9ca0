"""Pre-tokens of many texts at once, as arrays of code points, and byte-pair merging.

Character classes of a whole batch are looked up together and token borders follow
from class changes, so no pattern engine walks the text. Each pre-token is named by a
64-bit hash of its code points; each distinct one is encoded once.
"""

from __future__ import annotations

import base64
import json
import unicodedata

import numpy as np
import pandas as pd

from tidyward.llm.common import mix, ragged, span_hashes

SPACE, LETTER, NUMBER, OTHER = range(4)
_CACHE: dict = {}


def class_table() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    if "classes" not in _CACHE:
        import regex
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            table[[ord(c) for c in regex.findall(pattern, every)]] = kind
        _CACHE["classes"] = table
    return _CACHE["classes"]


class Tokens:
    """Borders of the pre-tokens of ``texts``, which are looked at one by one.

    ``spaced``: white space belongs to tokens, a space to the one that follows, numbers
    run on (byte-level pattern); else white space is left out and digits stand alone.
    """

    def __init__(self, texts: list[str], spaced: bool = True):
        self.text = "".join(texts)
        self.codes = codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.firsts = np.cumsum(sizes) - sizes
        n = len(codes)
        kinds = class_table()[codes]
        first = np.zeros(n + 1, bool)
        first[self.firsts] = True
        first[n] = True
        mark = first[:n].copy()
        mark[1:] |= kinds[1:] != kinds[:-1]
        runs = np.flatnonzero(mark)
        ends = np.append(runs[1:], n)
        of = kinds[runs]
        if spaced:
            # the last white space before a word stands alone, or joins it if it is a space
            inner = (of == SPACE) & ~first[ends]
            last = ends[inner] - 1
            mark[last] = True
            mark[last[codes[last] == 32] + 1] = False
        else:
            mark |= kinds == NUMBER
        self._contractions(runs, ends, of, mark, first, spaced)
        self.starts = np.flatnonzero(mark)
        self.ends = np.append(self.starts[1:], n)
        if not spaced:
            words = kinds[self.starts] != SPACE
            self.starts, self.ends = self.starts[words], self.ends[words]
        self.of_text = np.searchsorted(self.firsts, self.starts, "right") - 1

    def _contractions(self, runs, ends, of, mark, first, spaced) -> None:
        """'s 't 'm 'd 're 've 'll where a match begins at the apostrophe."""
        codes = self.codes
        at = np.flatnonzero((of == OTHER) & (ends - runs == 1) & (codes[runs] == 39))
        at = at[at + 1 < len(runs)]
        at = at[(of[at + 1] == LETTER) & ~first[ends[at]]]
        place, stop = runs[at], ends[at + 1]
        if spaced:
            taken = ~first[place] & (place > 0) & (codes[np.maximum(place, 1) - 1] == 32)
            place, stop = place[~taken], stop[~taken]
        one = codes[place + 1]
        two = np.where(place + 2 < stop, codes[np.minimum(place + 2, len(codes) - 1)], 0)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
                | (one == ord("l")) & (two == ord("l")))
        length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long, 2, 0))
        place, stop, length = place[length > 0], stop[length > 0], length[length > 0]
        mark[place + 1] = False
        rest = place + 1 + length
        mark[rest[rest < stop]] = True

    def hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            values = mix(self.codes.astype(np.uint64) + np.uint64(1))
        return span_hashes(values, self.starts, self.ends)

    def word(self, i: int) -> str:
        return self.text[self.starts[i]:self.ends[i]]


class Merger:
    """Byte-pair merging of many sequences at once, in step with the ranks.

    Symbols of all sequences stand in one array. In each round every sequence merges
    all occurrences of its own lowest-ranked pair, from the left; sequences without a
    mergeable pair leave the array.
    """

    NONE = np.iinfo(np.int64).max

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], size: int):
        """``pairs``: (left id, right id) -> (rank, id of both)."""
        self.size = size
        keys = np.fromiter((a * size + b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter((v[0] for v in pairs.values()), np.int64, len(pairs))[order]
        self.results = np.fromiter((v[1] for v in pairs.values()), np.int64, len(pairs))[order]

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences one after another, and how many each has. No length is 0."""
        counts = lengths.astype(np.int64).copy()
        done_ids, done_seq = [], []
        seq = np.repeat(np.arange(len(lengths)), lengths)
        symbols = symbols.astype(np.int64)
        while len(symbols):
            found = np.full(len(symbols), -1, np.int64)
            pair = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            found[:-1][known] = at[known]
            ranks = np.where(found >= 0, self.ranks[found], self.NONE)
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            spans = np.diff(np.append(heads, len(seq)))
            lowest = np.minimum.reduceat(ranks, heads)
            live = np.repeat(lowest < self.NONE, spans)
            if not live.all():
                done_ids.append(symbols[~live])
                done_seq.append(seq[~live])
            hit = (ranks == np.repeat(lowest, spans)) & live
            # of overlapping occurrences (a a a) every second one, from the left
            places = np.flatnonzero(hit)
            if len(places):
                fresh = np.append(True, np.diff(places) > 1)
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - begin) % 2 == 0]
                symbols[places] = self.results[found[places]]
                live[places + 1] = False
                np.subtract.at(counts, seq[places], 1)
            symbols, seq = symbols[live], seq[live]
        if not done_ids:
            return symbols, counts
        ids, owner = np.concatenate(done_ids), np.concatenate(done_seq)
        return ids[np.argsort(owner, kind="stable")], counts


class Vocabulary:
    """Ids of single bytes or word symbols, the merges, and the bytes of each id."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            self._from_json(json.load(open(path, encoding="utf-8")))
        else:
            self._from_ranks(path)

    def _from_ranks(self, path: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        pairs = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        size = max(ranks.values()) + 1
        self.bytes_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.end_ids, self.special = None, {}
        self.merger = Merger(pairs, size)
        names = [b""] * size
        for whole, rank in ranks.items():
            names[rank] = whole
        lengths = np.fromiter(map(len, names), np.int64, size)
        self.id_starts, self.id_lengths = np.cumsum(lengths) - lengths, lengths
        self.id_bytes = np.frombuffer(b"".join(names), np.uint8)

    def _from_json(self, spec: dict) -> None:
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        pairs = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        letters = byte_letters()
        self.bytes_ids = np.array([vocab[c] for c in letters], np.int64)
        self.end_ids = np.array([vocab[c + suffix] for c in letters], np.int64) if suffix else None
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.merger = Merger(pairs, max(vocab.values()) + 1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the count of each."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.bytes_ids[raw]
        if self.end_ids is not None:
            last = np.cumsum(lengths) - 1
            symbols[last] = self.end_ids[raw[last]]
        return self.merger.merge(symbols, lengths)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after another."""
        return self.id_bytes[ragged(self.id_starts[ids], self.id_lengths[ids])]


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1
    bytes stand for themselves, the others take the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def plain_words(text: str) -> str:
    """Composed and in lower case letter by letter, as the word vocabulary wants it."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        # Python lowers a final capital sigma by its place in the word, which this doesn't
        text = text.replace("Σ", "σ")
    return text.lower()


class Encoder:
    """Encodes texts; remembers the ids of up to ``most`` distinct pre-tokens."""

    def __init__(self, path: str, most: int = 400_000):
        self.vocabulary = Vocabulary(path)
        self.spaced = self.vocabulary.end_ids is None
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        ids, counts = self.vocabulary.encode([w.encode("utf-8", "replace") for w in words])
        have, want = len(self.known), len(self.known) + len(words)
        while len(self.starts) < want:
            self.starts, self.counts = np.resize(self.starts, 2 * want), np.resize(self.counts, 2 * want)
        while len(self.ids) < self.used + len(ids):
            self.ids = np.resize(self.ids, 2 * (self.used + len(ids)))
        self.ids[self.used:self.used + len(ids)] = ids
        self.counts[have:want] = counts
        self.starts[have:want] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.known.update(zip(hashes, range(have, want)))

    def _look_up(self, tokens: Tokens) -> np.ndarray:
        """For each token its place in the memory."""
        codes, distinct = pd.factorize(tokens.hashes())
        if len(self.known) + len(distinct) > self.most:
            self._forget()
        names = distinct.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        if new:
            first = np.zeros(len(distinct), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            self._learn([names[i] for i in new], [tokens.word(first[i]) for i in new])
        known = self.known
        return np.fromiter((known[h] for h in names), np.int64, len(names))[codes]

    def _segments(self, texts: list[str]):
        """Texts cut at special strings: segments, the text of each, and (segment, id) marks."""
        special = self.vocabulary.special
        if not any(s in t for s in special for t in texts):
            return texts, np.arange(len(texts)), []
        import re
        cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        segments, owner, marks = [], [], []
        for i, text in enumerate(texts):
            for part in cut.split(text):
                if part in special:
                    marks.append((len(segments) - 1, special[part]))
                else:
                    segments.append(part)
                    owner.append(i)
        return segments, np.array(owner), marks

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        segments, owner, marks = self._segments(texts)
        tokens = Tokens(segments if self.spaced else list(map(plain_words, segments)), self.spaced)
        out = np.zeros(len(texts), np.int64)
        if len(tokens.starts):
            at = self._look_up(tokens)
            np.add.at(out, owner[tokens.of_text], self.counts[at])
        for segment, _ in marks:
            out[owner[segment]] += 1
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and the count of each text."""
        segments, owner, marks = self._segments(texts)
        tokens = Tokens(segments if self.spaced else list(map(plain_words, segments)), self.spaced)
        return self._ids(tokens, owner, marks, len(texts))

    def _ids(self, tokens: Tokens, owner, marks, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros(n, np.int64)
        per_segment = np.zeros(len(owner), np.int64)
        ids = np.zeros(0, np.int32)
        if len(tokens.starts):
            at = self._look_up(tokens)
            np.add.at(per_segment, tokens.of_text, self.counts[at])
            ids = self.ids[ragged(self.starts[at], self.counts[at])]
        np.add.at(out, owner, per_segment)
        if marks:
            behind = np.cumsum(per_segment)
            ids = np.insert(ids, [behind[s] for s, _ in marks], [i for _, i in marks])
            np.add.at(out, owner[[s for s, _ in marks]], 1)
        return ids, out


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    if path not in _CACHE:
        _CACHE[path] = Encoder(path)
    return _CACHE[path]


def text_batches(texts: list[str], most: int = 2_000_000):
    """(first, last) slices of about ``most`` characters; a longer text is alone."""
    first = held = 0
    for i, text in enumerate(texts):
        if i > first and held + len(text) > most:
            yield first, i
            first, held = i, 0
        held += len(text)
    if first < len(texts):
        yield first, len(texts)
