"""Token ids of whole documents, by a public tokenizer, through a cache of words."""

from __future__ import annotations

import json
import os
from itertools import chain, islice

import numpy as np

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ROWS = 4096  # words merged at once


def words_of(text: bytes) -> list[bytes]:
    """Words to encode one by one: white space ends them, case is dropped unless the text may hold one of the tokenizer's special strings."""
    return text.split() if b"<|" in text else text.lower().split()


class Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Merges:
    """Byte-pair merges of whole arrays of words.

    A row of a matrix is a word's symbols.  Each round merges, in every row that
    has any, the pair of least rank (the leftmost of equal ones), which is the
    order of byte-pair encoding.
    """

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # a merge's number is its rank; one more than all stands for no merge
        self.key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs] + [0xFFFFFFFF], np.uint32)
        self.product = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first, left = self.table(np.arange(len(pairs)), 0x9E3779B1)
        factor = 0x85EBCA6B
        while True:  # a few keys share a place; another table has room for them
            self.second, rest = self.table(left, factor)
            if not len(rest):
                break
            factor += 2
        self.factor = np.uint32(factor)

    def table(self, merges: np.ndarray, factor: int) -> tuple[np.ndarray, np.ndarray]:
        out = np.full(1 << 20, len(self.product), np.int32)
        at = (self.key[merges] * np.uint32(factor)) >> np.uint32(12)
        out[at[::-1]] = merges[::-1]
        return out, merges[out[at] != merges]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        one = self.first[(k * np.uint32(0x9E3779B1)) >> np.uint32(12)]
        two = self.second[(k * self.factor) >> np.uint32(12)]
        return np.where(self.key[one] == k, one, np.where(self.key[two] == k, two, self.NONE))

    def encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words (bytes, and where each of them starts and how long it is, at least 1), one after the other, and how many each has."""
        order = np.argsort(lens, kind="stable")
        counts = np.empty(len(lens), np.int64)
        rows = []
        for i in range(0, len(order), ROWS):
            mine = order[i : i + ROWS]
            n, width = lens[mine], int(lens[mine[-1]])
            spot = np.minimum(starts[mine] + np.arange(width)[:, None], len(data) - 1)
            sym = self.inner[data[spot]]
            here = np.arange(len(mine))
            sym[n - 1, here] = self.last[data[spot[n - 1, here]]]
            sym, n = self.merged(sym, n.copy())
            counts[mine] = n
            rows.append((mine, sym, n))
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for mine, sym, n in rows:
            place = np.arange(sym.shape[0])[:, None]
            inside = place < n
            out[(begin[mine] + place)[inside]] = sym[inside]
        return out, counts

    def merged(self, sym: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (place, word) and their numbers after all merges."""
        width = sym.shape[0]
        if width < 2:
            return sym, n
        rank = self.ranks(sym[:-1], sym[1:])
        rank[np.arange(1, width)[:, None] >= n] = self.NONE
        final, words, left = sym.copy(), np.arange(sym.shape[1]), n.copy()  # words: those with merges left
        column = np.arange(width)[:, None]
        while True:
            p = rank.argmin(axis=0)
            least = rank[p, np.arange(len(p))]
            go = least < self.NONE
            if not go.all():
                done = words[~go]
                final[: len(sym), done], n[done] = sym[:, ~go], left[~go]
                if len(done) == len(words):
                    return final, n
                words, sym, rank, p, least, left = words[go], sym[:, go], rank[:, go], p[go], least[go], left[go]
            left = left - 1
            # what is right of the merged pair moves one place to the left
            sym = np.where(column[: len(sym) - 1] > p, sym[1:], sym[:-1])
            sym[p, np.arange(len(words))] = self.product[least]
            if len(sym) < 2:
                rank = np.full((1, len(words)), self.NONE)
                continue
            rank = np.where(column[: len(rank) - 1] > p, rank[1:], rank[:-1])
            k = np.flatnonzero(p > 0)
            rank[p[k] - 1, k] = self.ranks(sym[p[k] - 1, k], sym[p[k], k])
            more = p + 1 < left
            k = np.flatnonzero(more)
            rank[p[k], k] = self.ranks(sym[p[k], k], sym[p[k] + 1, k])
            k = np.flatnonzero(~more & (p < len(rank)))
            rank[p[k], k] = self.NONE


def marked(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


#: Letters in UTF-8 that need nothing but a change of case, in composed form: a-z, and of U+00C0 to U+00FF all but two signs, whose first byte is LEAD.
LEAD = 0xC3
ONE, SECOND, CAPITAL = marked((97, 122), (LEAD, LEAD)), marked((0x80, 0x96), (0x98, 0xB6), (0xB8, 0xBF)), marked((0x80, 0x9E))
#: The tokenizer always parts a letter from a run of these (an apostrophe may begin a contraction, and < a special string).
STOP = marked((32, 38), (40, 47), (58, 59), (61, 64), (91, 96), (123, 126))
LONGEST = 48


KEPT: dict[str, WordTokens] = {}


class WordTokens:
    """Encodes texts word by word.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its words in turn.  Each distinct word is encoded
    once, until the cache holds `most` words.
    """

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.merges = Merges(path)
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokens:
        """The one of this process, without words: tables are read once, and no cache outlives its task."""
        if path not in KEPT:
            KEPT.clear()
            KEPT[path] = cls(path)
        KEPT[path].clear()
        return KEPT[path]

    def clear(self) -> None:
        self.code, self.tail = Numbers(), {}
        self.flat, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def whole(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in words], add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Adds words to the cache: those of plain letters, with or without marks behind them, by merges, the others by the tokenizer."""
        lens = np.fromiter(map(len, new), np.int64, len(new))
        data = np.frombuffer(b" ".join(new) + b" ", np.uint8)
        starts = np.cumsum(lens + 1) - lens - 1
        after = np.zeros(len(data), bool)  # the second bytes of letters of two
        after[1:] = data[:-1] == LEAD
        bad = np.concatenate(([0], np.cumsum(~np.where(after, SECOND[data], ONE[data]))))
        body = np.maximum.reduceat(np.where(STOP[data], -1, np.arange(len(data))), starts) + 1 - starts
        fits = (body > 0) & (body <= LONGEST)
        fits[fits] = bad[(starts + body)[fits]] == bad[starts[fits]]
        plain, odd = np.flatnonzero(fits), np.flatnonzero(~fits)
        ids, counts = self.merges.encode(np.where(after & CAPITAL[data], data + np.uint8(0x20), data), starts[plain], body[plain])
        tailed = np.flatnonzero(body[plain] < lens[plain])
        tails = [new[k][n:] for k, n in zip(plain[tailed].tolist(), body[plain[tailed]].tolist(), strict=True)]
        unseen = [t for t in dict.fromkeys(tails) if t not in self.tail]
        self.tail.update(zip(unseen, self.whole(unseen), strict=True))
        others, ends = self.whole([new[k] for k in odd.tolist()]), [self.tail[t] for t in tails]
        more = np.fromiter(map(len, ends), np.int64, len(ends))
        size = np.empty(len(new), np.int64)
        size[plain] = counts
        size[plain[tailed]] += more
        size[odd] = np.fromiter(map(len, others), np.int64, len(others))
        stops = np.cumsum(size)
        begin, flat = stops - size, np.empty(int(size.sum()), np.uint32)

        def put(at: np.ndarray, n: np.ndarray, values: np.ndarray) -> None:
            flat[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = values

        put(begin[plain], counts, ids)
        put(begin[plain[tailed]] + counts[tailed], more, np.fromiter(chain.from_iterable(ends), np.uint32, int(more.sum())))
        put(begin[odd], size[odd], np.fromiter(chain.from_iterable(others), np.uint32, int(size[odd].sum())))
        self.flat = np.concatenate((self.flat, flat))
        self.start = np.concatenate((self.start, self.start[-1] + stops))

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids, each text's followed by `end`, and how many each has."""
        if len(self.code) > self.most:
            self.clear()
        code, codes, counts = self.code, [], []
        before = len(code)
        for t in texts:
            words = words_of(t)
            # a word not seen before gets the next number
            codes.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
            counts.append(len(words))
        if len(code) > before:
            self.learn(list(islice(code, before, None)))
        of = np.concatenate(codes) if codes else np.zeros(0, np.int32)
        begin = self.start[of]
        lens = self.start[of + 1] - begin
        total = int(lens.sum())
        words_end = np.cumsum(np.array(counts, np.int64))
        at = np.cumsum(lens)
        n = np.diff(np.concatenate(([0], np.concatenate(([0], at))[words_end])))
        out = self.flat[np.repeat(begin - (at - lens), lens) + np.arange(total)]
        if end is not None:
            stops = np.cumsum(n)
            out = np.insert(out, stops, np.uint32(end))
            n = n + 1
        return out, n
