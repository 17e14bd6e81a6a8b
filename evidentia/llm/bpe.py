"""Byte-pair merging of many words at once in ragged numpy arrays, for tokenizer files with word ends.

The tokenizer file is a parameter and is read where the work is done; nothing is trained here.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

NO_RANK = np.int32(2**31 - 1)
#: Bytes that the word cache of a Python worker may hold, by a generous estimate; a full cache is emptied, never the input.
CACHE_BYTES = 48 << 20
#: What a cached word or piece takes beside its own bytes: two objects and a place in a table.
ENTRY = 200
#: Texts whose new words are merged together.
GROUP = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankArrays:
    """The merge table as sorted pair keys, and rank-synchronous merging over ragged arrays."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        pairs = [m if isinstance(m, list | tuple) else m.split(" ") for m in merges]
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], dtype=np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order.astype(np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all words, concatenated, and the number of them in each word (none is empty).

        A round finds each word's lowest-ranked neighbouring pair and merges all its places at once, left to right
        where they overlap. Words without a mergeable pair leave; pairs whose symbols stay keep their rank.
        """
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, last = self.inner[raw], np.cumsum(sizes) - 1
        ids[last] = self.final[raw[last]]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(ids), NO_RANK, dtype=np.int32)
        stale = np.ones(len(ids), dtype=bool)
        done_ids, done_word = [], []
        while len(ids):
            stale[:-1] &= word[:-1] == word[1:]
            stale[-1] = False
            at = np.flatnonzero(stale)
            rank[at] = self.ranks(ids[at], ids[at + 1])
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.r_[begins, len(ids)]))
            live = least != NO_RANK
            if not live.all():
                done_ids.append(ids[~live])
                done_word.append(word[~live])
                ids, word, rank, least = ids[live], word[live], rank[live], least[live]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            run = np.r_[True, (hit[1:] != hit[:-1] + 1) | (word[hit[1:]] != word[hit[:-1]])]
            nth = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[nth % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            rank[hit] = NO_RANK
            stale = np.zeros(len(ids), dtype=bool)
            stale[hit] = True
            stale[np.maximum(hit - 1, 0)] = True
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            # a symbol before a merged pair may itself have been absorbed; its absorber is stale already
            ids, word, rank, stale = ids[keep], word[keep], rank[keep], stale[keep]
            rank[stale] = NO_RANK
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))


class WordTokenizer:
    """Ids of white-space-separated words, each computed once: white space never enters a token of these files."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.arrays = RankArrays(model["vocab"], model["merges"], model["end_of_word_suffix"])
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), regex.V0)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """Empty the cache, when it is full and at the end of a task: a worker that waits holds nothing."""
        self.known.clear()
        self.pieces.clear()
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Fill the cache for words, merging all new pieces in one go."""
        whole: dict[str, str] = {}
        split: dict[str, list] = {}
        for w in words:
            plain = w if w.isascii() else unicodedata.normalize("NFC", w).replace("Σ", "σ")
            low = plain.lower()
            if low.isalpha():
                whole[w] = low
                continue
            out: list = []
            for part in self.cut.split(w) if "<|" in w else (w,):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    out += self.piece.findall(low)
            split[w] = out
        pieces = self.pieces
        fresh = {p for p in whole.values() if p not in pieces}
        fresh |= {p for out in split.values() for p in out if isinstance(p, str) and p not in pieces}
        if fresh:
            order = list(fresh)
            ids, counts = self.arrays.merge([p.encode() for p in order])
            raw, begin = ids.astype("<u4").tobytes(), 0
            self.held += ENTRY * len(order) + 2 * len(raw)
            for p, end in zip(order, (np.cumsum(counts) * 4).tolist(), strict=True):
                pieces[p] = raw[begin:end]
                begin = end
        known = self.known
        self.held += ENTRY * len(words) + 2 * sum(map(len, words))
        for w, p in whole.items():
            known[w] = pieces[p]
        for w, out in split.items():
            known[w] = b"".join([pieces[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in out])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers, without added special tokens."""
        out: list[bytes] = []
        for k in range(0, len(texts), GROUP):
            if self.held > CACHE_BYTES:
                self.forget()
            parts = [split_words(t) for t in texts[k : k + GROUP]]
            found = [list(map(self.known.get, ws)) for ws in parts]
            short = [n for n, ids in enumerate(found) if None in ids]
            if short:
                self.learn({w for n in short for w, i in zip(parts[n], found[n], strict=True) if i is None})
                get = self.known.__getitem__
                for n in short:
                    found[n] = [get(w) if i is None else i for w, i in zip(parts[n], found[n], strict=True)]
            out += map(b"".join, found)
        return out


#: str.split() also splits at these, which are no white space to the tokenizer.
_CONTROL = re.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def split_words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _CONTROL.search(text) else text.split()


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
