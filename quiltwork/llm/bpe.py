"""Byte-level BPE by backtracking.

Encoding a word: an Aho-Corasick automaton over all tokens gives, for each place, the longest token that
starts there.  A depth-first search walks from place to place, longest token first, and takes a token only if it is
compatible with the one before it, that is, if the merge rules would leave exactly these two side by side.  The tokens
of a prefix are unique, so a place from which no token leads on is dead for good and is never entered again, and the
work is linear in the word's length.  Compatibility is kept in a table of pairs that fills as pairs are met.  Decoding
copies byte ranges of one blob by an offset table.

Compatibility follows from the definition.  While a token is made of its bytes, the piece at its right edge changes
with certain merges, and so does the piece at its left edge; ``spines`` lists these pieces with the rank of the merge
that ends each.  Two tokens stay apart if no piece at the left one's right edge has a merge with a piece at the right
one's left edge, alive at the same time, that comes before both pieces end.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: White space of the pre-tokenizer (fixed values: Unicode's White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
#: The pre-tokenizer's pattern (fixed value of the public byte-level BPE).
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: Words held in memory by one worker; beyond that the table starts anew, which costs time only.
CACHE_WORDS = 400_000
#: Pairs held in the table of a worker; others are worked out each time.
MOST_PAIRS = 4_000_000
#: The rank that ends a whole token's life: none.
NEVER = 1 << 60


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Encoded words (ids as little-endian 32-bit integers), made as they are met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = np.array(self.encode(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            self[word] = out
        return out


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*token, *self.special.values()]) + 1
        blobs = [token.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            blobs[i] = text.encode()
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in blobs], out=self.offsets[1:])
        # rank 0..: single bytes, then merges in their order; ranks and ids are mapped both ways
        single = {b[0]: i for i, b in token.items() if len(b) == 1}
        self.ranked: list[int] = [single[b] for b in range(256)]
        self.length = [1] * 256
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        rank_of = {bytes([b]): b for b in range(256)}
        self.pair: dict[int, int] = {}
        for m in spec["model"]["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = bytes(letters[c] for c in left), bytes(letters[c] for c in right)
            r = len(self.ranked)
            self.ranked.append(vocab[left + right])
            self.length.append(len(a) + len(b))
            self.split.append((rank_of[a], rank_of[b]))
            self.pair.setdefault(rank_of[a] << 20 | rank_of[b], r)
            rank_of.setdefault(a + b, r)
        self.rank_of = rank_of
        self.machine = ahocorasick.Automaton()
        for t, r in rank_of.items():
            self.machine.add_word(t.decode("latin-1"), r)
        self.machine.make_automaton()
        # the longest token that is a proper prefix of a token, or -1
        self.shorter = [-1] * len(self.ranked)
        for t, r in rank_of.items():
            self.shorter[r] = next((rank_of[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in rank_of), -1)
        self.edges: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.compatible: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words = _Words(self._encode_word)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def spines(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The pieces at the token's left and right edge, from a single byte to the token, each with the rank that ends it."""
        held = self.edges.get(token)
        if held is None:
            held = self.edges[token] = tuple(self._spine(token, side) for side in (0, 1))
        return held

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        out = [(token, NEVER)]
        while out[-1][0] >= 256:
            out.append((self.split[out[-1][0]][side], out[-1][0]))
        return out[::-1]

    def _meeting(self, left: int, right: int) -> int | None:
        """The rank of the merge that joins the two tokens across their border as early as possible, or None.

        A merge of equal rank further left is made first, so it has to come before the left piece's end, but may
        share the right piece's.
        """
        ours, theirs = self.spines(left)[1], self.spines(right)[0]
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = ours[i], theirs[j]
            rank = self.pair.get(a << 20 | b)
            if rank is not None and rank < a_end and rank <= b_end:
                return rank
            if a_end == b_end == NEVER:
                return None
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        """Would the merge rules leave these two tokens next to each other?"""
        key = left << 20 | right
        ok = self.compatible.get(key)
        if ok is None:
            ok = self._meeting(left, right) is None
            if len(self.compatible) < MOST_PAIRS:
                self.compatible[key] = ok
        return ok

    def is_whole(self, token: int) -> bool:
        """Do the merge rules themselves make this token from its bytes?"""
        if token < 256:
            return True
        ok = self.whole.get(token)
        if ok is None:
            a, b = self.split[token]
            ok = self.whole[token] = self.is_whole(a) and self.is_whole(b) and self._meeting(a, b) == token
        return ok

    def _encode_word(self, word: bytes) -> list[int]:
        one = self.rank_of.get(word)
        if one is not None and self.is_whole(one):
            return [self.ranked[one]]
        n, length, shorter, known = len(word), self.length, self.shorter, self.compatible
        longest = [-1] * (n + 1)
        for last, r in self.machine.iter(word.decode("latin-1")):
            first = last + 1 - length[r]
            if longest[first] < 0 or length[longest[first]] < length[r]:
                longest[first] = r
        # the path so far, for each of its tokens where it starts and the next shorter one to try there
        dead: set[int] = set()
        path: list[int] = []
        starts: list[int] = []
        retry: list[int] = []
        at, left, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                if at + length[token] not in dead:
                    ok = left < 0 or known.get(left << 20 | token)
                    if ok or ok is None and self.fits(left, token):
                        break
                token = shorter[token]
            if token < 0:  # nothing leads on from here: back to the token before
                dead.add(at)
                del path[-1]
                at, token = starts.pop(), retry.pop()
                left = path[-1] if path else -1
            else:
                path.append(token)
                starts.append(at)
                retry.append(shorter[token])
                at += length[token]
                left, token = token, longest[at]
        return [self.ranked[r] for r in path]

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.encode(p) for k, p in enumerate(parts) if p)
        words = self.words
        return b"".join([words[w] for w in _WORDS.findall(text)])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: byte ranges of the blob by the offset table; what isn't UTF-8 becomes U+FFFD."""
        ids = ids.astype(np.int64)
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        total = int(size.sum())
        ends = np.cumsum(size)
        place = np.repeat(start - ends + size, size)
        place += np.arange(total)
        return self.blob[place].tobytes().decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    """One encoder a process."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return Bpe(path)
