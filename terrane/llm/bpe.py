"""Byte-level BPE by backtracking over longest matches, in time linear in the text.

A sequence of tokens is what the merges give if every two neighbours are: whether two tokens can be neighbours depends on
these two alone and is remembered. The encoder takes the longest token at each place, steps back to shorter ones where
neighbours don't fit, and marks places from which no way leads on, so that none is tried twice.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import ahocorasick
import regex

#: How the vocabulary's makers split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker; beyond that it starts anew.
REMEMBERED = 200_000


def _printable() -> dict[str, int]:
    """The alphabet of byte-level vocabularies: bytes that print stand for themselves, the others for 256 onwards, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts by a vocabulary file of the `tokenizers` library (byte-level BPE without special tokens)."""

    def __init__(self, vocabulary: bytes, split: str = SPLIT):
        model = json.loads(vocabulary)["model"]
        alphabet = _printable()
        latin = lambda token: "".join(chr(alphabet[c]) for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = model["vocab"]
        self.split = regex.compile(split)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.length: dict[int, int] = {}
        self.tokens = ahocorasick.Automaton()
        for token in [*alphabet, *(a + b for a, b in merges)]:
            i, text = names[token], latin(token)
            self.length[i] = len(text)
            self.tokens.add_word(text, i)
        self.tokens.make_automaton()
        for n, (a, b) in enumerate(merges):
            self.rank.setdefault((names[a], names[b]), n)
            self.parts.setdefault(names[a + b], (names[a], names[b], n))
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens together gives just these two.

        Both are taken apart, the latest merge first. If the tokens that touch at a stage could merge earlier than the
        pieces they became, that merge would have been made.
        """
        bound = len(self.rank)
        while True:
            joint = self.rank.get((left, right))
            if joint is not None and joint < bound:
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # of equal merges the left one is made first, so on the right a joint merge of that rank would come before it
            if b is None or a is not None and a[2] > b[2]:
                left, bound = a[1], a[2]
            else:
                right, bound = b[0], b[2] + 1

    def _adjacent(self, left: int, right: int) -> bool:
        pair = (left, right)
        fit = self.fits.get(pair)
        if fit is None:
            fit = self.fits[pair] = self._neighbours(left, right)
        return fit

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 of its bytes."""
        n, length, adjacent = len(text), self.length, self._adjacent
        at: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.tokens.iter(text):
            at[end + 1 - length[token]].append(token)  # by growing length
        if length[at[0][-1]] == n:
            return [at[0][-1]]
        usable, out, tried, place = bytearray(b"\1") * (n + 1), [], [], 0
        choice = len(at[0]) - 1
        while place < n:
            options = at[place]
            last = out[-1] if out else None
            while choice >= 0:
                token = options[choice]
                if usable[place + length[token]] and (last is None or adjacent(last, token)):
                    break
                choice -= 1
            if choice >= 0:
                out.append(token)
                tried.append(choice)
                place += length[token]
                choice = len(at[place]) - 1 if place < n else 0
            else:
                usable[place] = 0
                place -= length[out.pop()]
                choice = tried.pop() - 1
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty text."""
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for piece in self.split.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode("utf-8").decode("latin-1"))
                if len(known) >= REMEMBERED or len(self.fits) >= 16 * REMEMBERED:
                    known.clear()
                    self.fits.clear()
                if len(piece) <= 256:
                    known[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(packed: bytes, split: str = SPLIT) -> Encoder:
    """The worker's encoder for a packed vocabulary file, built once in each process."""
    return Encoder(zlib.decompress(packed), split)
