"""Byte-level BPE from a rank table: exact merges found by backtracking over longest matches.

Bytes are written as Latin-1 characters, so that an Aho-Corasick automaton over
the vocabulary gives, in one pass, the longest tokens one after the other. Two
tokens may stand side by side in an encoding only if merging their joined bytes
by rank would leave exactly those two; this is found by undoing the merges that
meet at their border and is remembered per pair. An encoding in which all
neighbours are compatible is the one that merging gives, so the encoder takes the
longest token at each place, and on a conflict falls back to the next shorter
one, marking places from which no encoding is left. Every place is marked at most
once, which bounds the work by the length of the input.
"""

from __future__ import annotations

import base64

import ahocorasick
import regex

#: Encodings remembered per process; a memory holds at most so many short pieces, and the one before it as many.
REMEMBERED = 200_000
LONGEST_REMEMBERED = 40

# Letters and numbers of Unicode versions after the one that public encoders
# class by. A pattern sees them as what they were before, code points of no class.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 "
    "16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NEWER = regex.compile(
    "[" + "".join("-".join(chr(int(c, 16)) for c in part.split("-")) for part in NEWER.split()) + "]"
)
UNASSIGNED = "\u0378"


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by id from lines of base64 and rank."""
    pairs = [line.split() for line in data.splitlines() if line]
    tokens: list[bytes] = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Encoder:
    """Encodes bytes by the ranks of ``tokens`` (token by id); every single byte must be a token."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {token: i for i, token in enumerate(tokens) if token}
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        self.remembered: dict[tuple[int, int], bool] = {}
        self.shorter = [self._shorter(token) for token in tokens]
        # By rising rank, as the parts of a token have lower ranks than the token.
        for i, token in enumerate(tokens):
            self.parts.append(self._split(i, token))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            if len(token) == 1 or self.parts[i] != (i, i):
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.lengths = [len(token) for token in tokens]

    def _shorter(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        for n in range(len(token) - 1, 0, -1):
            if token[:n] in self.ids:
                return self.ids[token[:n]]
        return -1

    def _split(self, i: int, token: bytes) -> tuple[int, int]:
        """The two tokens whose merge makes token ``i``; one that no merge makes is its own part."""
        left = self.shorter[i]
        while left >= 0:
            right = self.ids.get(token[len(self.tokens[left]) :])
            if right is not None and left < i and right < i and self._stand_apart(left, right):
                self.merged[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _stand_apart(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the two as neighbours.

        Undoes the later of the two tokens at the border, again and again; a merge
        across the border that is due before the one just undone joins them.
        """
        due = 1 << 62
        while True:
            if self.merged.get((left, right), due) < due:
                return False
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left" and self.parts[left] != (left, left):
                    due, left = left, self.parts[left][1]
                    break
                if side == "right" and self.parts[right] != (right, right):
                    # Of equal ranks the left one merges first, so the right one's own rank is still due.
                    due, right = right + 1, self.parts[right][0]
                    break
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.remembered.get((left, right))
        if known is None:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            known = self.remembered[left, right] = self._stand_apart(left, right)
        return known

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place of a Latin-1 text."""
        return next(self.automaton.iter_long(text, at))[1]

    def encode(self, piece: bytes) -> list[int]:
        """Ids of ``piece``: the ids that merging by lowest rank first leaves."""
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        # The longest token at each place in turn; mostly all of them are compatible.
        greedy = [token for _, token in self.automaton.iter_long(text)]
        known = self.remembered.get
        for place, pair in enumerate(zip(greedy, greedy[1:]), 1):
            if not known(pair) and not self.compatible(*pair):
                return self._backtracked(text, greedy, place)
        return greedy

    def _backtracked(self, text: str, greedy: list[int], agreed: int) -> list[int]:
        """The encoding, found from the first ``agreed`` longest tokens, which are compatible, and the rest."""
        lengths, shorter, size = self.lengths, self.shorter, len(text)
        known = self.remembered.get
        open_places = bytearray(b"\1") * (size + 1)
        # Longest tokens by place, looked up where the search comes by.
        longest: dict[int, int] = {}
        at = 0
        for token in greedy:
            longest[at] = token
            at += lengths[token]
        out = greedy[:agreed]
        at, token = sum(lengths[t] for t in out), greedy[agreed]
        while True:
            end = at + lengths[token]
            if open_places[end] and (not out or known((out[-1], token)) or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == size:
                    return out
                token = longest.get(at, -1)
                if token < 0:
                    token = longest[at] = self.longest(text, at)
                continue
            token = shorter[token]
            while token < 0:
                open_places[at] = 0
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]


class Text:
    """Encodes whole texts: the pattern cuts pieces, each piece is encoded separately.

    With ``single_spaces`` the pattern is known to start a piece at every single
    space between two other characters, and to keep such a space and the letters A to Z
    after it together, as the patterns of public byte-level vocabularies do. Texts are then cut at such spaces first and whole words are
    remembered; texts with other white space at a cut go through the pattern as
    they are.
    """

    def __init__(self, tokens: list[bytes], pattern: str, single_spaces: bool = True):
        self.encoder = Encoder(tokens)
        self.pattern = regex.compile(pattern)
        self.single_spaces = single_spaces
        # Each memory with the one before it, which still answers when the newer one is full.
        self.words: dict[str, str] = {}
        self.older_words: dict[str, str] = {}
        self.known: dict[str, str] = {}
        self.older_known: dict[str, str] = {}
        self.by_id = {str(i): token for i, token in enumerate(tokens) if token}

    def _encoded(self, piece: str) -> str:
        return ",".join(map(str, self.encoder.encode(piece.encode("utf-8", "replace"))))

    def _piece(self, piece: str) -> str:
        """Decimal ids joined by commas; short pieces are remembered."""
        ids = self.known.get(piece)
        if ids is None:
            ids = self.older_known.get(piece)
            if ids is None:
                ids = self._encoded(piece)
            if len(piece) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older_known = {}, self.known
                self.known[piece] = ids
        return ids

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() or not _NEWER.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(_NEWER.sub(UNASSIGNED, text))]

    def _whole(self, text: str) -> str:
        return ",".join(map(self._piece, self._pieces(text)))

    def _word(self, word: str) -> str:
        ids = self.older_words.get(word)
        if ids is None:
            # A space and letters are one piece; what else there is, the pattern cuts.
            plain = word.isascii() and word.isalpha()
            ids = self._encoded(" " + word) if plain else self._whole(" " + word)
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.words) >= REMEMBERED:
                self.words, self.older_words = {}, self.words
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> str:
        """Ids of ``text`` in decimal, joined by commas."""
        words = text.split(" ")
        if not self.single_spaces or len(words) == 1:
            return self._whole(text)
        known = self.words.get
        out = [known(word) for word in words]
        out[0] = self._whole(words[0]) if words[0] and not words[0][-1].isspace() else None
        if None in out:
            for place, ids in enumerate(out):
                if ids is None:
                    word = words[place]
                    if not word or word[0].isspace() or word[-1].isspace():
                        return self._whole(text)
                    out[place] = self._word(word)
        return ",".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.split(","))) if ids else b""
