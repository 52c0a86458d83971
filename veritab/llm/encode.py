"""Whole texts to token ids through the tokenizers library, each distinct piece of a text once."""

from __future__ import annotations

import gc
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core

from tokenizers import Tokenizer  # noqa: E402

from veritab.llm.bpe import byte_alphabet  # noqa: E402
from veritab.llm.common import Kept  # noqa: E402

_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Marks that are tokens of their own after letters.
MARKS = ",.!?;:"
#: The character that stands for each byte in byte-level vocabularies.
_ALPHABET = dict(enumerate(byte_alphabet()))
#: Letters up to U+017F that no normalisation touches and whose lower case is one letter, too.
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f]+")
#: Longer pieces are not kept.
LONG_PIECE = 256


def _marked(part: str) -> bool:
    """Whether a piece is letters, the last of them Latin, and one mark: then the mark is a pre-token of its own."""
    return part[-1:] in MARKS and part[-2:-1] < "\u0180" and part[:-1].isalpha() and "\u0130" not in part


class PieceEncoder:
    """Ids of whole texts, equal to the library's encode(text, add_special_tokens=False).

    A single space between two characters that are no white space is always a boundary of these vocabularies'
    pre-tokenizers, so a text is cut there and the ids of each piece are kept. keep_space: the space belongs to the piece after it (byte-level
    vocabularies); else the vocabulary drops white space. Pieces not seen before are taken apart further where that is
    a boundary, too: at single newlines, and before a mark after letters of which the last is Latin, which no
    normalisation changes. At most `most` pieces are kept.
    """

    def __init__(self, path: str, keep_space: bool, most: int = 1_600_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.space = " " if keep_space else ""
        self.marks = {m: self._ids([m])[0] for m in (*MARKS, "\n")}
        #: Ids of pieces at a text's or line's start, and of those after a space; the same where white space is dropped.
        self.first = Kept(most)
        self.later = Kept(most) if keep_space else self.first

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, words: list[str], before: str) -> list[bytes]:
        """Ids of pieces. Words of Latin letters are one pre-token, so the vocabulary's model takes them as they are."""
        out, rest = [b""] * len(words), []
        tokenize, latin, lower = self.tokenizer.model.tokenize, _LATIN.fullmatch, not self.space
        lead = before.translate(_ALPHABET)
        for i, w in enumerate(words):
            if w.isascii() and w.isalpha():
                out[i] = array("I", [t.id for t in tokenize(w.lower() if lower else lead + w)]).tobytes()
            elif latin(w):
                out[i] = array("I", [t.id for t in tokenize(lead + (w.lower() if lower else w).encode().decode("latin-1").translate(_ALPHABET))]).tobytes()
            else:
                rest.append(i)
        for i, ids in zip(rest, self._ids([before + words[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _apart(self, piece: str, kept: Kept) -> list | None:
        """[(kept, letters, mark), ...] whose ids, with newlines between them, are the piece's; None if it is one."""
        if "\n" not in piece and not _marked(piece):
            return None
        out = []
        for part in piece.split("\n"):
            if not part or part[0].isspace() or part[-1].isspace() or "<|" in part:
                return None
            out.append((kept, part[:-1], part[-1]) if _marked(part) else (kept, part, ""))
            kept = self.first
        return out

    def _learn(self, heads: set[str], rest: set[str]) -> None:
        self.first.turn()
        if self.later is not self.first:
            self.later.turn()
        later: list[tuple[Kept, str, list]] = []
        ask: dict[int, set[str]] = {id(self.first): set(), id(self.later): set()}
        for kept, pieces in ((self.first, heads), (self.later, rest)):
            plain = ask[id(kept)]
            for piece in pieces:
                apart = self._apart(piece, kept) if piece[-1:] in MARKS or "\n" in piece else None
                if apart is None:
                    plain.add(piece)
                else:
                    later.append((kept, piece, apart))
                    for k, letters, _ in apart:
                        if letters not in k.young and k.again(letters) is None:
                            ask[id(k)].add(letters)
        for kept, before in ((self.first, ""), (self.later, self.space)):
            new = list(ask.pop(id(kept), ()))
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                kept.young.update(zip(part, self._known(part, before), strict=True))
        newline = self.marks["\n"]
        for kept, piece, apart in later:
            kept.young[piece] = newline.join([k.young[letters] + self.marks[mark] if mark else k.young[letters] for k, letters, mark in apart])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # Nothing here refers to itself, so the cycle collector would walk the long lists for nothing.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        first, later = self.first.young.get, self.later.young.get
        first_again, again = self.first.again, self.later.again
        done: list[tuple[list[str], list[bytes | None], list[int]]] = []
        heads: set[str] = set()
        rest: set[str] = set()
        for t in texts:
            pieces = t.split(" ")
            ids = list(map(later, pieces))
            ids[0] = first(pieces[0])
            gaps = []
            if None in ids:
                new = [i for i, x in enumerate(ids) if x is None]
                # Pieces with white space at an end are never kept, so they show here; such a text is cut with more care.
                if any(not pieces[i] or pieces[i][0].isspace() or pieces[i][-1].isspace() for i in new):
                    pieces = _CUT.split(t)
                    ids = [None] * len(pieces)
                    new = range(len(pieces))
                for i in new:
                    piece = pieces[i]
                    asked = rest if i else heads
                    if piece not in asked:
                        if (found := (again if i else first_again)(piece)) is not None:
                            ids[i] = found
                            continue
                        asked.add(piece)
                    gaps.append(i)
            done.append((pieces, ids, gaps))
        # Ids found before stay as they are, even if a new generation begins.
        self._learn(heads, rest)
        first, later = self.first.young, self.later.young
        for pieces, ids, gaps in done:
            for i in gaps:
                ids[i] = later[pieces[i]] if i else first[pieces[0]]
        for p in heads | rest:
            if len(p) > LONG_PIECE or not p or p[0].isspace() or p[-1].isspace():
                self.first.drop(p)
                self.later.drop(p)
        return [b"".join(ids) for _, ids, _ in done]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder_for(path: str, keep_space: bool, most: int = 1_600_000) -> PieceEncoder:
    """One encoder a worker process and vocabulary, kept while the worker lives; it holds some 160 bytes a kept piece."""
    key = (path, keep_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, keep_space, most)
    return _ENCODERS[key]
