"""Token ids of texts, as the tokenizers library gives them, each distinct piece of text encoded once for a worker.

A byte-pair encoder splits a text into pre-tokens and encodes each by itself. Words repeat, so a
worker keeps the ids of the space-delimited pieces that it has met and asks the library's model only
for new ones. Where a cut at spaces would not be a cut between pre-tokens (two white-space
characters side by side), where a text holds the string of an added token, and for vocabularies whose
steps are none of those known here, the whole text goes through the library's own ``encode``.

Pieces, ends of words and lines are remembered apart, so that what a worker has met before never
changes a result. An empty text has no ids; texts of any length are read whole; equal texts have equal ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex

#: Pieces, and lines, that a worker remembers; further ones are encoded each time they come.
REMEMBERED = 600_000

#: Fixed value: the pattern of the library's byte-level pre-tokenizer, which vocabulary files name but do not hold.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The steps of a vocabulary file that pieces are cut for: byte-level with spaces kept, and white space dropped after folding.
KEEPS_SPACES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
BYTES_ONLY = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


#: Marks that may end a word; each is a pre-token of its own there.
ENDS = frozenset(".,;:!?%#&*|")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it can be seen, else the next one from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in seen else spare))
        spare += b not in seen
    return letters


LETTERS = dict(enumerate(byte_letters()))


def pattern_of(steps: dict) -> tuple[str | None, bool]:
    """The pre-token pattern of a vocabulary file, and whether it folds case and drops white space; None if its steps are others."""
    cut, folds = steps["pre_tokenizer"] or {}, steps["normalizer"]
    same = lambda found, want: {k: found.get(k) for k in want} == want
    if folds is None and same(cut, KEEPS_SPACES):
        return BYTE_PATTERN, False
    parts = cut.get("pretokenizers") or []
    if (folds or {}).get("normalizers") == FOLDS and len(parts) == 2 and same(parts[0], {"type": "Split", "behavior": "Removed", "invert": True}) and same(parts[1], BYTES_ONLY):
        return parts[0]["pattern"].get("Regex"), True
    return None, False


class Encoder:
    """ids(text): the text's token ids as little-endian unsigned 32-bit bytes, as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        steps = json.loads(self.whole.to_str())
        pattern, self.folds = pattern_of(steps)
        self.tokenize = self.whole.model.tokenize
        self.pattern = regex.compile(pattern) if pattern else None
        self.added = [t["content"] for t in steps["added_tokens"]]
        if any(t["normalized"] for t in steps["added_tokens"]):
            self.pattern = None  # such a token may stand for strings other than its own
        self.known: dict[str, bytes] = {"": b""} if self.folds else {}
        self.marks: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]

    def _run(self, pre_token: str) -> bytes:
        letters = pre_token.encode().decode("latin-1").translate(LETTERS)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(letters)])

    def _runs(self, text: str) -> bytes:
        return b"".join(map(self._run, self.pattern.findall(text)))

    def _piece(self, piece: str) -> bytes | None:
        """The ids of a piece between spaces, the space before included where the vocabulary has it; None if no piece of its own."""
        found = self.known.get(piece)
        if found is not None:
            return found
        lead = "" if self.folds else " "
        if piece.isalpha():
            found = self._run(lead + piece)
        elif not self.folds and (not piece or piece[0].isspace() or piece[-1].isspace()):
            return None
        elif piece[-1] in ENDS and piece[:-1].isalpha():
            again = piece[:-1] in self.known
            found = self._piece(piece[:-1]) + self._mark(piece[-1])
            if not again:  # a rare word is remembered once, whatever ends it
                return found
        elif "\n" in piece:
            first, *lines = piece.split("\n")
            parts = [self._piece(first), *(self._line(x) for x in lines)]
            return None if None in parts else b"".join(parts)
        else:
            found = self._runs(lead + piece)
        if len(self.known) < REMEMBERED:
            self.known[piece] = found
        return found

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._run(mark)
        return self.marks[mark]

    def _line(self, piece: str) -> bytes | None:
        """A line break and the piece after it, which has no space before."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        if piece[-1] in ENDS and piece[:-1].isalpha():
            return self._line(piece[:-1]) + self._mark(piece[-1])
        found = self.lines.get(piece)
        if found is None:
            found = self._run("\n") + self._runs(piece)
            if len(self.lines) < REMEMBERED:
                self.lines[piece] = found
        return found

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.whole.encode(text, add_special_tokens=False).ids))

    def ids(self, text: str) -> bytes:
        if self.pattern is None or any(map(text.__contains__, self.added)):
            return self._plain(text)
        if self.folds:
            try:
                text.encode("latin-1")
                text = text.lower()  # for these characters all that the normaliser does
            except UnicodeEncodeError:
                text = self.whole.normalizer.normalize_str(text)
            pieces, head = text.replace("\n", " ").split(" "), b""
        else:
            first, *pieces = text.split(" ")
            if not first or first[-1].isspace():
                return self._plain(text)
            head = self._runs(first)
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = self._piece(pieces[i])
                    if x is None:
                        return self._plain(text)
        return head + b"".join(found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker for the vocabulary file ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(texts: Iterator[str], path: str, end: int | None = None) -> Iterator[bytes]:
    """The ids of each text, with the id ``end`` after them."""
    enc, last = encoder(path), b"" if end is None else end.to_bytes(4, "little")
    return (enc.ids(t) + last for t in texts)
