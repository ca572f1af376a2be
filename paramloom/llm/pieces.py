"""Token ids of whole texts as a tokenizer of the ``tokenizers`` library gives them, faster.

Both tokenizers used here split a text by a pattern and encode each piece by
itself. So the ids of a text are those of its pieces in order, and a piece
needs encoding once per worker: the library's model encodes pieces not yet
seen, a bounded dict remembers them. The pattern runs in Python only on texts made of
characters for which both pattern engines are known to agree (``_SAFE``,
compared exhaustively in the tests); any other text, and one that holds a
special string, goes to the library whole.
"""

from __future__ import annotations

import array
import os
import re
import sys
import unicodedata

from paramloom.llm.scratch import worker_state

SPECIALS = ("<|endoftext|>", "<|startoftext|>")
MAX_PIECES = 1_000_000
LONGEST_KEPT = 128
CHUNK = 1 << 20

_SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def _safe_chars() -> list[str]:
    chars = [chr(i) for i in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    return [c for c in chars if c not in "\x1c\x1d\x1e\x1f" and len(c.lower()) == 1 and (ord(c.lower()) < 0x250 or c.lower() == c)]


def _members(chars) -> str:
    """The inside of a character class."""
    out, codes = [], sorted(map(ord, chars))
    start = last = None
    for code in [*codes, None]:
        if start is not None and code != last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = None
        if start is None:
            start = code
        last = code
    return "".join(out)


def _patterns() -> dict[str, re.Pattern]:
    safe = _safe_chars()
    letters = _members(c for c in safe if unicodedata.category(c)[0] == "L")
    numbers = _members(c for c in safe if unicodedata.category(c)[0] == "N")
    spaces = _members(_SPACES)
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    return {
        "unsafe": re.compile(f"[^{_members(safe)}]"),
        "byte": re.compile(f"{short}| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"),
        "word": re.compile(f"{short}|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"),
        "cut": re.compile(f"(?<=[^{spaces}])(?=[{spaces}])"),
    }


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies spell each byte: itself if it prints, else the next one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """kind: 'byte' (byte-level, spaces belong to pieces) or 'word' (lower case, spaces dropped)."""

    def __init__(self, spec: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.known = kind, {}
        self.tokenize, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        patterns = _patterns()
        self.unsafe, self.cut = patterns["unsafe"].search, patterns["cut"]
        self.split = patterns[kind].findall

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        out = array.array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunks(self, text: str):
        """Parts of a long text, cut where a space follows another character: no piece reaches over that."""
        start = 0
        while len(text) - start > CHUNK:
            hit = self.cut.search(text, start + CHUNK)
            if hit is None:
                break
            yield text[start : hit.start()]
            start = hit.start()
        yield text[start:] if start else text

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.unsafe(text) or any(s in text for s in SPECIALS):
            return self._whole(text)
        if self.kind == "word":
            text = text.lower()
        if len(text) <= CHUNK:
            return self._joined(self.split(text))
        return b"".join(self._joined(self.split(part)) for part in self._chunks(text))

    def _joined(self, pieces: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        new = [p for p in set(pieces) if p not in known]
        extra = {}
        for piece in new:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            (known if len(piece) <= LONGEST_KEPT else extra)[piece] = self._raw([t.id for t in self.tokenize(spelled)])
        out = b"".join([known[p] if p in known else extra[p] for p in pieces])
        if len(known) > MAX_PIECES:
            known.clear()
        return out


def encoder(spec: str, kind: str) -> Encoder:
    """This worker's encoder for a tokenizer, with what it has learnt in earlier tasks."""
    state, key = worker_state(), ("encoder", kind, hash(spec))
    if key not in state:
        state[key] = Encoder(spec, kind)
    return state[key]
