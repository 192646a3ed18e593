"""Token ids by the tokenizers library, with a bounded cache of encoded words."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa

#: A space that another white-space character or the end follows: there, splitting at every space isn't safe.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_SAFE_SPLIT = re.compile(r" (?=\S)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE has for bytes: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts word by word; the ids equal those of the library's Tokenizer.encode(text, add_special_tokens=False).

    Both pre-tokenizers in use never let a piece cross from one word into the space before the next, so a text's ids are those
    of its first word and of each later word with the space before it. A new word runs through the tokenizer's own normalizer,
    pre-tokenizer and model; the ids of recent words stay in two dicts of at most `limit` entries, of which the older is
    dropped when the younger is full, so memory is bounded at any input size. A text that may hold the string of an added token
    (any occurrence of such a token's first two characters) is encoded whole by the library instead, which gives that string its
    token. Ids are returned as little-endian bytes of `dtype`.
    """

    def __init__(self, path: str, limit: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.marks = sorted({x.content[:2] for x in t.get_added_tokens_decoder().values()})
        self.dtype = np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        spaced = isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel)
        self.words, self.firsts = _Words(self, limit, " ", spaced), _Words(self, limit // 4, "", spaced)
        self.words.firsts = self.firsts.firsts = self.firsts

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes."""
        if not text:
            return b""
        if any(x in text for x in self.marks):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        parts = _SAFE_SPLIT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        words = self.words
        first = self.firsts[parts[0]]
        del parts[0]
        out = first + b"".join([words[x] for x in parts])
        words.turn()
        self.firsts.turn()
        return out


class _Words(dict):
    """Words with `lead` before them, and their ids as bytes."""

    def __init__(self, owner: WordEncoder, limit: int, lead: str, spaced: bool):
        t = owner.tokenizer
        self.normal, self.pre, self.model = t.normalizer, t.pre_tokenizer, t.model
        self.code, self.limit, self.lead, self.old = owner.code, limit, lead, {}
        self.letters = _byte_letters()
        self.head = "Ġ" if spaced and lead else ""
        self.newline = self.slow("\n")

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def slow(self, text: str) -> bytes:
        if self.normal is not None:
            text = self.normal.normalize_str(text)
        tokenize = self.model.tokenize
        return array(self.code, [x.id for piece, _ in self.pre.pre_tokenize_str(text) for x in tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.fresh(word)
        self[word] = out
        return out

    def fresh(self, word: str) -> bytes:
        if word.isalpha():  # one piece: a run of letters with the space before it
            text = word if self.normal is None else word.lower() if word.isascii() else self.normal.normalize_str(word)
            if text.isalpha():
                if not text.isascii():
                    text = text.encode().decode("latin-1").translate(self.letters)
                return array(self.code, [x.id for x in self.model.tokenize(self.head + text)]).tobytes()
        a, line, b = word.partition("\n")
        if line and a and b and not a[-1].isspace() and not b[0].isspace():  # a lone line feed is a piece of its own, or none
            return self[a] + self.newline + self.firsts[b]
        core = word.rstrip(".,;:!?")
        if core and len(core) < len(word) and core.isalpha():
            return self[core] + self.firsts[word[len(core) :]]
        return self.slow(self.lead + word)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def release(encoders: bool = True) -> None:
    """At the end of a task: lets go of buffers and, if told, of encoders, since a Python worker lives on and shares its executor's memory.

    A worker without its encoder reads the file again for the next task, and encodes frequent words anew; one that keeps it has both,
    within the encoder's bound.
    """
    if encoders:
        _ENCODERS.clear()
    pa.default_memory_pool().release_unused()
