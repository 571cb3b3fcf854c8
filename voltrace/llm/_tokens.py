"""Token ids from a public vocabulary file, memoised by pre-token.

A byte-level BPE splits a text into pre-tokens and merges inside each one, so the ids of a text are the ids of its
pre-tokens, one after another. Natural text repeats its pre-tokens, so each worker keeps a bounded dictionary from
pre-token to packed ids and asks the tokenizers library only for new ones. Texts that hold an added token's string, or
characters outside those whose classes are the same in every Unicode version, go to the library whole, and so do
vocabularies of another kind. The ids are always those of ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_SPACES = r"\t\n\r "
#: The split that byte-level BPE vocabularies of this family make, for the characters that _UNUSUAL doesn't match.
_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
#: Pre-tokens of more characters aren't memoised.
LONGEST_KEY = 64
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ–—‘’“”…€]")


def _byte_letters() -> dict[int, str]:
    """The letter for each byte in a byte-level vocabulary: itself where it prints in Latin-1, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)}


class PackedEncoder:
    """encode(texts): for each text its ids as little-endian unsigned 32-bit integers in one bytes object."""

    def __init__(self, path: str, max_entries: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("packed ids are little-endian 32-bit integers")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        pre = kind.get("pre_tokenizer") or {}
        self.splits = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not kind.get("normalizer")
        )
        added = [t["content"] for t in kind.get("added_tokens") or [] if t.get("content")]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.max_entries = max_entries
        #: Two generations: a full memo becomes the old one, from which what is met again moves on.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, part: str) -> bytes:
        """The ids of one pre-token, by the library's model alone."""
        return array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def _one(self, text: str) -> bytes:
        if not self.splits or _UNUSUAL.search(text) or (self.added and self.added.search(text)):
            return self._ask([text])[0]
        parts = _SPLIT.findall(text)
        if new := set(parts).difference(self.memo):
            long = {x: self._merge(x) for x in new if len(x) > LONGEST_KEY}
            new.difference_update(long)
            if len(self.memo) + len(new) > self.max_entries:
                self.old, self.memo, new = self.memo, {}, set(parts).difference(long)
            old = self.old
            self.memo.update((x, old[x]) for x in new if x in old)
            self.memo.update((x, self._merge(x)) for x in new if x not in old)
            if long:
                return b"".join(long[x] if len(x) > LONGEST_KEY else self.memo[x] for x in parts)
        return b"".join(map(self.memo.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._one(x) if x else b"" for x in texts]


@lru_cache(maxsize=4)
def packed_encoder(path: str) -> PackedEncoder:
    """One encoder for each vocabulary in a Python worker, kept from task to task."""
    return PackedEncoder(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
