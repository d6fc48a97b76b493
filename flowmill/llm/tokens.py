"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: The vocabulary's pre-token patterns. The second equals the first on texts without two
#: neighbouring white-space characters; it needs no look-ahead, which makes encoding about twice as fast.
FULL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"

_RARE_ASCII = "\t\x0b\x0c\r"
_RARE = re.compile("[\x85\xa0  -     　]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Texts are encoded in parts of about so many characters, cut before a space between two other characters.
PART = 1 << 20
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


class Encoder:
    """Ids as `Tokenizer.from_file(path).encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        spec = json.loads(Tokenizer.from_file(path).to_str())
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = {c: b for b, c in _byte_chars().items()}
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in added}
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in spec["model"]["merges"]]
        if [spec["model"]["vocab"][x] for x in merged] != sorted(spec["model"]["vocab"][x] for x in merged):
            raise ValueError("the vocabulary's ids don't follow its merges")
        self.size = 1 + max([*ranks.values(), *added.values()])
        self.special = added
        self._split = re.compile("|".join(map(re.escape, added))) if added else None
        self._full, self._plain = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe for p in (FULL, PLAIN))

    def _part(self, text: str) -> list[int]:
        plain = not any(x in text for x in _PAIRS) and not any(x in text for x in _RARE_ASCII) and (text.isascii() or not _RARE.search(text))
        return (self._plain if plain else self._full).encode_ordinary(text)

    def _ordinary(self, text: str) -> Iterator[list[int]]:
        at = 0
        while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
            yield self._part(text[at : cut.start()])
            at = cut.start()
        yield self._part(text[at:] if at else text)

    def encode(self, text: str) -> array:
        ids = array("I")
        at = 0
        for found in self._split.finditer(text) if self._split and any(x in text for x in self.special) else ():
            for part in self._ordinary(text[at : found.start()]):
                ids.extend(part)
            ids.append(self.special[found[0]])
            at = found.end()
        for part in self._ordinary(text[at:] if at else text):
            ids.fromlist(part)
        return ids


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    return Encoder(path)


def ranks_of(path: str) -> dict[bytes, int]:
    """A vocabulary given as ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
