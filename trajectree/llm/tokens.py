"""Encoding text with a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
import re
from functools import cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: How this vocabulary's tokenizer splits text before merging (fixed by the vocabulary's format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of these characters are split alike by every version of the Unicode tables; others go to the slower library.
COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary file stands for: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Encoder:
    """Ids of a byte-level BPE vocabulary file, as the tokenizers library gives them (without special tokens added).

    Plain texts are encoded by tiktoken with the same vocabulary, which is several times faster; texts with the strings of special tokens, or with
    characters on which the libraries' Unicode tables may differ, by tokenizers itself.
    """

    def __init__(self, path: str, remembered: int = 200_000):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.special = [x["content"] for x in read["added_tokens"]]
        ranks = {bytes(_letters()[c] for c in word): i for word, i in read["model"]["vocab"].items() if word not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.around = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        #: Characters that a boundary of pre-tokens can depend on: two of the pattern, or a special token's string.
        self.reach = max(2, *map(len, self.special)) if self.special else 2
        self.counts: dict[str, int] = {}
        self.remembered = remembered

    def plain(self, text: str) -> bool:
        return COMMON.fullmatch(text) is not None and not any(x in text for x in self.special)

    def ids(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.plain(text) else self.slow.encode(text, add_special_tokens=False).ids

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, end to end; the string of a special token is one, and what lies on either side is split on its own."""
        if self.plain(text):
            return self.pattern.findall(text)
        out = []
        for k, part in enumerate(self.around.split(text) if self.around else [text]):
            if k % 2:
                out.append(part)
            elif COMMON.fullmatch(part):
                out += self.pattern.findall(part)
            else:
                out += [part[a:b] for _, (a, b) in self.slow.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def count(self, piece: str) -> int:
        """Ids of one pre-token, remembered for up to a fixed number of them."""
        n = self.counts.get(piece)
        if n is None:
            if len(self.counts) >= self.remembered:
                self.counts.clear()
            n = self.counts[piece] = len(self.ids(piece))
        return n


@cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
