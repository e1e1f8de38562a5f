"""Exact ids of ``word_bpe_49k.json`` with a per-word cache, and lengths under a byte-level vocabulary.

A text's ids are those of its parts between ASCII white space one after the other: the normaliser
maps white space to one space, nothing composes across it, and no pre-token contains it. In a
text of ASCII and Latin letters the pre-tokens go through tiktoken's merge loop over the same ranks;
the end-of-word mark is one more byte that UTF-8 never uses, and joins the last byte first as its
rank is the lowest. The words of any other text go through ``tokenizers`` itself.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache
from struct import pack

import numpy as np

#: Words held by one worker; beyond that the cache starts anew.
CACHE_WORDS = 500_000
_END = b"\xff"
_SPACES = re.compile("[\\x20\\x09-\\x0d]+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    """ids(texts): for each text, an array of unsigned 32-bit ids."""

    def __init__(self, path: str) -> None:
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = _byte_of()
        ranks = {}
        for token, rank in vocabulary.items():
            ended = token.endswith("</w>")
            body = token[:-4] if ended else token
            if not all(c in byte for c in body):
                continue
            raw = bytes(byte[c] for c in body)
            if not ended and raw == _END:
                continue
            ranks[raw + _END if ended else raw] = rank
        ranks[_END] = max(ranks.values()) + 1
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.plain = re.compile("[\\x20-\\x7e\\x09-\\x0d\u00c0-\u012f\u0131-\u017e]*").fullmatch
        self.split = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u017e]+").findall
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        ids = self.core(part.encode() + _END)
        return pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        if len(self.parts) + len(self.words) > CACHE_WORDS:
            self.parts.clear()
            self.words.clear()
        for text in texts:
            text = text or ""
            if self.plain(text) and "<|" not in text:
                cache, made, parts = self.parts, self._part, self.split(text.lower())
            else:
                cache, made, parts = self.words, self._word, _SPACES.split(text)
            try:
                found = [cache[x] for x in parts]
            except KeyError:
                for x in parts:
                    if x not in cache:
                        cache[x] = made(x)
                found = [cache[x] for x in parts]
            out.append(np.frombuffer(b"".join(found), np.uint32))
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
