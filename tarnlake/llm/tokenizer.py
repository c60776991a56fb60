"""Byte-level BPE ids. The vocabulary files stay where they are installed; their paths are parameters."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field

import numpy as np

_DOUBLE_SPACE = re.compile(r"\s\s")
#: Beyond this code point the libraries' Unicode tables could differ; such texts take the reference library.
_COMMON = "ɏ"
_UNCOMMON = re.compile(f"[^\x00-{_COMMON}]")
_CACHE: dict[tuple[str, str], "Encoder"] = {}


@dataclass
class Encoder:
    """Ids of a text under ``json_path`` (tokenizers), computed by tiktoken from the same vocabulary
    (``ranks_path``) where both are known to agree: no special-token string, only common characters."""

    json_path: str
    ranks_path: str
    pattern: str
    special: tuple[str, ...] = ("<|endoftext|>",)
    _made: dict = field(default_factory=dict, repr=False)

    def _fast(self, plain: bool):
        if plain not in self._made:
            import tiktoken

            with open(self.ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # Without two white-space characters in a row the look-ahead never matters.
            pattern = self.pattern.replace(r"\s+(?!\S)|", "") if plain else self.pattern
            self._made[plain] = tiktoken.Encoding(f"ranks{plain}", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self._made[plain]

    def _slow(self):
        if "slow" not in self._made:
            from tokenizers import Tokenizer

            self._made["slow"] = Tokenizer.from_file(self.json_path)
        return self._made["slow"]

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or _UNCOMMON.search(text):
            return np.array(self._slow().encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast(not _DOUBLE_SPACE.search(text)).encode_to_numpy(text, disallowed_special=())

    def certain(self, text: str) -> bool:
        """Whether the libraries' Unicode tables agree on all characters."""
        return not _UNCOMMON.search(text)

    def _literal(self):
        """The library's tokenizer, with special-token strings as ordinary text."""
        if "literal" not in self._made:
            from tokenizers import Tokenizer

            self._made["literal"] = Tokenizer.from_file(self.json_path)
            self._made["literal"].encode_special_tokens = True
        return self._made["literal"]

    def encode_plain(self, text: str) -> np.ndarray:
        """As ``encode``, but special-token strings are ordinary text."""
        if not self.certain(text):
            return np.array(self._literal().encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast(not _DOUBLE_SPACE.search(text)).encode_to_numpy(text, disallowed_special=())

    def cut(self, text: str) -> np.ndarray:
        """Characters of each pre-token of a text."""
        if self.certain(text):
            return np.fromiter(map(len, self.pieces().findall(text)), np.int64)
        return np.array([b - a for _, (a, b) in self._literal().pre_tokenizer.pre_tokenize_str(text)], np.int64)

    def count(self, text: str, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, from one pass over the text."""
        if not len(lengths):
            return np.zeros(0, np.int64)
        if not self.certain(text):
            return np.bincount(np.array(self._literal().encode(text, add_special_tokens=False).word_ids, np.int64), minlength=len(lengths))
        ends, token_ends = np.cumsum(lengths), np.cumsum(self.token_bytes()[self.encode_plain(text)])
        if not text.isascii():
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(1 + (code > 0x7F) + (code > 0x7FF))[ends - 1]
        return np.diff(np.searchsorted(token_ends, ends, "right"), prepend=0)

    def token_bytes(self) -> np.ndarray:
        """Bytes of each id."""
        if "bytes" not in self._made:
            t = self._fast(True)
            self._made["bytes"] = np.array([len(t.decode_single_token_bytes(i)) for i in range(t.n_vocab)], np.int64)
        return self._made["bytes"]

    def pieces(self):
        """The compiled pattern that cuts a text before merging."""
        if "pieces" not in self._made:
            import regex

            self._made["pieces"] = regex.compile(self.pattern)
        return self._made["pieces"]


def byte_bpe(json_path: str | None = None, ranks_path: str | None = None) -> Encoder:
    """The encoder of this process for the given files; by default the installed public 50k vocabulary."""
    import public_tokenizers as P

    key = (json_path or P.path("byte_bpe_50k.json"), ranks_path or P.path("byte_bpe_50k.tiktoken"))
    if key not in _CACHE:
        _CACHE[key] = Encoder(*key, P.PATTERN)
    return _CACHE[key]
