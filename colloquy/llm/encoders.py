"""Ids by public tokenizer libraries, the way the operators need them inside tasks."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

#: Letters beyond these blocks are left to the tokenizers library itself.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧€]*\Z")
#: So is a text with a run of so many characters without or of white space: the faster library gives up on very long ones.
RUN = 4096
_SPACES = re.compile(rf"(?<!\s)\s{{{RUN}}}")


def has_long_run(text: str) -> bool:
    if len(text) < RUN:
        return False
    words = text.split()
    sizes = list(map(len, words))
    return max(sizes, default=0) >= RUN or len(text) - sum(sizes) - len(words) >= RUN - 2 and _SPACES.search(text) is not None


class Encoder:
    """Ids of byte_bpe_50k.json by the tokenizers library, add_special_tokens=False.

    The same vocabulary lies beside it as ranks, for a library that is several
    times faster; texts of Latin letters without very long runs take that way, and
    go back to the first one if it fails (the tests compare both). Without
    ``specials`` the strings of special tokens are plain text.
    """

    def __init__(self, path: str | None = None, ranks_path: str | None = None, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.exact.encode_special_tokens = not specials
        self.fast, self.specials = None, [t.content for t in self.exact.get_added_tokens_decoder().values()] if specials else []
        if path is None or ranks_path:
            with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()} if specials else {}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and (text.isascii() or _PLAIN.match(text)) and not has_long_run(text):
            try:
                if self.specials and any(t in text for t in self.specials):
                    return self.fast.encode(text, allowed_special="all", disallowed_special=())
                return self.fast.encode_ordinary(text)
            except Exception:  # the exact library takes every text
                pass
        return self.exact.encode(text, add_special_tokens=False).ids


@lru_cache(4)
def encoder(path: str | None = None, ranks_path: str | None = None, specials: bool = True) -> Encoder:
    """A worker reads a tokenizer once for all its tasks."""
    return Encoder(path, ranks_path, specials)
