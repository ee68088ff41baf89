"""Token ids of texts, as the tokenizers library gives them for a byte-level BPE file.

Most texts take a faster way to the same ids: a rank table of the same vocabulary.
The two ways split words by Unicode classes that differ between Unicode versions,
and only the first reads special tokens in texts; texts with characters outside
long-settled blocks, or with a special token, therefore take the first.
"""

from __future__ import annotations

import re

#: Characters whose classes have been the same in every Unicode version that the two libraries know.
_SETTLED = re.compile("[^\\x00-\\x1B\\x20-\\x7E\\xA0-\\u0377\\u0400-\\u052F\\u2010-\\u2027\\u2030-\\u205E\\u3041-\\u3096\\u30A1-\\u30FA\\u4E00-\\u9FA5\\uAC00-\\uD7A3]")
#: One encoder for each file.
_cache: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.slow.get_vocab().items() if token not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = re.compile("|".join(map(re.escape, sorted(added)))) if added else None

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _SETTLED.search(text) or self.special and self.special.search(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast(text)


def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker."""
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]
