"""Byte-pair encoding by a given vocabulary file; nothing is trained here."""

from __future__ import annotations

import base64

#: The pre-tokenizer of the byte-level vocabulary, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read on the driver (about 1 MB); tasks get its content, so executors need no copy."""
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
