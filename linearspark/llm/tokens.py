"""Public byte-level BPE tokenizers, loaded once per Python worker."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np

TOKENIZER = "byte_bpe_50k"


@cache
def _fast(name: str):
    """The vocabulary as ranks, in the library that is quickest for long texts."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _plain(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@cache
def _special(name: str) -> tuple[str, ...]:
    return tuple(t.content for t in _plain(name).get_added_tokens_decoder().values() if t.special)


def encode(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Ids of ``tokenizers`` without added special tokens.  Both libraries give
    the same ids; texts that hold a special token's string, or that the quick
    one refuses (its pattern engine has a limit for very long runs), go to the
    plain one."""
    if any(s in text for s in _special(name)):
        return np.array(_plain(name).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    try:
        return np.array(_fast(name).encode_ordinary(text), dtype=np.uint32)
    except BaseException as error:      # a Rust panic is no Exception
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        return np.array(_plain(name).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def encode_ordinary(text: str, name: str = TOKENIZER) -> np.ndarray:
    """Ids with the strings of special tokens as ordinary text."""
    try:
        return np.array(_fast(name).encode_ordinary(text), dtype=np.uint32)
    except BaseException as error:
        if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
            raise
        plain = _plain(name)
        plain.encode_special_tokens = True
        try:
            return np.array(plain.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        finally:
            plain.encode_special_tokens = False


def decode(ids: np.ndarray, name: str = TOKENIZER) -> str:
    return _fast(name).decode_bytes(ids.tolist()).decode("utf-8")
