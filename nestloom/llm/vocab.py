"""Vocabulary files, loaded once in each Python worker. They are named by path and never copied here."""

from __future__ import annotations

import base64
import functools

import public_tokenizers


def path(name: str) -> str:
    return public_tokenizers.path(name)


PATTERN = public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def byte_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=4)
def word_tokenizer(file: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def piece_model(file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=file)
