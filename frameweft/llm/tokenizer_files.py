"""Where the public tokenizers' files are; they are read in place and never copied."""

from __future__ import annotations


def path_of(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
