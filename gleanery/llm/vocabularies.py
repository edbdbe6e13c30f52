"""Where the files of public tokenizers lie; operators take paths, only the queries look here."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
