"""Where tokenizer files are. The path is a parameter everywhere; the files stay outside the repository."""

from __future__ import annotations

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this machine (the package is installed on every executor)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
