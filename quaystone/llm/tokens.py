"""Token ids by a public byte-level BPE.

The ids are those of the tokenizer in the JSON file. Where its merges are in the order of its ids, as they are in the published vocabulary,
the same BPE runs in the faster of the two public libraries, on the vocabulary of that very file. Texts with characters on which two Unicode
versions could differ, or with the spelling of a special token, go through the tokenizer itself, and so does all if the order differs.
"""

from __future__ import annotations

import array
import json
from collections.abc import Iterator

import regex

#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRETOKEN = regex.compile(PATTERN)
UNSURE = regex.compile("[^\x00-ɏ‐-‧]|<\\|")
#: Most pre-tokens in a worker's cache, and the longest that is kept.
CACHE, LONGEST = 400_000, 64


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The published spelling of bytes in a byte-level vocabulary: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    return out | {chr(0x100 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def fast_bpe(path: str):
    """The file's vocabulary in tiktoken, if rank by id is rank by merge; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], model["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    made = [vocab.get(a + b, -1) for a, b in pairs]
    if made != list(range(256, 256 + len(made))):
        return None
    of = byte_alphabet()
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if i < 256 + len(made)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe


class Encoder(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit bytes; ``encode`` does so for a text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = fast_bpe(path)

        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def special(self, text: str) -> bool:
        """Whether a special token's spelling is in the text, which the tokenizer cuts out before anything else."""
        return any(x in text for x in self.specials)

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Places of the pre-tokens: by the pattern, or by the tokenizer itself where Unicode versions may differ on a character."""
        if not UNSURE.search(text):
            return (m.span() for m in PRETOKEN.finditer(text))
        return (place for _, place in self.tokenizer.pre_tokenizer.pre_tokenize_str(text))

    def whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or UNSURE.search(text):
            return self.whole(text)
        return array.array("I", self.fast.encode_ordinary(text)).tobytes()

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = out
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
