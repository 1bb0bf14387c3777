"""Ids of whole texts by the vocabulary file of a public byte-level BPE."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Fixed value: how a byte-level BPE of this kind cuts a text before it merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the vocabulary: itself where it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """The ids that the ``tokenizers`` library gives, special tokens in texts included.

    The file's merges are in the order of their ids, so they can be used as
    ranks by the ``tiktoken`` library, which takes a third of the time and
    remembers nothing between texts; another kind of file is refused.  Both
    libraries cut texts alike: the tests hold them side by side.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, cutter = whole["model"], whole["pre_tokenizer"]
        signs = byte_signs()
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        ranks = {
            bytes(map(signs.__getitem__, token)): i for token, i in ids.items() if token not in special
        }
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
        plain = cutter == cutter | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if (
            not plain
            or whole["normalizer"] is not None
            or [ids["".join(pair)] for pair in merges] != list(range(256, 256 + len(merges)))
        ):
            raise ValueError(f"{path} is no byte-level BPE whose merges are in order of their ids")
        self.size = max(max(ids.values()), *special.values()) + 1
        self.special = list(special)
        self.encoding = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as unsigned 32-bit numbers."""
        if any(token in text for token in self.special):
            return np.array(self.encoding.encode(text, allowed_special="all"), "<u4")
        return np.array(self.encoding.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
