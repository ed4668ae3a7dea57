"""The tokenizers of the public vocabulary files, opened once per Python worker by path."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

SPECIAL = "<|endoftext|>"


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def rank_encoder(path: str):
    """The same byte-level BPE from its table of ranks; gives the ids of the .json file faster."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: len(ranks)})


def groups(texts, most: int = 1 << 20):
    """Lists of texts of about `most` letters, so that the encodings of one call stay small."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def counts(path: str, texts) -> list[int]:
    t = tokenizer(path)
    return [len(e) for g in groups(texts) for e in t.encode_batch_fast(g, add_special_tokens=False)]
