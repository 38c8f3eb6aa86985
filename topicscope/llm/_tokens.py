"""Public tokenizer files as encoders, loaded once per Python worker.

The byte-level file is read as JSON.  Where its ids follow its merge order, the
ids are found by ``tiktoken`` from the same vocabulary, at several times the speed
of ``tokenizers`` (tests compare the two on every code point and on whole tables);
any other byte-level file is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

import numpy as np


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the sign of its own code point if
    that is printable Latin-1, and else as the next sign from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    out = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in set(printable)):
        out[chr(256 + i)] = b
    return out


@lru_cache(maxsize=4)
def _byte_level_file(path: str) -> tuple[dict[str, int], list, dict[str, int], dict]:
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    added = {t["content"]: t["id"] for t in data["added_tokens"]}
    return data["model"]["vocab"], data["model"]["merges"], added, data


@lru_cache(maxsize=4)
def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary; added tokens as their text."""
    vocab, _, added, _ = _byte_level_file(path)
    sign = _byte_of_sign()
    out = [b""] * (1 + max([*vocab.values(), *added.values()]))
    for token, i in vocab.items():
        out[i] = token.encode() if token in added else bytes(sign[c] for c in token)
    for token, i in added.items():
        out[i] = token.encode()
    return out


def _ids_follow_merges(path: str) -> bool:
    vocab, merges, added, data = _byte_level_file(path)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    plain = (data["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not data["pre_tokenizer"]["add_prefix_space"]
    loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in data["added_tokens"])
    return plain and not loose and data["normalizer"] is None and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))


@lru_cache(maxsize=4)
def byte_level_encoder(path: str, special: bool) -> Callable[[str], np.ndarray]:
    """text -> ids (uint32).  ``special`` says whether the strings of special tokens
    inside a text become their ids (the library's default) or stay plain text."""
    if _ids_follow_merges(path):
        import public_tokenizers
        import tiktoken

        added = _byte_level_file(path)[2]
        ranks = {b: i for i, b in enumerate(byte_level_bytes(path)) if i not in set(added.values())}
        enc = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        if special:
            return lambda text: enc.encode_to_numpy(text, allowed_special="all")
        return lambda text: enc.encode_to_numpy(text, disallowed_special=())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = not special
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=4)
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every piece: its UTF-8 with U+2581 as a space; byte pieces as
    their byte; control pieces as nothing."""
    sp = piece_model(path)
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            out.append(bytes([int(p[3:5], 16)]))
        else:
            out.append(b"" if sp.is_control(i) else p.replace("▁", " ").encode())
    return out
