"""Token ids as the ``tokenizers`` library gives them for a vocabulary file, read in bounded slices.

Plain byte-level BPE files are encoded with ``tiktoken``, which gives the same ids from the same
merges several times faster and keeps no words; any other file goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import numpy as np

SLICE = 1 << 20
#: The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the others counted on from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTER_BYTES = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
# Fixed value: where byte-level BPE cuts a text before it merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary by bytes if the file is plain byte-level BPE whose merges are in the order of their ids, else None."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cutter = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or file.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
        return None
    added, vocab = {t["content"] for t in file.get("added_tokens", [])}, model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged):
        return None
    return {bytes(LETTER_BYTES[c] for c in word): i for word, i in vocab.items() if word not in added}


def slices(text: str) -> Iterator[str]:
    """Parts of about ``SLICE`` characters, cut before a space with a letter or digit on both sides, where tokens end too."""
    at = 0
    while len(text) - at > SLICE:
        end = text.find(" ", at + SLICE)
        while end > 0 and not (text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()):
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def encoder(path: str) -> Callable[[str], bytes]:
    """A function of a text: its ids as little-endian unsigned 32-bit numbers; names of special tokens are ordinary text."""
    ranks = byte_level_ranks(path)
    if ranks is not None:
        import tiktoken

        encode = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def encode(text: str) -> list[int]:
            return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    return lambda text: b"".join(np.array(encode(s), dtype="<u4").tobytes() for s in slices(text))
