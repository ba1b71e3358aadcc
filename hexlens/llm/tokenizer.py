"""Byte-level BPE token ids of whole texts, from a public vocabulary file.

The file is a ``tokenizers`` JSON.  The ids are those of
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``: the string
of an added token in a text is that token.  Where the file is plain byte-level
BPE whose ids follow the merge order, the same merges run in ``tiktoken``,
which is several times as fast; texts with the string of an added token, those
with characters beyond Latin Extended-B, for which the two libraries' Unicode
classes could differ, and other files go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Fixed value: the split pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
UNUSUAL = re.compile("[^\x00-ɏ]")


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.added}
        pieces = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        pre = spec.get("pre_tokenizer") or {}
        plain = (model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                 and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("ignore_merges")
                 and all(vocab.get(a + b) == 256 + k for k, (a, b) in enumerate(merges)))
        self.fast = None
        if plain:
            import tiktoken
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, special_tokens={},
                                          mergeable_ranks={b: i for i, b in pieces.items()})
        #: bytes of text behind each id (byte-level BPE loses none)
        self.widths = np.zeros(max((*pieces, *self.added.values())) + 1, np.int64)
        for i, b in pieces.items():
            self.widths[i] = len(b)
        for t, i in self.added.items():
            self.widths[i] = len(t.encode())

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def ids(self, text: str) -> list[int]:
        if self.fast is None or UNUSUAL.search(text) or any(t in text for t in self.added):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def ends(self, text: str) -> np.ndarray:
        """Byte ends of the tokens of a text."""
        if not any(t in text for t in self.added):
            return np.cumsum(self.widths[np.array(self.ids(text), np.int64)])
        got = self.slow.encode(text, add_special_tokens=False)
        ids = np.array(got.ids, np.int64)
        widths, known = self.widths[ids], np.fromiter(self.added.values(), np.int64)
        for k in np.flatnonzero(np.isin(ids, known)):  # an added token may take the white space beside it
            a, z = got.offsets[k]
            widths[k] = len(text[a:z].encode())
        return np.cumsum(widths)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
