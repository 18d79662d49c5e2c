"""Token ids of whole texts with a public byte-level BPE: each distinct word piece is encoded once a task."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

_TWO_BLANKS = re.compile(r"\s\s")
#: Fixed value: where byte-level BPE cuts a text before it merges.
_PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHORT = 200


def _by_rank(path: str):
    """An encoder of short texts by the ranks of a byte-level BPE file, or None where its merges aren't in the order of their ids or it cuts texts otherwise. It takes a third of the time on single words, with the same ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, cut = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer") or made != sorted(made):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes are written as themselves, the others as the characters from 256 on
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    added = {x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocab.items() if i not in added}
    return tiktoken.Encoding("by_rank", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class TokenBytes(dict):
    """What follows a blank -> its ids as little-endian unsigned 32-bit bytes. Forgets all once they and their ids take `limit` bytes.

    The tokenizer cuts a text before each blank that stands between two other characters, and around each line feed that does, and
    never merges across these cuts; so what lies between them has the same ids in any text. Texts with two white-space characters
    in a row are encoded as a whole.
    """

    def __init__(self, path: str, limit: int = 64 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit, self.size = limit, 0
        self.short = _by_rank(path)

    def _words(self, texts: list[str]) -> list[bytes]:
        """As _ids, for texts of a word or so."""
        if self.short is None:
            return self._ids(texts)
        out = [array("I", self.short(t)).tobytes() if len(t) <= _SHORT else b"" for t in texts]
        long = [k for k, t in enumerate(texts) if len(t) > _SHORT]
        for k, ids in zip(long, self._ids([texts[k] for k in long])):
            out[k] = ids
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; a null one has none. Parts that are new to this task are encoded together."""
        out: list[bytes] = [b""] * len(texts)
        whole, parts = [], {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if text[0].isspace() or text[-1].isspace() or _TWO_BLANKS.search(text):
                whole.append(k)
            else:
                parts[k] = text.replace("\n", " \n").split(" ")
        for k, ids in zip(whole, self._ids([texts[k] for k in whole])):
            out[k] = ids
        if self.size > self.limit:
            self.clear()
            self.size = 0
        firsts = self._words([p[0] for p in parts.values()])
        found = [list(map(self.get, p[1:])) for p in parts.values()]
        new = list({w for p, ids in zip(parts.values(), found) if None in ids for w, x in zip(p[1:], ids) if x is None})
        made = self._words([p if p[0] == "\n" else " " + p for p in new])
        self.update(zip(new, made))
        self.size += sum(map(len, new)) * 4 + sum(map(len, made)) + 200 * len(new)  # four bytes a character at most, and the objects themselves
        for (k, p), first, ids in zip(parts.items(), firsts, found):
            out[k] = first + b"".join(map(self.__getitem__, p[1:]) if None in ids else ids)
        return out


@lru_cache(maxsize=2)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)
