"""Byte-level BPE encoding by a table of distinct space-delimited chunks."""

from __future__ import annotations

import json
import struct

import numpy as np

#: The pre-tokenization of the byte-level vocabulary (its library's built-in pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other bytes follow from U+0100."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _fast(path: str):
    """tiktoken over the file's own vocabulary, if its ids are in merge order (else None)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, of = spec["model"], byte_of_char()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not plain or model.get("end_of_word_suffix") or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(of[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in of for c in piece) and i < 256 + len(merges)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class ChunkEncoder(dict):
    """Token ids of a text as little-endian unsigned 32-bit bytes, as Tokenizer.encode(text, add_special_tokens=False).

    The vocabulary's pattern never joins characters across a single space or line feed that stands between
    visible characters, so a text is encoded chunk by chunk and each distinct chunk once per worker (the dict
    holds the ids of a chunk with its leading space). A text with other white space, runs of it, or an added
    token's string goes to the library whole. The dict is emptied when it holds `limit` chunks.
    """

    limit = 700_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = _fast(path)

    def plain(self, text: str) -> bytes:
        """Ids of a text that holds no added token."""
        if self.fast:
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ids = self[chunk] = self.plain(chunk if chunk[:1] == "\n" else " " + chunk)
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if any(a in text for a in self.added):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if text.replace("\n", " ").split(" ") != text.split():  # other white space, or runs of it
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return self.plain(first) + b"".join(map(self.__getitem__, rest))

    def count(self, text: str) -> int:
        """The number of tokens of a text, which may begin with a space (as a leaf of a document does)."""
        if text[:1] != " ":
            return len(self.encode(text)) // 4
        if any(a in text for a in self.added) or text[1:].replace("\n", " ").split(" ") != text.split():
            return len(self.encode(text)) // 4
        return sum(map(len, map(self.__getitem__, text[1:].replace("\n", " \n").split(" ")))) // 4


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
