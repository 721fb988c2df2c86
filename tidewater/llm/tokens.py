"""Token ids of whole texts.

`Ids` gives what a tokenizer file's own library gives with `add_special_tokens=False`. Where the file is a byte-level
BPE whose ids follow its merges, a rank-based engine over the same vocabulary yields the same ids at a third of the
cost; other files, and texts which that engine refuses (some 100,000 blanks on end), go through the library.

`Packer` is for functions that encode one string at a time, such as our own BPE: units between single spaces are cached.
The public pattern never matches across a lone space's left side, nor on either side of a lone newline, so a text
whose only white space is lone spaces and lone newlines splits there without changing its ids. Other texts are cut
only at spaces between two non-blank characters. Ids are packed (little-endian unsigned 32-bit).
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np

#: Units kept at once by one worker, and the longest one that is kept: together the bound on the cache's memory.
LIMIT, LONGEST = 1_000_000, 48
_LONE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE files write each byte: itself if printable, else the next beyond 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return {chr(b if b in plain else next(other)): b for b in range(256)}


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id of a tokenizer file whose ids are the ranks of its merges; None for any other kind of file."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    split = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    added = all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec.get("added_tokens", []))
    if not (usual and split and added) or spec.get("normalizer"):
        return None
    letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    try:
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
        merged = [ranks[bytes(map(letters.__getitem__, "".join(m) if isinstance(m, list) else m.replace(" ", "")))] for m in model["merges"]]
    except KeyError:
        return None
    return ranks if merged == list(range(256, 256 + len(merged))) and len(ranks) == 256 + len(merged) else None


class Ids:
    """Text -> ids (unsigned 32-bit array), as the library of the tokenizer file at `path` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text("utf-8"))
        ranks, self.fast = plain_ranks(spec), None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            engine = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec.get("added_tokens", [])})
            self.fast = lambda text: engine.encode_to_numpy(text, allowed_special="all")

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast(text)
            except ValueError:  # too many blanks on end for its pattern
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


class Units(dict):
    """unit -> packed ids, computed on a miss; emptied when full. A unit has a space before it, or begins with a newline."""

    def __init__(self, ids_of: Callable[[str], Iterable[int]]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, unit: str) -> bytes:
        packed = array("I", self.ids_of(unit if unit[:1] == "\n" else " " + unit)).tobytes()
        if len(unit) <= LONGEST:
            if len(self) >= LIMIT:
                self.clear()
            self[unit] = packed
        return packed


class Packer:
    """Text -> packed ids, given a function from a string to its ids."""

    def __init__(self, ids_of: Callable[[str], Iterable[int]]):
        self.ids_of, self.units = ids_of, Units(ids_of)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split()
        # No two blanks meet, none is at an end, and each is a space or a newline.
        if len(" ".join(words)) == len(text) and text.count(" ") + text.count("\n") == len(words) - 1:
            head, *rest = text.replace("\n", " \n").split(" ")
        else:
            head, *rest = _LONE.split(text)
        return array("I", self.ids_of(head)).tobytes() + b"".join(map(self.units.__getitem__, rest))
