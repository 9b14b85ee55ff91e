"""Ids of a lower-casing word BPE (word ends are marked), with the codes of known words kept per task.

Texts of Latin-1 letters are split at white space, and each distinct run is encoded once with the vocabulary's ranks; the
end of a word is written as byte 0, which such texts cannot hold. All other texts (other scripts, control characters,
special tokens) go to the tokenizers library as they are.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from flowlens.llm.bpe import byte_letters

_END = "</w>"
_LOWER = bytes(
    x + 32 if 0x41 <= x <= 0x5A or (0xC0 <= x <= 0xDE and x != 0xD7) else x for x in range(256)
)
_ODD = re.compile(rb"[\x00-\x08\x0e-\x1f\x7f-\xa0]|<\|")
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
_MOST_KEPT = 400_000
_loaded: dict[str, WordBpe] = {}


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special, letters = {t["content"] for t in spec["added_tokens"]}, byte_letters()
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in special:
                ends = t.endswith(_END) and t != _END
                ranks[bytes(letters[c] for c in (t[: -len(_END)] if ends else t)) + b"\0" * ends] = i
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        self.known: dict[bytes, bytes] = {}

    def _learn(self, runs: list[bytes]) -> dict[bytes, bytes]:
        """Codes of runs without white space, little-endian unsigned 32-bit."""
        marked = _WORDS.sub("\\g<0>\0", b"\n".join(runs).decode("latin-1"))
        ids = np.array(self.encoding.encode_ordinary(marked), dtype="<u4")
        parts = np.split(ids, np.flatnonzero(ids == self.newline))
        return {r: (p[1:] if k else p).tobytes() for k, (r, p) in enumerate(zip(runs, parts, strict=True))}

    def packed(self, text: str) -> bytes:
        """All ids of a text, little-endian unsigned 32-bit."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            raw = b"<|"
        if _ODD.search(raw):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        runs = raw.translate(_LOWER).split()
        got = list(map(self.known.get, runs))
        if None in got:
            new = self._learn(list({r for r, g in zip(runs, got, strict=True) if g is None}))
            if len(self.known) + len(new) > _MOST_KEPT:
                self.known.clear()
            got = [new[r] if g is None else g for r, g in zip(runs, got, strict=True)]
            self.known.update((r, c) for r, c in new.items() if len(r) <= 64)
        return b"".join(got)


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
