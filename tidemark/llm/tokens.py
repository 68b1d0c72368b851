"""Token ids of a byte-level BPE vocabulary, as bytes, with a memory of words."""

import json
import re
from functools import lru_cache

import numpy as np

#: GPT-2's split pattern, which the vocabulary's pre-tokenizer applies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where splitting at single blanks could part white space that the pattern keeps together.
AWKWARD = re.compile(r"\s (?:\s|$)")
MOST_WORDS = 250_000
LONGEST_WORD = 48


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Tokens:
    """Encodes as the ``tokenizers`` library does with the same file and add_special_tokens=False.

    A vocabulary whose ids follow the order of its merges is encoded by the faster tiktoken library, others by
    ``tokenizers``. White space that stands alone parts a text into words whose ids don't depend on each other;
    a bounded number of them is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        ordered = [vocabulary.get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs)))
        pre = spec.get("pre_tokenizer") or {}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special, self.words = tuple(special), {}
        if ordered and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer"):
            import tiktoken

            ranks = {bytes(symbols[c] for c in t): i for t, i in vocabulary.items() if t not in special}
            fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.plain, self.all, self.remember = fast.encode_ordinary, lambda t: fast.encode(t, allowed_special="all"), True
        else:
            slow = Tokenizer.from_file(path)
            self.plain = self.all = lambda t: slow.encode(t, add_special_tokens=False).ids
            self.remember = False

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit values."""
        if any(s in text for s in self.special):
            return np.array(self.all(text), "<u4").tobytes()
        if not self.remember or AWKWARD.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        words, plain = self.words, self.plain
        parts = text.split(" ")
        out = [np.array(plain(parts[0]), "<u4").tobytes()]
        add = out.append
        for w in parts[1:]:
            ids = words.get(w)
            if ids is None:
                ids = np.array(plain(" " + w), "<u4").tobytes()
                if len(w) <= LONGEST_WORD:
                    if len(words) >= MOST_WORDS:
                        words.clear()
                    words[w] = ids
            add(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One for each vocabulary and Python worker."""
    return Tokens(path)
