"""A bounded memory of values computed for words."""

import numpy as np


class Lexicon:
    """Arrays of values by word. It forgets everything when full, so its size is bounded whatever the corpus."""

    def __init__(self, functions: list, kinds: list, most: int = 150_000):
        self.functions, self.most, self.known = functions, most, {}
        self.columns = [np.empty(most, k) for k in kinds]

    def __call__(self, words: list) -> list[np.ndarray]:
        if len(self.known) + len(words) > self.most:
            self.known = {}
            if len(words) > self.most:
                self.most = 2 * len(words)
                self.columns = [np.empty(self.most, c.dtype) for c in self.columns]
        known, out = self.known, []
        for w in words:
            k = known.get(w)
            if k is None:
                k = known[w] = len(known)
                for f, c in zip(self.functions, self.columns, strict=True):
                    c[k] = f(w)
            out.append(k)
        at = np.array(out, dtype=np.intp)
        return [c[at] for c in self.columns]
