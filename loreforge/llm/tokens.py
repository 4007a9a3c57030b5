"""Token ids of whole texts by a public tokenizer, with each distinct word encoded once in a worker."""

from __future__ import annotations

import os
import re
import unicodedata
from itertools import chain

import numpy as np

#: Letters and signs after them, and the same after a line break. An apostrophe or mark may belong to what stands before it.
_SIGNS = r"[!-&(-/:-@\[-^`{-~]"
_PARTS = re.compile(rf"([^\W\d_]+)({_SIGNS}+)(?:(\n)([^\W\d_]+)({_SIGNS}*))?|([^\W\d_]+)(\n)([^\W\d_]+)({_SIGNS}*)")
#: Words kept by one cache; it is emptied then, which costs time and never ids.
CACHE_WORDS = 800_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids as little-endian unsigned 32-bit bytes. A text may be cut before a single space between two words.

    glued: the tokenizer takes that space as the start of the next word (byte-level vocabularies);
    otherwise white space is dropped and each word is encoded by itself.
    """

    _open: dict[tuple[str, bool], WordTokens] = {}

    def __init__(self, path: str, glued: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # The tokenizer finds these in a text before it cuts words, so such texts are encoded whole.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.glued = glued
        self.known: dict[str, bytes | None] = {}
        self.starting: dict[str, bytes] = {} if glued else self.known
        # In a byte-level vocabulary a space starts a word's first token; in the other its last token ends in a mark.
        self.edge = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.edge[k] = token.startswith("\u0120") if glued else token.endswith("</w>")
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    @classmethod
    def of(cls, path: str, glued: bool) -> WordTokens:
        """One for each worker process, which serves many tasks."""
        if (path, glued) not in cls._open:
            cls._open[path, glued] = cls(path, glued)
        return cls._open[path, glued]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of words of letters only: encoded as one text, and told apart by the tokens at their edges.

        spaced: with the space before them; else, where that matters, they are put on lines of their own.
        """
        lines = self.glued and not spaced
        if not words or lines and len(self.line) != 1:
            return self._ids([f" {w}" for w in words] if spaced else words)
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(["", *words]) if lines else " ".join(["", *words])], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(ids == self.line[0]) if lines else np.flatnonzero(self.edge[ids])
        if len(edges) != len(words):
            return self._ids([f" {w}" for w in words] if spaced else words)
        starts, ends = (edges + lines, np.append(edges[1:], len(ids))) if self.glued else (np.insert(edges[:-1] + 1, 0, 0), edges + 1)
        raw = ids.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(starts.tolist(), ends.tolist())]

    def _add(self, to: dict, words: set[str], spaced: bool) -> None:
        """Encodes what is new: words of letters many at a time, others each by itself."""
        new = words.difference(to)
        letters = list(filter(str.isalpha, new))
        rest = list(new.difference(letters))
        for at in range(0, len(letters), 4096):
            some = letters[at : at + 4096]
            to.update(zip(some, self._letters(some, spaced), strict=True))
        to.update(zip(rest, self._ids([f" {w}" for w in rest] if spaced else rest), strict=True))

    def _whole(self, part: str) -> bool:
        """Whether a part is signs, or letters that are as many letters still once a vocabulary without case has lowered them."""
        if self.glued or not part.isalpha():
            return part.isalpha() or not part[0].isalnum()
        low = unicodedata.normalize("NFC", part).lower()
        return len(low) == len(part) and low.isalpha()

    def _learn(self, words: set[str]) -> None:
        """Encodes words that are new here. Letters, signs after them and a line break are cut apart first, as every
        pattern of these vocabularies does.

        White space at a word's edge would join the space before or after it: such a word is kept as None.
        """
        known, starting = self.known, self.starting
        if len(known) + len(starting) > CACHE_WORDS:
            known.clear()
            starting.clear()
        new = words.difference(known)
        alone, parts = set(filter(str.isalpha, new)), {}
        for w in new.difference(alone):
            if (found := _PARTS.fullmatch(w)) and (cut := [x for x in found.groups() if x]) and (w.isascii() or all(self._whole(x) for x in cut)):
                parts[w] = cut
            elif self.glued and (not w or w[0].isspace() or w[-1].isspace()):
                known[w] = None
            else:
                alone.add(w)
        alone.update(cut[0] for cut in parts.values())
        self._add(known, alone, self.glued)
        self._add(starting, {x for cut in parts.values() for x in cut[1:]}, False)
        for w, cut in parts.items():
            known[w] = known[cut[0]] + b"".join([starting[x] for x in cut[1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        if held := [i for i, t in enumerate(texts) if any(x in t for x in self.added)]:
            whole = dict(zip(held, self._ids([texts[i] for i in held]), strict=True))
            out = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [whole[i] if i in whole else next(out) for i in range(len(texts))]
        words = [t.split(" ") for t in texts]
        self._learn(set(chain.from_iterable(w[1:] if self.glued else w for w in words)))
        get = self.known.__getitem__
        if not self.glued:
            return [b"".join(map(get, w)) for w in words]
        self._add(self.starting, {w[0] for w in words}, False)
        out = []
        for w in words:
            try:
                out.append(None if w[0][-1:].isspace() else b"".join([self.starting[w[0]], *map(get, w[1:])]))
            except TypeError:  # holds a None
                out.append(None)
        if whole := [i for i, x in enumerate(out) if x is None]:
            for i, x in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
                out[i] = x
        return out
