"""Token ids by a public word-level BPE file, with a bounded cache of words.

The tokenizer lower-cases, drops white space and never joins characters across it, so a text's ids are those of its
words one after another. Most words repeat: a task looks them up and hands the tokenizer only the new words of some
texts, all in one call, whose character offsets tell the words apart again.

Words of small letters, most of the new ones, need no normalising and are one unit each. Their merges are run by a faster
library on the same vocabulary, which joins the neighbours whose union has the least id. That is the same as the merges in
their order if these hold (a test reads the whole file for them): each token has one merge, ids ascend with the merges, and
every token taken alone is merged to itself. For then the parts of a token that meet inside a word are those of its one merge.
"""

from __future__ import annotations

import json
import re

import numpy as np

from colloquy.llm.words import CACHES, chunks

#: Words of small letters alone are one unit for the tokenizer, whose last id ends a word; marks after a letter or digit are a unit of their own.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
MARKS = b".,;:!?#$%&*()"
BEFORE_MARKS = re.compile(rb"(?:[a-z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])\Z")
#: Longer words of letters go to the tokenizer, whose merges take less than the square of a word's length.
LETTERS_BYTES = 256
#: Stands for the end of a word in the vocabulary as bytes.
END, END_NAME = b" ", "</w>"

WORD_FILE = "word_bpe_49k.json"
CACHE_WORDS = 600_000
CHUNK = 1 << 22
CALL_WORDS = 1 << 16


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token (bytes, END after a word's last) to id. Tokens of white space and special tokens, which no word has, are left out."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    found = {}
    for name, i in names.items():
        if not name.startswith("<|"):
            body = bytes(byte_of[c] for c in name.removesuffix(END_NAME))
            if body and END not in body:
                found[body + END * name.endswith(END_NAME)] = i
    return found


class WordIds(dict):
    """Word (bytes) to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = byte_vocabulary(path)
        last = max(vocabulary.values())
        self.ends = np.zeros(last + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith(END)]] = True
        self.letters = Encoding("words of letters", pat_str=r"\S+ ", mergeable_ranks=vocabulary | {END: last + 1}, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[bytes]) -> None:
        """Ids of new words. Marks at a word's end are learnt apart; words with characters of the tokenizer's own marks go to it one by one."""
        plain, other, tailed = [], [], []
        for w in words:
            core = w.rstrip(MARKS)
            if LETTERS.fullmatch(core):
                if len(core) < len(w):
                    tailed.append((w, core, w[len(core):]))
                else:
                    (plain if len(w) <= LETTERS_BYTES else other).append(w)
            elif b"<|" in w:
                self[w] = self.encode(w.decode()).tobytes()
            elif len(core) < len(w) and BEFORE_MARKS.search(core):
                tailed.append((w, core, w[len(core):]))
            else:
                other.append(w)
        for p in {p for _, *two in tailed for p in two if p not in self}.difference(plain, other):
            (plain if len(p) <= LETTERS_BYTES and LETTERS.fullmatch(p) else other).append(p)
        for lo in range(0, len(plain), CALL_WORDS):
            part = plain[lo:lo + CALL_WORDS]
            ids = np.asarray(self.letters.encode_ordinary((END.join(part) + END).decode()), "<u4")
            self._keep(part, ids, np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]))
        for lo in range(0, len(other), CALL_WORDS):
            part = other[lo:lo + CALL_WORDS]
            texts = b" ".join(part).decode()
            found = self.tokenizer.encode(texts, add_special_tokens=False)
            begin = np.fromiter(map(len, texts.split(" ")), np.int64, len(part)) + 1
            begin = np.cumsum(begin) - begin
            at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            self._keep(part, np.asarray(found.ids, "<u4"), np.append(np.searchsorted(at, begin), len(at)))
        for w, core, tail in tailed:
            self[w] = self[core] + self[tail]

    def _keep(self, words: list[bytes], ids: np.ndarray, cut: np.ndarray) -> None:
        at, ids = (cut * 4).tolist(), ids.tobytes()
        self.update(zip(words, [ids[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], strict=True))

    def texts_ids(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of UTF-8 texts; null counts as empty. Beyond CACHE_WORDS, new words are kept for these texts only."""
        out = []
        for lo, hi in chunks(texts, CHUNK):
            split = [(t if b"<|" in t else t.lower()).split() if t else [] for t in texts[lo:hi]]
            new = [w for w in set().union(*split) if w not in self]
            self.learn(new)
            out += [b"".join(map(self.__getitem__, words)) for words in split]
            if len(self) > CACHE_WORDS:
                for w in new:
                    del self[w]
        return out

    def text_ids(self, text: bytes | None) -> bytes:
        return self.texts_ids([text])[0]


LOADED: dict[str, WordIds] = {}
CACHES.append(LOADED)


def word_ids(path: str) -> WordIds:
    """One per worker process."""
    if path not in LOADED:
        LOADED[path] = WordIds(path)
    return LOADED[path]


def public_path(name: str = WORD_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
