"""Token ids of whole texts, with every distinct chunk between blanks encoded once per worker.

The vocabulary drops white space and no token crosses it, so a text's ids are those of its chunks, joined. Chunks of
plain Latin characters are cut into words here and looked up; a word seen for the first time goes to the tokenizer's
model, and a chunk with anything else (other scripts, combining marks, control strings) to the whole tokenizer.
"""

from __future__ import annotations

import sys
import types

import numpy as np

VOCABULARY = "word_bpe_49k.json"
CACHE_CHUNKS = 200_000


def vocabulary_path(path: str | None) -> str:
    """The file named, or the installed one of the public vocabularies."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class ChunkIds(dict):
    """chunk -> its ids as little-endian uint32 bytes. Emptied when it holds ``most`` chunks."""

    def __init__(self, path: str, most: int = CACHE_CHUNKS):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.most = most
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        # The vocabulary's own split pattern, and characters on which Python's and its lower case agree.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile("[!-~¡-¬®-ɏ]+").fullmatch
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(kept)]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            ids = [t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))]
            if len(self.words) >= self.most:
                self.words.clear()
            got = self.words[w] = np.array(ids, "<u4").tobytes()
        return got

    def __missing__(self, chunk: str) -> bytes:
        low = chunk.lower()
        if chunk.isascii() and low.isalpha():
            got = self.word(low)
        elif not chunk:
            got = b""
        elif not self.plain(chunk) or "<|" in chunk:
            got = np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        elif low.isalpha():
            got = self.word(low)
        elif low[:-1].isalpha() and low[-1] in ".,;:!?":
            got = self.word(low[:-1]) + self.word(low[-1])
        else:
            got = b"".join(map(self.word, self.split(low)))
        if len(self) >= self.most:
            self.clear()
        self[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def worker_cache(path: str | None) -> ChunkIds:
    """The cache of this Python worker; workers are reused, so it outlives a task."""
    path = vocabulary_path(path)
    home = sys.modules.setdefault("_chunk_ids_of_this_worker", types.ModuleType("_chunk_ids_of_this_worker"))
    made = getattr(home, "made", None)
    if made is None or made[0] != path:
        home.made = made = (path, ChunkIds(path))
    return made[1]
