"""Token ids of whole texts, with caches of encoded words."""

from __future__ import annotations

import os
import sys
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: How the byte-level tokenizer cuts a text before it merges bytes (a fixed value of its vocabulary).
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space other than single blanks and line ends between words.
_OTHER_SPACE = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace() and chr(i) not in " \n"]
#: Signs that end words and are one piece together; no apostrophe, which may start a piece with letters.
_ENDING = ".,;:!?$%&*#)\"-"
#: Words kept per worker and cache. It bounds memory only: a word that was let go is encoded again.
CACHE_WORDS = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it is visible, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}


class WordEncoder:
    """Ids of texts as little-endian bytes.

    The byte-level pattern never joins a letter, digit or mark to white space after it, so a text
    of words between single blanks and line ends falls apart into words with the blank before
    them. Most of those were seen before, if not with the signs after them. Any other text is cut by the pattern itself. Texts that
    hold an added token of the tokenizer, and whole texts of a tokenizer of another kind, go through
    the library's own pipeline.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [re.escape(x.content) for x in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)).search if added else None
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        probe = " a b1\n\nc  d's ._.\té"
        self.merge, self.letters = self.whole.model.tokenize, _byte_letters()
        self.blank = self.letters[32]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.bytewise = sys.byteorder == "little" and self._cut(probe) == self._whole([probe])[0]

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _piece(self, piece: str) -> bytes:
        # A blank and letters are a word of their own, so they are kept as one and not here too.
        if piece[0] == " " and piece[1:].isalpha():
            return self.words.get(piece[1:]) or self._word(piece[1:])
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._merged(piece)
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [x.id for x in self.merge(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word, new to the worker or not kept, with the blank before it."""
        if word.isalpha():
            # Most letters of one byte stand for themselves.
            spelt = self.blank + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
            ids = array(self.code, [x.id for x in self.merge(spelt)]).tobytes()
        else:
            bare = word.rstrip(_ENDING)
            rest = word[len(bare):]
            if rest and bare.isalpha():
                # Letters, then signs: two pieces, each kept; the pair is not, so the kept words last longer.
                get = self.words.get
                return (get(bare) or self._word(bare)) + (self.pieces.get(rest) or self._piece(rest))
            else:
                ids = self._cut(word if word[0] == "\n" else " " + word)
        return self._kept(word, ids)

    def _cut(self, text: str) -> bytes:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self._piece(text)
        return b"".join(map(self._piece, _PIECES.findall(text)))

    def _kept(self, word: str, ids: bytes) -> bytes:
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        self.words[word] = ids
        return ids

    def _words(self, text: str) -> list[str] | None:
        """The words with their blank or line end before them, or None if the text has other white space."""
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(map(text.__contains__, _OTHER_SPACE)):
            return None
        if not text or text[0] in " \n" or text[-1] in " \n":
            return None
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.bytewise:
            return self._whole(texts)
        out = []
        for text in texts:
            if self.added and self.added(text):
                out += self._whole([text])
                continue
            words = self._words(text)
            if words is None:
                out.append(self._cut(text) if text else b"")
                continue
            get = self.words.get
            found = list(map(get, words))
            found[0] = self._cut(words[0])
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        w = words[i]
                        # A word may be new to the text twice.
                        found[i] = get(w) or self._word(w)
            out.append(b"".join(found))
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer: the next task of the worker finds the words of the one before."""
    return WordEncoder(path)


def text_groups(texts: list[str], chars: int = 500_000):
    """Ranges of neighbouring texts of about `chars` characters, so that work in hand stays small."""
    start, size = 0, 0
    for at, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)
