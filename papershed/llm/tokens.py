"""Token ids of whole texts, from a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array
from pathlib import Path

import numpy as np

#: Words whose ids a worker remembers, some 200 bytes each; once it is full, new words are forgotten after their batch.
WORDS_KEPT = 400_000
#: Characters of text whose words are in memory at once, but for a single longer text.
BATCH_CHARS = 3_000_000

#: Byte-level vocabularies write a byte outside the printable ones as a code point from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
BYTE_SPACE = chr(BYTE_LETTERS[32])
#: Latin letters up to U+012F, which have no combining forms and a lower case that doesn't depend on their place, and up to 8 ASCII signs after them.
_LETTERS_AND_SIGNS = re.compile(r"([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-/:-@\[-^`{-~]{0,8})")

_MADE: dict[tuple, "Encoder"] = {}


def specification(path: str) -> str:
    """The tokenizer file's text, read where the job is planned and sent along with it."""
    return Path(path).read_text()


class Encoder:
    """Encodes texts word by word and remembers the ids of words.

    A text is cut at single spaces, which is where these tokenizers cut as well, so the ids
    of the parts, in order, are the ids of the text. ``spaces`` says what becomes of them:
    ``dropped``, or ``leading`` if a space belongs to the word after it. Where a part is empty
    or has white space at an end, runs of white space could be cut otherwise, and parts with
    an added token are read ahead of the words: such a text is encoded as a whole. A new word
    of Latin letters, with or without signs after it, goes straight to the tokenizer's model.
    """

    def __init__(self, spec: str, spaces: str, words_kept: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.words_kept = words_kept or WORDS_KEPT
        self.tokenize = self.tokenizer.model.tokenize
        self.lead = " " if spaces == "leading" else ""
        self.lowers = '"Lowercase"' in spec
        self.marks: dict[str, bytes] = {}
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words: dict[str, bytes | None] = {}
        self.firsts: dict[str, bytes | None] = {}
        self.others: list[str] = []

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]

    def _word_ids(self, lead: str, letters: str) -> bytes:
        """Ids of a run of Latin letters, which is one word for the model."""
        if self.lowers:
            letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.tokenize(BYTE_SPACE + letters if lead else letters)]).tobytes()

    def _mark_ids(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._ids([mark])[0]
        return self.marks[mark]

    def _plain(self, known: dict, lead: str, word: str, made: list[str]) -> bytes | None:
        """Ids of Latin letters with or without signs after them, or of such words parted by line ends; else None.

        The letters alone are remembered too, as the same word comes with different signs.
        """
        if found := _LETTERS_AND_SIGNS.fullmatch(word):
            letters, signs = found.groups()
            ids = known.get(letters)
            if ids is None:
                ids = known[letters] = self._word_ids(lead, letters)
                made.append(letters)
            return ids + self._mark_ids(signs) if signs else ids
        if "\n" in word and self.lead:
            parts = word.split("\n")
            found = [self._plain(*((self.firsts, "") if i else (known, lead)), p, self.others if i else made) if p else None for i, p in enumerate(parts)]
            return None if None in found else self._mark_ids("\n").join(found)
        return None

    def _learn(self, known: dict, lead: str, words: set[str]) -> list[str]:
        """Makes all the words known; returns those to forget after the batch."""
        hard, new, made = [], words.difference(known), []
        room = self.words_kept - len(known)
        matched, get, word_ids, marks = _LETTERS_AND_SIGNS.fullmatch, known.get, self._word_ids, self.marks
        for w in new:
            if found := matched(w):  # the common case of _plain, without its calls
                letters, signs = found.groups()
                ids = get(letters)
                if ids is None:
                    ids = known[letters] = word_ids(lead, letters)
                    if signs:
                        made.append(letters)
                if signs:
                    known[w] = ids + (marks.get(signs) or self._mark_ids(signs))
                continue
            ids = self._plain(known, lead, w, made)
            if ids is not None:
                known[w] = ids
            elif self.lead and (not w or w[0].isspace() or w[-1].isspace()) or any(a in w for a in self.added):
                known[w] = None
            else:
                hard.append(w)
        known.update(zip(hard, self._ids([lead + w for w in hard])))
        return [*new.union(made)] if len(new) + len(made) > room else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        start = size = 0
        for at, text in enumerate(texts):
            if size and size + len(text) > BATCH_CHARS:
                out += self._encode(texts[start:at])
                start, size = at, 0
            size += len(text)
        return out + self._encode(texts[start:])

    def _encode(self, texts: list[str]) -> list[bytes]:
        parts = [(t if self.lead else t.replace("\n", " ")).split(" ") for t in texts]
        firsts = [p.pop(0) for p in parts]
        once = [(self.firsts, self._learn(self.firsts, "", set(firsts))), (self.words, self._learn(self.words, self.lead, set().union(*parts)))]
        out: list[bytes] = []
        for text, first, rest in zip(texts, firsts, parts):
            try:
                out.append(b"".join([self.firsts[first], *map(self.words.__getitem__, rest)]))
            except TypeError:  # a part that must not be encoded alone
                out.append(self._ids([text])[0])
        if len(self.firsts) > self.words_kept // 4:
            once.append((self.firsts, self.others))
            self.others = []
        for known, words in once:
            for w in words:
                known.pop(w, None)
        return out


def slices(batch, rows: int = 500):
    """The batch in parts of so many rows."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encoder(spec: str, spaces: str, words_kept: int | None = None) -> Encoder:
    """One encoder for each specification and worker process."""
    key = (len(spec), hash(spec), spaces)
    if key not in _MADE:
        _MADE[key] = Encoder(spec, spaces, words_kept)
    return _MADE[key]
