"""Token ids of texts for a vocabulary that never joins words across ASCII white space.

Most words of a corpus are few words over and over: each distinct word is given to the tokenizer once.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np

# Words a worker remembers; beyond that it starts anew.
MEMORY = 800_000
STOP = re.compile(rb"(?<=[a-z])[.,](?=[ \n]|$)")


class _Places(dict):
    """Place of each word; a word not seen before gets the next one and waits to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.waiting.append(word)
        return place


class WordIds:
    """Ids of whole texts, word by word, equal to the tokenizer's own ``encode(text, add_special_tokens=False)``.

    Holds for tokenizers that drop white space and split at it before anything else. A trailing full stop or comma after a
    letter is a word of its own for them and ASCII capitals are lowered, so that "word" and "Word," share one entry.
    """

    _made: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordIds:
        """One encoder a worker process and vocabulary."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.places = _Places()
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self) -> None:
        """Encode the words that wait."""
        waiting, one = self.places.waiting, self.tokenizer.model.tokenize
        coded: list[bytes] = [b""] * len(waiting)
        others = []
        for place, word in enumerate(waiting):
            if word.isalpha() and word.islower():  # ASCII letters only: nothing to normalise or to split
                coded[place] = array("I", [token.id for token in one(word.decode())]).tobytes()
            else:
                others.append(place)
        for at in range(0, len(others), 20_000):
            some = others[at:at + 20_000]
            texts = [waiting[place].decode("utf-8", "replace") for place in some]
            begins = np.cumsum([0, *(len(text) + 1 for text in texts)])
            made = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
            ids = np.array(made.ids, np.uint32)
            ends = np.searchsorted(np.array([span[0] for span in made.offsets], np.int64), begins[1:])
            for place, begin, end in zip(some, [0, *ends[:-1]], ends):
                coded[place] = ids[begin:end].tobytes()
        counts = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), np.uint32)])
        waiting.clear()

    @staticmethod
    def words(text: bytes) -> list[bytes]:
        if b"<|" not in text:  # where case tells a special token from its look-alike, it stays
            text = text.lower()
        return STOP.sub(rb" \g<0>", text).split()

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.places) > MEMORY:
            self.forget()
        words = list(map(self.words, texts))
        places = np.fromiter(map(self.places.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        if self.places.waiting:
            self.learn()
        counts = self.counts[places]
        ends = np.cumsum(counts)
        shift = np.repeat(self.starts[places] - (ends - counts), counts)
        ids = self.ids[shift + np.arange(len(shift))]
        cuts = np.concatenate([[0], ends])[np.cumsum([len(doc) for doc in words])[:-1]] if texts else []
        return np.split(ids, cuts) if texts else []
