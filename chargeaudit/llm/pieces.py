"""Fast and exact encoding of texts by a tokenizer of the tokenizers library.

The pattern of the byte-level vocabularies never matches across a single space that
has a letter, digit or mark on at least one of its sides, other than as the first
character of a match. A text is therefore cut before such spaces, and each distinct
piece is encoded once per task. Texts where the cut isn't safe (a space between white
space) or that hold a special token go to the library as a whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from chargeaudit.llm.common import ragged

CLOSING = (".", ",", ";", ":", "!", "?", ")")
UNSAFE = re.compile(r"[\s\x1c-\x1f] (?=[\s\x1c-\x1f]|\Z)")


class _Slots(dict):
    """Numbers pieces in the order they are met; ``count`` is shared by all kinds of pieces."""

    def __init__(self, owner: PieceEncoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> int:
        self[piece] = slot = self.owner.next
        self.owner.next += 1
        self.owner.fresh.append((slot, self.lead, piece))
        return slot


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    while len(array) < size:
        array = np.concatenate([array, np.zeros_like(array)])
    return array


class PieceEncoder:
    """Token ids of texts; remembers pieces up to a bound of entries and characters."""

    def __init__(self, tokenizer, most: int = 600_000, most_chars: int = 12_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = tokenizer
        self.most, self.most_chars = most, most_chars
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # Words of letters only are single matches of the pattern: for them cutting at spaces is enough.
        # The model is shared, since a second one would take as much memory again.
        self.words = Tokenizer(tokenizer.model)
        if tokenizer.normalizer is not None:
            self.words.normalizer = tokenizer.normalizer
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(" ", "merged_with_next"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # byte-level vocabularies: a token has one character for each of its bytes
        vocabulary = tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.width[np.fromiter(vocabulary.values(), np.int64, len(vocabulary))] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self) -> None:
        self.next, self.fresh, self.chars, self.used, self.learning = 0, [], 0, 0, False
        self.spaced, self.plain = _Slots(self, " "), _Slots(self, "")
        self.starts, self.lengths = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)

    def _library(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _store(self, slots: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Ids of pieces, one piece after the other."""
        self.starts, self.lengths = _grown(self.starts, self.next), _grown(self.lengths, self.next)
        self.ids = _grown(self.ids, self.used + len(ids))
        self.lengths[slots] = lengths
        self.starts[slots] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _parts(self, lead: str, piece: str) -> tuple[int, ...] | None:
        """Pieces that make up ``piece`` where the pattern must cut it: after a word of letters, at a single line break."""
        if piece[-1:] in CLOSING and piece[:-1].isalpha():
            return (self.spaced if lead else self.plain)[piece[:-1]], self.plain[piece[-1]]
        head, found, tail = piece.partition("\n")
        if found and head and tail and not (head[-1].isspace() or tail[0].isspace() or head[-1] < " " or tail[0] < " "):
            return (self.spaced if lead else self.plain)[head], self.plain["\n"], self.plain[tail]
        return None

    def _learn(self) -> None:
        """Encode the pieces not met before."""
        self.learning = True
        words: list[tuple[int, str]] = []
        others: list[tuple[int, str]] = []
        made: list[tuple[int, tuple[int, ...]]] = []
        for slot, lead, piece in self.fresh:  # grows while parts are looked up
            if lead and piece.isalpha():
                words.append((slot, piece))
            elif parts := self._parts(lead, piece):
                made.append((slot, parts))
            else:
                others.append((slot, lead + piece))
            self.chars += len(piece)
        self.fresh = []
        for at in range(0, len(words), 5_000):
            part = words[at : at + 5_000]
            text = "".join(f" {w}" for _, w in part)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            data = np.frombuffer(text.encode(), np.uint8)
            begins = np.flatnonzero(data == 32)
            at_byte = np.cumsum(self.width[ids]) - self.width[ids]
            first = np.searchsorted(at_byte, begins)
            self._store(np.array([s for s, _ in part]), np.diff(first, append=len(ids)), ids)
        for at in range(0, len(others), 5_000):
            part = others[at : at + 5_000]
            coded = self._library([text for _, text in part])
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            self._store(np.array([s for s, _ in part]), lengths, np.array([i for c in coded for i in c], np.uint32))
        if made:
            self._compose(made)
        self.learning = False

    def _compose(self, made: list[tuple[int, tuple[int, ...]]]) -> None:
        """Store pieces that consist of other pieces, the innermost first."""
        empty = self.plain[""]
        if self.fresh:
            self.fresh = []
            self._store(np.array([empty]), np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self.starts, self.lengths = _grown(self.starts, self.next), _grown(self.lengths, self.next)
        slots = np.array([s for s, _ in made])
        parts = np.array([(*p, empty)[:3] for _, p in made])
        known = np.ones(self.next, bool)
        known[slots] = False
        while len(slots):
            ready = known[parts].all(axis=1)
            flat = parts[ready].ravel()
            ids = self.ids[ragged(self.starts[flat], self.lengths[flat])]
            self._store(slots[ready], self.lengths[parts[ready]].sum(axis=1), ids)
            known[slots[ready]] = True
            slots, parts = slots[~ready], parts[~ready]

    def slots_of(self, text: str) -> np.ndarray | None:
        """Numbers of the text's pieces; None if the text can't be cut safely."""
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return None
        first, *rest = text.split(" ")
        slots = np.empty(len(rest) + 1, np.int64)
        slots[0] = self.plain[first]
        slots[1:] = np.fromiter(map(self.spaced.__getitem__, rest), np.int64, len(rest))
        return slots

    def _batches(self, texts: Sequence[str], most: int = 8_000_000):
        """Runs of texts with a bounded number of characters."""
        if self.fresh or self.learning:  # an earlier task of this worker was cut short
            self._forget()
        at, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most:
                yield texts[at : i + 1]
                at, size = i + 1, 0
        if at < len(texts):
            yield texts[at:]

    def encode(self, texts: Sequence[str]):
        """Yield the ids of each text as unsigned 32-bit integers."""
        for batch in self._batches(texts):
            slots = [self.slots_of(t) for t in batch]
            self._learn()
            for text, own in zip(batch, slots, strict=True):
                if own is None:
                    yield np.array(self._library([text])[0], np.uint32)
                else:
                    yield self.ids[ragged(self.starts[own], self.lengths[own])]
            self._bound()

    def counted(self, texts: Sequence[str]):
        """Yield (token count at the end of each piece, end of each piece in characters)."""
        for batch in self._batches(texts):
            slots = [self.slots_of(t) for t in batch]
            self._learn()
            for text, own in zip(batch, slots, strict=True):
                if own is None:
                    yield np.array([len(self._library([text])[0])]), np.array([len(text)])
                else:
                    chars = np.fromiter(map(len, text.split(" ")), np.int64, len(own))
                    chars[1:] += 1
                    yield np.cumsum(self.lengths[own]), np.cumsum(chars)
            self._bound()

    def _bound(self) -> None:
        if self.next > self.most or self.chars > self.most_chars:
            self._forget()


@lru_cache(maxsize=1)
def json_tokenizer(path: str) -> PieceEncoder:
    """Encoder of a tokenizer file of the library; the tasks of a worker share it and what it remembers."""
    from tokenizers import Tokenizer

    return PieceEncoder(Tokenizer.from_file(path))
