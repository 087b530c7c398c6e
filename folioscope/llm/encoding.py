"""Token ids of whole texts with a public tokenizer file, each distinct piece encoded once per worker.

Both vocabularies cut a text before they merge: the byte-level one never joins the characters on the two sides of a change
from other characters to white space, the word one drops white space. Encoding the pieces between such places one by one
therefore gives the ids of the whole text. Encoded whole are texts that hold one of the file's added tokens, texts with control
characters, and, where ids hold the white space, those with white space or marks of layout other than blanks and line feeds.
The ids are those of the library's plain call: the string of an added token in a text gives that token's id.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from .common import cache_of, give_back, spans

_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f]")
_PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Distinct pieces that a worker remembers; beyond that it forgets the rare ones.
CACHE_PIECES = 600_000
#: Their characters; pieces longer than the second number are the first to go.
CACHE_CHARS, LONG_PIECE = 24 << 20, 200
#: Calls after which freed memory goes back to the system: what the tokenizer frees in small blocks would else stay with the worker.
TIDY_CALLS = 8
_MARKS = ",.;:!?%&$#*)"


def shared_encoder(file: str, end_id: int, keeps_space: bool) -> PieceEncoder:
    """One encoder for all tasks of a worker process."""
    key = (file, end_id, keeps_space)
    held = cache_of("encoding")
    if key not in held:
        held[key] = PieceEncoder(*key)
    return held[key]


class _Numbers(dict):
    """Piece -> number in order of arrival."""

    def __init__(self):
        self.new, self.chars = [], 0

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        self.chars += len(key)
        return n


class PieceEncoder:
    """Encodes texts to ids, each followed by ``end_id``. ``keeps_space``: whether ids hold the white space."""

    #: Calls so far; encoders of other libraries with their own ``__init__`` begin here too.
    calls = 0

    def __init__(self, file: str, end_id: int, keeps_space: bool, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id, self.keeps_space, self.cache_pieces = end_id, keeps_space, cache_pieces
        self.dtype = np.uint16 if max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else np.uint32
        self._clear()

    def _clear(self):
        self.numbers = _Numbers()
        self.lengths, self.starts, self.hits = (np.zeros(1 << 16, np.int64) for _ in range(3))
        self.pool, self.used, self.known = np.zeros(1 << 18, self.dtype), 0, 0

    def _evict(self):
        """Forgets the pieces that were met least, so that at most half of the allowed number stay."""
        hits, least = self.hits[: self.known], 2
        while (hits >= least).sum() > self.cache_pieces // 2:
            least *= 2
        keep = hits >= least
        keys = [k for k, x in zip(self.numbers, keep.tolist(), strict=True) if x and k is not None and len(k) <= LONG_PIECE]
        at = np.fromiter(map(self.numbers.get, keys), np.int64, len(keys))
        n, flat, counts = self.lengths[at], self.pool[spans(self.starts[at], self.lengths[at])], hits[at]
        self._clear()
        self.numbers.update(zip(keys, range(len(keys)), strict=True))
        self.numbers.chars = sum(map(len, keys))
        self._room(len(keys), len(flat))
        self.pool[: len(flat)], self.used, self.known = flat, len(flat), len(keys)
        self.lengths[: len(keys)], self.starts[: len(keys)], self.hits[: len(keys)] = n, np.cumsum(n) - n, counts // 2

    def _room(self, pieces: int, ids: int):
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + pieces > len(self.lengths):
            self.lengths, self.starts, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lengths, self.starts, self.hits))

    def _pieces(self, text: str) -> list[str]:
        """Keys of the pieces: a word stands for itself after a blank, other pieces carry a mark first, which no piece holds."""
        flat = text.replace("\n", " ")
        if not flat.isprintable() and (self.keeps_space or _CONTROL.search(flat)) or any(t in text for t in self.added):
            return ["\0" + text]
        if not self.keeps_space:
            return flat.split(" ")
        if "  " in flat:
            return ["\0" + p for p in _PIECES.findall(text)]
        found = text.replace("\n", " \n").split(" ")
        found[0] = "\0" + found[0]
        return found

    def _text(self, key: str) -> str:
        if key[:1] == "\0":
            return key[1:]
        return key if not self.keeps_space or key[:1] == "\n" else " " + key

    def _learn(self):
        """Ids of the new pieces. Marks at the end of a word are pieces of their own, so that words with and without them share their ids."""
        new, plain, joined = self.numbers.new, [], []
        for i, key in enumerate(new):  # grows while it runs
            word = key.rstrip(_MARKS)
            # the capital I with a dot has a mark behind it in lower case
            if len(word) < len(key) and word[-1:].isalpha() and word[-1] < "\u0250" and word[-1] != "İ" and key[:1] != "\0":
                joined.append((i, self.numbers[word], self.numbers["\0" + key[len(word) :] if self.keeps_space else key[len(word) :]]))
            else:
                plain.append(i)
        self.numbers.new = []
        n = np.zeros(len(new), np.int64)
        ids = [e.ids for j in range(0, len(plain), 20_000) for e in self.tokenizer.encode_batch_fast([self._text(new[i]) for i in plain[j : j + 20_000]], add_special_tokens=False)]
        n[plain] = np.fromiter(map(len, ids), np.int64, len(ids))
        first = self.known
        self._room(len(new), 0)
        self.lengths[first : first + len(new)] = n
        at, word, mark = np.array(joined, np.int64).reshape(-1, 3).T
        self.lengths[first + at] = self.lengths[word] + self.lengths[mark]
        n = self.lengths[first : first + len(new)]
        self._room(len(new), int(n.sum()))
        starts = self.used + np.cumsum(n) - n
        self.starts[first : first + len(new)] = starts
        self.pool[spans(starts[plain], n[plain])] = np.fromiter(chain.from_iterable(ids), self.dtype, int(n[plain].sum()))
        for piece, shift in ((word, 0), (mark, self.lengths[word])):
            self.pool[spans(starts[at] + shift, self.lengths[piece])] = self.pool[spans(self.starts[piece], self.lengths[piece])]
        self.used += int(n.sum())
        self.known += len(new)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of each text's, with the end id."""
        if len(self.numbers) > self.cache_pieces or self.numbers.chars > CACHE_CHARS:
            self._evict()
        self.calls += 1
        if self.calls % TIDY_CALLS == 0:
            give_back()
        keys, counts = [], []
        for text in texts:
            found = self._pieces(text or "")
            found.append(None)  # the end
            counts.append(len(found))
            keys += found
        if None not in self.numbers:
            self._end()
        at = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        self._learn()
        self.hits[: self.known] += np.bincount(at, minlength=self.known)
        n = self.lengths[at]
        flat = self.pool[spans(self.starts[at], n)]
        ends = np.cumsum(np.asarray(counts, np.int64))
        total = np.concatenate([[0], np.cumsum(n)])
        return flat, total[ends] - total[ends - np.asarray(counts, np.int64)]

    def _end(self):
        self._learn()
        self._room(1, 1)
        self.numbers[None] = self.known
        self.numbers.new.clear()
        self.pool[self.used] = self.end_id
        self.starts[self.known], self.lengths[self.known] = self.used, 1
        self.used += 1
        self.known += 1


def batches(batch, size: int = 4 << 20):
    """Texts and rows of an Arrow batch in groups of about ``size`` characters; column ``text`` is cut out of the batch."""
    texts = batch.column("text")
    rest = batch.drop_columns(["text"])
    at, held, count = 0, [], 0
    for i in range(batch.num_rows):
        text = texts[i].as_py()
        held.append(text)
        count += len(text or "")
        if count >= size:
            yield held, rest.slice(at, i + 1 - at)
            at, held, count = i + 1, [], 0
    if held:
        yield held, rest.slice(at)
