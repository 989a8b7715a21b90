"""Token ids of whole texts, with a cache of words in each Python worker."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Pieces of words that a worker remembers in each of two generations.
CACHE_ENTRIES = 200_000
#: Characters encoded together, which bounds what a worker holds at a time.
BATCH_CHARS = 3_000_000

_PIECES = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: All but ASCII without controls, blanks, and composed Latin letters with a lower case of their own: for
#: these alone the classes and the case rules of Python and of the tokenizer are the same.
_OTHERS = re.compile("[^\t\n\v\f\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]")
#: Marks side by side, which are one piece; written as two classes, of which the first is searched for fast.
_JOINED = re.compile(r"[!-/:-@\[-`{-~][!-/:-@\[-`{-~]")
_TRIED = ("Onion", "Forêt", "ŒUVRE", "straße")
_WORKER: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + n for n, b in enumerate(others)}


class Memory(dict):
    """Ids by text, made when first asked for; entries unused while a whole generation filled up are forgotten."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self._make, self._old = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self._old.get(text)
        if found is None:
            found = self._make(text)
        self[text] = found
        return found

    def turn(self) -> None:
        """A new generation, if this one is full."""
        if len(self) > CACHE_ENTRIES:
            self._old = dict(self)
            self.clear()


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, as bytes.

    Where the tokenizer drops white space and case (tested once on load), a text of printable
    ASCII, blanks and Latin letters is the concatenation of its lower-cased words, and a word without
    apostrophes that of its runs of letters and of others; those are remembered. Runs of letters go
    straight to the library's model as byte letters, which is what its own first steps would make of
    them (tested on load too); all else goes through the whole library, and so do whole texts that
    have any other character or one of the vocabulary's added tokens, in whatever case. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._letters = _byte_letters()
        self._added = [t.content.lower() for t in self._library.get_added_tokens_decoder().values()]
        self._pieces = Memory(lambda p: self._run(p) if p.isalpha() else self._encode([p])[0])
        a, b, both = self._encode(["Onion,", "tree.", "onion, tree.\n"])
        self._by_word = a + b == both and [self._run(w.lower()) for w in _TRIED] == self._encode(list(_TRIED))

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _run(self, low: str) -> bytes:
        """Ids of a run of lower-case Latin letters."""
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self._letters)
        found = self._model.tokenize(low)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _split(self, text: str) -> list[str] | None:
        """A text's pieces and, between some of them, nothing; None for a text that the library takes whole."""
        low = text.lower()
        if _OTHERS.search(text) or any(t in low for t in self._added):
            return None
        low = low.replace("\n", " ")
        if "'" not in low and not _JOINED.search(low):  # no contraction; a comma or full stop is a piece of its own
            return low.replace(",", " , ").replace(".", " . ").split(" ")
        return [p for w in low.split(" ") for p in ([w] if w.isalpha() or "'" in w else _PIECES.findall(w))]

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self._by_word:
            return self._encode(texts)
        pieces = [self._split(t) for t in texts]
        self._pieces.turn()
        whole = [i for i, p in enumerate(pieces) if p is None]
        found = dict(zip(whole, self._encode([texts[i] for i in whole]), strict=True))
        get = self._pieces.__getitem__
        return [found[i] if p is None else b"".join(map(get, p)) for i, p in enumerate(pieces)]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def encoded(rows: Iterable[tuple], path: str, end_id: int) -> Iterator[tuple[object, bytes]]:
    """(key, ids with the end id) for each (key, text); a null text counts as empty."""
    enc, end = encoder(path), np.asarray([end_id], dtype="<u4").tobytes()
    keys: list = []
    texts: list[str] = []
    size = 0
    for key, text in rows:
        keys.append(key)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield from ((k, ids + end) for k, ids in zip(keys, enc.batch(texts), strict=True))
            keys, texts, size = [], [], 0
    if keys:
        yield from ((k, ids + end) for k, ids in zip(keys, enc.batch(texts), strict=True))
