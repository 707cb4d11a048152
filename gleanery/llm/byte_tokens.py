"""Ids of whole texts by a public byte-level tokenizer, fast enough for a corpus.

Such a tokenizer cuts a text before every run of white space that follows another
character, and what stands on one side of a cut does not change the ids of the other. So
a text is cut into pieces of white space and what follows it, and a worker keeps the ids
of the pieces it has met.

Pieces have keys: a word stands for a space and the word, what begins with a new line for
itself, and anything else follows a carriage return. So the keys of a text in which no two
white-space characters meet are had by one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Pieces kept by a worker, as they stand in texts and without stops. A full store is emptied; this affects speed only.
KEPT = 1_200_000
#: Texts whose new pieces are learnt together.
BLOCK = 64
_PIECE = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_MIXED = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: White space of other kinds; texts with it, or with a special token, are encoded whole.
_OTHER_SPACE = re.compile("[" + "".join(map(chr, [*range(11, 13), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
#: A key of one run of Latin letters and one run of stops: two words of the tokenizer.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")


def keys_of(text: str) -> list[str]:
    """The keys of a text's pieces, in order."""
    if not text:
        return []
    if text[0] not in " \n" and text[-1] not in " \n" and not any(two in text for two in _MIXED):
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\r" + keys[0]
        return keys
    return [p[1:] if p[0] == " " and p[1:2].strip(" \n\r\t") else p if p[0] == "\n" else "\r" + p for p in _PIECE.findall(text)]


def piece_of(key: str) -> str:
    return key[1:] if key[0] == "\r" else key if key[0] == "\n" else " " + key


class BytePieces:
    """`known`: key of a piece -> its ids as little-endian unsigned 16-bit bytes, filled on demand."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}  # a plain dict: sets are compared with it in C
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit into 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        starts = np.zeros(65536, bool)
        starts[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True  # a space
        self.starts = starts

    def _ask(self, words: list[str]) -> None:
        """Encode words, each behind a space, many to a call; that space tells where to cut."""
        groups = [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            cuts = (np.flatnonzero(self.starts[ids]) * 2).tolist()
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not begin every word once")
            raw = ids.tobytes()
            self.known.update(zip(group, [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]))

    def learn(self, fresh: set[str]) -> None:
        """Fill in pieces not known yet."""
        known = self.known
        if len(known) > KEPT:
            known.clear()
        plain = [m for m in map(_PLAIN.fullmatch, fresh) if m]
        stopped = [(m[0], m[1], "\r" + m[2]) for m in plain if m[2]]
        others = list(fresh.difference([m[0] for m in plain]).union({stops for _key, _word, stops in stopped}.difference(known)))
        self._ask(list({m[1] for m in plain}.difference(known)))
        for key, e in zip(others, self.tokenizer.encode_batch_fast([piece_of(k) for k in others], add_special_tokens=False)):
            known[key] = np.array(e.ids, "<u2").tobytes()
        for key, word, stops in stopped:
            known[key] = known[word] + known[stops]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts. Each is looked up as soon as it is cut, while its pieces are at hand; new ones are learnt together."""
        cut, fresh = [], set()
        for text in texts:
            if _OTHER_SPACE.search(text) or any(s in text for s in self.special):
                cut.append((None, self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            keys = keys_of(text)
            found = list(map(self.known.get, keys))
            if None in found:
                fresh.update([k for k, ids in zip(keys, found) if ids is None])
                cut.append((keys, found))
            else:
                cut.append(((), b"".join(found)))
        if fresh:
            self.learn(fresh)
        get = self.known.get
        return [
            np.array(found, "<u2").tobytes() if keys is None else b"".join([get(k) if ids is None else ids for k, ids in zip(keys, found)]) if keys else found
            for keys, found in cut
        ]


def byte_pieces(path: str) -> BytePieces:
    """The worker's store for a tokenizer file. Functions travel to workers by value, so the
    store hangs on the tokenizers module, which a worker loads once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    stores = tokenizers.__dict__.setdefault("_byte_pieces", {})
    if path not in stores:
        stores[path] = BytePieces(path)
    return stores[path]


def encode(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text as unsigned 16-bit bytes; null is an empty text."""
    store = byte_pieces(path)
    for at in range(0, len(texts), BLOCK):
        yield from store.ids([t or "" for t in texts[at : at + BLOCK]])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
