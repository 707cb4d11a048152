"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The tokenizer's rules never join across a space or a newline, so a text's ids are those
of its pieces between them, in order. A worker keeps the ids of the pieces it has met
and hands only new ones to the tokenizers library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Entries kept by a worker: pieces as they stand in texts, and words behind them. A full
#: store is emptied; this affects speed only.
KEPT_PIECES, KEPT_WORDS = 400_000, 1_000_000
#: The same where other stages follow in the workers, which hold their stores meanwhile: about 200 MB a worker instead of 350.
FEW = (150_000, 300_000)
#: Texts whose new pieces are learnt together.
BLOCK = 64
#: A piece that is one run of Latin letters and one run of stops: their ids stand side by side.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")


class PieceIds:
    """`known`: piece -> its ids as little-endian unsigned 16-bit bytes, filled on demand.

    `words` holds what the tokenizer was asked; a capital or a stop does not ask again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.kept = (KEPT_PIECES, KEPT_WORDS)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids do not fit into 16 bits")
        self.words: dict[str, bytes] = {"": b""}
        ends = np.zeros(65536, bool)
        ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.ends = ends

    def _ask(self, fresh: list[str]) -> None:
        """Encode words of one run each, many to a call; an id that ends a word tells where to cut."""
        groups = [fresh[i : i + 80] for i in range(0, len(fresh), 80)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u2")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 2
            if len(cuts) != len(group):
                raise ValueError("the tokenizer does not end every word once")
            raw, at = ids.tobytes(), 0
            for word, cut in zip(group, cuts.tolist()):
                self.words[word] = raw[at:cut]
                at = cut

    def learn(self, pieces: set[str]) -> None:
        """Fill in pieces not known yet."""
        if len(self.known) > self.kept[0]:
            self.known.clear()
        if len(self.words) > self.kept[1]:
            self.words = {"": b""}
        known, words = self.known, self.words
        plain = [m for m in map(_PLAIN.fullmatch, pieces) if m]
        parts = [(m[0], m[1].lower(), m[2]) for m in plain]
        others = list(pieces.difference([m[0] for m in plain]))
        self._ask(list({w for _, a, b in parts for w in (a, b)}.difference(words)))
        for p, a, b in parts:
            known[p] = words[a] + words[b] if b else words[a]
        for p, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            known[p] = array("H", e.ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts. Each is looked up as soon as it is cut, while its pieces are at hand; new ones are learnt together."""
        cut, fresh = [], set()
        for text in texts:
            pieces = text.replace("\n", " ").split(" ")
            found = list(map(self.known.get, pieces))
            if None in found:
                fresh.update([p for p, ids in zip(pieces, found) if ids is None])
                cut.append((pieces, found))
            else:
                cut.append((None, b"".join(found)))
        if fresh:
            self.learn(fresh)
        get = self.known.get
        # native order, which is little-endian on Spark's platforms
        return [found if pieces is None else b"".join([get(p) if ids is None else ids for p, ids in zip(pieces, found)]) for pieces, found in cut]


def piece_ids(path: str) -> PieceIds:
    """The worker's store for a tokenizer file. Functions travel to workers by value, so the
    store hangs on the tokenizers module, which a worker loads once."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tokenizers

    stores = tokenizers.__dict__.setdefault("_piece_ids", {})
    if path not in stores:
        stores[path] = PieceIds(path)
    return stores[path]


def release() -> None:
    """Gives back the stores of a worker that goes on to other work; it would hold them as long as it lives."""
    import sys

    sys.modules.get("tokenizers", sys).__dict__.pop("_piece_ids", None)


def encode(texts: list[str | None], path: str, kept: tuple[int, int] | None = None) -> Iterator[bytes]:
    """Ids of each text as unsigned 16-bit bytes; null is an empty text. `kept`: pieces and words that the store may keep."""
    store = piece_ids(path)
    store.kept = kept or (KEPT_PIECES, KEPT_WORDS)
    for at in range(0, len(texts), BLOCK):
        yield from store.ids([t or "" for t in texts[at : at + BLOCK]])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
