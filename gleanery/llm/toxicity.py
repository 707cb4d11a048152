"""Toxicity of texts, read through obfuscation.

1. A character language model is counted over every text of the corpus: trigrams of
   letters, with word ends. The table is bounded by the alphabet, not by the corpus.
2. A piece of text that looks disguised (letters mixed with digits or signs, a letter
   three times or more in a row, single letters set apart) is a noisy reading of a word.
   Its lattice holds, for each character, the letters it may stand for, whether a repeat was
   meant, and nothing for what only separates; Viterbi decoding under the language
   model and the channel's costs gives the word. Pieces of any length are decoded, those of
   over `LONG` characters part by part between separators. A letter outside the model
   stands for itself. Other pieces stand for themselves.
3. Restored texts are scored by a logistic model over word beginnings. Beginnings are
   counted, and chosen by how much more often toxic rows have them, over all labelled rows.
   Labels of equal texts are added up by digest, so a text is decoded once and weighs as its
   rows do. Whole texts are shuffled only once for each distinct labelled text: a filter of
   the wanted ids, of a fixed number of bits, is asked first.
   For the fit, rows with equal features and label are one row with a weight; if these
   are more than `TRAIN_ROWS`, rows are drawn by the rarest feature they have, so that rare
   features are fitted too, and each weighs as much more as it was less likely to be drawn.

Defined results: null and empty texts have no word, so they get the model's base score;
labels without a text and rows with a null label teach nothing; of several labels of an id
the highest counts; rows with an equal text count each, with the label of their own id, and
get equal scores; rows that share an id and differ in text all have its label; an empty table gives an empty result, and without
labels every score is the base score 0; other columns are not looked at.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bound on the (weighted) rows that the classifier is fitted on, on average over draws, and on its features.
TRAIN_ROWS, FEATURES = 30_000, 4_000
#: A beginning is a feature if it is in this many toxic texts and its log odds are above this.
LEAST_TOXIC, LEAST_ODDS = 4, 1.5
#: Bits of the filter of labelled ids, a power of two. Beyond some ten million labels it lets ever more rows through; this affects speed only.
FILTER_BITS = 1 << 26
#: Lengths of the word beginnings that are features.
BEGINNINGS = (4, 5, 6, 7)

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
#: What a sign may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "*": "aeiou",
}
#: Log costs of the channel: another letter for a sign, a dropped repeat, a dropped sign.
SIGN, REPEAT, DROP = -0.7, -0.3, -5.0

_HINT = re.compile(r"[0-9@$!|+(<€*]|(\w)\1\1|(?<!\w)\w(?:[ ._*-]\w){2,}(?!\w)")
_SPACED = re.compile(r"(?<![^\s])[^\W_](?:([ ._*-])[^\W_])(?:\1[^\W_])+(?![^\s.,!?;:])")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1")
_STRETCHED = re.compile(r"(.)\1{3,}")
_SEPARATORS = re.compile(r"([^\w@$!|+(<€*]+|_+)")
#: Pieces with more characters than this, runs folded, are cut at separators and their parts decoded.
LONG = 40
_EDGE = ".,;:!?\"'()#%&*<>[]{}|-_"


# --- the language model ---------------------------------------------------------------


def _codes(text: str) -> np.ndarray:
    """Letters as 1.., everything else as 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    table = np.zeros(256, np.int64)
    for i, c in enumerate(LETTERS):
        table[ord(c)] = i + 1
    return np.where(points < 256, table[np.minimum(points, 255)], 0)


def character_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(code, n) of every letter trigram of all texts; at most (letters + 1) ** 3 rows."""
    base = len(LETTERS) + 1

    def count(batches):
        total = np.zeros(base**3, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = _codes(f"  {t} " if t else "")
                if len(c) > 2:
                    code = (c[:-2] * base + c[1:-1]) * base + c[2:]
                    total += np.bincount(code[(c[1:-1] > 0) | (c[2:] > 0)], minlength=base**3) if len(c) > 50_000 else 0
                    if len(c) <= 50_000:
                        np.add.at(total, code[(c[1:-1] > 0) | (c[2:] > 0)], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["code", "n"])

    return docs.select(F.col(text)).mapInArrow(count, "code INT, n BIGINT").groupBy("code").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Log probability of a letter after two others, backed off to one."""

    def __init__(self, counts: np.ndarray):
        n = len(LETTERS) + 1
        three = counts.reshape(n, n, n).astype(float)
        two = three.sum(axis=0)
        one = two.sum(axis=0)
        p1 = (one + 1) / (one.sum() + n)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        self.logs = np.log((three + 5 * p2[None]) / (three.sum(axis=2, keepdims=True) + 5))
        self.index = {c: i + 1 for i, c in enumerate(LETTERS)}

    def decode(self, seen: str) -> str:
        """The likeliest word behind a disguised piece."""
        lattice, at = [], 0
        seen = seen.lower()
        while at < len(seen):
            run = at
            while run < len(seen) and seen[run] == seen[at]:
                run += 1
            c, n = seen[at], run - at
            if c.isalpha() and c not in self.index:
                # a letter the model does not know stands for itself, once if it is stretched
                lattice.append([(c if n > 2 else c * n, [0], 0.0)])
                at = run
                continue
            own = [(self.index[c], 0.0)] if c in self.index else [(self.index[x], SIGN) for x in READINGS.get(c, "")]
            # one or two of a run were meant; a sign may also mean nothing
            ways = [(LETTERS[i - 1], [i], cost + REPEAT * (n > 1)) for i, cost in own]
            ways += [(LETTERS[i - 1] * 2, [i, i], 2 * cost + REPEAT * (n > 2)) for i, cost in own if n > 1]
            if c not in self.index:
                ways.append(("", [], DROP if own else 0.0))
            lattice.append(ways)
            at = run
        # a path's word is a chain (earlier, letters), so a step costs the same however long the piece is
        paths = {(0, 0): (0.0, None)}
        for ways in lattice:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, word) in paths.items():
                for letters, codes, cost in ways:
                    x, y, s = a, b, score + cost
                    for i in codes:
                        s += self.logs[x, y, i] if i else 0.0
                        x, y = y, i
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, (word, letters) if letters else word)
            paths = after
        word = max(((s + self.logs[a, b, 0], w) for (a, b), (s, w) in paths.items()), key=lambda p: p[0])[1]
        out = []
        while word is not None:
            word, letters = word
            out.append(letters)
        return "".join(reversed(out))


def disguised(piece: str) -> bool:
    letters = sum(c.isalpha() for c in piece)
    return letters >= 2 and (bool(_RUN.search(piece)) or any(c in READINGS for c in piece))


def restore(text: str | None, model: CharacterModel, known: dict[str, str]) -> str:
    """The lower-case text with disguised pieces decoded. `known` remembers decoded pieces."""
    text = (text or "").lower()
    if not _HINT.search(text):
        return text
    text = _SPACED.sub(lambda m: m[0].replace(m[1], ""), text)
    out = []
    for piece in re.split(r"(\s+)", text):
        core = piece.strip(_EDGE)
        if core[-3:] in ("$$$", "@@@", "+++"):
            core = core.rstrip("$@+")
        if core and not core.isalpha() or _RUN.search(core):
            core = _STRETCHED.sub(r"\1\1\1", core)  # decoding takes longer runs for the same
            if len(core) > LONG:
                piece = "".join(_decoded(part, model, known) for part in _parts(core))
            elif disguised(core):
                piece = _decoded(core, model, known)
        out.append(piece)
    return "".join(out)


def _parts(core: str) -> list[str]:
    """A long piece cut at its separators, which are parts too; parts of one or two characters that follow each other are one part."""
    found = _SEPARATORS.split(core)
    out = found[:1]
    for at in range(1, len(found) - 1, 2):
        if len(found[at + 1]) <= 2 and len(found[at - 1]) <= 2 and out[-1]:
            out[-1] += found[at] + found[at + 1]
        else:
            out += found[at : at + 2]
    return out


def _decoded(part: str, model: CharacterModel, known: dict[str, str]) -> str:
    spelled = _SEPARATORS.search(part) is not None
    if not disguised(part) and not (spelled and sum(c.isalpha() for c in part) >= 2):
        return part
    if len(part) > LONG:  # not worth remembering
        return model.decode(part)
    if part not in known:
        if len(known) > 200_000:
            known.clear()
        known[part] = model.decode(part)
    return known[part]


# --- the classifier -------------------------------------------------------------------


def beginnings(text: str) -> set[str]:
    words = set(_WORD.findall(text))
    return {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}


class Finder:
    """Which chosen beginnings stand at the start of a word of a text."""

    def __init__(self, chosen: list[str]):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for i, w in enumerate(chosen):
            self.machine.add_word(w, (i, len(w)))
        if chosen:
            self.machine.make_automaton()
        self.any = bool(chosen)

    def find(self, text: str) -> list[int]:
        if not self.any:
            return []
        found = set()
        for end, (i, n) in self.machine.iter(text):
            if i not in found and (end == n - 1 or not text[end - n].isalpha()):
                found.add(i)
        return sorted(found)


def fit_logistic(
    rows: list[list[int]], labels: np.ndarray, n: int, steps: int = 400, shrink: float = 1.0, stands_for: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic model on present features, by accelerated gradient steps.

    `stands_for`: of how many labelled rows each row is the image; one by default.
    """
    stands_for = np.ones(len(labels)) if stands_for is None else stands_for
    toxic, every = (stands_for * labels).sum(), stands_for.sum()
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], np.int64)
    weights, bias = np.zeros(n), math.log((toxic + 1) / (every - toxic + 1))
    most = max((len(r) for r in rows), default=0) + 1
    rate = 4.0 / most
    look, look_bias, before, before_bias = weights.copy(), bias, weights, bias
    scale = every / 100.0
    for step in range(steps):
        score = np.bincount(at, look[column], len(rows)) + look_bias
        miss = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * stands_for
        weights = look - rate * (np.bincount(column, miss[at], n) + shrink * look) / scale
        bias = look_bias - rate * miss.sum() / scale / 10
        pull = step / (step + 3)
        look, look_bias = weights + pull * (weights - before), bias + pull * (bias - before_bias)
        before, before_bias = weights, bias
    return weights, float(bias)


def fitting_rows(seen: DataFrame, often: np.ndarray, bound: int) -> DataFrame:
    """(y, found, stands_for) to fit on, about `bound` rows at most, from (y, found, n) of all labelled rows.

    Equal rows are put together. `often` has the number of rows of each feature; a row that
    is put together from c rows and whose rarest feature is in m is drawn with probability
    c * k / m (at most 1) for the largest power of two k that keeps to the bound.
    """
    rows = stored(seen.groupBy("y", "found").agg(F.sum("n").alias("n")), "toxic-rows")
    if rows.count() <= bound:
        return rows.withColumn("stands_for", F.col("n").cast("double"))

    @F.pandas_udf("double")
    def rarest(found: pd.Series) -> pd.Series:
        return found.map(lambda f: float(often[list(f)].min()) if len(f) else 1.0)

    share = F.col("n") / rarest("found")
    ks = [2.0**e for e in range(-20, 21)]
    sums = rows.withColumn("_share", share).agg(*[F.sum(F.least(F.lit(1.0), F.col("_share") * k)) for k in ks]).first()
    k = max((k for k, total in zip(ks, sums) if total <= bound), default=ks[0])
    chance = rows.withColumn("_chance", F.least(F.lit(1.0), share * k))
    draw = F.pmod(F.xxhash64("y", "found", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return chance.filter(draw < F.col("_chance")).withColumn("stands_for", F.col("n") / F.col("_chance")).drop("_chance")


def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two bits of the filter for each id."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((x ^ (x >> np.uint64(31))) & np.uint64(bits - 1)).astype(np.int64))
    return out


def labelled_filter(marks: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter (64 bits a word) that holds every `_id` of marks; its size does not depend on theirs."""

    def fill(batches):
        for batch in batches:
            places = np.concatenate(_places(batch.column(0).to_numpy(), bits))
            word, back = np.unique(places >> 6, return_inverse=True)
            held = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(held, back, np.uint64(1) << (places & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(held.view(np.int64))], names=["word", "held"])

    found = marks.select("_id").mapInArrow(fill, "word BIGINT, held BIGINT").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits >> 6, np.uint64)
    out[found.column("word").to_numpy()] = found.column("held").to_numpy().view(np.uint64)
    return out


def labelled_texts(docs: DataFrame, marks: DataFrame, key: str, text: str, bits: int = FILTER_BITS) -> DataFrame:
    """(text, clean, toxic): each distinct text of the rows whose id is in marks (_id, _y), and its labels."""
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter("_id IS NOT NULL")

    def among(ids: DataFrame) -> DataFrame:
        held = labelled_filter(ids, bits)

        @F.pandas_udf("boolean")
        def may_hold(ids: pd.Series) -> pd.Series:
            hit = np.ones(len(ids), bool)
            for place in _places(ids.to_numpy(np.int64), bits):
                hit &= (held[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) > 0
            return pd.Series(hit)

        return rows.filter(may_hold("_id")).select("_id", "text", F.unhex(F.md5("text")).alias("digest"))

    told = among(marks).select("_id", "digest").join(marks.hint("merge"), "_id")
    texts = told.groupBy("digest").agg(F.min("_id").alias("_id"), F.count_if(F.col("_y") <= 0).alias("clean"), F.count_if(F.col("_y") > 0).alias("toxic"))
    texts = stored(texts, "toxic-texts")
    # a text is read from the row of its least id; a row that is there twice is one
    found = among(texts).join(texts.hint("merge"), ["_id", "digest"])
    return found.groupBy("_id", "digest").agg(F.first("text").alias("text"), F.first("clean").alias("clean"), F.first("toxic").alias("toxic")).select("text", "clean", "toxic")


def telling_beginnings(
    taught: DataFrame, model: CharacterModel, most: int = FEATURES, least_toxic: int = LEAST_TOXIC, least_odds: float = LEAST_ODDS
) -> list[tuple[str, int, int]]:
    """(beginning, clean, toxic rows that have it), the most telling first, `most` at most."""

    def features(batches):
        known: dict[str, str] = {}
        tally: dict[str, list[int]] = {}

        def told():
            columns = list(zip(*tally.values())) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(tally), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=["feature", "clean", "toxic", "texts"]
            )

        for batch in batches:
            for t, clean, toxic in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for f in beginnings(restore(t, model, known)):
                    seen = tally.setdefault(f, [0, 0, 0])
                    seen[0] += clean
                    seen[1] += toxic
                    seen[2] += toxic > 0
                if len(tally) > 500_000:  # the counts are summed later
                    yield told()
                    tally.clear()
        yield told()

    told = taught.select("text", "clean", "toxic").mapInArrow(features, "feature STRING, clean BIGINT, toxic BIGINT, texts BIGINT")
    tally = told.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "texts")])
    total = taught.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (total[0] + 1.0))
    telling = tally.filter(F.col("texts") >= least_toxic).withColumn("odds", odds).filter(F.col("odds") > least_odds)
    best = telling.orderBy((F.col("odds") * F.sqrt("texts")).desc(), "feature").limit(most)
    return [(r["feature"], r["clean"], r["toxic"]) for r in best.collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, teach=None, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, score, predicted). `teach`: condition on label rows that may be learned from."""
    size = (len(LETTERS) + 1) ** 3
    counts = np.zeros(size, np.int64)
    for r in character_counts(docs, text).collect():  # bounded by the alphabet
        counts[r["code"]] = r["n"]
    marks = labels.select(F.col(key).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id IS NOT NULL AND _y IS NOT NULL")
    if teach is not None:
        marks = marks.filter(teach(F.col("_id")))
    marks = stored(marks.groupBy("_id").agg(F.max("_y").alias("_y")), "toxic-marks")
    taught = stored(labelled_texts(docs, marks, key, text), "toxic-taught")
    model = CharacterModel(counts)
    best = telling_beginnings(taught, model)
    chosen, often = [f for f, _c, _t in best], np.array([c + t for _f, c, t in best], float)

    def present(batches):
        finder, known = Finder(chosen), {}
        for batch in batches:
            found = [finder.find(restore(t, model, known)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))], names=["clean", "toxic", "found"])

    told = taught.select("text", "clean", "toxic").mapInArrow(present, "clean BIGINT, toxic BIGINT, found ARRAY<INT>")
    labelled = F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("clean").alias("n")), F.struct(F.lit(1).alias("y"), F.col("toxic").alias("n")))).alias("label")
    seen = told.select("found", labelled).select("label.y", "found", "label.n").filter("n > 0")
    seen = fitting_rows(seen, often, TRAIN_ROWS).collect()  # about TRAIN_ROWS rows at most
    seen.sort(key=lambda r: (r["y"], r["found"]))  # sums of floats in one order, however the rows came
    y, stands_for = np.array([r["y"] > 0 for r in seen], float), np.array([r["stands_for"] for r in seen], float)
    weights, bias = fit_logistic([list(r["found"]) for r in seen], y, len(chosen), stands_for=stands_for) if len(y) else (np.zeros(0), -30.0)
    weights = weights.astype(np.float64)

    def score(batches):
        finder, known = Finder(chosen), {}
        for batch in batches:
            sums = [bias + float(weights[finder.find(restore(t, model, known))].sum()) for t in batch.column(1).to_pylist()]
            out = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(score, "doc_id BIGINT, score DOUBLE, predicted INT")
