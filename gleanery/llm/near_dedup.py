"""Near-duplicate documents: MinHash signatures met by a multi-index Hamming join.

1. Each text becomes its set of word shingles and a signature of CHUNKS x WIDTH MinHash
   values of 16 bits. Texts with the same set are one class, and only the least id of a
   class goes on, so exact copies cost one row.
2. Two signatures that differ in at most d = CHUNKS * (ERRORS + 1) - 1 values agree, by
   pigeonhole, up to ERRORS values in some chunk. Every chunk is indexed once for each choice of
   ERRORS values left out, so every pair within distance d shares a key. Pairs further
   apart may share one too; nothing is lost by that, as links are confirmed.
3. A key's members are not paired with each other. They are all paired with one of them,
   drawn by a hash; pairs are confirmed on the full sets, and linked members become one
   component. Only keys that still hold several components go on: there, every pair across
   components that is close enough is tried, each at the first key it shares. So the
   components equal those of all links between pairs that the index brings together, and a
   group of n near copies costs a few n confirmations beside those between its components.

Of 65 indexed values a pair of similarity 0.8 differs in 13 on average; more than 25 has a
probability of about 1 in 10,000. Before a pair is confirmed, 256 values in all may differ in 79:
51 on average at 0.8, more than 79 with about 1 in 100,000. Both fall quickly above 0.8.

Defined results: words are split at ASCII white space after lower-casing A-Z; a text
with fewer words than a shingle is one shingle; a null or blank text has an empty set and
is linked with nothing; rows that share an id are one document whose texts are linked;
rows with a null id are left out, as they cannot be named; an empty table gives an empty
result; other columns are not looked at. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import stored
from .tokens import release

SHINGLE, PERCENT = 5, 80
CHUNKS, WIDTH, ERRORS, SEED = 13, 5, 1, 20240
INDEXED, DISTANCE = CHUNKS * WIDTH, CHUNKS * (ERRORS + 1) - 1
#: Values in all, the further ones of 8 bits, and how many may differ before a pair is confirmed.
WHOLE, WHOLE_DISTANCE = 256, 79
#: Bytes of text hashed at a time in a task.
BLOCK = 250_000
#: Orders of chance in which a key's first partner is drawn; each member of a group meets about as many.
CENTRES = 4
#: Keys with this many members at most have the pairs across their components tried at once;
#: larger ones are cut into tiles. A matter of speed: both try all that is left.
SMALL = 64
#: Members of one key in a slice, and their shingles; a task compares two slices.
SLICE, SLICE_SHINGLES = 1024, 1_000_000
#: Shingles looked up at a time in a tile.
LOOKUP = 250_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Shingle sets of a block of texts at once, as sorted 64-bit hashes."""

    def __init__(self, width: int = SHINGLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.width = width
        self.letters = rng.integers(1, 2**63, 256, np.uint64) | np.uint64(1)
        self.letters[65:91] = self.letters[97:123]  # A-Z are read as a-z
        self.letters[_SPACE] = 0
        self.base = np.uint64(0x9E3779B97F4A7C15)
        back = pow(int(self.base), -1, 2**64)
        self.powers, self.inverse = self._powers(int(self.base)), self._powers(back)
        self.places = rng.integers(1, 2**63, width, np.uint64) | np.uint64(1)

    def _powers(self, base: int, n: int = 2 * BLOCK) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            self.powers = self._powers(int(self.base), n)
            self.inverse = self._powers(pow(int(self.base), -1, 2**64), n)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """One sorted array of distinct hashes per text."""
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        first, last = edge[::2], edge[1::2]  # the block begins and ends with a space
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        word = _mix((sums[last] - sums[first]) * self.inverse[first])
        ends = np.cumsum([len(r) + 1 for r in raw]) + 1
        cuts = np.searchsorted(first, ends)
        rolled = np.zeros(len(word), np.uint64)
        n = max(0, len(word) - self.width + 1)
        for k in range(self.width):
            rolled[:n] += word[k : k + n] * self.places[k]
        rolled = _mix(rolled)
        out, at = [], 0
        for cut in cuts:
            count = cut - at
            if count >= self.width:
                own = np.sort(rolled[at : cut - self.width + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif count:
                out.append(_mix((word[at:cut] * self.places[:count]).sum(keepdims=True) + np.uint64(count)))
            else:
                out.append(np.zeros(0, np.uint64))
            at = cut
        return out


def _blocks(texts: list[str | None]):
    """Slices of a batch of about BLOCK characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > BLOCK:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def signature(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> bytes:
    """MinHash values of a set: 16 bits of the indexed ones, 8 bits of the others."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    out = np.empty(len(factors), np.uint32)
    step = max(1, (1 << 16) // max(1, len(short)))
    for at in range(0, len(factors), step):
        out[at : at + step] = (short[None, :] * factors[at : at + step, None] + shifts[at : at + step, None]).min(axis=1)
    out *= np.uint32(2654435769)
    return (out[:INDEXED] >> np.uint32(16)).astype("<u2").tobytes() + (out[INDEXED:] >> np.uint32(24)).astype(np.uint8).tobytes()


def _functions(n: int = WHOLE, seed: int = SEED):
    rng = np.random.default_rng(seed + 1)
    return rng.integers(1, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, same, signature): `same` is a digest of the whole set, null for an empty one."""

    def sign(batches):
        release()
        shingler, (factors, shifts) = Shingler(shingle), _functions()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                sets = shingler.sets(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:b], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array([signature(s, factors, shifts) if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "n_shingles", "same", "signature"],
                )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    return source.mapInArrow(sign, "doc_id BIGINT, n_shingles BIGINT, same BINARY, signature BINARY")


def full_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, same, set): the sorted hashes of the full set, as bytes, and their digest as in `signatures`."""

    def build(batches):
        release()
        shingler = Shingler(shingle)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _blocks(texts):
                sets = [s.tobytes() for s in shingler.sets(texts[a:b])]
                same = [hashlib.blake2b(s, digest_size=16).digest() if s else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(same, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "same", "set"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id IS NOT NULL")
    return source.mapInArrow(build, "doc_id BIGINT, same BINARY, set BINARY")


def index_keys(signed: DataFrame) -> DataFrame:
    """(index, key, doc_id): for each chunk, one key per choice of ERRORS values left out of it."""
    piece = lambda i: F.substring("signature", 2 * i + 1, 2)
    keys = []
    for c in range(CHUNKS):
        for out in combinations(range(WIDTH), ERRORS):
            kept = [piece(c * WIDTH + i) for i in range(WIDTH) if i not in out]
            keys.append(F.xxhash64(F.lit(c), F.lit(",".join(map(str, out))), F.concat(*kept)))
    return signed.select(F.posexplode(F.array(*keys)).alias("index", "key"), "doc_id")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(u, v, linked) of pairs (u, v), decided on full sets."""

    def decide(batches):
        release()
        for batch in batches:
            us, vs, a, b = (batch.column(i) for i in range(4))
            hit = []
            for x, y in zip(a, b):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                hit.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([us, vs, pa.array(hit, pa.bool_())], names=["u", "v", "linked"])

    left, right = (sets.select(F.col("doc_id").alias(n), F.col("set").alias(f"set_{n}")) for n in "uv")
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v")
    decided = both.mapInArrow(decide, "u BIGINT, v BIGINT, linked BOOLEAN")
    return decided.groupBy("u", "v").agg(F.max("linked").alias("linked"))  # an id may have several texts


def _unpacked(signatures: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indexed values and further values of signatures, one row each."""
    rows = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    return np.ascontiguousarray(rows[:, : 2 * INDEXED]).view("<u2"), rows[:, 2 * INDEXED :]


def _near(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs whose signatures are close enough and whose set sizes allow a link."""
    column = lambda n: signed.select(F.col("doc_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("signature").alias(f"s_{n}"))

    def measure(batches):
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            (a, x), (b, y) = (_unpacked(batch.column(i).to_pylist()) for i in (2, 3))
            keep = pa.array(((a != b).sum(axis=1) <= DISTANCE) & ((a != b).sum(axis=1) + (x != y).sum(axis=1) <= WHOLE_DISTANCE))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])

    sized = pairs.join(column("u"), "u").join(column("v"), "v").filter(
        f"100 * least(n_u, n_v) >= {PERCENT} * greatest(n_u, n_v)"
    )
    return sized.select("u", "v", "s_u", "s_v").mapInArrow(measure, "u BIGINT, v BIGINT").distinct()


def _linked(own: np.ndarray, others: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which of `others` are linked with the set `own`."""
    sizes = np.array([len(o) for o in others])
    block, hit = np.cumsum(sizes) // LOOKUP, []
    for first, last in zip(*(np.searchsorted(block, np.unique(block), side) for side in ("left", "right"))):
        every, n = np.concatenate(others[first:last]), sizes[first:last]
        at = np.minimum(np.searchsorted(own, every), len(own) - 1)
        both = np.add.reduceat(own[at] == every, np.cumsum(n) - n, dtype=np.int64)
        hit.append(100 * both >= percent * (len(own) + n - both))
    return np.concatenate(hit)


def _across(members: DataFrame) -> DataFrame:
    """(u, v): links across the components of a key. No pair is a row: signatures and full sets meet inside tiles.

    A key's members are dealt to slices, and a task holds two slices, whatever the size of the key. Close pairs
    of different components are tried at the first key that the two share; links that join what the
    tile has joined before are left out, so a tile gives fewer rows than it has components.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / SLICE, F.sum("n_shingles") / SLICE_SHINGLES)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = (
        members.join(sizes, "key").withColumn("slice", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("one", F.least("slice", "other")).withColumn("two", F.greatest("slice", "other"))
        .select("key", "one", "two", "slice", "index", "doc_id", "label", "n_shingles", "signature", "set")
    )
    outs = list(combinations(range(WIDTH), ERRORS))
    rest = [[i for i in range(WIDTH) if i not in out] for out in outs]

    def tile(pdf):
        import pandas as pd

        release()
        chunk, out = divmod(int(pdf["index"].iloc[0]), len(outs))
        whole = pdf["one"].iloc[0] == pdf["two"].iloc[0]
        ids, labels, sizes, part = (pdf[c].to_numpy() for c in ("doc_id", "label", "n_shingles", "slice"))
        sets = [np.frombuffer(b, np.uint64) for b in pdf["set"]]
        indexed, further = _unpacked(pdf["signature"].tolist())
        own = np.unique(labels, return_inverse=True)[1]
        largest = np.bincount(own).argmax()
        joined, links = own.copy(), []  # the component of each member, as links join them
        for i in np.flatnonzero(own != largest):
            fits = 100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i])
            at = np.flatnonzero((joined != joined[i]) & ((own == largest) | (ids > ids[i])) & fits & (whole | (part != part[i])))
            off = indexed[at] != indexed[i]
            far = off.sum(axis=1)
            near = (far <= DISTANCE) & (far + (further[at] != further[i]).sum(axis=1) <= WHOLE_DISTANCE)
            at, off = at[near], off[near].reshape(-1, CHUNKS, WIDTH)
            met = off.sum(axis=2) <= ERRORS
            first = met.argmax(axis=1) == chunk
            at, off = at[first], off[first][:, chunk]
            shares = np.stack([~off[:, kept].any(axis=1) for kept in rest], axis=1)
            at = at[shares.argmax(axis=1) == out]
            if not len(at):
                continue
            for j in at[_linked(sets[i], [sets[j] for j in at])]:
                if joined[j] != joined[i]:
                    joined[joined == joined[j]] = joined[i]
                    links.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    return dealt.groupBy("key", "one", "two").applyInPandas(tile, "u BIGINT, v BIGINT")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id) of every document with an id.

    component_id is the least id reachable over links, class_id the least id with the same set.
    """
    signed = stored(signatures(docs, key, text, shingle), "near-signed")
    classes = signed.filter("same IS NOT NULL").groupBy("same").agg(
        F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    classes = stored(classes, "near-classes")
    leaders = classes.select(F.col("class_id").alias("doc_id"), "same", "n_shingles", "signature")
    keys = index_keys(classes.withColumnRenamed("class_id", "doc_id"))
    # a member by chance, not always the least, so that a large group is tried against several
    chance = F.xxhash64("doc_id", F.pmod("key", F.lit(CENTRES)))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min_by("doc_id", chance).alias("centre")).filter("a <> b")
    members = stored(keys.join(shared.select("key", "centre"), "key"), "near-members")
    pairs = members.filter("doc_id <> centre").select(F.least("centre", "doc_id").alias("u"), F.greatest("centre", "doc_id").alias("v")).distinct()
    pairs = stored(_near(pairs, leaders), "near-pairs")
    wanted = members.select("doc_id").distinct()
    sets = stored(full_sets(docs.join(wanted, docs[key].cast("long") == wanted["doc_id"], "left_semi"), key, text, shingle), "near-sets")
    tried = stored(confirm(pairs, sets), "near-tried")
    # rows that share an id but not a text tie their classes together
    several = signed.groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("b")).filter("a <> b").select("doc_id")
    tied = signed.join(several, "doc_id", "left_semi").join(classes, "same").select(F.col("doc_id").alias("u"), F.col("class_id").alias("v"))
    tied = stored(tied.filter("u <> v"), "near-tied")
    def labelled(tried: DataFrame) -> DataFrame:
        links = tried.filter("linked").select("u", "v").unionByName(tied)
        if links.isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        return stored(connected_components(links), "near-labels")

    labels = labelled(tried)
    named = members.join(labels, members["doc_id"] == labels["node"], "left").select(
        "key", "index", "doc_id", F.coalesce("component", "doc_id").alias("label")
    )
    several = named.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("a <> b AND n > 2")
    open_ = stored(named.join(several.select("key", "n"), "key"), "near-open")  # a key of two members has been tried already
    one, two = (open_.filter(F.col("n") <= SMALL).select("key", F.col("doc_id").alias(n), F.col("label").alias(f"label_{n}")) for n in "uv")
    few = _near(one.join(two, "key").filter("u < v AND label_u <> label_v").select("u", "v").distinct(), leaders)
    fresh = stored(few.join(tried.select("u", "v"), ["u", "v"], "left_anti"), "near-fresh")
    large = open_.filter(F.col("n") > SMALL)
    held = sets.join(large.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "same").agg(F.first("set").alias("set"))
    links = stored(_across(large.join(leaders.join(held, ["doc_id", "same"]), "doc_id")).distinct(), "near-links")
    decided = stored(confirm(fresh, sets).unionByName(links.withColumn("linked", F.lit(True))), "near-decided")
    if not decided.filter("linked").isEmpty():
        labels = labelled(tried.unionByName(decided))
    ends = signed.join(classes.select("same", "class_id"), "same", "left").join(labels, F.col("class_id") == F.col("node"), "left")
    return ends.select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    ).withColumn("kept", F.col("doc_id") == F.col("component_id"))
