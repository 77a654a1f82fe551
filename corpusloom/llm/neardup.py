"""Near-duplicate records by an LSH forest over MinHash signatures, with exact verification.

1. Each text becomes a set of shingles (64-bit hashes of word or character sequences) and a signature of 256 MinHash
   values. Texts with equal sets form a class, of which only the least id goes on.
2. Groups of nearly equal texts are found first: members of a common prefix of many are compared with its least id, the
   leader. Two texts within half the allowed distance of one leader are near duplicates by the triangle inequality, so such
   a tight class needs no comparisons inside, however large it is.
3. A forest of prefix tries: each tree orders the signatures by its own sequence of their values. The trees are sorted once,
   into subtries (all that share the shortest prefix in use) that are written as blocks of sorted keys; a subtrie with one
   leaf is dropped. Candidates are pairs of leaves of different classes; the level of a pair is the length of its keys' common prefix.
   Pairs of the deepest levels come first, and the prefix is shortened, level by level on the stored blocks, until the recall
   reaches its target. The recall is estimated from the verified pairs (each of similarity s stands for 1 / P(s) pairs, P
   being the chance that it shares a prefix at the depth in some tree), and has to be at least `floor` for a pair that lies
   just at the threshold. Where even the shortest stored prefix is too long, the trees are sorted anew with a shorter one.
4. Candidates whose signatures differ too much (by more than four standard deviations) are dropped; all others are
   verified by the similarity of their whole sets.

A block holds at most BLOCK leaves. A subtrie of more is several blocks, of which each two (unless both are of one tight class)
are compared in a task of their own; nothing is gathered, and there is no cap on runs, partners or candidates.

Cases: null texts and texts with fewer words or signs than a shingle have no set and no partner; a row without id is left
out; of several texts of one id the one with the least set hash counts; repeated rows count once; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import discard, materialize

#: MinHash values in a signature, trees, and values in a tree's longest prefix.
VALUES, TREES, DEPTH = 256, 64, 8
#: Levels that the stored subtries allow to shorten a prefix by, and leaves in a block of a subtrie.
LEVELS, BLOCK = 2, 256
#: Values of a leaf's key beyond its subtrie: prefixes that are longer still need not be told apart.
KEY = 4
#: Trees in which leaders of tight classes are sought, and members that a prefix must have for one.
LEADER_TREES, HOT = 8, 32
#: Characters worked on at once, and words whose hashes are remembered.
CHUNK, WORDS = 2_000_000, 1_000_000

_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint32)
_PATHS = np.stack([_RNG.permutation(VALUES)[:DEPTH] for _ in range(TREES)])
_WORD = re.compile(r"[^\W_]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def _sequences(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all sequences of so many values inside each stretch, and the stretch of each."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = mix(h + values[i : n + i] * np.uint64(2 * i + 1) + np.uint64(0x9E3779B97F4A7C15))
    inside = owner[:n] == owner[length - 1 :]
    return h[inside], owner[:n][inside]


def word_shingles(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of sequences of so many words (runs of letters and digits of the lower-cased text), and their texts' index."""
    found = [_WORD.findall(t.lower()) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    hashes = np.fromiter((_words[w] for ws in found for w in ws), np.uint64, int(sizes.sum()))
    return _sequences(hashes, sizes, length)


def char_shingles(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of sequences of so many characters, and their texts' index."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _sequences(codes, sizes, length)


def url_shingles(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """char_shingles of URLs, lower case, without all up to the first '://'."""
    return char_shingles([t.lower().split("://", 1)[-1] for t in texts], length)


def distinct_sets(shingles: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles by owner, sorted, and the n + 1 bounds of the owners."""
    order = np.lexsort((shingles, owner))
    s, o = shingles[order], owner[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    return s[keep], np.searchsorted(o[keep], np.arange(n + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values (the low 16 bits of each minimum) of non-empty sets, one row each."""
    low = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, VALUES), np.uint16)
    for k in range(VALUES):
        out[:, k] = np.minimum.reduceat(low * _MUL[k] + _ADD[k], bounds[:-1]).astype(np.uint16)
    return out


@dataclass(frozen=True)
class Shape:
    """What similarity means: the shingles of a text, and the least share of common ones."""

    shingles: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]]
    length: int
    threshold: float


WORDS3 = Shape(word_shingles, 3, 0.6)
WORDS5 = Shape(word_shingles, 5, 0.8)
URL5 = Shape(url_shingles, 5, 0.7)


def _chunks(ids: list, texts: list) -> Iterator[tuple[list, list[str]]]:
    a, b, n = [], [], 0
    for i, t in zip(ids, texts):
        if i is None or not t:
            continue
        a.append(i)
        b.append(t)
        n += len(t)
        if n > CHUNK:
            yield a, b
            a, b, n = [], [], 0
    if a:
        yield a, b


def _features(shape: Shape, id_type: pa.DataType, whole: bool):
    """For mapInArrow: (id, text) to (id, set_hash, n, signature), or with `whole` to (id, set_hash, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sets, bounds = distinct_sets(*shape.shingles(texts, shape.length), len(texts))
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                if not len(full):
                    continue
                starts = bounds[:-1][full]
                key = pa.array(np.add.reduceat(mix(sets), starts).view(np.int64))
                who = pa.array([ids[i] for i in full.tolist()], id_type)
                ends = np.append(starts, len(sets)).astype(np.int32)  # empty sets take no place
                if whole:
                    yield pa.RecordBatch.from_arrays([who, key, pa.ListArray.from_arrays(pa.array(ends), pa.array(sets.view(np.int64)))], names=["id", "set_hash", "shingles"])
                else:
                    sig = signatures(sets, ends.astype(np.int64))
                    flat = pa.py_buffer(np.ascontiguousarray(sig).tobytes())
                    binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), len(sig), [None, flat]).cast(pa.binary())
                    bits = np.packbits((sig & 1).astype(bool), axis=1)
                    sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(VALUES // 8), len(sig), [None, pa.py_buffer(bits.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([who, key, pa.array(sizes[full].astype(np.int32)), binary, sketch], names=["id", "set_hash", "n", "sig", "sketch"])

    return run


def _leaves(low: int, trees: int):
    """For mapInArrow: (id, label, sig) to (node, key, id, label), one row for each tree; node names the tree and the first `low` values, key holds the next KEY ones, the first in its highest bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(n, VALUES).astype(np.uint64)
            for t in range(trees):
                node, key = np.full(n, t + 1, np.uint64), np.zeros(n, np.uint64)
                for k in _PATHS[t, :low]:
                    node = mix(node * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                for i, k in enumerate(_PATHS[t, low : low + KEY]):
                    key |= sig[:, k] << np.uint64(16 * (KEY - 1 - i))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], names=["node", "key", "id", "label"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: leaves sorted by (node, key) to blocks (node, block, label, keys, ids, labels); nodes with one leaf are dropped. label: the one of all its leaves, or null."""
    held, carried = None, 0  # the leaves of the last block, which may go on, and its number

    def made(part: pa.RecordBatch, number: np.ndarray) -> pa.RecordBatch:
        node = np.asarray(part.column(0))
        start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (number[1:] != number[:-1])])
        size = np.diff(np.r_[start, len(node)])
        kept = (size > 1) | (number[start] > 0)
        part, number = part.filter(pa.array(np.repeat(kept, size))), np.repeat(number[start][kept], size[kept])
        start = np.r_[0, np.cumsum(size[kept])].astype(np.int32)
        first = start[:-1]
        labels, ids = part.column(3), part.column(2)
        own = np.asarray(labels)
        low, high = (f.reduceat(own, first) if len(first) else own[:0] for f in (np.minimum, np.maximum))
        return pa.RecordBatch.from_arrays([
            part.column(0).take(pa.array(first)), pa.array(number[first].astype(np.int32)), pa.array(low, labels.type, mask=low != high),
            pa.ListArray.from_arrays(pa.array(start), part.column(1)), pa.ListArray.from_arrays(pa.array(start), ids), pa.ListArray.from_arrays(pa.array(start), labels),
        ], names=["node", "block", "label", "keys", "ids", "labels"])

    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        node = np.asarray(b.column(0))
        begins = np.r_[True, node[1:] != node[:-1]]
        at = np.arange(len(node))
        place = at - np.maximum.accumulate(np.where(begins, at, 0))
        place[: begins[1:].argmax() + 1 if begins[1:].any() else len(node)] += carried * BLOCK  # the first node goes on
        number = place // BLOCK
        cut = int(np.flatnonzero(np.r_[True, begins[1:] | (number[1:] != number[:-1])])[-1])
        if cut:
            yield made(b.slice(0, cut), number[:cut])
        held, carried = b.slice(cut), int(number[cut])
    if held is not None:
        yield made(held, np.full(held.num_rows, carried))


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number of first values that the keys x have in common with the keys y beside them."""
    differ = (x ^ y).view(np.uint64)
    return sum((differ < np.uint64(1 << (16 * k))).astype(int) for k in range(1, KEY)) + (differ == 0)


def _inside(deep: int, shallow: int, id_type: pa.DataType):
    """For mapInArrow: blocks (keys, ids, labels) to pairs of ids of different labels in one block whose level lies between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, labels = (np.asarray(batch.column(k).flatten()) for k in (0, 1, 2))
            block = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column(1).value_lengths()))
            at, step = np.arange(len(ids)), 1
            # Sorted keys: if a leaf's prefix differs from that of the one `step` behind, no later one shares it.
            while len(at := at[at + step < len(ids)]):
                at = at[block[at] == block[at + step]]
                level = _common(keys[at], keys[at + step])
                at, level = at[level >= shallow], level[level >= shallow]
                i = at[(level <= deep) & (labels[at] != labels[at + step]) & (ids[at] != ids[at + step])]
                x, y = ids[i], ids[i + step]
                for k in range(0, len(i), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[k : k + 100_000], id_type), pa.array(np.maximum(x, y)[k : k + 100_000], id_type)], names=["a", "b"])
                step += 1

    return run


def _across(deep: int, shallow: int, id_type: pa.DataType):
    """For mapInArrow: two blocks (keys, ids, labels, and again for the other) to pairs of an id of each, as _inside has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kx, ix, lx, ky, iy, ly in zip(*(c.to_pylist() for c in batch.columns)):
                x, y, ix, iy, lx, ly = (np.array(c) for c in (kx, ky, ix, iy, lx, ly))
                i, j = (k.ravel() for k in np.indices((len(ix), len(iy))))
                m = lx[i] != ly[j]
                i, j = i[m], j[m]
                level = _common(x[i], y[j])
                m = (level >= shallow) & (level <= deep) & (ix[i] != iy[j])
                a, b = ix[i[m]], iy[j[m]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), id_type), pa.array(np.maximum(a, b), id_type)], names=["a", "b"])

    return run


def _leaders(lead: DataFrame, depth: int) -> DataFrame:
    """(id, leader): for members of prefixes of more than HOT texts the least id of such a prefix."""
    rows = lead.select("id", F.col("id").alias("label"), "sig").mapInArrow(_leaves(depth, LEADER_TREES), f"node bigint, key bigint, id {lead.schema['id'].dataType.simpleString()}, label {lead.schema['id'].dataType.simpleString()}").select("node", "id")
    rows = materialize(rows, "leading")
    hot = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("leader")).filter(F.col("n") > HOT).select("node", "leader")
    return rows.join(hot, "node").groupBy("id").agg(F.min("leader").alias("leader")).filter("id <> leader")


def _candidates(blocks: DataFrame, deep: int, shallow: int, arrow: pa.DataType) -> DataFrame:
    """Pairs (a, b) of leaves of one subtrie whose level, counted from the subtrie's root, lies between: inside each block, and across each two blocks of a large one."""
    pair = f"a {arrow_name(arrow)}, b {arrow_name(arrow)}"
    inside = blocks.filter("label is null").select("keys", "ids", "labels").mapInArrow(_inside(deep, shallow, arrow), pair)
    many = blocks.filter("block > 0").select("node").distinct()
    large = blocks.join(many, "node", "left_semi")
    about = large.select("node", "block", "label")
    two = about.join(about.select("node", F.col("block").alias("other"), F.col("label").alias("l")), "node").filter("block < other and (label is null or l is null or label <> l)").select("node", "block", "other")
    across = two.join(large.select("node", "block", "keys", "ids", "labels"), ["node", "block"]).join(large.select("node", F.col("block").alias("other"), F.col("keys").alias("ky"), F.col("ids").alias("iy"), F.col("labels").alias("ly")), ["node", "other"])
    return inside.unionByName(across.select("keys", "ids", "labels", "ky", "iy", "ly").mapInArrow(_across(deep, shallow, arrow), pair)).distinct()


def arrow_name(arrow: pa.DataType) -> str:
    return "bigint" if arrow == pa.int64() else "int"


def chance(s, depth: int):
    """The chance that a pair of similarity s shares a prefix of that depth in some tree."""
    return 1 - (1 - s**depth) ** TREES


def _alike(a: str, b: str):
    """Common bits of two sketches of VALUES bits each, as a column."""
    words = []
    for i in range(0, VALUES // 8, 8):
        x, y = (F.conv(F.hex(F.substring(F.col(c), i + 1, 8)), 16, -10).cast("bigint") for c in (a, b))
        words.append(F.bit_count(x.bitwiseXOR(y)))
    return F.lit(VALUES) - sum(words[1:], words[0])


@dataclass
class Forest:
    """The near-duplicates of a table of texts. classes: (id, rep); tight: (rep, label) of the tight classes of more than one; links: (a, b, similarity) between representatives of different labels, a < b."""

    classes: DataFrame
    links: DataFrame
    depth: int
    recall: float
    tight: DataFrame | None = None


def near_duplicates(texts: DataFrame, shape: Shape, target: float = 0.99, floor: float = 0.95) -> Forest:
    """Classes and links of texts (id, text); ids are int or bigint.

    target: least estimated recall of the links. floor: least chance of a candidate at the threshold itself.
    """
    kind = texts.schema["id"].dataType
    arrow = pa.int64() if kind.simpleString() == "bigint" else pa.int32()
    own = kind.simpleString()
    rows = texts.select("id", "text").filter("id is not null and text is not null")
    features = materialize(rows.mapInArrow(_features(shape, arrow, False), f"id {own}, set_hash bigint, n int, sig binary, sketch binary"), "signatures")
    one = features.groupBy("id").agg(F.min(F.struct("set_hash", "n")).alias("s")).select("id", "s.set_hash", "s.n")
    reps = one.groupBy("set_hash", "n").agg(F.min("id").alias("rep"))
    classes = materialize(one.join(reps, ["set_hash", "n"]).select("id", "rep", "set_hash"), "classes")
    chosen = classes.filter("id = rep").select("id", "set_hash")
    lead = materialize(features.join(chosen, ["id", "set_hash"], "left_semi").select("id", "sig", "sketch").dropDuplicates(["id"]), "lead")
    discard(features)  # classes and lead hold what goes on
    sketches = lead.select("id", "sketch")
    least = shape.threshold - 4 * 2 * (0.25 * (1 - shape.threshold**2) / VALUES) ** 0.5
    depth = max(d for d in range(1, DEPTH + 1) if d == 1 or chance(shape.threshold, d) >= floor)
    leaders = materialize(_leaders(lead, depth).select(F.col("leader").alias("a"), F.col("id").alias("b")), "leaders")
    tight, known = None, None
    leaves = lead.select("id", F.col("id").alias("label"), "sig")
    if not leaders.isEmpty():
        near = materialize(_verify(leaders, rows, chosen, shape, arrow, own), "near")
        tight = materialize(near.filter(F.col("similarity") >= (1 + shape.threshold) / 2).select(F.col("b").alias("rep"), F.col("a").alias("label")), "tight")
        heads = tight.select(F.col("label").alias("rep"), "label").distinct().join(tight.select("rep"), "rep", "left_anti")
        tight = materialize(tight.unionByName(heads), "labels")
        # What the comparison with leaders outside of one's class has shown is kept.
        known = materialize(_labelled(near, tight).filter("la <> lb").select("a", "b", "similarity"), "links")
        leaves = lead.select("id", "sig").join(tight.withColumnRenamed("rep", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "sig")
    low, deep, blocks = 0, DEPTH, None
    while True:
        if blocks is None or depth < low:
            low = max(1, depth - LEVELS)
            sorted_ = leaves.mapInArrow(_leaves(low, TREES), f"node bigint, key bigint, id {own}, label {own}")
            if tight is None:  # then each label is the id: it need not be shuffled
                sorted_ = sorted_.select("node", "key", "id")
            sorted_ = sorted_.repartition("node").sortWithinPartitions("node", "key").select("node", "key", "id", F.col("id" if tight is None else "label").alias("label"))
            blocks = materialize(sorted_.mapInArrow(_blocks, f"node bigint, block int, label {own}, keys array<bigint>, ids array<{own}>, labels array<{own}>"), "subtries")
        pairs = _candidates(blocks, KEY if deep == DEPTH else deep - low, depth - low, arrow)
        if known is not None:
            pairs = pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pairs = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("ka")), "a").join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("kb")), "b")
        likely = materialize(pairs.filter(_alike("ka", "kb") >= VALUES * (1 + least) / 2).select("a", "b"), "candidates")
        found = _verify(likely, rows, chosen, shape, arrow, own)
        known = materialize(found if known is None else known.unionByName(found), "links")
        p = F.lit(1.0) - F.pow(1 - F.pow("similarity", F.lit(depth)), F.lit(TREES))
        n, stands_for = known.agg(F.count("*"), F.sum(1 / p)).first()
        recall = n / stands_for if n else 1.0
        if recall >= target or depth == 1:
            return Forest(classes.select("id", "rep"), known, depth, recall, tight)
        deep = depth = depth - 1


def _labelled(pairs: DataFrame, tight: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the labels la and lb, an id without one being its own."""
    for c in ("a", "b"):
        pairs = pairs.join(tight.select(F.col("rep").alias(c), F.col("label").alias(f"l{c}")), c, "left").withColumn(f"l{c}", F.coalesce(f"l{c}", c))
    return pairs


def _verify(pairs: DataFrame, rows: DataFrame, chosen: DataFrame, shape: Shape, arrow: pa.DataType, own: str) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, with the similarity. Only their texts are read into sets."""
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = rows.join(needed, "id", "left_semi").mapInArrow(_features(shape, arrow, True), f"id {own}, set_hash bigint, shingles array<bigint>")
    sets = sets.join(chosen, ["id", "set_hash"], "left_semi").dropDuplicates(["id"]).select("id", "shingles")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("common"))
    # In whole numbers (thousandths), so that a pair just at the threshold is not lost to rounding.
    enough = F.col("common") * 1000 >= (F.col("na") + F.col("nb") - F.col("common")) * round(shape.threshold * 1000)
    return both.filter(enough).select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("similarity"))


def all_pairs(forest: Forest) -> DataFrame:
    """(a, b), a < b: each pair of ids whose texts are near duplicates, members of classes included."""
    members = forest.classes
    x = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    y = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = forest.links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    labelled = members.select("id", F.col("rep").alias("label")) if forest.tight is None else members.join(forest.tight, "rep", "left").select("id", F.coalesce("label", "rep").alias("label"))
    many = labelled.groupBy("label").agg(F.count("*").alias("m")).filter("m > 1").select("label")
    shared = labelled.join(many, "label", "left_semi")
    within = shared.select("label", F.col("id").alias("x")).join(shared.select("label", F.col("id").alias("y")), "label").filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def star_links(forest: Forest) -> DataFrame:
    """(a, b): the links, and for each member of a tight class the one to its leader: enough to reach all that the class links."""
    links = forest.links.select("a", "b")
    return links if forest.tight is None else links.unionByName(forest.tight.select(F.col("label").alias("a"), F.col("rep").alias("b"))).filter("a <> b").distinct()


def union(first: Forest, second: Forest) -> Forest:
    """One forest of the ids of both, linked where either links them. Its classes are those of first; an id it lacks is its own.

    The classes of second become links from each member's class to the class of its representative, tight classes links to the leader.
    """
    ids = first.classes.select("id", "rep").join(second.classes.select("id", F.col("rep").alias("other")), "id", "full")
    nodes = materialize(ids.select("id", F.coalesce("rep", "id").alias("rep"), "other"), "nodes")
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("rep").alias(f"{c}_node"))
    members = nodes.filter("other is not null").select(F.col("rep").alias("a"), "other").join(of("other"), "other").select("a", F.col("other_node").alias("b"))
    across = star_links(second).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    links = star_links(first).unionByName(members).unionByName(across).filter("a <> b")
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return Forest(nodes.select("id", "rep"), links, min(first.depth, second.depth), min(first.recall, second.recall))


def groups(forest: Forest) -> DataFrame:
    """(id, group, rep, links): each id with the least id that a chain of near-duplicates leads to, and the number of links of its representative in star form (inside a tight class only the one to the leader).

    Labels spread by rounds in which each label also jumps to its own label, so chains halve; each round is a written table.
    """
    edges = star_links(forest)
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(forest.classes.filter("id = rep").select("id", F.col("id").alias("group")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group").alias("near"))
        step = labels.join(near, "id", "left").select("id", "group", F.least("group", F.coalesce("near", "group")).alias("next"))
        jump = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = materialize(step.join(jump, "next", "left").select("id", "group", F.least("next", F.coalesce("far", "next")).alias("to")), "labels")
        changed = new.filter("to < `group`").limit(1).count()
        labels = new.select("id", F.col("to").alias("group"))
        if not changed:
            break
    degree = both.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    out = forest.classes.join(labels.withColumnRenamed("id", "rep"), "rep").join(degree, "rep", "left")
    return out.select("id", "group", "rep", F.coalesce("links", F.lit(0)).alias("links"))
