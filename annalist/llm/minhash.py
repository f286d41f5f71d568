"""Near duplicates by b-bit MinHash.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, and from it a digest of
   the set, BANDS x ROWS minima, a key for each band of minima, and the low two bits of each minimum, packed.
   Documents of one digest have the same set: they are one class, known by its smallest id.
2. Classes that share a band key are candidates. Within a key all members are first held against one of them,
   the member that shares keys with the most others; those that are found linked to it, directly or through
   others, need no further look. Keys that still hold several components are open. Their classes get a finer sketch of
   FINE minima and are compared with all of their keys' classes that are in other components, each pair once and in
   parts of a large key. Nearly all pairs that aren't linked are settled by the sketches; no candidate is dropped.
3. A candidate pair's similarity is estimated from the bits that agree, corrected for those that agree by
   chance (1 in 4); pairs far below the threshold go. The others are confirmed on their full sets.
4. Confirmed links make components; the smallest id of each is kept.

A pair at the threshold shares a key with probability 1 - (1 - 0.8^8)^56 = 0.99997, more above it; the estimate's
margin is four standard deviations, the finer one's four and a half.

Defined cases: a text without words, or a null text, has an empty set and is linked with nothing; with fewer
words than a shingle takes, the whole sequence is the one shingle; rows with the same id are each their own row
of the result; a null id makes a row of its own class unless others have its set; an empty table gives no rows.
Sets are compared by 64-bit hashes of shingles. doc_id is an integer (long); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import with_key_row, written
from annalist.llm.components import connected
from annalist.llm.pieces import Recent

BANDS, ROWS = 56, 8
LONGS = BANDS * ROWS // 64
#: Below the threshold by so much, an estimate rules a pair out.
MARGIN = 0.09
#: Minima of the finer sketch that only classes of open keys get, and its margin, four and a half standard deviations.
FINE, FINE_MARGIN = 4_096, 0.035
#: A key's members are compared in parts of about so many.
PART = 2_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_random = np.random.default_rng(20)
_A = _random.integers(0, 1 << 31, (BANDS * ROWS, 1)).astype(np.uint32) * 2 + 1
_B = _random.integers(0, 1 << 32, (BANDS * ROWS, 1)).astype(np.uint32)
_KEY = _random.integers(0, 1 << 62, (BANDS, ROWS)).astype(np.uint64) * 2 + 1
_FINE_A = _random.integers(0, 1 << 31, (FINE, 1)).astype(np.uint32) * 2 + 1
_FINE_B = _random.integers(0, 1 << 32, (FINE, 1)).astype(np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of shingles of texts; hashes of words are kept while they are not too many."""

    def __init__(self, words: int):
        import xxhash

        self.n, self.hash, self.known = words, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not len(h):
            return h
        short = len(h) < self.n
        width = len(h) if short else self.n
        out = np.full(len(h) - width + 1, width if short else 0, dtype=np.uint64)
        for i in range(width):
            out = _mixed(out * _STEP + h[i : i + len(out)])
        return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(least, (_A * x[None, i : i + 2048] + _B).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low two bits of the mixed minima: LONGS integers of first bits, then LONGS of second bits."""
    m = _mixed(least.astype(np.uint64))
    return np.concatenate([np.packbits((m >> np.uint64(k)).astype(np.uint8) & 1).view(np.uint64) for k in (0, 1)]).astype(np.int64)


def fine_bits(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low two bits of FINE minima, as integers of first bits and of second bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    least = np.full(FINE, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(least, (_FINE_A * x[None, i : i + 256] + _FINE_B).min(axis=1), out=least)
    m = _mixed(least.astype(np.uint64))
    return tuple(np.packbits((m >> np.uint64(k)).astype(np.uint8) & 1).view(np.uint64).astype(np.int64) for k in (0, 1))


def band_keys(least: np.ndarray) -> np.ndarray:
    return _mixed((least.reshape(BANDS, ROWS).astype(np.uint64) * _KEY).sum(axis=1)).astype(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for an empty set), keys, bits."""

    def run(batches):
        import xxhash

        shingles, seen = Shingles(words), {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                if not len(s):
                    rows.append((0, None, None, None))
                    continue
                digest = xxhash.xxh3_128_digest(s.tobytes())
                if digest not in seen:
                    if len(seen) > 5_000:
                        seen.clear()
                    least = minima(s)
                    seen[digest] = (band_keys(least), packed(least))
                rows.append((len(s), digest, *seen[digest]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_shingles", "digest", "keys", "bits"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity by the share of minima whose bits agree, corrected for chance agreement."""
    differ = F.lit(0)
    for i in range(LONGS):
        first = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        second = F.get(a, F.lit(i + LONGS)).bitwiseXOR(F.get(b, F.lit(i + LONGS)))
        differ = differ + F.bit_count(first.bitwiseOR(second))
    return (F.lit(1.0) - differ / F.lit(BANDS * ROWS) - 0.25) / 0.75


def _likely(a: str, b: str, percent: int) -> Column:
    """Whether two classes' sizes allow the similarity, and their bits make it likely."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (estimate(F.col(f"{a}.bits"), F.col(f"{b}.bits")) >= percent / 100 - MARGIN)


def _confirmed(pairs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets have percent * union <= 100 * intersection."""
    own = nodes.select("node", F.struct("n", "bits", "text").alias("x"))
    both = pairs.join(own.select(F.col("node").alias("u"), F.col("x").alias("a")), "u").join(own.select(F.col("node").alias("v"), F.col("x").alias("b")), "v").where(_likely("a", "b", percent))

    def run(batches):
        shingles, sets = Shingles(words), Recent(2_000)

        def of(text):
            if sets.absent([text]):
                sets[text] = shingles(text)
            return sets[text]

        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = of(a), of(b)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("u", "v", F.col("a.text").alias("a"), F.col("b.text").alias("b")).mapInArrow(run, "u long, v long"), "near-links")


def _star(postings: DataFrame, total: int) -> DataFrame:
    """Pairs of each key's best-connected node with the key's other nodes."""
    best = postings.groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"), F.count("*").alias("size"))
    best = best.select("key", F.col("best.node").alias("v"), "size")
    return with_key_row(postings, best, "key", "size", total).where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def _open(postings: DataFrame, found: DataFrame, total: int) -> DataFrame:
    """key, node, component, main, size: the postings of keys that hold more than one component; main is the largest of them."""
    placed = written(postings.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most")).where("parts > 1")
    keys = keys.select("key", "size", F.col("most.component").alias("main"))
    return written(with_key_row(placed, keys, "key", "size", total), "open-postings")


def _finer(nodes: DataFrame, words: int) -> DataFrame:
    """node, n, bits, keys, and first, second: the low two bits of FINE more minima of the node's set."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            rows = [fine_bits(shingles(x)) for x in batch.column(4).to_pylist()]
            more = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *more], ["node", "n", "bits", "keys", "first", "second"])

    schema = "node long, n long, bits array<long>, keys array<long>, first array<long>, second array<long>"
    return nodes.select("node", "n", "bits", "keys", "text").mapInArrow(run, schema)


def _fine_likely(a: str, b: str, percent: int) -> Column:
    """The same test by FINE minima, for pairs that passed the first."""
    x, y = (F.zip_with(f"{a}.{c}", f"{b}.{c}", lambda p, q: p.bitwiseXOR(q)) for c in ("first", "second"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseOR(q))), F.lit(0), lambda s, n: s + n)
    return (F.lit(1.0) - differ / F.lit(FINE) - 0.25) / 0.75 >= percent / 100 - FINE_MARGIN


def _rest(opened: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Likely pairs of different components that share an open key, each at the first of its shared keys only.

    Members of a key's main component aren't held against each other, and a large key's members are dealt out in parts.
    """
    fine = written(_finer(nodes.join(opened.select("node").distinct(), "node", "left_semi"), words), "finer")
    rows = opened.join(fine.select("node", F.struct("n", "bits", "keys", "first", "second").alias("x")), "node").where(F.array_contains("x.keys", F.col("key")))
    rows = rows.withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    left = rows.where("component <> main").select("key", F.col("node").alias("u"), F.col("component").alias("c"), F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = rows.select("key", F.col("node").alias("v"), F.col("component").alias("d"), (F.col("component") == F.col("main")).alias("in_main"), F.col("x").alias("b"), F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"))
    first = F.get(F.filter(F.zip_with("a.keys", "b.keys", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()), F.lit(0))
    other = F.col("in_main") | (F.col("c") < F.col("d"))
    return left.join(right, (left.key == right.key) & (left.part == right.part) & other & _likely("a", "b", percent) & (first == left.key) & _fine_likely("a", "b", percent)).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id, kept, class_id (smallest id with the same set)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketch = written(sketches(docs, words), "sketches")
    classes = written(sketch.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    total = classes.count() * BANDS
    # Rows of one id and different texts are one node with several sets; their component is their id anyway.
    first = classes.where("node is not null").select(F.col("node").alias("doc_id"), F.col("digest").alias("d"))
    members = sketch.join(first, "doc_id").where("digest = d").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "keys", "bits")
    postings = members.select("node", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    postings = written(with_key_row(postings, shared.select("key", "size"), "key", "size", total), "postings")
    scores = postings.groupBy("node").agg(F.sum("size").alias("score"))
    postings = written(postings.select("key", "node").join(scores, "node"), "scored-postings")
    active = scores.select("node")
    texts = docs.join(active.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text")
    nodes = written(members.join(active, "node").join(texts, "node"), "near-nodes")

    links = _confirmed(_star(postings, total), nodes, words, percent)
    found = written(connected(links), "near-components")
    more = _confirmed(_rest(_open(postings, found, total), nodes, words, percent), nodes, words, percent)
    if not more.isEmpty():
        found = written(connected(links.union(more)), "near-components")

    known = classes.join(found, "node", "left").where("n > 1 or component is not null")
    known = known.select("digest", F.col("node").alias("first"), F.coalesce("component", "node").alias("component"), "n")
    out = with_key_row(sketch.select("doc_id", "n_shingles", "digest"), known, "digest", "n", total // BANDS, "left")
    component = F.coalesce("component", "doc_id")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("first", "doc_id").alias("class_id"))
