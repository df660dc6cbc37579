"""Problem 1: records that are revisions of one another.

Each text becomes a signature of ``CHUNKS`` * ``CHUNK_WIDTH`` b-bit symbols (b-bit minwise
hashes of its word sequences); two texts differ in an expected share of 1 - similarity of
the symbols.  The multi-index Hamming join splits signatures into chunks.  By pigeonhole,
two signatures that differ in at most ``radius()`` symbols have a chunk that differs in at
most ``CHUNK_ERRORS``; so each record is entered under every chunk with every choice of
so many symbols left out, and two such records meet in at least one entry.  Records that
meet and agree in enough symbols are verified exactly on their texts.

Exact copies share one class and one representative; only representatives are joined,
and pairs of copies come from the classes.  Texts with fewer words than a sequence, null and
empty texts have no pairs.  A record that is repeated counts once.  Heavy entries are split by
Spark's skew join.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.operators.components import connected_components
from lodestrata.session import cut
from lodestrata.tables import chunk_nodes, table

WORDS = 3
SIMILARITY = 0.6
CHUNKS, CHUNK_WIDTH, CHUNK_ERRORS = 10, 4, 1
SYMBOL_BITS = 32
#: Symbols of a signature that travel with each entry, five bits each, twelve to a long, and how many of them
#: must agree before texts are compared; at the least similarity asked for, fewer agree once in thousands of pairs.
SKETCH_SYMBOLS, SKETCH_AGREE = 24, 8
#: Ids of texts to compare that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Texts whose sequences are hashed at once, and texts whose sets a task remembers; both only bound memory.
HASHED_TEXTS, REMEMBERED_TEXTS = 2_000, 200
_SEED = 20_240_131


def radius(chunks: int = CHUNKS, errors: int = CHUNK_ERRORS) -> int:
    """Symbols in which two signatures may differ and still be sure to meet."""
    return chunks * (errors + 1) - 1


class _WordHashes(dict):
    """64-bit hashes of words, each computed once; cleared when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def sequence_hashes(texts: list[str | None], hashes: _WordHashes, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word sequences of all texts, one text after the other, and how many each has."""
    lists = [t.lower().split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    flat = np.fromiter((hashes[w] for x in lists for w in x), dtype=np.uint64, count=int(sizes.sum()))
    counts = np.maximum(sizes - words + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    rolled = flat[: len(flat) - words + 1].copy()
    for i in range(1, words):
        rolled *= np.uint64(0x100000001B3)
        rolled ^= flat[i : len(flat) - words + 1 + i]
        rolled = _mix(rolled)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return rolled[at], counts


def signatures(values: np.ndarray, counts: np.ndarray, symbols: int, bits: int = SYMBOL_BITS) -> np.ndarray:
    """One row of ``symbols`` b-bit minwise hashes for each text that has sequences, in order."""
    rng = np.random.default_rng(_SEED)
    factors = rng.integers(1, 2**63, symbols, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 2**63, symbols, dtype=np.uint64)
    kept = counts[counts > 0]
    starts = np.cumsum(kept) - kept
    out = np.empty((len(kept), symbols), dtype=np.uint64)
    room = np.empty_like(values)
    for k in range(symbols):
        np.bitwise_xor(values, shifts[k], out=room)
        np.multiply(room, factors[k], out=room)
        out[:, k] = np.minimum.reduceat(room, starts)
    return _mix(out) >> np.uint64(64 - bits)


def index_entries(space: Column, symbols: Column) -> Column:
    """The index entries of a signature: every chunk with every choice of ``CHUNK_ERRORS`` symbols left out."""
    keys = []
    for chunk in range(CHUNKS):
        for kept in combinations(range(CHUNK_WIDTH), CHUNK_WIDTH - CHUNK_ERRORS):
            tag = chunk * 1_000 + sum(1 << i for i in kept)
            keys.append(F.xxhash64(space, F.lit(tag), *(symbols[chunk * CHUNK_WIDTH + i] for i in kept)))
    return F.array(*keys)


def sketches(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest five bits of ``SKETCH_SYMBOLS`` symbols, packed into two longs."""
    half = SKETCH_SYMBOLS // 2
    low = rows[:, :SKETCH_SYMBOLS] & np.uint64(31)
    shifts = (np.arange(half) * 5).astype(np.uint64)
    return tuple(np.bitwise_or.reduce(low[:, part] << shifts, axis=1).view(np.int64) for part in (slice(0, half), slice(half, 2 * half)))


def _disagree(one: str, other: str) -> Column:
    """How many five-bit symbols of two packed longs differ."""
    x = F.col(one).bitwiseXOR(F.col(other))
    some = x
    for i in range(1, 5):
        some = some.bitwiseOR(F.shiftright(x, i))
    ones = sum(1 << (5 * i) for i in range(SKETCH_SYMBOLS // 2))
    return F.bit_count(some.bitwiseAND(F.lit(ones)))


def signed_records(records: DataFrame, words: int = WORDS) -> DataFrame:
    """(``rid``, ``space``, ``id``, ``copy``, ``copy2``, ``s1``, ``s2``, ``symbols``) of the ``records`` (rid, space, id, text) that have a word sequence.

    ``copy`` and ``copy2``, 128 bits in all, are the same for texts with the same words in the same order within a space.
    """

    def make():
        hashes = _WordHashes()

        def part(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            values, counts = sequence_hashes(batch.column(3).to_pylist(), hashes, words)
            has = counts > 0
            if not has.any():
                return None
            rows = signatures(values, counts, CHUNKS * CHUNK_WIDTH)
            kept = counts[has]
            starts = np.cumsum(kept) - kept
            place = np.arange(len(values)) - np.repeat(starts, kept)
            space = batch.column(1).to_numpy(zero_copy_only=False)[has].astype(np.uint64)
            placed = values + _mix(place.astype(np.uint64))
            copy = np.add.reduceat(_mix(placed), starts) + space
            copy2 = np.add.reduceat(_mix(placed ^ np.uint64(_SEED)), starts)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            symbols = pa.ListArray.from_arrays(offsets, pa.array(rows.astype(np.uint32).view(np.int32).ravel()))
            own = [c.filter(pa.array(has)) for c in batch.columns[:3]]
            return pa.RecordBatch.from_arrays([*own, *map(pa.array, (copy.view(np.int64), copy2.view(np.int64), *sketches(rows))), symbols], names=["rid", "space", "id", "copy", "copy2", "s1", "s2", "symbols"])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            parts = [p for i in range(0, batch.num_rows, HASHED_TEXTS) if (p := part(batch.slice(i, HASHED_TEXTS))) is not None]
            return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

        return run

    schema = "rid bigint, space int, id string, copy bigint, copy2 bigint, s1 bigint, s2 bigint, symbols array<int>"
    return map_batches(records.select("rid", "space", "id", "text"), make, schema)


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of different representatives that meet in an entry and agree in enough symbols."""
    entry = signed.select(F.explode(index_entries(F.col("space"), F.col("symbols"))).alias("entry"), "rid", "s1", "s2")
    # both sides are the same plan over a checkpoint, so the index is shuffled once and read twice
    agree = F.lit(SKETCH_SYMBOLS) - _disagree("x.s1", "y.s1") - _disagree("x.s2", "y.s2")
    met = entry.alias("x").join(entry.alias("y"), F.col("x.entry") == F.col("y.entry"))
    return met.where((F.col("x.rid") < F.col("y.rid")) & (agree >= SKETCH_AGREE)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def verified_pairs(pairs: DataFrame, records: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(``a``, ``b``, ``similarity``) of the pairs whose sets of word sequences are alike enough, by their whole texts."""
    pairs = cut(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    if pairs.count() * 2 <= BROADCAST_IDS:
        needed = F.broadcast(needed)
    texts = records.select("rid", "text").join(needed, "rid", "left_semi")
    both = (
        pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )

    def make():
        def grams(text: str) -> set:
            w = text.lower().split()
            return set(zip(*(w[i:] for i in range(words))))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            a, b, one, two = batch.columns
            known: dict[str, set] = {}
            values = []
            for x, y in zip(one.to_pylist(), two.to_pylist()):
                if len(known) > REMEMBERED_TEXTS:
                    known.clear()
                p = known.get(x) or known.setdefault(x, grams(x))
                q = known.get(y) or known.setdefault(y, grams(y))
                common = len(p & q)
                values.append(common / max(1, len(p) + len(q) - common))
            values = np.array(values)
            keep = pa.array(values >= similarity)
            return pa.RecordBatch.from_arrays([a, b, pa.array(values)], names=["a", "b", "similarity"]).filter(keep)

        return run

    return map_batches(both, make, "a bigint, b bigint, similarity double")


def curation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (even ``rid``, space 0) and chunk nodes (odd ``rid``, space 1)."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("rid"), F.lit(0).alias("space"), F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    chunks = chunk_nodes(spark, sf_dir).select((F.col("pos") * 2 + 1).alias("rid"), F.lit(1).alias("space"), "id", "text")
    return docs.unionByName(chunks)


def revisions(records: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Members (``head``, ``id``) of all classes of copies, and pairs of class heads (``a``, ``b``, ``similarity``)."""
    signed = signed_records(records, words).persist(StorageLevel.DISK_ONLY)
    first = F.min_by(F.struct("rid", "space", "s1", "s2", "symbols"), "rid").alias("first")
    heads = cut(signed.groupBy("copy", "copy2").agg(first).select("copy", "copy2", "first.*"))
    # a class may hold a third of all records: a join that can be split by rows, no window over a class
    members = signed.select("copy", "copy2", "id").join(heads.select("copy", "copy2", F.col("rid").alias("head")), ["copy", "copy2"]).select("head", "id").distinct()
    return members, verified_pairs(candidate_pairs(heads), records, words, similarity)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, pairs = revisions(curation_records(spark, sf_dir))
    a, b = members.select(F.col("head").alias("a"), F.col("id").alias("x")), members.select(F.col("head").alias("b"), F.col("id").alias("y"))
    links = pairs.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    repeated = members.join(members.groupBy("head").count().where("count > 1").select("head"), "head", "left_semi")
    twins = repeated.select("head", F.col("id").alias("x")).join(repeated.select("head", F.col("id").alias("y")), "head").where("x < y").select("x", "y")
    return links.unionByName(twins).where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``id``, ``group``, ``keep``, ``links``) of every record with word sequences: its group of revisions, whether it is the
    one to keep (the first by its number), and how many other classes of copies its own is linked to."""
    members, pairs = revisions(curation_records(spark, sf_dir))
    pairs = cut(pairs.select("a", "b"))
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("head"), F.col("component").alias("first"))
    sides = pairs.select(F.col("a").alias("head")).unionByName(pairs.select(F.col("b").alias("head")))
    links = sides.groupBy("head").agg(F.count("*").alias("links"))
    rows = members.join(groups, "head", "left").join(links, "head", "left")
    own = members.groupBy("head").agg(F.min("id").alias("first_id"))
    return (
        rows.withColumn("group", F.coalesce("first", "head"))
        .join(own, "head")
        .select("id", "group", ((F.col("group") == F.col("head")) & (F.col("id") == F.col("first_id"))).alias("keep"), F.coalesce("links", F.lit(0)).alias("links"))
    )


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

_SPACES = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_GRAMS = rf"""t AS (
  SELECT 'd' || doc_id AS id, 0 AS space, doc_id * 2 AS rid, text FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT id, 1, min(pos) * 2 + 1, text FROM nodes WHERE lower(type) = 'chunk' AND text IS NOT NULL GROUP BY id, text),
w AS (SELECT id, space, rid, list_filter(regexp_split_to_array(lower(text), '{_SPACES}'), lambda x: x <> '') AS w FROM t),
g AS (SELECT DISTINCT id, space, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT id, space, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.h = b.h AND a.space = b.space AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b FROM s JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c))"""

ORACLES = {
    "p1_found": f"WITH {_GRAMS} SELECT id_a, id_b FROM pairs",
    "p1_groups": f"""WITH RECURSIVE {_GRAMS},
c AS (SELECT space || ':' || array_to_string(w, ' ') AS class, id, rid FROM w WHERE len(w) > 2),
h AS (SELECT class, min(rid) AS head, min(id) AS first_id FROM c GROUP BY 1),
m AS (SELECT DISTINCT id, head, first_id FROM c JOIN h USING (class)),
l AS (SELECT DISTINCT x.head AS a, y.head AS b FROM pairs JOIN m x ON x.id = id_a JOIN m y ON y.id = id_b WHERE x.head <> y.head),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
walk(head, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM u) UNION SELECT u.b, walk.root FROM walk JOIN u ON u.a = walk.head),
r AS (SELECT head, min(root) AS root FROM walk GROUP BY 1),
k AS (SELECT a AS head, count(*) AS links FROM u GROUP BY 1)
SELECT id, coalesce(root, m.head) AS "group", coalesce(root, m.head) = m.head AND id = first_id AS keep, coalesce(links, 0) AS links FROM m LEFT JOIN r ON r.head = m.head LEFT JOIN k ON k.head = m.head""",
}
