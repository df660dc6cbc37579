"""Problem 9: find the test items that leaked into documents.

A passage of ``PASSAGE`` consecutive words of an item, found with at most ``BUDGET``
words inserted, left out or replaced, holds one of ``BUDGET`` + 1 pieces of it
unchanged (pigeonhole).  Every exact hit of a piece is verified: Myers' bit-parallel distance
over words gives the least distance of the passages that hold the piece, and no row comes without it.

Up to ``HELD_ITEMS`` items are held by the tasks, as an Aho-Corasick automaton over their pieces.  More
never meet on the driver or in one task: their pieces are hashed into a bitmap of fixed size, one pass
of the texts keeps the words around pieces that may be there, and a join by hash brings them to the items' passages.

Words are runs of letters and digits, lower-cased.  Items of fewer words than a
passage and null or empty texts give nothing.  Repeated rows give one result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.session import cut
from lodestrata.tables import table

PASSAGE = 12
BUDGET = 1
#: Items that tasks may hold; more are joined.
HELD_ITEMS = 20_000
#: Bits of the bitmap that tells which hashes of pieces occur in items (16 MB).
BITMAP_BITS = 27
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def myers_least(pattern: list[str], text: list[str]) -> int:
    """Least edit distance, in words, of ``pattern`` to any stretch of ``text``; one step a text word over bit vectors."""
    masks: dict[str, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        masks[word] |= 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    least = m
    for word in text:
        eq = masks.get(word, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = (down | ~(d0 | up)) & full
        hn = up & d0
        score += bool(hp & top) - bool(hn & top)
        hp = hp << 1 & full  # a match may begin at any word, so nothing is shifted in
        up = ((hn << 1) | ~(d0 | hp)) & full
        down = hp & d0
        least = min(least, score)
    return least


class LeakFinder:
    """Holds the pieces of a block of items; ``find`` gives (item index, least distance) of a text."""

    def __init__(self, items: Iterable[str | None], passage: int = PASSAGE, budget: int = BUDGET):
        import ahocorasick

        self.items = [words_of(t) for t in items]
        self.passage, self.budget, self.size = passage, budget, passage // (budget + 1)
        if self.size < 1:
            raise ValueError("a passage needs more words than the error budget")
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, words in enumerate(self.items):
            if len(words) >= passage:
                for at in range(len(words) - self.size + 1):
                    places[" " + " ".join(words[at : at + self.size]) + " "].append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def _distance(self, words: list[str], at: int, item: list[str], start: int) -> int:
        """Least distance of any passage of the item with its piece ``start`` at word ``at``."""
        least = self.passage
        for part in range(self.budget + 1):
            first = start - part * self.size
            if 0 <= first <= len(item) - self.passage:
                left = max(0, at - part * self.size - self.budget)
                right = at + (self.budget + 1 - part) * self.size + self.passage % self.size + self.budget
                least = min(least, myers_least(item[first : first + self.passage], words[left:right]))
        return least

    def find(self, text: str | None) -> list[tuple[int, int]]:
        if not text or not self.any:
            return []
        words = words_of(text)
        line = " " + " ".join(words) + " "
        hits = [(end, value) for end, value in self.automaton.iter(line)]
        found: dict[int, int] = {}
        counted, offset = 0, 0
        for end, (length, where) in hits:
            begin = end - length + 1
            counted += line.count(" ", offset, begin)
            offset = begin
            for i, start in where:
                least = found.get(i, self.passage)
                # no distance is less than 0, so an item found unchanged is not verified again
                if least and (distance := self._distance(words, counted, self.items[i], start)) <= self.budget:
                    found[i] = min(least, distance)
        return list(found.items())


def piece_hash(words: list[str]) -> int:
    """A signed 64-bit hash of consecutive words."""
    value = xxhash.xxh3_64_intdigest(" ".join(words))
    return value - (1 << 64) if value >= 1 << 63 else value


def _item_pieces(items: DataFrame, item_kind: str) -> DataFrame:
    """(``hash``, ``item``, ``words``): the distinct pieces of each item, with the words of the passages around them."""
    size = PASSAGE // (BUDGET + 1)

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes, which, around = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) >= PASSAGE:
                    for at in range(len(words) - size + 1):
                        hashes.append(piece_hash(words[at : at + size]))
                        which.append(n)
                        around.append(" ".join(words[max(0, at - PASSAGE + size) : at + PASSAGE]))
            return pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(0).take(pa.array(which, pa.int32())), pa.array(around, pa.string())], names=["hash", "item", "words"])

        return run

    return map_batches(items.select("item", "words"), make, f"hash bigint, item {item_kind}, words string").distinct()


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of the ``hashes``; tasks send at most one row for each word of the bitmap that has a bit."""
    place = hashes.select(F.shiftrightunsigned("hash", 64 - BITMAP_BITS).alias("place"))
    words = place.groupBy(F.shiftright("place", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 31 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 5), dtype=np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _joined_leaks(rows: DataFrame, items: DataFrame, kind: str, item_kind: str) -> DataFrame:
    """As the automaton finds them, for any number of items."""
    size = PASSAGE // (BUDGET + 1)
    pieces = cut(_item_pieces(items, item_kind))
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(pieces))

    def make():
        bits = shared.value

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            docs, hashes, around = [], [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if len(words) < size:
                    continue
                own = np.array([piece_hash(words[at : at + size]) for at in range(len(words) - size + 1)], dtype=np.int64)
                place = own.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
                for at in np.flatnonzero(bits[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32) & np.uint32(1)):
                    docs.append(n)
                    hashes.append(int(own[at]))
                    around.append(" ".join(words[max(0, at - PASSAGE + size - BUDGET) : at + PASSAGE + BUDGET]))
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int32())), pa.array(hashes, pa.int64()), pa.array(around, pa.string())], names=["doc", "hash", "around"])

        return run

    hits = map_batches(rows, make, f"doc {kind}, hash bigint, around string").distinct()

    def verify():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            distances = []
            for around, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text, item = around.split(" "), words.split(" ")
                distances.append(min(myers_least(item[a : a + PASSAGE], text) for a in range(len(item) - PASSAGE + 1)))
            out = pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(distances, pa.int32())], names=["doc", "item", "distance"])
            return out.filter(pa.array(np.array(distances, dtype=np.int64) <= BUDGET))

        return run

    return map_batches(hits.join(pieces, "hash").select("doc", "item", "around", "words"), verify, f"doc {kind}, item {item_kind}, distance int")


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", held_items: int = HELD_ITEMS) -> DataFrame:
    """(``key``, ``item_key``, ``distance``) of each document and item that share a passage, with the least number of changed words of any passage."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("words")).where("item IS NOT NULL AND words IS NOT NULL")
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") > 0)
    held = items.limit(held_items + 1).toArrow()
    if held.num_rows > held_items:
        found = _joined_leaks(rows, items, kind, item_kind)
    else:
        ids, texts = held["item"].combine_chunks(), held["words"].to_pylist()

        def make():
            finder = LeakFinder(texts)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                out = [(n, i, d) for n, text_ in enumerate(batch.column(1).to_pylist()) for i, d in finder.find(text_)]
                n, i, distance = (pa.array(c, pa.int32()) for c in (zip(*out) if out else ([], [], [])))
                return pa.RecordBatch.from_arrays([batch.column(0).take(n), ids.take(i), distance], names=["doc", "item", "distance"])

            return run

        found = map_batches(rows, make, f"doc {kind}, item {item_kind}, distance int")
    return found.groupBy(F.col("doc").alias(key), F.col("item").alias(item_key)).agg(F.min("distance").alias("distance"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks with up to ``BUDGET`` words of a passage changed."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at distance 0 of a passage of an item."""
    return p9_leaks(spark, sf_dir).where("distance = 0").select("doc_id", "item_id")


QUERIES = {"p9_found": p9_found, "p9_leaks": p9_leaks}

ORACLES = {
    "p9_found": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM eval_items),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p9_leaks": r"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM eval_items),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, w[k : k + 11] AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
pieces AS (SELECT item_id, '=' || array_to_string(p, ' ') AS g, 0 AS distance FROM p
  UNION ALL SELECT item_id, '+' || array_to_string(p, ' '), 1 FROM p
  UNION ALL SELECT item_id, kind || array_to_string(p[: j - 1] || p[j + 1 :], ' '), 1 FROM (SELECT item_id, p, unnest(range(1, 13)) AS j FROM p), (VALUES ('-'), ('~')) v(kind)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
grams AS (SELECT doc_id, '=' || array_to_string(w[k : k + 11], ' ') AS g FROM places WHERE k + 11 <= len(w)
  UNION ALL SELECT doc_id, '-' || array_to_string(w[k : k + 10], ' ') FROM places WHERE k + 10 <= len(w)
  UNION ALL SELECT doc_id, '~' || array_to_string(w[k : k + j - 2] || w[k + j : k + 11], ' ') FROM (SELECT doc_id, w, k, unnest(range(1, 13)) AS j FROM places WHERE k + 11 <= len(w))
  UNION ALL SELECT doc_id, '+' || array_to_string(w[k : k + j - 2] || w[k + j : k + 12], ' ') FROM (SELECT doc_id, w, k, unnest(range(2, 13)) AS j FROM places WHERE k + 12 <= len(w)))
SELECT doc_id, item_id, min(distance)::INT AS distance FROM grams JOIN pieces USING (g) GROUP BY 1, 2""",
}
