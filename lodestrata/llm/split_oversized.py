"""Problem 6: cut texts over a size limit at natural boundaries, with overlap.

A text begins as atomic segments: words with the white space after them, in scripts without
spaces the single signs with the marks after them; what is longer than a piece is cut hard, though
never before a combining mark.  Adjacent segments stand in a
heap by the strength of the boundary between them: character, word, clause, sentence,
line, paragraph.  The weakest boundary is merged first, while the merged segment and
the overlap fit the limit; boundaries that no longer fit are where the cuts fall.
Each piece but the first begins ``overlap`` characters before its own segment, so that
consecutive pieces share exactly that many characters.

Sizes are in code points.  Null and empty texts, and texts within the limit, give no
pieces.  A limit must exceed its overlap.  Ties go to the smaller merged segment and then
to the left.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import map_batches
from lodestrata.tables import chunk_nodes, table

CHARACTER, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
# Signs that stand alone (kana, ideographs), marks that end sentences and clauses, and what may close after them.
_SIGNS = "぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
_WIDE_MARKS = "。！？，、；：．」』）】》〉"
_ATOM = re.compile(rf"\s*(?:[{_SIGNS}]|[^\s{_SIGNS}{_WIDE_MARKS}]+|(?=[{_WIDE_MARKS}]))[{_WIDE_MARKS}]*\s*|\s+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n|\r\n?[^\S\r]*\r|\f|\u2029")
_LINE = re.compile(r"[\n\r\x85\u2028]")
_SENTENCE_MARKS, _CLAUSE_MARKS, _CLOSERS = ".!?…。！？．؟", ",;:،、，；：–—", "\"'”’»)]」』）】》〉"


def _strength(body: str, space: str) -> int:
    """Of the boundary after ``body`` and the white space that follows it."""
    if _PARAGRAPH.search(space):
        return PARAGRAPH
    if _LINE.search(space):
        return LINE
    last = body.rstrip(_CLOSERS)[-1:]
    if last and last in _SENTENCE_MARKS:
        return SENTENCE
    return CLAUSE if last and last in _CLAUSE_MARKS else WORD


def _extends(char: str) -> bool:
    """Whether a character belongs to the one before it."""
    return char == "\u200d" or "\ufe00" <= char <= "\ufe0f" or "\U0001f3fb" <= char <= "\U0001f3ff" or unicodedata.category(char)[0] == "M"


def _hard_cut(text: str, begin: int, most: int) -> int:
    """Where a stretch without boundaries ends: after ``most`` characters, or before the whole character that stands there."""
    end = begin + most
    while end > begin + 1 and (_extends(text[end]) or text[end - 1] == "\u200d"):
        end -= 1
    return end if end > begin + 1 else begin + most


def atoms(text: str, most: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary at that end) of each atomic segment, in order."""
    found = []
    for atom in _ATOM.finditer(text):
        begin, end = atom.span()
        body = atom[0].rstrip()
        filled = begin + len(body)
        while end - begin > most:
            stop = _hard_cut(text, begin, most)
            found.append((stop, CHARACTER if stop < filled else _strength(body, text[filled:stop])))
            begin = stop
        found.append((end, _strength(body, text[filled:end])))
    return found


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where the segments of ``text`` end; the last is its length."""
    most = limit - overlap
    if most <= 0:
        raise ValueError("the limit must exceed the overlap")
    parts = atoms(text, most)
    ends = [e for e, _ in parts]
    strength = [s for _, s in parts]
    n = len(ends)
    begin = [0, *ends[:-1]]
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    # an entry names the left segment of a pair and both ends of the merged segment; it is void once either has changed
    heap = [(strength[i], ends[i + 1] - begin[i], i, begin[i], ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, first, last = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if not alive[i] or j >= n or begin[i] != first or ends[j] != last or size > most:
            continue
        ends[i], strength[i], right[i] = ends[j], strength[j], right[j]
        alive[j] = False
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[i], ends[right[i]] - begin[i], i, begin[i], ends[right[i]]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[k], ends[i] - begin[k], k, begin[k], ends[i]))
    cuts = [ends[i] for i in range(n) if alive[i]]
    if len(cuts) > 1 and cuts[0] < overlap:  # the second piece needs that many characters before it
        low, high = max(overlap, cuts[1] - most), min(most, cuts[1])
        inner = [(s, e) for e, s in parts if low <= e <= high]
        cuts[0] = max(inner)[1] if inner else low
        if cuts[0] >= cuts[1]:
            del cuts[1]
    return cuts


def pieces(text: str, limit: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(start, piece) of each piece of a text over the limit."""
    begin = 0
    for end in cut_points(text, limit, overlap):
        start = max(0, begin - overlap)
        yield start, text[start:end]
        begin = end


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(``id``, ``piece``, ``start``, ``text``) of the ``items`` (id, kind, text) over the limit of their kind.

    ``limits`` (kind, max_chars, overlap_chars) has one row a kind, so it is small.
    """
    limits = limits.groupBy("kind").agg(F.min("max_chars").alias("max_chars"), F.min("overlap_chars").alias("overlap_chars"))
    large = items.select("id", "kind", "text").join(F.broadcast(limits), "kind").where(F.length("text") > F.col("max_chars"))

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for id_, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(id_, n, start, piece) for n, (start, piece) in enumerate(pieces(text, limit, overlap))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            types = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "piece", "start", "text"])

        return run

    return map_batches(large.select("id", "text", "max_chars", "overlap_chars"), make, "id string, piece int, start int, text string")


def sized_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("document").alias("kind"), "text")
    return docs.unionByName(chunk_nodes(spark, sf_dir).select("id", F.lit("chunk").alias("kind"), "text"))


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(sized_items(spark, sf_dir), table(spark, sf_dir, "chunk_limits")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(sized_items(spark, sf_dir), table(spark, sf_dir, "chunk_limits")).select("id").distinct()


def joined(pieces_: DataFrame) -> DataFrame:
    """(``id``, ``text``): the texts of which pieces (id, start, text) are, each piece without what the one before it holds."""
    order = Window.partitionBy("id").orderBy("start")
    before = F.coalesce(F.lag(F.col("start") + F.length("text")).over(order), F.lit(0))
    own = pieces_.withColumn("own", F.substr("text", before - F.col("start") + 1))
    return own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "own"))), lambda p: p["own"]), "").alias("text"))


def p6_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every oversized text, put together again from its pieces."""
    return joined(p6_pieces(spark, sf_dir)).select("id", F.md5("text").alias("fingerprint"))


QUERIES = {"p6_found": p6_found, "p6_pieces": p6_pieces, "p6_joined": p6_joined}

ORACLES = {
    "p6_found": """
SELECT DISTINCT id FROM (
  SELECT 'd' || doc_id AS id, 'document' AS kind, text FROM documents
  UNION ALL SELECT id, 'chunk', text FROM nodes WHERE lower(type) = 'chunk') i
JOIN chunk_limits l ON l.kind = i.kind WHERE length(text) > max_chars""",
    "p6_joined": """
SELECT DISTINCT id, md5(text) AS fingerprint FROM (
  SELECT 'd' || doc_id AS id, 'document' AS kind, text FROM documents
  UNION ALL SELECT id, 'chunk', text FROM nodes WHERE lower(type) = 'chunk') i
JOIN chunk_limits l ON l.kind = i.kind WHERE length(text) > max_chars""",
}
