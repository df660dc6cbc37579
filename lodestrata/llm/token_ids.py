"""Problem 8: encode every text with a public byte-level BPE vocabulary.

The JVM splits texts into pieces (the vocabulary's own split pattern); a task then
gathers the different pieces of each Arrow batch and contracts those it has not met
before in DuckDB: a recursive query over token positions joins the merge table and
replaces every occurrence of a piece's lowest-ranked pair, left to right, until no
pair is left.  Ids of a text are gathered from its pieces without a Python loop.  An ordered aggregation
over the ids joined with the vocabulary decodes them.

The vocabulary is a path handed to the operator, else the file of that name in the folder that ``TOKENIZER_DIR`` names.

Null and empty texts give an empty list.  Strings of special tokens are plain text.
Repeated rows give repeated rows; columns other than the two read are not looked at.
Memory of a task is bounded by a batch and ``PIECE_CACHE`` remembered pieces.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.tables import table

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"
PIECE_CACHE = 400_000
#: Ids that are decoded in one aggregation.
DECODED_IDS = 200_000
#: A task has one core; nothing is spilled to a folder of its node.
DUCKDB = {"threads": 1, "memory_limit": "500MB", "temp_directory": ""}
#: Pieces with more bytes are contracted in calls of their own, so that one odd text doesn't swell a batch's query.
LONG_PIECE = 2_000

# The split pattern published with the vocabulary, with white space spelt out, as Java's \s is ASCII only.
_SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

CONTRACT = """
WITH RECURSIVE state(piece, pos, token) USING KEY (piece, pos) AS (
    SELECT piece, pos, token FROM positions
  UNION ALL
    (WITH live AS (SELECT piece, pos, token FROM state WHERE token >= 0),
    pairs AS (
        SELECT piece, pos, token,
               lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos, row_number() OVER w AS nth
        FROM live WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    ranked AS (
        SELECT p.piece, p.pos, p.next_pos, p.nth, m.rank, m.joined, p.token = p.next_token AS twin
        FROM pairs p JOIN merges m ON m.first = p.token AND m.second = p.next_token),
    lowest AS (SELECT *, min(rank) OVER (PARTITION BY piece) AS least FROM ranked),
    hits AS (SELECT * FROM lowest WHERE rank = least),
    runs AS (SELECT *, nth - row_number() OVER (PARTITION BY piece ORDER BY nth) AS run FROM hits),
    chosen AS (
        SELECT piece, pos, next_pos, joined FROM (
            SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY nth) AS in_run FROM runs)
        WHERE NOT twin OR in_run % 2 = 1),
    touched AS (SELECT DISTINCT piece FROM chosen)
    SELECT l.piece, l.pos, CASE WHEN c.joined IS NOT NULL THEN c.joined WHEN d.next_pos IS NOT NULL THEN -1 ELSE l.token END
    FROM live l JOIN touched t ON t.piece = l.piece
    LEFT JOIN chosen c ON c.piece = l.piece AND c.pos = l.pos
    LEFT JOIN chosen d ON d.piece = l.piece AND d.next_pos = l.pos)
)
SELECT piece, list(token ORDER BY pos) AS ids FROM state WHERE token >= 0 GROUP BY piece ORDER BY piece
"""


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=2)
def load_merges(path: str) -> tuple[np.ndarray, pa.Table]:
    """Ids of the 256 bytes, and the merge table (first, second, rank, joined)."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    byte_ids = np.array([vocabulary[c] for c in _byte_alphabet()], dtype=np.int32)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = pa.table(
        {
            "first": pa.array([vocabulary[a] for a, _ in pairs], pa.int32()),
            "second": pa.array([vocabulary[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()),
            "joined": pa.array([vocabulary[a + b] for a, b in pairs], pa.int32()),
        }
    )
    return byte_ids, merges


class PieceEncoder:
    """Ids of pieces, with the pieces already met remembered."""

    def __init__(self, path: str):
        import duckdb

        self.byte_ids, merges = load_merges(path)
        self.db = duckdb.connect(":memory:", config=DUCKDB)
        self.db.execute("SET enable_progress_bar = false")
        self.db.register("merges_arrow", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_arrow")
        self.seen: dict[str, np.ndarray] = {}

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        starts = np.cumsum(lengths) - lengths
        pos = (np.arange(lengths.sum()) - np.repeat(starts, lengths)).astype(np.int32)
        token = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        self.db.register("positions_arrow", pa.table({"piece": piece, "pos": pos, "token": token}))
        self.db.execute("CREATE OR REPLACE TEMP TABLE positions AS SELECT * FROM positions_arrow")
        self.db.unregister("positions_arrow")
        found = self.db.sql(CONTRACT).to_arrow_table()
        ids = found["ids"].combine_chunks()
        values, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
        return [values[a:b].astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]

    def learn(self, pieces: list[str]) -> None:
        new = [p for p in pieces if p not in self.seen]
        if len(self.seen) + len(new) > PIECE_CACHE:
            self.seen.clear()
            new = list(pieces)
        coded = [p.encode() for p in new]
        usual = [i for i, p in enumerate(coded) if len(p) <= LONG_PIECE]
        groups = [usual[a : a + 20_000] for a in range(0, len(usual), 20_000)] + [[i] for i, p in enumerate(coded) if len(p) > LONG_PIECE]
        for group in groups:
            for i, ids in zip(group, self._contract([coded[i] for i in group])):
                self.seen[new[i]] = ids

    def encode(self, lists: pa.ListArray) -> pa.ListArray:
        """Ids of each row, given the pieces of each row."""
        flat = lists.flatten()
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        if not len(flat):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(lists) + 1, dtype=np.int32)), pa.array([], pa.int32()))
        coded = flat.dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(words)
        ids = [self.seen[w] for w in words]
        sizes = np.array([len(x) for x in ids])
        table_, starts = np.concatenate(ids), np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy()
        n = sizes[which]
        ends = np.cumsum(n)
        at = np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1])
        row_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(row_ends.astype(np.int32)), pa.array(table_[at].astype(np.int32)))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(``key``, ``ids``) of every row of ``docs``."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for batch in batches:
            keys, lists = batch.columns
            yield pa.RecordBatch.from_arrays([keys, encoder.encode(lists)], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SPLIT_PATTERN), F.lit(0))
    return docs.select(F.col(key), pieces.alias("pieces")).mapInArrow(run, f"{key} {kind}, ids array<int>")


DECODE = """
SELECT place, string_agg(piece, '' ORDER BY pos) AS text
FROM listed JOIN vocabulary USING (id) GROUP BY place
"""


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> pa.Table:
    """(``id``, ``piece``) of every token, in the printable characters that stand for bytes."""
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "piece": pa.array(vocabulary.keys(), pa.string())})


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(``key``, ``text``) of every row of ``encoded``; empty and null lists give an empty text, ids that the vocabulary lacks nothing.

    Bytes that are no UTF-8, as of a list cut in the middle of a letter, become U+FFFD.
    """
    path = vocabulary or os.path.join(TOKENIZER_DIR, VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config=DUCKDB)
        db.execute("SET enable_progress_bar = false")
        db.register("vocabulary_arrow", load_vocabulary(path))
        db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_arrow")
        byte_of = str.maketrans({c: chr(b) for b, c in enumerate(_byte_alphabet())})
        for batch in batches:
            counts = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            flat, places = batch.column(1).flatten(), np.repeat(np.arange(batch.num_rows, dtype=np.int32), counts)
            coded = [""] * batch.num_rows
            # so many ids at once that the aggregation's memory is bounded; a text may go on in the next
            for begin in range(0, len(flat), DECODED_IDS):
                part = flat.slice(begin, DECODED_IDS)
                db.register("listed", pa.table({"place": places[begin : begin + DECODED_IDS], "pos": np.arange(len(part), dtype=np.int32), "id": part}))
                found = db.sql(DECODE).to_arrow_table()
                db.unregister("listed")
                for place, text in zip(found["place"].to_pylist(), found["text"].to_pylist()):
                    coded[place] += text
            texts = [text.translate(byte_of).encode("latin-1").decode("utf-8", "replace") for text in coded]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"{key} {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every text decoded from its ids."""
    return decode_ids(p8_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("fingerprint"))


QUERIES = {"p8_ids": p8_ids, "p8_texts": p8_texts}

ORACLES = {"p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS fingerprint FROM documents"}
