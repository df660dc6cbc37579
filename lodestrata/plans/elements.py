"""Walks over sections, media and facts; deletion, records and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions.text import clean_text
from lodestrata.operators import building as B
from lodestrata.operators import elements as L
from lodestrata.operators import graph as G
from lodestrata.plans.building import _A
from lodestrata.plans.graph import _DATE
from lodestrata.plans.sqltext import clean
from lodestrata.tables import chunk_nodes, table

RECORDED = r"minutes|interview|transcript|recording"


def _lines(spark, sf_dir):
    return L.section_lines(table(spark, sf_dir, "documents"))


def _sections(spark, sf_dir):
    return L.section_edges(_lines(spark, sf_dir))


def _facts(spark, sf_dir):
    return L.fact_edges(L.triplet_facts(L.line_chunks(_lines(spark, sf_dir)))).unionByName(_sections(spark, sf_dir))


def walk_document_sections(spark, sf_dir):
    return G.members_in_order(_sections(spark, sf_dir), "has_section").withColumnsRenamed({"src": "document", "dst": "section"})


def walk_section_chunks(spark, sf_dir):
    """Chunks under each section, in order."""
    edges = _sections(spark, sf_dir).where("relation = 'under_section'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation", "sequence")
    return G.members_in_order(edges, "under_section").withColumnsRenamed({"src": "section", "dst": "chunk"})


def walk_chunk_section(spark, sf_dir):
    return L.first_target(_sections(spark, sf_dir), "under_section").withColumnsRenamed({"src": "chunk", "dst": "section"})


def walk_section_document(spark, sf_dir):
    return L.first_parent(_sections(spark, sf_dir), "has_section").withColumnsRenamed({"src": "document", "dst": "section"})


def walk_section_neighbours(spark, sf_dir):
    """Each section with the one before and after it in its document."""
    return G.followers(_sections(spark, sf_dir), "has_section").select(F.col("src").alias("document"), F.col("dst").alias("section"), "previous", "next")


def walk_section_page(spark, sf_dir):
    return L.section_nodes(_lines(spark, sf_dir)).select(F.col("id").alias("section"), "text", "page")


def walk_chunk_page(spark, sf_dir):
    return G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'chunk'").select(F.col("id").alias("chunk"), "page")


def _images(spark, sf_dir):
    return L.image_edges(L.image_rows(table(spark, sf_dir, "pdf")))


def walk_document_images(spark, sf_dir):
    return G.members_in_order(_images(spark, sf_dir), "has_image").withColumnsRenamed({"src": "document", "dst": "image"})


def walk_document_captions(spark, sf_dir):
    captions = L.image_rows(table(spark, sf_dir, "pdf")).select(F.col("caption_id").alias("dst"), "caption")
    return G.members_in_order(_images(spark, sf_dir), "has_caption").join(captions, "dst").select(F.col("src").alias("document"), F.col("dst").alias("id"), "n", "caption")


def walk_image_caption(spark, sf_dir):
    return L.first_parent(_images(spark, sf_dir), "caption_of").select(F.col("dst").alias("image"), F.col("src").alias("caption"))


def _audios(spark, sf_dir):
    recorded = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type = 'document'").where(F.rlike("source", F.lit(f"(?i){RECORDED}"))).select("id")
    return L.audio_edges(recorded, table(spark, sf_dir, "edges"))


def walk_document_audios(spark, sf_dir):
    return G.members_in_order(_audios(spark, sf_dir), "has_audio").select(F.col("src").alias("document"), F.col("dst").alias("audio"))


def walk_chunk_transcripts(spark, sf_dir):
    return G.related(_audios(spark, sf_dir), "transcript_of").select(F.col("src").alias("chunk"), F.col("dst").alias("audio"))


def walk_document_atoms(spark, sf_dir):
    return B.atom_rows(table(spark, sf_dir, "documents")).select("document", F.col("id").alias("atom"), "sequence", "kind")


def walk_molecule_atoms(spark, sf_dir):
    return B.molecule_rows(B.atom_rows(table(spark, sf_dir, "documents")))


def walk_document_molecules(spark, sf_dir):
    rows = walk_molecule_atoms(spark, sf_dir).select(F.regexp_extract("molecule", r"^(d[0-9]+)_", 1).alias("document"), "molecule")
    return rows.distinct()


def walk_chunk_facts(spark, sf_dir):
    return L.fact_chunks(_facts(spark, sf_dir))


def walk_entity_facts(spark, sf_dir):
    return L.entity_facts(_facts(spark, sf_dir))


def walk_fact_entities(spark, sf_dir):
    edges = _facts(spark, sf_dir)
    return G.related(edges, "subject").unionByName(G.related(edges, "object")).select(F.col("src").alias("fact"), "relation", F.col("dst").alias("entity"))


def walk_fact_sections(spark, sf_dir):
    return L.fact_sections(_facts(spark, sf_dir))


def walk_fact_documents(spark, sf_dir):
    return L.fact_documents(_facts(spark, sf_dir))


def walk_document_facts(spark, sf_dir):
    """How many facts each document states, and the first of them."""
    return L.fact_documents(_facts(spark, sf_dir)).groupBy("document").agg(F.count("*").alias("facts"), F.min("fact").alias("first"))


def walk_fact_pages(spark, sf_dir):
    return L.fact_pages(L.line_chunks(_lines(spark, sf_dir)), _facts(spark, sf_dir))


def walk_entity_chunks(spark, sf_dir):
    return G.mentions(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "edges")).groupBy("entity").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first"), F.max("chunk").alias("last"))


def graph_linked_sections_by_entity(spark, sf_dir):
    """Sections that state something about the same subject."""
    return G.co_mentions_in_tiles(L.section_subjects(table(spark, sf_dir, "documents")), "section", "entity")


def graph_found_facts(spark, sf_dir):
    """Facts by what they say, whatever their subject and object."""
    return L.matching_facts(L.triplet_facts(L.line_chunks(_lines(spark, sf_dir))), predicate="is").select("id", "subject", "object")


def graph_labels(spark, sf_dir):
    """Which labels any node has."""
    asked = spark.createDataFrame([("chunk",), ("document",), ("entity",), ("image",)], "label string")
    seen = table(spark, sf_dir, "nodes").select(F.lower("type").alias("label")).distinct().withColumn("known", F.lit(True))
    return asked.join(seen, "label", "left").select("label", F.coalesce("known", F.lit(False)).alias("known"))


def graph_removed_chunks(spark, sf_dir):
    """Chunks of each document without those of less than 200 characters, numbered anew."""
    gone = chunk_nodes(spark, sf_dir).where(F.coalesce(F.length("text"), F.lit(0)) < 200).select("id").distinct()
    return L.without_chunks(table(spark, sf_dir, "edges"), gone)


def graph_linked_names(spark, sf_dir):
    """mentions edges of chunks to entity nodes of the same name, case aside; the provenance is the chunk's source."""
    nodes = G.distinct_nodes(table(spark, sf_dir, "nodes"))
    named = nodes.where("type = 'entity'").select(F.col("id").alias("dst"), F.lower("text").alias("name"))
    typed = nodes.where("type = 'chunk'").select(F.col("id").alias("src"), "source", F.explode("entities").alias("e"))
    return typed.withColumn("name", F.lower("e")).join(named, "name").select("src", "dst", F.lit("mentions").alias("relation"), F.col("source").alias("provenance")).distinct()


def keep_not_purged(spark, sf_dir):
    """Documents deleted at the time in their row, as of the newest one; those without a time were never deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "ingested_at")
    newest = docs.agg(F.max("ingested_at").alias("now"))
    return L.not_purged(docs.crossJoin(F.broadcast(newest)), "ingested_at", F.col("now"), 30).select("doc_id")


def keep_marked(spark, sf_dir):
    """Documents of one source marked as deleted at the time of the newest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "ingested_at")
    newest = docs.agg(F.max("ingested_at").alias("now"))
    return docs.crossJoin(F.broadcast(newest)).select("doc_id", F.when(F.col("source").like("file:%"), F.unix_micros("now")).alias("deleted_us"))


def graph_cleaned(spark, sf_dir):
    """The cleaning steps in order: the first chunk of each text, white space, dates, and the keeper of each entity's name."""
    nodes = G.distinct_nodes(table(spark, sf_dir, "nodes"))
    chunks = nodes.where("type = 'chunk' AND text IS NOT NULL").groupBy("text").agg(F.min_by("id", "pos").alias("id"))
    kept = nodes.where("type <> 'chunk' OR text IS NULL").select("id").unionByName(chunks.select("id"))
    keepers = G.resolved_entities(table(spark, sf_dir, "nodes"))
    rows = nodes.join(kept, "id", "left_semi").join(keepers, "id", "left").where("keeper IS NULL OR keeper = id")
    text = F.when(F.col("type") == "chunk", F.md5(clean_text(F.col("text"))))
    return rows.select("id", "type", text.alias("fingerprint"), G.normalized_date(F.col("birth_date")).cast("string").alias("born"))


def export_graph_records(spark, sf_dir):
    """Nodes and edges as JSON objects, a line each."""
    nodes = G.distinct_nodes(table(spark, sf_dir, "nodes")).where("type <> 'chunk'").select("id", "type", "author", "page")
    edges = G.distinct_edges(table(spark, sf_dir, "edges")).select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", "sequence")
    return L.as_records(nodes).unionByName(L.as_records(edges))


def build_from_records(spark, sf_dir):
    """Edges read back from their JSON objects."""
    return L.from_records(export_graph_records(spark, sf_dir), "source string, target string, relation string, sequence int").where("source IS NOT NULL")


def graph_properties(spark, sf_dir):
    """Properties by key; keys that are no identifiers are refused."""
    rows = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("pos"), F.regexp_replace("source", r"[^A-Za-z0-9_.]", "_").alias("key"), F.col("path").alias("value"))
    return L.properties(rows)


QUERIES = {
    f.__name__: f
    for f in (
        walk_document_sections, walk_section_chunks, walk_chunk_section, walk_section_document, walk_section_neighbours, walk_section_page, walk_chunk_page, walk_document_images, walk_document_captions, walk_image_caption,
        walk_document_audios, walk_chunk_transcripts, walk_document_atoms, walk_molecule_atoms, walk_document_molecules, walk_chunk_facts, walk_entity_facts, walk_fact_entities, walk_fact_sections, walk_fact_documents,
        walk_document_facts, walk_fact_pages, walk_entity_chunks, graph_linked_sections_by_entity, graph_found_facts, graph_labels, graph_removed_chunks, graph_linked_names, keep_not_purged, keep_marked, graph_cleaned,
        export_graph_records, build_from_records, graph_properties,
    )
}

_S = rf"""{_A}, s AS (SELECT document, sequence, kind, text, n, CASE WHEN n > 0 THEN document || '_section_' || n END AS section, (floor(sequence / 40) + 1)::INT AS page
  FROM (SELECT *, sum((kind = 'Title')::INT) OVER (PARTITION BY document ORDER BY sequence)::BIGINT AS n FROM k)),
t AS (SELECT * FROM s WHERE kind = 'Title'), lc AS (SELECT *, document || '_line_' || sequence AS id FROM s WHERE kind <> 'Title')"""
_T = r"(?i)([A-Za-z_]+)\s+(is|likes|has|eats|knows|located_in|capital_of)\s+([A-Za-z_]+)"
_LF = rf"""{_S}, fl AS (SELECT id AS chunk, document, section, page, regexp_extract_all(lower(text), '{_T}', 1) AS su, regexp_extract_all(lower(text), '{_T}', 2) AS pr, regexp_extract_all(lower(text), '{_T}', 3) AS ob FROM lc),
f AS (SELECT chunk || '_fact_' || (n - 1) AS fact, chunk, document, section, page, su[n] AS subject, pr[n] AS predicate, ob[n] AS object FROM (SELECT *, unnest(range(1, len(su) + 1)) AS n FROM fl))"""
_I = "p AS (SELECT doc_id, min({'path': path, 'n': n_pages}) AS p FROM pdf WHERE n_pages > 0 GROUP BY 1), im AS (SELECT 'd' || doc_id AS document, p.path AS path, unnest(range(0, p.n)) AS n FROM p)"
_DN = "dn AS (SELECT id, min(pos) AS pos, arg_min({'v': lower(type)}, pos).v AS type, arg_min({'v': text}, pos).v AS text, arg_min({'v': source}, pos).v AS source, arg_min({'v': author}, pos).v AS author, arg_min({'v': page}, pos).v AS page, arg_min({'v': birth_date}, pos).v AS birth_date, arg_min({'v': entities}, pos).v AS entities FROM nodes GROUP BY id)"
_HC = "hc AS (SELECT src, dst, min(sequence) AS sequence FROM edges WHERE lower(relation) = 'has_chunk' GROUP BY 1, 2)"
_AU = f"{_DN}, {_HC}, rec AS (SELECT id FROM dn WHERE type = 'document' AND regexp_matches(source, '(?i){RECORDED}'))"

_KEEPER = r"first_value(id) OVER (PARTITION BY lower(regexp_replace(trim(text), '\s+', ' ', 'g')) ORDER BY pos)"


def _record(*fields):
    """JSON objects that leave nulls out."""
    parts = " || ".join(f"CASE WHEN {f} IS NULL THEN '' ELSE ',\"{n}\":' || to_json({f}) END" for n, f in fields)
    return f"'{{' || substr({parts}, 2) || '}}'"


ORACLES = {
    "walk_document_sections": f"WITH {_S} SELECT document, section, (n - 1)::INT AS n FROM t",
    "walk_section_chunks": f"WITH {_S} SELECT section, id AS chunk, (row_number() OVER (PARTITION BY section ORDER BY sequence) - 1)::INT AS n FROM lc WHERE section IS NOT NULL",
    "walk_chunk_section": f"WITH {_S} SELECT id AS chunk, section FROM lc WHERE section IS NOT NULL",
    "walk_section_document": f"WITH {_S} SELECT section, document FROM t",
    "walk_section_neighbours": f"WITH {_S} SELECT document, section, lag(section) OVER w AS previous, lead(section) OVER w AS next FROM t WINDOW w AS (PARTITION BY document ORDER BY sequence)",
    "walk_section_page": f"WITH {_S} SELECT section, text, page FROM t",
    "walk_chunk_page": f"WITH {_DN} SELECT id AS chunk, page FROM dn WHERE type = 'chunk'",
    "walk_document_images": f"WITH {_I} SELECT document, document || '_image_' || n AS image, n::INT AS n FROM im",
    "walk_document_captions": f"WITH {_I} SELECT document, document || '_image_' || n || '_caption' AS id, n::INT AS n, concat_ws(', page ', path, n + 1) AS caption FROM im",
    "walk_image_caption": f"WITH {_I} SELECT document || '_image_' || n AS image, document || '_image_' || n || '_caption' AS caption FROM im",
    "walk_document_audios": f"WITH {_AU} SELECT id AS document, id || '_audio_0' AS audio FROM rec",
    "walk_chunk_transcripts": f"WITH {_AU} SELECT dst AS chunk, src || '_audio_0' AS audio FROM hc WHERE src IN (SELECT id FROM rec)",
    "walk_document_atoms": f"WITH {_A} SELECT document, document || '_atom_' || sequence AS atom, sequence::INT AS sequence, kind FROM k",
    "walk_molecule_atoms": f"WITH {_S} SELECT document || '_atom_' || sequence AS atom, document || '_molecule_' || n AS molecule FROM s",
    "walk_document_molecules": f"WITH {_S} SELECT DISTINCT document, document || '_molecule_' || n AS molecule FROM s",
    "walk_chunk_facts": f"WITH {_LF} SELECT fact, chunk FROM f",
    "walk_entity_facts": f"WITH {_LF} SELECT subject AS entity, fact FROM f UNION SELECT object, fact FROM f",
    "walk_fact_entities": f"WITH {_LF} SELECT fact, 'subject' AS relation, subject AS entity FROM f UNION ALL SELECT fact, 'object', object FROM f",
    "walk_fact_sections": f"WITH {_LF} SELECT fact, section FROM f WHERE section IS NOT NULL",
    "walk_fact_documents": f"WITH {_LF} SELECT fact, document FROM f",
    "walk_document_facts": f"WITH {_LF} SELECT document, count(*) AS facts, min(fact) AS first FROM f GROUP BY 1",
    "walk_fact_pages": f"WITH {_LF} SELECT fact, page FROM f",
    "walk_entity_chunks": f"WITH {_DN} SELECT dst AS entity, count(DISTINCT src) AS chunks, min(src) AS first, max(src) AS last FROM edges WHERE lower(relation) = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'chunk') AND dst IN (SELECT id FROM dn WHERE type = 'entity') GROUP BY 1",
    "graph_linked_sections_by_entity": f"WITH {_LF}, se AS (SELECT DISTINCT section, subject AS entity FROM f WHERE section IS NOT NULL) SELECT a.section AS src, b.section AS dst, count(*) AS shared FROM se a JOIN se b ON a.entity = b.entity AND a.section < b.section GROUP BY 1, 2",
    "graph_found_facts": f"WITH {_LF} SELECT fact AS id, subject, object FROM f WHERE predicate = 'is'",
    "graph_labels": "SELECT label, label IN (SELECT lower(type) FROM nodes WHERE type IS NOT NULL) AS known FROM (VALUES ('chunk'), ('document'), ('entity'), ('image')) v(label)",
    "graph_removed_chunks": f"WITH {_HC} SELECT src, dst, (row_number() OVER (PARTITION BY src ORDER BY sequence NULLS LAST, dst) - 1)::INT AS n FROM hc WHERE dst NOT IN (SELECT id FROM nodes WHERE lower(type) = 'chunk' AND coalesce(length(text), 0) < 200)",
    "graph_linked_names": f"WITH {_DN} SELECT DISTINCT c.id AS src, e.id AS dst, 'mentions' AS relation, c.source AS provenance FROM (SELECT id, source, unnest(entities) AS e FROM dn WHERE type = 'chunk') c JOIN dn e ON e.type = 'entity' AND lower(e.text) = lower(c.e)",
    "keep_not_purged": "SELECT doc_id FROM documents WHERE ingested_at IS NULL OR ingested_at > (SELECT max(ingested_at) FROM documents) - INTERVAL 30 DAY",
    "keep_marked": "SELECT doc_id, CASE WHEN source LIKE 'file:%' THEN (SELECT epoch_us(max(ingested_at)) FROM documents) END AS deleted_us FROM documents",
    "graph_cleaned": f"WITH {_DN}, kept AS (SELECT id FROM dn WHERE type <> 'chunk' OR text IS NULL UNION ALL SELECT arg_min(id, pos) FROM dn WHERE type = 'chunk' AND text IS NOT NULL GROUP BY text), ke AS (SELECT id, {_KEEPER} AS keeper FROM dn WHERE type = 'entity' AND text IS NOT NULL) SELECT dn.id, type, CASE WHEN type = 'chunk' THEN md5({clean('text')}) END AS fingerprint, ({_DATE})::VARCHAR AS born FROM dn LEFT JOIN ke ON ke.id = dn.id WHERE dn.id IN (SELECT id FROM kept) AND (keeper IS NULL OR keeper = dn.id)",
    "export_graph_records": f"WITH {_DN} SELECT {_record(('id', 'id'), ('type', 'type'), ('author', 'author'), ('page', 'page'))} AS line FROM dn WHERE type <> 'chunk' UNION ALL SELECT {_record(('source', 'src'), ('target', 'dst'), ('relation', 'relation'), ('sequence', 'sequence'))} FROM (SELECT src, dst, lower(relation) AS relation, min(sequence) AS sequence FROM edges GROUP BY 1, 2, 3)",
    "build_from_records": "SELECT src AS source, dst AS target, lower(relation) AS relation, min(sequence) AS sequence FROM edges GROUP BY 1, 2, 3",
    "graph_properties": "SELECT key, arg_max({'v': path}, doc_id).v AS value FROM (SELECT doc_id, path, regexp_replace(source, '[^A-Za-z0-9_.]', '_', 'g') AS key FROM documents WHERE source IS NOT NULL) WHERE regexp_matches(key, '^[A-Za-z_][A-Za-z0-9_]*$') GROUP BY 1",
}
