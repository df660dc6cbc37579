"""Graph queries over the whole ``nodes`` and ``edges`` tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.operators import graph as G
from lodestrata.tables import table


def _n(spark, sf_dir):
    return table(spark, sf_dir, "nodes")


def _e(spark, sf_dir):
    return table(spark, sf_dir, "edges")


def graph_document_chunks(spark, sf_dir):
    return G.members_in_order(_e(spark, sf_dir), "has_chunk").withColumnsRenamed({"src": "document", "dst": "chunk"})


def graph_chunk_neighbours(spark, sf_dir):
    return G.followers(_e(spark, sf_dir)).select("src", "dst", "previous", "next")


def graph_chunk_context(spark, sf_dir):
    return G.chunk_context(_e(spark, sf_dir), 2, 1).select("id", F.array_join("context", " ").alias("context"))


def graph_renumbered(spark, sf_dir):
    return G.renumbered(_e(spark, sf_dir))


def graph_chunk_document(spark, sf_dir):
    return G.chunk_documents(_e(spark, sf_dir))


def graph_chunk_entities(spark, sf_dir):
    return G.mentions(_n(spark, sf_dir), _e(spark, sf_dir))


def graph_document_entities(spark, sf_dir):
    return G.document_entities(_n(spark, sf_dir), _e(spark, sf_dir))


def graph_entity_documents(spark, sf_dir):
    return G.document_entities(_n(spark, sf_dir), _e(spark, sf_dir)).groupBy("entity").agg(F.count("*").alias("documents"), F.min("document").alias("first_document"))


def graph_entity_pages(spark, sf_dir):
    pages = G.distinct_nodes(_n(spark, sf_dir)).where("page IS NOT NULL").select(F.col("id").alias("chunk"), "page")
    return G.mentions(_n(spark, sf_dir), _e(spark, sf_dir)).join(pages, "chunk").select("entity", "page").distinct()


def graph_linked_chunks_by_entity(spark, sf_dir):
    return G.co_mentions(G.mentions(_n(spark, sf_dir), _e(spark, sf_dir)), "chunk", "entity")


def graph_linked_documents_by_entity(spark, sf_dir):
    return G.co_mentions(G.document_entities(_n(spark, sf_dir), _e(spark, sf_dir)), "document", "entity")


def graph_affiliations(spark, sf_dir):
    rows = G.distinct_nodes(_n(spark, sf_dir)).where("type = 'document' AND trim(author) <> '' AND trim(organization) <> ''")
    return rows.select(F.col("author").alias("src"), F.col("organization").alias("dst"), F.lit("affiliated_with").alias("relation")).distinct()


def graph_conflicting_facts(spark, sf_dir):
    return G.conflicting_facts(_e(spark, sf_dir))


def graph_marked_conflicts(spark, sf_dir):
    return G.marked_conflicts(_e(spark, sf_dir))


def graph_normalized_dates(spark, sf_dir):
    rows = G.distinct_nodes(_n(spark, sf_dir)).where("birth_date IS NOT NULL")
    return rows.select("id", G.normalized_date(F.col("birth_date")).cast("string").alias("born"))


def graph_incoherent_dates(spark, sf_dir):
    """Similar-to edges between nodes born the wrong way round (the table has no parents)."""
    found = G.incoherent_parents(_n(spark, sf_dir), _e(spark, sf_dir), "similar_to")
    return found.select("src", "dst")


def graph_schema_coherent(spark, sf_dir):
    nodes = _n(spark, sf_dir).agg(F.count_if(F.col("type").isNull()).alias("untyped"))
    edges = _e(spark, sf_dir).agg(F.count_if(F.col("relation").isNull()).alias("unrelated"))
    return nodes.crossJoin(edges).select("untyped", "unrelated", F.when((F.col("untyped") == 0) & (F.col("unrelated") == 0), 1).otherwise(0).alias("coherent"))


def graph_consolidated_schema(spark, sf_dir):
    types = _n(spark, sf_dir).groupBy(F.lit("node").alias("of"), F.lower("type").alias("kind")).agg(F.count("*").alias("n"))
    relations = _e(spark, sf_dir).groupBy(F.lit("edge").alias("of"), F.lower("relation").alias("kind")).agg(F.count("*").alias("n"))
    return types.unionByName(relations)


def graph_pruned_sources(spark, sf_dir):
    large = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(3).select("source")
    nodes, edges = G.without_sources(_n(spark, sf_dir), _e(spark, sf_dir), large)
    listed = nodes.select(F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("dst"))
    return listed.unionByName(edges.select(F.lower("relation").alias("kind"), F.col("src").alias("id"), "dst")).distinct()


def graph_small_components(spark, sf_dir):
    return G.component_sizes(_n(spark, sf_dir), _e(spark, sf_dir)).where("size < 3").select("id", "component", "size")


def graph_components(spark, sf_dir):
    return G.component_sizes(_n(spark, sf_dir), _e(spark, sf_dir))


def graph_resolved_entities(spark, sf_dir):
    return G.resolved_entities(_n(spark, sf_dir))


def graph_search(spark, sf_dir):
    return G.text_search(_n(spark, sf_dir), "Ledger").select("id", "type")


def graph_search_documents(spark, sf_dir):
    return G.text_search(_n(spark, sf_dir), "notes", "document").select("id", "source")


def graph_search_with_links(spark, sf_dir):
    seeds = G.text_search(_n(spark, sf_dir), "harbour", "chunk").select("id")
    return G.expanded(seeds, _e(spark, sf_dir), 2)


def graph_fact_confidence(spark, sf_dir):
    """Statements made of next_chunk and mentions edges under both names."""
    edges = G.distinct_edges(_e(spark, sf_dir)).where("relation IN ('mentions', 'similar_to')")
    said = edges.select(F.col("src").alias("subject"), F.when(F.length("dst") % 2 == 0, F.col("relation")).otherwise("likes").alias("predicate"), F.col("dst").alias("object"))
    return G.fact_confidence(said, edges)


def graph_verified_statements(spark, sf_dir):
    return graph_fact_confidence(spark, sf_dir).agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("statements"))


def graph_removed_documents(spark, sf_dir):
    gone = G.distinct_nodes(_n(spark, sf_dir)).where("type = 'document' AND source LIKE 'scan:%'").select("id")
    return G.without_documents(_n(spark, sf_dir), _e(spark, sf_dir), gone).select("id", "type")


def graph_cascade_removed_documents(spark, sf_dir):
    gone = G.distinct_nodes(_n(spark, sf_dir)).where("type = 'document' AND source LIKE 'file:%'").select("id")
    return G.without_documents(_n(spark, sf_dir), _e(spark, sf_dir), gone, cascade=True).select("id", "type")


def graph_triangles(spark, sf_dir):
    return G.triangles(_e(spark, sf_dir))


def graph_text(spark, sf_dir):
    """Each document's chunk texts in order, as one text."""
    texts = G.distinct_nodes(_n(spark, sf_dir)).where("type = 'chunk' AND text IS NOT NULL").select(F.col("id").alias("dst"), "text")
    rows = G.members_in_order(_e(spark, sf_dir), "has_chunk").join(texts, "dst")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n\n")
    return rows.groupBy("src").agg(F.md5(joined).alias("fingerprint"), F.count("*").alias("chunks"))


def graph_statements(spark, sf_dir):
    """``u relation v`` of the mentions of each document's chunks, joined."""
    rows = G.mentions(_n(spark, sf_dir), _e(spark, sf_dir)).join(G.chunk_documents(_e(spark, sf_dir)), "chunk")
    said = F.concat_ws(" ", "chunk", F.lit("mentions"), "entity")
    return rows.groupBy("document").agg(F.array_join(F.array_sort(F.collect_list(said)), ". ").alias("text"))


def graph_export_prompts(spark, sf_dir):
    """A record of each chunk with its document's source, author and organization, and a fingerprint of the prompt."""
    nodes = G.distinct_nodes(_n(spark, sf_dir))
    chunks = nodes.where("type = 'chunk' AND text IS NOT NULL").select(F.col("id").alias("chunk"), F.md5("text").alias("prompt_hash"))
    documents = nodes.where("type = 'document'").select(F.col("id").alias("document"), "source", "author", "organization")
    return chunks.join(G.chunk_documents(_e(spark, sf_dir)), "chunk").join(documents, "document")


def graph_node_similarity(spark, sf_dir):
    """Pairs of documents by the Jaccard similarity of the entities they mention."""
    pairs = G.document_entities(_n(spark, sf_dir), _e(spark, sf_dir))
    sizes = pairs.groupBy("document").agg(F.count("*").alias("n"))
    shared = G.co_mentions(pairs, "document", "entity")
    rows = shared.join(sizes.select(F.col("document").alias("src"), F.col("n").alias("ns")), "src").join(sizes.select(F.col("document").alias("dst"), F.col("n").alias("nd")), "dst")
    value = F.col("shared") / (F.col("ns") + F.col("nd") - F.col("shared"))
    return rows.select("src", "dst", F.round(value, 6).alias("similarity")).where("similarity >= 0.3")


def graph_predicted_links(spark, sf_dir):
    """Adamic-Adar scores of pairs of entities that share chunks and aren't linked."""
    pairs = G.mentions(_n(spark, sf_dir), _e(spark, sf_dir))
    weight = pairs.withColumn("n", F.count("*").over(Window.partitionBy("chunk"))).where("n > 1").withColumn("w", 1 / F.log(F.col("n").cast("double")))
    other = weight.select("chunk", F.col("entity").alias("dst"))
    return weight.withColumnRenamed("entity", "src").join(other, "chunk").where("src < dst").groupBy("src", "dst").agg(F.round(F.sum("w"), 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        graph_document_chunks, graph_chunk_neighbours, graph_chunk_context, graph_renumbered, graph_chunk_document, graph_chunk_entities, graph_document_entities, graph_entity_documents, graph_entity_pages,
        graph_linked_chunks_by_entity, graph_linked_documents_by_entity, graph_affiliations, graph_conflicting_facts, graph_marked_conflicts, graph_normalized_dates, graph_incoherent_dates, graph_schema_coherent,
        graph_consolidated_schema, graph_pruned_sources, graph_small_components, graph_components, graph_resolved_entities, graph_search, graph_search_documents, graph_search_with_links, graph_fact_confidence,
        graph_verified_statements, graph_removed_documents, graph_cascade_removed_documents, graph_triangles, graph_text, graph_statements, graph_export_prompts, graph_node_similarity, graph_predicted_links,
    )
}

_BASE = """
dn AS (SELECT id, min(pos) AS pos, arg_min(lower(type), pos) AS type, arg_min({'v': text}, pos).v AS text, arg_min({'v': source}, pos).v AS source, arg_min({'v': author}, pos).v AS author,
  arg_min({'v': organization}, pos).v AS organization, arg_min({'v': birth_date}, pos).v AS birth_date, arg_min({'v': page}, pos).v AS page FROM nodes GROUP BY id),
de AS (SELECT src, dst, lower(relation) AS relation, min(sequence) AS sequence, min(provenance) AS provenance FROM edges GROUP BY 1, 2, 3),
hc AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY sequence NULLS LAST, dst) - 1 AS n FROM de WHERE relation = 'has_chunk'),
me AS (SELECT src AS chunk, dst AS entity FROM de WHERE relation = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'chunk') AND dst IN (SELECT id FROM dn WHERE type = 'entity')),
doe AS (SELECT src AS document, dst AS entity FROM de WHERE relation = 'mentions' AND src IN (SELECT id FROM dn WHERE type = 'document') UNION SELECT hc.src, entity FROM me JOIN hc ON hc.dst = chunk)"""


def _sql(select: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_BASE}{',' + more if more else ''} {select}"


_DATE = r"""coalesce(try_strptime(nullif(regexp_extract(trim(birth_date), '^(\d{4}-\d{2}-\d{2})[T ]', 1), ''), '%Y-%m-%d'), try_strptime(trim(birth_date), '%Y-%m-%d'), try_strptime(trim(birth_date), '%d.%m.%Y'), try_strptime(trim(birth_date), '%b %d, %Y'),
  try_strptime(trim(birth_date), '%B %d, %Y'), try_strptime(trim(birth_date), '%d %b %Y'), try_strptime(trim(birth_date), '%d %B %Y'), try_strptime(trim(birth_date), '%Y/%m/%d'), try_strptime(trim(birth_date), '%d/%m/%Y'))::DATE"""
_FACTS = """
fe AS (SELECT src, dst, relation FROM de WHERE relation IN ('mentions', 'similar_to')),
said AS (SELECT src AS subject, CASE WHEN length(dst) % 2 = 0 THEN relation ELSE 'likes' END AS predicate, dst AS object FROM fe),
links AS (SELECT src, dst FROM fe UNION SELECT dst, src FROM fe),
conf AS (SELECT subject, predicate, object, CASE WHEN EXISTS (SELECT 1 FROM fe WHERE src = subject AND relation = predicate AND dst = object) THEN 1.0
  WHEN EXISTS (SELECT 1 FROM links WHERE src = subject AND dst = object) THEN 0.4 ELSE 0.0 END::DOUBLE AS confidence FROM said)"""
_COMPONENTS = """
und AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
walk(id, root) AS (SELECT a, a FROM (SELECT DISTINCT a FROM und) UNION SELECT und.b, walk.root FROM walk JOIN und ON und.a = walk.id AND und.b > walk.root),
lab AS (SELECT id, min(root) AS component FROM walk GROUP BY id),
al AS (SELECT dn.id, coalesce(component, dn.id) AS component FROM dn LEFT JOIN lab USING (id)),
sz AS (SELECT component, count(*) AS size FROM al GROUP BY 1)"""

ORACLES = {
    "graph_document_chunks": _sql("SELECT src AS document, dst AS chunk, n::INT AS n FROM hc"),
    "graph_chunk_neighbours": _sql("SELECT src, dst, lag(dst) OVER w AS previous, lead(dst) OVER w AS next FROM hc WINDOW w AS (PARTITION BY src ORDER BY n)"),
    "graph_chunk_context": _sql("SELECT dst AS id, array_to_string(list(dst) OVER (PARTITION BY src ORDER BY n ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), ' ') AS context FROM hc"),
    "graph_renumbered": _sql("SELECT src, dst, 'has_chunk' AS relation, n::INT AS sequence FROM hc UNION ALL SELECT * FROM (SELECT dst, lead(dst) OVER (PARTITION BY src ORDER BY n) AS nx, 'next_chunk', NULL FROM hc) WHERE nx IS NOT NULL"),
    "graph_chunk_document": _sql("SELECT dst AS chunk, src AS document FROM hc"),
    "graph_chunk_entities": _sql("SELECT chunk, entity FROM me"),
    "graph_document_entities": _sql("SELECT document, entity FROM doe"),
    "graph_entity_documents": _sql("SELECT entity, count(*) AS documents, min(document) AS first_document FROM doe GROUP BY 1"),
    "graph_entity_pages": _sql("SELECT DISTINCT entity, page FROM me JOIN dn ON dn.id = chunk WHERE page IS NOT NULL"),
    "graph_linked_chunks_by_entity": _sql("SELECT a.chunk AS src, b.chunk AS dst, count(*) AS shared FROM me a JOIN me b ON a.entity = b.entity AND a.chunk < b.chunk GROUP BY 1, 2"),
    "graph_linked_documents_by_entity": _sql("SELECT a.document AS src, b.document AS dst, count(*) AS shared FROM doe a JOIN doe b ON a.entity = b.entity AND a.document < b.document GROUP BY 1, 2"),
    "graph_affiliations": _sql("SELECT DISTINCT author AS src, organization AS dst, 'affiliated_with' AS relation FROM dn WHERE type = 'document' AND trim(author) <> '' AND trim(organization) <> ''"),
    "graph_conflicting_facts": _sql("SELECT src, relation, count(*) AS objects FROM de WHERE relation NOT IN ('has_chunk', 'next_chunk', 'subject', 'object', 'has_fact', 'mentions') GROUP BY 1, 2 HAVING count(*) > 1"),
    "graph_marked_conflicts": _sql("SELECT src, dst, relation, count(*) OVER (PARTITION BY src, relation) > 1 AS conflict FROM de WHERE relation NOT IN ('has_chunk', 'next_chunk', 'subject', 'object', 'has_fact', 'mentions')"),
    "graph_normalized_dates": _sql(f"SELECT id, ({_DATE})::VARCHAR AS born FROM dn WHERE birth_date IS NOT NULL"),
    "graph_incoherent_dates": _sql(f"SELECT src, dst FROM de JOIN (SELECT id, {_DATE} AS born FROM dn) p ON p.id = src JOIN (SELECT id, {_DATE} AS born FROM dn) c ON c.id = dst WHERE relation = 'similar_to' AND p.born > c.born"),
    "graph_schema_coherent": "SELECT a.untyped, b.unrelated, (a.untyped = 0 AND b.unrelated = 0)::INT AS coherent FROM (SELECT count(*) FILTER (type IS NULL) AS untyped FROM nodes) a, (SELECT count(*) FILTER (relation IS NULL) AS unrelated FROM edges) b",
    "graph_consolidated_schema": "SELECT 'node' AS of, lower(type) AS kind, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', lower(relation), count(*) FROM edges GROUP BY 2",
    "graph_pruned_sources": """
WITH big AS (SELECT source FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1) ORDER BY n DESC, source LIMIT 3),
kn AS (SELECT * FROM nodes WHERE source IS NULL OR source NOT IN (SELECT source FROM big WHERE source IS NOT NULL)),
ke AS (SELECT * FROM edges WHERE (provenance IS NULL OR provenance NOT IN (SELECT source FROM big WHERE source IS NOT NULL)) AND src IN (SELECT id FROM kn) AND dst IN (SELECT id FROM kn))
SELECT DISTINCT 'node' AS kind, id, NULL AS dst FROM kn UNION SELECT DISTINCT lower(relation), src, dst FROM ke""",
    "graph_components": _sql("SELECT id, component, size FROM al JOIN sz USING (component)", _COMPONENTS, recursive=True),
    "graph_small_components": _sql("SELECT id, component, size FROM al JOIN sz USING (component) WHERE size < 3", _COMPONENTS, recursive=True),
    "graph_resolved_entities": _sql(r"SELECT id, first_value(id) OVER (PARTITION BY lower(regexp_replace(trim(text), '\s+', ' ', 'g')) ORDER BY pos) AS keeper FROM dn WHERE type = 'entity' AND text IS NOT NULL"),
    "graph_search": _sql("SELECT id, type FROM dn WHERE CASE WHEN type = 'document' THEN contains(lower(id), 'ledger') OR coalesce(contains(lower(source), 'ledger'), false) ELSE contains(lower(text), 'ledger') END"),
    "graph_search_documents": _sql("SELECT id, source FROM dn WHERE type = 'document' AND (contains(lower(id), 'notes') OR coalesce(contains(lower(source), 'notes'), false))"),
    "graph_search_with_links": _sql(
        "SELECT seed, id, min(depth)::INT AS depth FROM (SELECT id AS seed, id, 0 AS depth FROM seeds UNION ALL SELECT id, b, 1 FROM seeds JOIN lk ON a = id UNION ALL SELECT id, y.b, 2 FROM seeds JOIN lk x ON x.a = id JOIN lk y ON y.a = x.b) GROUP BY 1, 2",
        "seeds AS (SELECT id FROM dn WHERE type = 'chunk' AND contains(lower(text), 'harbour')), lk AS (SELECT src AS a, dst AS b FROM de WHERE relation IN ('next_chunk', 'similar_to') UNION SELECT dst, src FROM de WHERE relation IN ('next_chunk', 'similar_to'))",
    ),
    "graph_fact_confidence": _sql("SELECT * FROM conf", _FACTS),
    "graph_verified_statements": _sql("SELECT round(avg(confidence), 6) AS confidence, count(*) AS statements FROM conf", _FACTS),
    "graph_removed_documents": _sql("SELECT id, type FROM dn WHERE id NOT IN (SELECT id FROM gone) AND id NOT IN (SELECT dst FROM hc WHERE src IN (SELECT id FROM gone))", "gone AS (SELECT id FROM dn WHERE type = 'document' AND source LIKE 'scan:%')"),
    "graph_cascade_removed_documents": _sql(
        "SELECT id, type FROM dn WHERE id NOT IN (SELECT id FROM gone) AND (id NOT IN (SELECT dst FROM de WHERE relation = 'mentions') OR id IN (SELECT dst FROM de WHERE relation = 'mentions' AND src NOT IN (SELECT id FROM gone)))",
        "g0 AS (SELECT id FROM dn WHERE type = 'document' AND source LIKE 'file:%'), gone AS (SELECT id FROM g0 UNION SELECT dst FROM hc WHERE src IN (SELECT id FROM g0))",
    ),
    "graph_triangles": "WITH p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst) SELECT x.u AS a, x.v AS b, y.v AS c FROM p x JOIN p y ON y.u = x.v JOIN p z ON z.u = x.u AND z.v = y.v",
    "graph_text": _sql("SELECT src, md5(string_agg(text, chr(10) || chr(10) ORDER BY n, text)) AS fingerprint, count(*) AS chunks FROM hc JOIN dn ON dn.id = dst WHERE type = 'chunk' AND text IS NOT NULL GROUP BY 1"),
    "graph_statements": _sql("SELECT hc.src AS document, string_agg(chunk || ' mentions ' || entity, '. ' ORDER BY chunk || ' mentions ' || entity) AS text FROM me JOIN hc ON hc.dst = chunk GROUP BY 1"),
    "graph_export_prompts": _sql("SELECT d.id AS document, c.id AS chunk, md5(c.text) AS prompt_hash, d.source, d.author, d.organization FROM hc JOIN dn c ON c.id = hc.dst JOIN dn d ON d.id = hc.src WHERE c.type = 'chunk' AND c.text IS NOT NULL AND d.type = 'document'"),
    "graph_node_similarity": _sql("SELECT src, dst, round(shared / (x.n + y.n - shared), 6) AS similarity FROM sh JOIN s x ON x.document = src JOIN s y ON y.document = dst WHERE round(shared / (x.n + y.n - shared), 6) >= 0.3",
        "s AS (SELECT document, count(*) AS n FROM doe GROUP BY 1), sh AS (SELECT a.document AS src, b.document AS dst, count(*) AS shared FROM doe a JOIN doe b ON a.entity = b.entity AND a.document < b.document GROUP BY 1, 2)"),
    "graph_predicted_links": _sql("SELECT a.entity AS src, b.entity AS dst, round(sum(1 / ln(a.n)), 6) AS score FROM w a JOIN w b ON a.chunk = b.chunk AND a.entity < b.entity GROUP BY 1, 2", "w AS (SELECT * FROM (SELECT chunk, entity, count(*) OVER (PARTITION BY chunk) AS n FROM me) WHERE n > 1)"),
}
