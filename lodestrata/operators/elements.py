"""Sections, media and facts of documents as nodes and edges, and the walks between them.

Nodes are (id, type, text, page), edges (src, dst, relation, sequence); all walks are equi-joins on the edge table.
A walk from a node that has nothing at its end gives no row; repeated edges count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import stated_subjects, stated_triplets
from lodestrata.operators import building as B
from lodestrata.operators.graph import related


def section_lines(docs: DataFrame, lines_a_page: int = 40) -> DataFrame:
    """(``document``, ``sequence``, ``kind``, ``text``, ``section``, ``page``): every filled line with the section that the last title before it opened, null before the first."""
    number = F.sum(F.when(F.col("kind") == "Title", 1).otherwise(0)).over(Window.partitionBy("document").orderBy("sequence"))
    rows = B.atom_rows(docs).withColumn("n", number)
    section = F.when(F.col("n") > 0, F.concat("document", F.lit("_section_"), "n"))
    return rows.select("document", "sequence", "kind", "text", section.alias("section"), (F.floor(F.col("sequence") / lines_a_page) + 1).cast("int").alias("page"))


def section_nodes(lines: DataFrame) -> DataFrame:
    """(``id``, ``document``, ``text``, ``page``, ``sequence``) of each section, by its title."""
    return lines.where("kind = 'Title'").select(F.col("section").alias("id"), "document", "text", "page", "sequence")


def line_chunks(lines: DataFrame) -> DataFrame:
    """(``id``, ``document``, ``section``, ``text``, ``page``, ``sequence``): the lines that aren't titles, as chunks."""
    return lines.where("kind <> 'Title'").select(F.concat("document", F.lit("_line_"), "sequence").alias("id"), "document", "section", "text", "page", "sequence")


def _edges(rows: DataFrame, src, dst, relation: str, sequence=None) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    number = as_column(sequence) if sequence is not None else F.lit(None)
    return rows.select(as_column(src).alias("src"), as_column(dst).alias("dst"), F.lit(relation).alias("relation"), number.cast("int").alias("sequence"))


def section_edges(lines: DataFrame) -> DataFrame:
    """has_section, has_chunk, under_section and next_section; a section is linked to the next of its document."""
    sections, chunks = section_nodes(lines), line_chunks(lines)
    following = sections.withColumn("next", F.lead("id").over(Window.partitionBy("document").orderBy("sequence"))).where("next IS NOT NULL")
    return (
        _edges(sections, "document", "id", "has_section", "sequence")
        .unionByName(_edges(following, "id", "next", "next_section"))
        .unionByName(_edges(chunks, "document", "id", "has_chunk", "sequence"))
        .unionByName(_edges(chunks.where("section IS NOT NULL"), "id", "section", "under_section", "sequence"))
    )


def triplet_facts(chunks: DataFrame) -> DataFrame:
    """(``id``, ``chunk``, ``subject``, ``predicate``, ``object``) of the triplets stated in ``chunks`` (id, text)."""
    rows = chunks.select(F.col("id").alias("chunk"), F.posexplode(stated_triplets(F.col("text"))).alias("n", "t"))
    return rows.select(F.concat("chunk", F.lit("_fact_"), "n").alias("id"), "chunk", "t.subject", "t.predicate", "t.object")


def section_subjects(docs: DataFrame) -> DataFrame:
    """(``section``, ``entity``): what each section's lines state something about, as the walk over fact_edges and section_edges finds it, without their joins."""
    # of the lines only subjects are shuffled, and of titles that they are there: the null
    stated = F.when(F.col("kind") == "Title", F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(stated_subjects(F.col("text"))))
    rows = B.atom_rows(docs).select("document", "sequence", F.explode(stated).alias("entity"))
    number = F.sum(F.when(F.col("entity").isNull(), 1).otherwise(0)).over(Window.partitionBy("document").orderBy("sequence"))
    numbered = rows.withColumn("n", number).where("n > 0 AND entity IS NOT NULL")
    return numbered.select(F.concat("document", F.lit("_section_"), "n").alias("section"), "entity").distinct()


def fact_edges(facts: DataFrame) -> DataFrame:
    """has_fact, subject and object edges of ``facts`` (id, chunk, subject, predicate, object)."""
    return B.fact_edges(facts).where("relation IN ('has_fact', 'subject', 'object')").select("src", "dst", "relation", F.lit(None).cast("int").alias("sequence"))


def image_rows(payloads: DataFrame) -> DataFrame:
    """(``id``, ``document``, ``sequence``, ``caption_id``, ``caption``): a page image for each page of a payload (doc_id, path, n_pages); a document's payloads count once."""
    one = payloads.where("n_pages > 0").groupBy("doc_id").agg(F.min(F.struct("path", "n_pages")).alias("p"))
    rows = one.select(F.concat(F.lit("d"), "doc_id").alias("document"), "p.path", F.explode(F.sequence(F.lit(0), F.col("p.n_pages") - 1)).alias("sequence"))
    rows = rows.withColumn("id", F.concat("document", F.lit("_image_"), "sequence"))
    return rows.select("id", "document", "sequence", F.concat("id", F.lit("_caption")).alias("caption_id"), F.concat_ws(", page ", "path", F.col("sequence") + 1).alias("caption"))


def image_edges(images: DataFrame) -> DataFrame:
    """has_image and has_caption from documents, caption_of from captions to images."""
    return (
        _edges(images, "document", "id", "has_image", "sequence")
        .unionByName(_edges(images, "document", "caption_id", "has_caption", "sequence"))
        .unionByName(_edges(images, "caption_id", "id", "caption_of"))
    )


def audio_edges(recorded: DataFrame, chunk_edges: DataFrame) -> DataFrame:
    """has_audio from each recorded document (id), and transcript_of from its chunks to the recording."""
    audio = F.concat("id", F.lit("_audio_0"))
    spoken = related(chunk_edges, "has_chunk").join(recorded.select(F.col("id").alias("src")), "src", "left_semi")
    return _edges(recorded, "id", audio, "has_audio", F.lit(0)).unionByName(_edges(spoken, "dst", F.concat("src", F.lit("_audio_0")), "transcript_of"))


def first_parent(edges: DataFrame, relation: str) -> DataFrame:
    """(``dst``, ``src``): the first source of each target of a relation, by name."""
    return related(edges, relation).groupBy("dst").agg(F.min("src").alias("src"))


def first_target(edges: DataFrame, relation: str) -> DataFrame:
    """(``src``, ``dst``): the first target of each source of a relation, by sequence, then name."""
    order = F.struct(F.coalesce("sequence", F.lit(2**31 - 1)), "dst")
    return related(edges, relation).groupBy("src").agg(F.min_by("dst", order).alias("dst"))


def entity_facts(edges: DataFrame) -> DataFrame:
    """(``entity``, ``fact``): facts whose subject or object the entity is."""
    both = related(edges, "subject").unionByName(related(edges, "object"))
    return both.select(F.col("dst").alias("entity"), F.col("src").alias("fact")).distinct()


def fact_chunks(edges: DataFrame) -> DataFrame:
    return related(edges, "has_fact").select(F.col("dst").alias("fact"), F.col("src").alias("chunk"))


def fact_sections(edges: DataFrame) -> DataFrame:
    """(``fact``, ``section``) by the chunks that state it."""
    under = related(edges, "under_section").select(F.col("src").alias("chunk"), F.col("dst").alias("section"))
    return fact_chunks(edges).join(under, "chunk").select("fact", "section").distinct()


def fact_documents(edges: DataFrame) -> DataFrame:
    owner = related(edges, "has_chunk").select(F.col("dst").alias("chunk"), F.col("src").alias("document"))
    return fact_chunks(edges).join(owner, "chunk").select("fact", "document").distinct()


def fact_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    pages = nodes.where("page IS NOT NULL").select(F.col("id").alias("chunk"), "page")
    return fact_chunks(edges).join(pages, "chunk").select("fact", "page").distinct()


def matching_facts(facts: DataFrame, subject: str | None = None, predicate: str | None = None, object: str | None = None) -> DataFrame:  # noqa: A002
    """``facts`` equal to what is given; None stands for anything."""
    for column, value in (("subject", subject), ("predicate", predicate), ("object", object)):
        if value is not None:
            facts = facts.where(F.col(column) == value)
    return facts


def without_chunks(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``n``): chunks of each document without those ``gone`` (id), numbered anew."""
    kept = related(edges, "has_chunk").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    order = Window.partitionBy("src").orderBy(F.col("sequence").asc_nulls_last(), "dst")
    return kept.select("src", "dst", (F.row_number().over(order) - 1).alias("n"))


def not_purged(rows: DataFrame, deleted_at: str, now, days: int = 30) -> DataFrame:
    """Rows that were never deleted, or less than ``days`` before ``now`` (a column); what is exactly that old goes."""
    return rows.where(F.col(deleted_at).isNull() | (F.col(deleted_at) > now - F.expr(f"INTERVAL {days} DAYS")))


def as_records(rows: DataFrame) -> DataFrame:
    """(``line``): a JSON object for each row, nulls left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def from_records(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON objects (``line``); what doesn't parse gives a row of nulls."""
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def properties(rows: DataFrame) -> DataFrame:
    """(``key``, ``value``) whose key is an identifier, the last by ``pos`` of each key."""
    return rows.where(F.rlike("key", F.lit(r"\A[A-Za-z_][A-Za-z0-9_]*\z"))).groupBy("key").agg(F.max_by("value", "pos").alias("value"))
