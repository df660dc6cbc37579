"""Building node and edge tables from documents: chunks, facts, entities, atoms and molecules.

Ids follow from the document's: ``d7_chunk_0``, ``d7_chunk_0_fact_0``, ``d7_atom_3``, ``d7_molecule_1``; order is carried by ``sequence``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.session import cut


def document_rows(docs: DataFrame) -> DataFrame:
    """(``id``, ``text``, ``source``, ``uid``): the cleaned text and its SHA-1."""
    cleaned = T.clean_text(F.coalesce("text", F.lit("")))
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), cleaned.alias("text"), "source").withColumn("uid", F.sha1("text"))


def chunk_rows(documents: DataFrame, window: int = 512, overlap: int = 64) -> DataFrame:
    """(``id``, ``document``, ``sequence``, ``text``, ``source``) of each document's windows."""
    rows = documents.select(F.col("id").alias("document"), "source", F.posexplode(T.sliding_windows(F.col("text"), window, overlap)).alias("sequence", "text"))
    return rows.select(F.concat("document", F.lit("_chunk_"), "sequence").alias("id"), "document", "sequence", "text", "source")


def parent_edges(children: DataFrame, relation: str) -> DataFrame:
    return children.select(F.col("document").alias("src"), F.col("id").alias("dst"), F.lit(relation).alias("relation"), "sequence")


def chain_edges(children: DataFrame, relation: str) -> DataFrame:
    """Edges from each child to the next of its document; ids follow from the sequence, so nothing is sorted."""
    stem = F.regexp_replace("id", r"\d+$", "")
    last = children.groupBy("document").agg(F.max("sequence").alias("last"))
    rows = children.join(last, "document").where(F.col("sequence") < F.col("last"))
    return rows.select(F.col("id").alias("src"), F.concat(stem, F.col("sequence") + 1).alias("dst"), F.lit(relation).alias("relation"), F.lit(None).cast("int").alias("sequence"))


def fact_rows(chunks: DataFrame) -> DataFrame:
    """(``id``, ``chunk``, ``subject``, ``predicate``, ``object``) stated in the chunks."""
    rows = chunks.select(F.col("id").alias("chunk"), F.posexplode(T.stated_facts(F.col("text"))).alias("n", "f"))
    return rows.select(F.concat("chunk", F.lit("_fact_"), "n").alias("id"), "chunk", "f.subject", "f.predicate", "f.object")


def fact_edges(facts: DataFrame) -> DataFrame:
    """has_fact, subject, object and the stated relation itself; one direct edge for each pair and relation."""
    # read four times, so what they were found by is done once
    facts = cut(facts)
    edge = lambda a, b, r: facts.select(F.col(a).alias("src"), F.col(b).alias("dst"), (F.lit(r) if isinstance(r, str) else r).alias("relation"))
    return edge("chunk", "id", "has_fact").unionByName(edge("id", "subject", "subject")).unionByName(edge("id", "object", "object")).unionByName(edge("subject", "object", F.col("predicate")).distinct())


def entity_mentions(chunks: DataFrame) -> DataFrame:
    """(``chunk``, ``entity``): distinct capitalised names of each chunk."""
    return chunks.select(F.col("id").alias("chunk"), F.explode(T.capitalized_names(F.col("text"))).alias("entity"))


def atom_rows(docs: DataFrame) -> DataFrame:
    """(``id``, ``document``, ``sequence``, ``kind``, ``text``): the non-blank lines of each document, told apart as list items, titles and text."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r?\n"), lambda s: F.rlike(s, F.lit(r"[^ \t\r\xa0]")))
    rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("document"), F.posexplode(lines).alias("sequence", "text"))
    kind = F.when(F.rlike("text", F.lit(r"^\s*[-*•]")), "ListItem").when((F.length("text") < 60) & ~F.rlike("text", F.lit(r"[.!?]\s*\z")), "Title").otherwise("NarrativeText")
    return rows.select(F.concat("document", F.lit("_atom_"), "sequence").alias("id"), "document", "sequence", kind.alias("kind"), "text")


def molecule_rows(atoms: DataFrame) -> DataFrame:
    """(``atom``, ``molecule``): runs of atoms from one title to the next."""
    window = Window.partitionBy("document").orderBy("sequence")
    number = F.sum(F.when(F.col("kind") == "Title", 1).otherwise(0)).over(window)
    return atoms.select(F.col("id").alias("atom"), F.concat("document", F.lit("_molecule_"), number).alias("molecule"))


def valid_ids(members: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Members whose node is missing: to be empty before hyperedges or simplices are added."""
    return members.join(nodes.select(F.col("id").alias(column)), column, "left_anti")


def simplex_rows(members: DataFrame, simplex: str) -> DataFrame:
    """(``simplex``, ``dimension``): one less than the number of different members."""
    return members.groupBy(simplex).agg((F.countDistinct("node") - 1).alias("dimension"))


def captions(images: DataFrame, image: str, alt: Column) -> DataFrame:
    """(``image``, ``caption``, ``text``) of the images that have an alternative text."""
    return images.where(F.trim(alt) != "").select(F.col(image).alias("image"), F.concat(image, F.lit("_caption")).alias("caption"), alt.alias("text"))
