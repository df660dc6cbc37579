"""Graphs as ``nodes`` and ``edges`` tables: building, walking, linking and cleaning.

``nodes`` has id, pos (the order of insertion), type, text and more; ``edges`` has src, dst, relation and more.
Every function takes tables and returns a table.  Repeated nodes count once (the first by pos), repeated edges once;
types and relations are compared in lower case.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.components import connected_components
from lodestrata.session import cut
from lodestrata.tables import share_package

#: Relations that don't state facts.
STRUCTURAL = ("has_chunk", "next_chunk", "subject", "object", "has_fact", "mentions")

#: Members of a block, about; blocks at least, where there are so many members for each; and names that a task passes on at once.
MEMBERS_A_BLOCK, LEAST_BLOCKS, FEW_MEMBERS, NAMES_AT_ONCE = 12_000, 8, 500, 200_000
#: Pairs that Spark makes of one row from Python, about: it holds them all at a time.
PAIRS_A_ROW = 4_000


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Each id once, the first by pos, with its type in lower case."""
    columns = [c for c in nodes.columns if c != "id"]
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*columns), "pos").alias("n"))
    return first.select("id", "n.*").withColumn("type", F.lower("type"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each (src, dst, relation) once, the relation in lower case, with its least sequence, and its least provenance and similarity if the table has them."""
    least = [F.min(c).alias(c) for c in ("sequence", "provenance", "similarity") if c in edges.columns]
    return edges.groupBy("src", "dst", F.lower("relation").alias("relation")).agg(*least)


def related(edges: DataFrame, relation: str) -> DataFrame:
    return distinct_edges(edges).where(F.col("relation") == relation)


def members_in_order(edges: DataFrame, relation: str) -> DataFrame:
    """(``src``, ``dst``, ``n``): targets of a relation numbered from 0; those without a sequence come last, then by id."""
    order = Window.partitionBy("src").orderBy(F.col("sequence").asc_nulls_last(), "dst")
    return related(edges, relation).select("src", "dst", (F.row_number().over(order) - 1).alias("n"))


def followers(edges: DataFrame, relation: str = "has_chunk") -> DataFrame:
    """(``src``, ``dst``, ``previous``, ``next``) of each member by the order of its parent."""
    order = Window.partitionBy("src").orderBy("n")
    return members_in_order(edges, relation).select("src", "dst", F.lag("dst").over(order).alias("previous"), F.lead("dst").over(order).alias("next"))


def renumbered(edges: DataFrame, relation: str = "has_chunk", chain: str = "next_chunk") -> DataFrame:
    """Edges whose members are numbered anew, with the chain of neighbours built from that order."""
    members = members_in_order(edges, relation)
    parents = members.select("src", "dst", F.lit(relation).alias("relation"), F.col("n").alias("sequence"))
    links = followers(edges, relation).where("next IS NOT NULL").select(F.col("dst").alias("src"), F.col("next").alias("dst"), F.lit(chain).alias("relation"), F.lit(None).cast("int").alias("sequence"))
    return parents.unionByName(links)


def chunk_context(edges: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(``id``, ``context``): ids of a chunk's neighbours in order, itself included."""
    window = Window.partitionBy("src").orderBy("n").rowsBetween(-before, after)
    return members_in_order(edges, "has_chunk").select(F.col("dst").alias("id"), F.collect_list("dst").over(window).alias("context"))


def mentions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``chunk``, ``entity``): which chunk nodes mention which entity nodes."""
    kinds = distinct_nodes(nodes).select("id", "type")
    found = related(edges, "mentions").select(F.col("src").alias("chunk"), F.col("dst").alias("entity"))
    chunks = kinds.where("type = 'chunk'").select(F.col("id").alias("chunk"))
    entities = kinds.where("type = 'entity'").select(F.col("id").alias("entity"))
    return found.join(chunks, "chunk", "left_semi").join(entities, "entity", "left_semi")


def chunk_documents(edges: DataFrame) -> DataFrame:
    """(``chunk``, ``document``) by has_chunk."""
    return related(edges, "has_chunk").select(F.col("dst").alias("chunk"), F.col("src").alias("document"))


def document_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``document``, ``entity``): mentioned by the document itself or one of its chunks."""
    direct = related(edges, "mentions").join(distinct_nodes(nodes).where("type = 'document'").select(F.col("id").alias("src")), "src", "left_semi")
    through = mentions(nodes, edges).join(chunk_documents(edges), "chunk").select("document", "entity")
    return direct.select(F.col("src").alias("document"), F.col("dst").alias("entity")).unionByName(through).distinct()


def co_mentions(pairs: DataFrame, member: str, group: str) -> DataFrame:
    """(``src``, ``dst``, ``shared``): members of the same groups, each pair once; as many edges as there are pairs."""
    rows = pairs.select(F.col(member).alias("m"), F.col(group).alias("g")).distinct()
    other = rows.select(F.col("m").alias("dst"), "g")
    return rows.withColumnRenamed("m", "src").join(other, "g").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))


def _tiles(batches):
    """Rows of one tile after another, as sorted."""
    held, last = [], None
    for batch in batches:
        tile = batch.column("tile").to_numpy()
        bounds = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
        for start, end in zip(bounds, bounds[1:]):
            if end > start:
                if held and tile[start] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, end - start))
                last = tile[start]
    if held:
        yield pa.Table.from_batches(held)


def _later(tile: pa.Table):
    """(sources, shared, others): members of a tile, and the later ones that share so many groups with each; of two blocks the first (side -1) is before the second (1), and either may be empty."""
    names, listed = tile["m"].combine_chunks(), tile["groups"].combine_chunks()
    side, lengths = tile["side"].to_numpy(), listed.value_lengths().to_numpy()
    codes = listed.flatten().dictionary_encode()
    group, owner = codes.indices.to_numpy().astype(np.intp), np.repeat(np.arange(len(names)), lengths)
    group, ends = group[np.lexsort((group, owner))], np.cumsum(lengths)
    alike = defaultdict(list)
    split = int((side < 0).sum()) if (two := side[0] != 0) else len(names)
    for i, (end, n) in enumerate(zip(ends[:split].tolist(), lengths[:split].tolist())):
        alike[group[end - n : end].tobytes()].append(i)
    target, first = (names.slice(split), split) if two else (names, 0)
    mine = owner >= first
    by_group = np.argsort(group[mine], kind="stable")
    members = (owner[mine] - first)[by_group]
    bounds = np.searchsorted(group[mine][by_group], np.arange(len(codes.dictionary) + 1)).tolist()
    for key, sources in alike.items():  # members of the same groups share as many with any other
        met = np.concatenate([members[bounds[g] : bounds[g + 1]] for g in np.frombuffer(key, np.intp).tolist()])
        if 8 * len(met) < len(target):
            hits, shared = np.unique(met, return_counts=True)
        else:
            shared = np.bincount(met, minlength=len(target))
            hits = np.flatnonzero(shared)
            shared = shared[hits]
        if not len(hits):
            continue
        order = np.argsort(shared.astype(np.int16) if shared.max() < 2**15 else shared, kind="stable")
        hits, shared = hits[order], shared[order]
        taken, edges = target.take(pa.array(hits)), [0, *(np.flatnonzero(np.diff(shared)) + 1).tolist(), len(hits)]
        for start, end in zip(edges, edges[1:]):
            if two:
                yield sources, shared[start], taken.slice(start, end - start)
            else:  # those met are in the order of their names
                for source, later in zip(sources, (start + np.searchsorted(hits[start:end], sources, side="right")).tolist()):
                    if later < end:
                        yield [source], shared[start], taken.slice(later, end - later)


def _linked(at_once: int, a_row: int):
    """Rows of _later of at most about ``a_row`` pairs each, so many names at a time."""

    def lists(values, lengths):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), values)

    def batch(names, rows):
        sources, shared, others = zip(*rows)
        sources = lists(names.take(pa.array(list(chain.from_iterable(sources)))), map(len, sources))
        return pa.RecordBatch.from_arrays([sources, pa.array(shared, pa.int64()), lists(pa.concat_arrays(others), map(len, others))], names=["sources", "shared", "others"])

    def run(batches):
        for tile in _tiles(batches):
            names, rows, n = tile["m"].combine_chunks(), [], 0
            for sources, shared, others in _later(tile):
                step = max(1, a_row // len(others))
                for i in range(0, len(sources), step):
                    rows.append((sources[i : i + step], shared, others))
                    n += len(rows[-1][0]) + len(others)
                    if n >= at_once:
                        yield batch(names, rows)
                        rows, n = [], 0
            if rows:
                yield batch(names, rows)

    return run


def co_mentions_in_tiles(pairs: DataFrame, member: str, group: str) -> DataFrame:
    """co_mentions where groups are large: no pair is shuffled.

    Members are held with their groups, in blocks by name; a task has two of the blocks, or one, and counts what each member shares with later
    ones.  A member is shuffled once for each block, so shuffles grow with the members times their blocks, not with the pairs.
    """
    share_package(pairs.sparkSession)
    kind = pairs.schema[member].dataType.simpleString()
    rows = pairs.select(F.col(member).alias("m"), F.col(group).alias("g")).where("m IS NOT NULL AND g IS NOT NULL")
    held = cut(rows.groupBy("m").agg(F.collect_set("g").alias("groups")))
    n = held.count()
    blocks = max(1, -(-n // MEMBERS_A_BLOCK), min(LEAST_BLOCKS, n // FEW_MEMBERS))
    # held again, as the bounds of blocks are drawn from samples
    ranged = cut(held.repartitionByRange(blocks, "m").withColumn("block", F.spark_partition_id()))
    met = ranged.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    met = met.select((high * (high + 1) / 2 + low).cast("int").alias("tile"), F.signum(F.col("block") - F.col("other")).cast("int").alias("side"), "m", "groups")
    tiles = met.repartitionById(blocks * (blocks + 1) // 2, "tile").sortWithinPartitions("tile", "m")
    linked = tiles.mapInArrow(_linked(NAMES_AT_ONCE, PAIRS_A_ROW), f"sources array<{kind}>, shared bigint, others array<{kind}>")
    return linked.select(F.explode("sources").alias("src"), "shared", "others").select("src", F.explode("others").alias("dst"), "shared")


def conflicting_facts(edges: DataFrame) -> DataFrame:
    """(``src``, ``relation``, ``objects``) of the statements that name several objects."""
    facts = distinct_edges(edges).where(~F.col("relation").isin(*STRUCTURAL))
    return facts.groupBy("src", "relation").agg(F.count("dst").alias("objects")).where("objects > 1")


def marked_conflicts(edges: DataFrame) -> DataFrame:
    """Fact edges with ``conflict``: whether their subject and relation have another object."""
    window = Window.partitionBy("src", "relation")
    facts = distinct_edges(edges).where(~F.col("relation").isin(*STRUCTURAL))
    return facts.withColumn("conflict", F.count("dst").over(window) > 1).select("src", "dst", "relation", "conflict")


def normalized_date(text: Column) -> Column:
    """ISO date of a date typed in one of the usual ways, null for others (such as a year alone)."""
    text = F.trim(text)
    forms = ("yyyy-M-d", "d.M.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "d/M/yyyy")
    stamp = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})[T ]", 1)
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in forms]
    return F.coalesce(F.to_date(F.nullif(stamp, F.lit(""))), *tries)


def incoherent_parents(nodes: DataFrame, edges: DataFrame, relation: str = "parent_of") -> DataFrame:
    """Edges whose parent was born after the child."""
    born = distinct_nodes(nodes).select("id", normalized_date(F.col("birth_date")).alias("born"))
    return (
        related(edges, relation)
        .join(born.select(F.col("id").alias("src"), F.col("born").alias("parent_born")), "src")
        .join(born.select(F.col("id").alias("dst"), F.col("born").alias("child_born")), "dst")
        .where("parent_born > child_born")
        .select("src", "dst", "parent_born", "child_born")
    )


def without_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes not from the listed ``sources`` (source), and edges between them with another provenance."""
    kept = nodes.join(sources, "source", "left_anti")
    ids = kept.select("id").distinct()
    left = edges.join(sources.withColumnRenamed("source", "provenance"), "provenance", "left_anti")
    left = left.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, left


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(``id``, ``component``, ``size``) of every node; nodes without edges are components of their own."""
    found = cut(connected_components(edges)).select(F.col("node").alias("id"), "component")
    labelled = distinct_nodes(nodes).select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("size"))
    return labelled.join(sizes, "component").select("id", "component", "size")


def resolved_entities(nodes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(``id``, ``keeper``): entity nodes of one canonical name, and the first of them; ``aliases`` (alias, name) are case-insensitive."""
    name = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    entities = distinct_nodes(nodes).where("type = 'entity' AND text IS NOT NULL").select("id", "pos", name.alias("name"))
    if aliases is not None:
        known = aliases.select(F.lower("alias").alias("name"), F.lower("name").alias("canonical")).dropDuplicates(["name"])
        entities = entities.join(F.broadcast(known), "name", "left").withColumn("name", F.coalesce("canonical", "name"))
    return entities.withColumn("keeper", F.first("id").over(Window.partitionBy("name").orderBy("pos"))).select("id", "keeper")


def expanded(seeds: DataFrame, edges: DataFrame, hops: int, relations: tuple[str, ...] = ("next_chunk", "similar_to")) -> DataFrame:
    """(``seed``, ``id``, ``depth``): nodes within ``hops`` of each seed (id), in both directions, at their least depth."""
    links = distinct_edges(edges).where(F.col("relation").isin(*relations)).select("src", "dst")
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.select("seed", F.col("id").alias("src")).join(both, "src").select("seed", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen


def fact_confidence(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """``statements`` (subject, predicate, object) with ``confidence``: 1.0 for a stated fact, 0.4 where another relation joins the two, 0.2 over two steps, else 0."""
    facts = distinct_edges(edges).select("src", "dst", "relation")
    exact = facts.select(F.col("src").alias("subject"), F.col("relation").alias("predicate"), F.col("dst").alias("object"), F.lit(1.0).alias("exact")).distinct()
    links = facts.select("src", "dst").unionByName(facts.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    direct = links.select(F.col("src").alias("subject"), F.col("dst").alias("object"), F.lit(0.4).alias("direct"))
    wanted = statements.select("subject", "object").distinct()
    first = wanted.join(links.withColumnRenamed("dst", "mid"), wanted["subject"] == F.col("src")).select("subject", "object", "mid")
    two = first.join(links, (F.col("mid") == F.col("src")) & (F.col("object") == F.col("dst"))).select("subject", "object", F.lit(0.2).alias("two")).distinct()
    out = statements.withColumn("predicate", F.lower("predicate")).join(exact, ["subject", "predicate", "object"], "left").join(direct, ["subject", "object"], "left").join(two, ["subject", "object"], "left")
    return out.select("subject", "predicate", "object", F.coalesce("exact", "direct", "two", F.lit(0.0)).alias("confidence"))


def text_search(nodes: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Nodes that hold ``query`` literally, case aside: documents in id or source, others in their text."""
    low = query.lower()
    has = lambda c: F.coalesce(F.instr(F.lower(F.col(c)), F.lit(low)) > 0, F.lit(False))
    rows = distinct_nodes(nodes)
    if kind:
        rows = rows.where(F.col("type") == kind)
    return rows.where(F.when(F.col("type") == "document", has("id") | has("source")).otherwise(has("text")))


def without_documents(nodes: DataFrame, edges: DataFrame, documents: DataFrame, cascade: bool = False) -> DataFrame:
    """Nodes without the listed ``documents`` (id) and their chunks; with ``cascade`` also without entities nothing mentions any more."""
    gone = documents.select("id").unionByName(related(edges, "has_chunk").join(documents.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))).distinct()
    kept = distinct_nodes(nodes).join(gone, "id", "left_anti")
    if cascade:
        held = related(edges, "mentions").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(F.col("dst").alias("id")).distinct()
        loose = related(edges, "mentions").select(F.col("dst").alias("id")).distinct().join(held, "id", "left_anti")
        kept = kept.join(loose, "id", "left_anti")
    return kept


def triangles(edges: DataFrame, relation: Column | None = None) -> DataFrame:
    """(``a``, ``b``, ``c``) with a < b < c, each once; wedges are made at the end of lower degree."""
    rows = edges if relation is None else edges.where(relation)
    pairs = rows.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    ends = pairs.select(F.col("u").alias("n")).unionByName(pairs.select(F.col("v").alias("n")))
    degree = ends.groupBy("n").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    arcs = ranked.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("high"))
    wedges = arcs.withColumnRenamed("high", "x").join(arcs.withColumnRenamed("high", "y"), "low").where("x < y")
    closed = wedges.join(pairs, (F.col("x") == F.col("u")) & (F.col("y") == F.col("v")))
    return closed.select(F.array_sort(F.array("low", "x", "y")).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of different ends once, as (u < v)."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    pairs = undirected(edges)
    return pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
