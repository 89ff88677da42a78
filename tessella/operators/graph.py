"""Knowledge graphs as node, edge and mention tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import entity_name, short_hash
from tessella.session import materialise, release


def with_entity_id(entities: DataFrame, kb: str, name: str = "name", label: str = "label") -> DataFrame:
    """``name`` in normal form and ``entity_id``: equal names and labels of a knowledge base are one entity."""
    named = entities.withColumn(name, entity_name(F.col(name)))
    return named.withColumn("entity_id", short_hash(F.lit(kb), F.col(name), F.col(label)))


def triple_id(kb: str):
    """The id of (name, label, relation, other_name, other_label)."""
    return short_hash(F.lit(kb), *(F.col(c) for c in ("name", "label", "relation", "other_name", "other_label")))


def normalised_relations(entities: DataFrame, relations: DataFrame, most_name: int = 512, most_label: int = 128) -> tuple[DataFrame, DataFrame]:
    """Extracted entities (chunk_id, ref, name, label) and relations (chunk_id, source, target, relation) in order:
    names collapsed, empty labels ``Entity``, names or labels that are empty or too long dropped, doubles of a
    chunk once, and relations kept only if both ends are entities of their chunk."""
    kept = (
        entities.withColumn("name", entity_name(F.col("name")))
        .withColumn("label", F.when(F.coalesce(F.trim("label"), F.lit("")) == "", "Entity").otherwise(F.trim("label")))
        .filter((F.length("name").between(1, most_name)) & (F.length("label") <= most_label))
    )
    ends = kept.groupBy("chunk_id", "ref").agg(F.min("name").alias("n"), F.min("label").alias("l"))
    joined = (
        relations.filter(F.coalesce(F.trim("relation"), F.lit("")) != "")
        .join(ends.select("chunk_id", F.col("ref").alias("source"), F.col("n").alias("name"), F.col("l").alias("label")), ["chunk_id", "source"])
        .join(ends.select("chunk_id", F.col("ref").alias("target"), F.col("n").alias("other_name"), F.col("l").alias("other_label")), ["chunk_id", "target"])
    )
    return kept.select("chunk_id", "name", "label").distinct(), joined.select("chunk_id", "name", "label", "relation", "other_name", "other_label").distinct()


def merged_payload(entities: DataFrame) -> DataFrame:
    """One row per (name, label), with the union of its attributes (array<string>)."""
    return entities.groupBy("name", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("attributes")))).alias("attributes"))


def upsert_last(old: DataFrame, new: DataFrame, key: list[str], seq: str, values: list[str]) -> DataFrame:
    """Rows of both; for each key the values of its last row in ``seq`` order."""
    last = F.max_by(F.struct(*values), seq).alias("v")
    return old.unionByName(new).groupBy(*key).agg(last).select(*key, "v.*")


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with those rows of ``new`` whose key it lacks, once each."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, *rest, F.lit(1).alias("_old")).unionByName(new.select(*key, *rest, F.lit(0).alias("_old")))
    values = [F.first(F.when(F.col("_old") == 0, F.struct(*rest)), ignorenulls=True).alias("_v")] if rest else []
    found = both.groupBy(*key).agg(F.min("_old").alias("_least"), F.max("_old").alias("_most"), *values)
    no_key = F.greatest(*(F.col(c).isNull() for c in key)) if len(key) > 1 else F.col(key[0]).isNull()  # equal to none
    absent = found.filter((F.col("_least") == 0) & ((F.col("_most") == 0) | no_key))
    return old.unionByName(absent.select(*key, *(["_v.*"] if rest else [])).select(*old.columns))


def delete_file(mentions: DataFrame, triples: DataFrame, triple_mentions: DataFrame, entities: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """What is left when the chunks in ``gone`` (chunk_id) are deleted: their mentions; then triples without
    mentions; then entities with neither mentions nor triples. Doing it again changes nothing."""
    left_mentions = mentions.join(gone, "chunk_id", "left_anti")
    left_triple_mentions = triple_mentions.join(gone, "chunk_id", "left_anti")
    left_triples = triples.join(left_triple_mentions, "triple_id", "left_semi")
    ends = left_triples.select(F.explode(F.array("source_id", "target_id")).alias("entity_id"))
    used = left_mentions.select("entity_id").unionByName(ends).distinct()
    return {"mentions": left_mentions, "triple_mentions": left_triple_mentions, "triples": left_triples, "entities": entities.join(used, "entity_id", "left_semi")}


def finished_chunks(chunks: DataFrame, mentions: DataFrame, triple_mentions: DataFrame) -> DataFrame:
    """Chunks none of whose entities or triples is not indexed yet."""
    waiting = lambda m: m.filter("status <> 'indexed' or status is null").select("chunk_id")
    return chunks.join(waiting(mentions), "chunk_id", "left_anti").join(waiting(triple_mentions), "chunk_id", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, hops): the nodes within ``depth`` undirected steps of ``seeds`` (id), through ``allowed`` nodes only.
    Each round joins the frontier to the edges and keeps the nodes not met before."""
    ways = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    if allowed is not None:
        ways = ways.join(allowed.select(F.col("id").alias("dst")), "dst", "left_semi")
    met = frontier = materialise(seeds.select("id").distinct().withColumn("hops", F.lit(0)), "met")
    for hop in range(1, depth + 1):
        frontier = frontier.select(F.col("id").alias("src")).join(ways, "src").select(F.col("dst").alias("id")).distinct().join(met, "id", "left_anti").withColumn("hops", F.lit(hop))
        frontier = materialise(frontier, "met")
        met = met.unionByName(frontier)
    return met


def capped(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """At most so many nodes (nearest, then least id), the edges among them, and at most twice as many edges."""
    kept = nodes.dropDuplicates(["id"]).orderBy("hops", "id").limit(most)
    ends = kept.select("id")
    inner = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inner.select("src", "dst").distinct().orderBy("src", "dst").limit(2 * most)


def personalised_pagerank(
    nodes: DataFrame, edges: DataFrame, restart: DataFrame, damping: float = 0.85, rounds: int = 2000, cut_every: int = 5, tolerance: float = 1e-6
) -> DataFrame:
    """(id, score) over the undirected simple graph: each round gives a node's score to its neighbours in equal
    parts; (1 - damping) of everything, and what nodes without neighbours hold, goes to the ``restart`` nodes
    (id, weight, summing to 1). Damping is held between 0.1 and 0.99. Rounds are joins and sums; every few
    of them the scores are written to the shared folder, and they end where all scores together have changed by less
    than ``tolerance`` (0: never) since the last time (at 0.99, after at most 1,450), or after ``rounds``. What nodes without
    neighbours hold comes from the restart alone, so it is a number that follows from their weight. Rounds broadcast nothing, so
    that what passes through the driver does not add up over them."""
    alpha = min(0.99, max(0.1, damping))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    degree = both.groupBy("src").agg(F.count("*").alias("degree"))
    ways = materialise(both.join(degree, "src").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"), "ways")
    start = materialise(nodes.select("id").distinct().join(restart, "id", "left").join(degree.select(F.col("src").alias("id"), "degree"), "id", "left").select("id", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("degree").isNull().alias("dangling")), "nodes")
    alone = start.filter("dangling").agg(F.sum("weight")).first()[0] or 0.0
    lost, written = alone, []
    scores = start.select("id", F.col("weight").alias("score"))
    kept = start.select("id", F.col("weight").alias("before"))
    for i in range(rounds):
        # one sum of what comes from the restart and from neighbours: it leaves scores dealt by id, as the next round joins them
        own = start.select("id", ((alpha * lost + 1 - alpha) * F.col("weight")).alias("part"))
        given = scores.select(F.col("id").alias("src"), "score").join(ways.hint("merge"), "src").select(F.col("dst").alias("id"), (alpha * F.col("score") / F.col("degree")).alias("part"))
        scores = own.unionByName(given).groupBy("id").agg(F.sum("part").alias("score"))
        lost = alone * (alpha * lost + 1 - alpha)
        if (i + 1) % cut_every == 0:
            scores = materialise(scores, "scores")
            written.append(scores)
            if len(written) > 2:  # the last two are compared
                release(written.pop(0))
            if not tolerance:
                continue
            change = scores.join(kept, "id").agg(F.sum(F.abs(F.col("score") - F.col("before")))).first()[0] or 0.0
            if change < tolerance:
                break
            kept = scores.select("id", F.col("score").alias("before"))
    return scores.select("id", "score")


#: Rows of a frontier, or of anchors, that go to every task; more are joined by a shuffle.
MOST_SENT = 1_000_000


class PushWays:
    """A simple undirected graph as ``pushed_pagerank`` walks it: ``edges`` (src, dst), each once in one direction, ``degrees`` (id,
    degree), and ``near``, the neighbours of those nodes that have pushed so far. A push needs only the neighbours of
    nodes that push for the first time; they are read out of ``edges`` by one scan, so the graph is never shuffled by a walk.

    With ``asked``, a condition on ``id``, other nodes are left out of ``near`` if even the whole weight of a query would not make them
    push; their scores are not returned, and those of nodes asked for stay the same."""

    def __init__(self, edges: DataFrame, residual: float, asked: Column | None = None, simple: bool = False) -> None:
        once = edges.select("src", "dst")
        if not simple:
            once = once.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        self.residual, self.asked = residual, asked
        self.edges = materialise(once, "edges")
        # src and dst each are counted before they meet: an explode would make two rows of each edge first
        ends = self.edges.groupBy(F.col("src").alias("id")).count().unionByName(self.edges.groupBy(F.col("dst").alias("id")).count())
        self.degrees = materialise(ends.groupBy("id").agg(F.sum("count").alias("degree")), "degrees")
        self.known: DataFrame | None = None
        self.near: DataFrame | None = None
        self._written = [self.edges, self.degrees]

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows (id, degree) without those nodes that neither are asked for nor can push."""
        can_push = F.col("degree") * self.residual < 1.001  # all weight of a query is 1, but for rounding
        return rows if self.asked is None else rows.filter(self.asked | can_push)

    def unknown(self, ids: DataFrame) -> DataFrame:
        return ids.distinct() if self.known is None else ids.distinct().join(self.known.hint("merge"), "id", "left_anti")

    def read(self, ids: DataFrame, n: int) -> None:
        """Add the neighbours of ``n`` nodes (id) that are not known yet."""
        ids = materialise(ids, "pushers")
        asking = ids.select(F.col("id").alias("src"))
        asking = F.broadcast(asking) if n <= MOST_SENT else asking
        found = self.edges.join(asking, "src").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).join(asking, "src"))
        near = materialise(self.kept(found.withColumnRenamed("dst", "id").join(self.degrees.hint("merge"), "id")).select("src", "id", "degree"), "near")
        self._written += [ids, near]
        self.known = ids if self.known is None else self.known.unionByName(ids)
        self.near = near if self.near is None else self.near.unionByName(near)

    def release(self) -> None:
        release(*self._written)


def pushed_pagerank(
    edges: DataFrame | None, restarts: DataFrame, damping: float = 0.85, residual: float = 1e-4, rounds: int = 400, ways: PushWays | None = None
) -> DataFrame:
    """(query_id, id, score) over the undirected simple graph, for all of ``restarts`` (query_id, id, weight, summing to 1 for
    each query) at once, by forward push: a node whose weight not yet given out is above ``residual`` times its degree keeps
    (1 - damping) of it as its score and gives the rest to its neighbours in equal parts. All such nodes of all queries push in
    the same round, and it ends when there is none (or after ``rounds``): no score, to which (1 - damping) of what is held is added,
    is then too low by more than ``residual`` times the degree, and a query touches at most 1 / (residual (1 - damping)) edges
    however large the graph is.

    Nodes of ``restarts`` without an edge are left out, so their weight is lost. What is given to a node by many is summed before
    it is dealt; the driver gets two numbers a round. Each round's table is written, and the one before deleted. ``ways``, if given,
    is the graph already made, whose ``residual`` holds and which keeps what it has read for other calls."""
    own = ways is None
    ways = PushWays(edges, residual) if own else ways
    begin = restarts.groupBy("query_id", "id").agg(F.sum("weight").alias("held")).join(ways.degrees.hint("merge"), "id")
    state = materialise(ways.kept(begin).select("query_id", "id", "degree", F.lit(0.0).alias("score"), "held", F.lit(0).alias("pushed")), "pushed")
    pushes = F.col("held") > ways.residual * F.col("degree")
    for _ in range(rounds):
        some, first = state.filter(pushes).agg(F.count("*"), F.count(F.when(F.col("pushed") == 0, 1))).first()
        if not some:
            break
        if first:  # those that have pushed for this query are known
            new = ways.unknown(state.filter(pushes & (F.col("pushed") == 0)).select("id"))
            if n := new.count():
                ways.read(new, n)
        given = (
            state.filter(pushes)
            .select("query_id", F.col("id").alias("src"), (damping * F.col("held") / F.col("degree")).alias("part"))
            .join(ways.near.hint("merge"), "src")
            .select("query_id", "id", "degree", F.lit(0.0).alias("score"), F.col("part").alias("held"), F.lit(0).alias("pushed"))
        )
        stays = state.select(
            "query_id", "id", "degree", (F.col("score") + F.when(pushes, (1 - damping) * F.col("held")).otherwise(0.0)).alias("score"), F.when(pushes, 0.0).otherwise(F.col("held")).alias("held"),
            F.when(pushes, 1).otherwise(F.col("pushed")).alias("pushed"),
        )
        sums = stays.unionByName(given).groupBy("query_id", "id")
        sums = sums.agg(F.max("degree").alias("degree"), F.sum("score").alias("score"), F.sum("held").alias("held"), F.max("pushed").alias("pushed"))
        before, state = state, materialise(sums, "pushed")
        release(before)
    if own:
        ways.release()
    return state.select("query_id", "id", (F.col("score") + (1 - damping) * F.col("held")).alias("score")).filter("score > 0")


def expanded_contexts(mentions: DataFrame, anchors: DataFrame, context: int, residual: float, damping: float = 0.85, decay: float = 0.9, simple: bool = False) -> DataFrame:
    """(anchor, position, chunk): for each anchor chunk the context of so many chunks that grows from it. In each round the
    entities of the anchor weigh 1, those of chunks taken in round r weigh decay^r (an entity its largest weight); of
    the chunks not taken yet that where the walk from these entities stays most is taken, ties by the least id. Anchors
    without an entity, or for which a round finds no chunk, are left out.

    ``mentions`` has (chunk: long, entity: string); ``simple`` says that no row is there twice. Anchors, their weights and what they
    took are tables; all of them take each round together, and nothing of them reaches the driver but up to MOST_SENT rows
    (anchor, chunk) that it sends on to every task."""
    node = F.concat(F.lit("chunk "), F.col("chunk"))
    edges = mentions.filter("chunk is not null and entity is not null").select(node.alias("src"), F.concat(F.lit("entity "), "entity").alias("dst"))
    ways = PushWays(edges if simple else edges.distinct(), residual, F.col("id").startswith("chunk "), simple=True)
    taken = materialise(anchors.select("anchor", F.lit(0).alias("position"), F.col("anchor").alias("chunk")), "taken")
    few = taken.count() <= MOST_SENT
    weights = None
    for r in range(context - 1):
        last = taken.filter(F.col("position") == r).select("anchor", node.alias("src"))
        now = ways.edges.join(F.broadcast(last) if few else last, "src").select("anchor", F.col("dst").alias("id"), F.lit(decay**r).alias("weight"))
        weights = now if weights is None else weights.unionByName(now)
        weights = materialise(weights.groupBy("anchor", "id").agg(F.max("weight").alias("weight")), "weights")
        total = weights.groupBy("anchor").agg(F.sum("weight").alias("total"))
        restarts = weights.join(total, "anchor").select(F.col("anchor").alias("query_id"), "id", (F.col("weight") / F.col("total")).alias("weight"))
        scores = pushed_pagerank(None, restarts, damping, residual, ways=ways).filter(F.col("id").startswith("chunk "))
        found = scores.select(F.col("query_id").alias("anchor"), F.substring("id", 7, 20).cast("long").alias("chunk"), "score").join(taken, ["anchor", "chunk"], "left_anti")
        best = found.groupBy("anchor").agg(F.max_by("chunk", F.struct(F.round("score", 9), -F.col("chunk"))).alias("chunk"))
        taken = materialise(taken.unionByName(best.select("anchor", F.lit(r + 1).alias("position"), "chunk")), "taken")
    ways.release()
    whole = taken.groupBy("anchor").count().filter(F.col("count") == context)
    return taken.join(whole, "anchor", "left_semi")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, nodes, all_nodes, all_edges) by label, the most frequent first."""
    totals = nodes.agg(F.count("*").alias("all_nodes")).join(edges.agg(F.count("*").alias("all_edges")))
    return nodes.groupBy("label").agg(F.count("*").alias("nodes")).join(F.broadcast(totals)).orderBy(F.desc("nodes"), "label")
