"""Property graphs as DataFrames: entities, mentions, relations; neighbourhoods, aliases, communities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.skew import hot_join
from quillmill.functions.text import entity_key
from quillmill.operators.components import connected_components
from quillmill.operators.parsing import alias_evidence, relation_meaning
from quillmill.session import cut_lineage


def entity_table(names: DataFrame, name: str, kind: str) -> DataFrame:
    """Columns ``id, name, type``: one row per normalised name, the smallest spelling and type of it."""
    n = names.filter(F.trim(name) != "").withColumn("id", entity_key(F.col(name)))
    return n.groupBy("id").agg(F.min_by(F.struct(F.col(name).alias("name"), F.col(kind).alias("type")), F.struct(name, kind)).alias("s")).select("id", "s.*")


def both_ways(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Columns ``src, dst``: each edge in both directions once, self-loops out."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def k_hop(edges: DataFrame, starts: DataFrame, hops: int = 2) -> DataFrame:
    """Columns ``start, node, hops``: nodes within ``hops`` undirected steps of each start with their distance.

    The frontier alone is joined with the edges in each step; nodes reached before are left out by anti-join.
    """
    e = both_ways(edges)
    frontier = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    seen = frontier.withColumn("hops", F.lit(0))
    for h in range(1, hops + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("hops", F.lit(h)))
    return seen


def inverted_index(mentions: DataFrame, key: str, chunk: str) -> DataFrame:
    """Columns ``key, chunk_ids, count``."""
    return mentions.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(chunk)).alias("chunk_ids")).withColumn("count", F.size("chunk_ids"))


def pair_key(a: str, b: str, sep: str = "<SEP>"):
    return F.concat_ws(sep, F.least(a, b), F.greatest(a, b))


def canonical(members: DataFrame, cluster: str, node: str, name: str, weight: str) -> DataFrame:
    """``is_canonical`` added: per cluster the node of most weight, then longest name, then smallest id."""
    best = members.groupBy(cluster).agg(F.min_by(F.col(node), F.struct(-F.col(weight), -F.length(name), F.col(node))).alias("_best"))
    return hot_join(members, best, cluster).withColumn("is_canonical", F.col(node) == F.col("_best")).drop("_best")


def alias_clusters(nodes: DataFrame, same_as: DataFrame, node: str = "id") -> DataFrame:
    """``cluster_id`` added: the component of each node over the alias edges, itself where it has none."""
    comp = connected_components(same_as, "src", "dst")
    return nodes.join(comp.select(F.col("node").alias(node), "component"), node, "left").withColumn("cluster_id", F.coalesce("component", node)).drop("component")


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Columns ``node, community``: synchronous label propagation; the most frequent neighbour label wins, ties by the smaller.

    A deterministic stand-in for a modularity optimiser. A node keeps its label if that is among the most
    frequent. Counts are combined before each shuffle; lineage is cut every round.
    """
    e = cut_lineage(both_ways(edges))
    edges_in = e.count()
    labels = cut_lineage(e.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = hot_join(e, labels.withColumnRenamed("node", "dst"), "dst", total=edges_in).groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min_by("community", F.struct(-F.col("n"), "community")).alias("best"), F.max("n").alias("top"))
        own = votes.select(F.col("src").alias("node"), F.col("community").alias("own"), F.col("n").alias("own_n"))
        nxt = labels.join(best, labels["node"] == best["src"]).join(own.withColumnRenamed("own", "community"), ["node", "community"], "left")
        nxt = nxt.select("node", F.when(F.col("own_n") == F.col("top"), F.col("community")).otherwise(F.col("best")).alias("community"), (F.coalesce(F.col("own_n") != F.col("top"), F.lit(True)) & (F.col("best") != F.col("community"))).alias("moved"))
        nxt = cut_lineage(nxt)
        labels = nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            break
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row ``modularity`` of a labelling."""
    e = both_ways(edges)
    a = labels.select(F.col("node").alias("src"), F.col("community").alias("cs"))
    b = labels.select(F.col("node").alias("dst"), F.col("community").alias("cd"))
    x = e.join(a, "src").join(b, "dst")
    inside = x.filter("cs = cd").groupBy("cs").agg(F.count("*").alias("inn"))
    degree = x.groupBy("cs").agg(F.count("*").alias("deg"))
    total = degree.agg(F.sum("deg").alias("m2"))
    return degree.join(inside, "cs", "left").crossJoin(F.broadcast(total)).agg(F.round(F.sum(F.coalesce("inn", F.lit(0)) / F.col("m2") - (F.col("deg") / F.col("m2")) ** 2), 6).alias("modularity"))


def shared_token_pairs(names: DataFrame, node: str, name: str, kind: str) -> DataFrame:
    """Columns ``a, b, shared, name_a, name_b``: nodes of one type whose names share a word, a before b.

    Blocking by word instead of comparing all names of a type.
    """
    t = names.select(node, name, kind, F.explode(F.array_distinct(F.split(F.lower(name), r"\s+"))).alias("_t"))
    l = t.select(F.col(node).alias("a"), F.col(name).alias("name_a"), kind, "_t")
    r = t.select(F.col(node).alias("b"), F.col(name).alias("name_b"), kind, "_t")
    return l.join(r, ["_t", kind]).filter("a < b").groupBy("a", "b", "name_a", "name_b").agg(F.count("*").alias("shared"))


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two names."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def with_ratio(pairs: DataFrame, a: str, b: str, out: str = "ratio") -> DataFrame:
    """Name similarity of the pairs in Arrow batches; no built-in computes this measure."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [ratio(x.lower(), y.lower()) if x is not None and y is not None else None for x, y in zip(pdf[a], pdf[b])]})

    return pairs.mapInPandas(run, f"{fields}, `{out}` double")


def close_matches(queries: DataFrame, query: str, names: DataFrame, name: str, cutoff: float = 0.8) -> DataFrame:
    """Columns ``query, match, ratio``: the closest name by similarity from ``cutoff`` on, else the query itself.

    A similarity of r takes 2·m/(n₁+n₂) ≥ r for m letters that match in m or fewer runs, so at most (2/r − 2)·m letters of both are left
    over, they part the matched ones into no more than that many runs and one more, and one run has a letter share of the names that
    is known from the length: both names have that run in common. Names are joined on runs of that length, chosen for each
    query and length of name; no pair that reaches the cutoff is lost. Case is set aside, as in the comparison.
    """
    q = queries.select(F.col(query).alias("query")).distinct()
    n = names.select(F.col(name).alias("match")).distinct()

    def least_run(total: Column) -> Column:
        matched = F.ceil(F.lit(cutoff) * total / 2 - F.lit(1e-9))
        return F.greatest(F.lit(1), F.ceil(matched / (total - 2 * matched + 1))).cast("int")

    def runs_of(c: Column, size: Column) -> Column:
        low = F.lower(c)
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - size + 1, F.lit(1))), lambda i: F.substr(low, i, size)))

    lengths = n.select(F.length("match").alias("m")).distinct()
    shortest = F.ceil(F.col("k") * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-9))
    longest = F.floor(F.col("k") * F.lit((2 - cutoff) / cutoff) + F.lit(1e-9))
    spans = q.select(F.length("query").alias("k")).distinct().join(F.broadcast(lengths), F.col("m").between(shortest, longest))
    spans = spans.withColumn("size", least_run(F.col("k") + F.col("m")))  # pairs of lengths, not of names
    qg = q.withColumn("k", F.length("query")).join(F.broadcast(spans), "k").select("query", "m", F.explode(runs_of(F.col("query"), F.col("size"))).alias("g"))
    ng = n.withColumn("m", F.length("match")).join(F.broadcast(spans.select("m", "size").distinct()), "m").select("match", "m", F.explode(runs_of(F.col("match"), F.col("size"))).alias("g"))
    cand = qg.join(ng, ["m", "g"]).select("query", "match").distinct()
    scored = with_ratio(cand, "query", "match").filter(F.col("ratio") >= cutoff)
    best = scored.groupBy("query").agg(F.max_by(F.struct("match", "ratio"), F.struct("ratio", "match")).alias("s"))
    return q.join(best, "query", "left").select("query", F.coalesce("s.match", "query").alias("match"), F.coalesce(F.round("s.ratio", 6), F.lit(0.0)).alias("ratio"))


def local_search(names: DataFrame, entities: DataFrame, edges: DataFrame, mentions: DataFrame, hops: int = 2, limit: int = 5) -> DataFrame:
    """Columns ``question, chunk_id, place``: name, its alias cluster, their neighbourhood, the first chunks that mention it.

    ``names`` has (question, name), ``entities`` (id, name, cluster_id), ``mentions`` (id, chunk_id). All questions
    run as one plan; chunks are ordered by distance, then id.
    """
    hit = names.join(entities, F.lower(names["name"]) == F.lower(entities["name"])).select("question", "cluster_id")
    start = hit.join(entities, "cluster_id").select("question", F.col("id").alias("start")).distinct()
    near = k_hop(edges, start.select("start").distinct(), hops)
    found = start.join(near, "start").join(mentions, near["node"] == mentions["id"]).groupBy("question", "chunk_id").agg(F.min("hops").alias("h"))
    w = Window.partitionBy("question").orderBy("h", "chunk_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).select("question", "chunk_id", "place")


def merge_groups(summaries: DataFrame, groups: DataFrame) -> DataFrame:
    """Columns ``community_id, members, summary``: communities named in one group become one, ids and summaries joined in order.

    ``summaries`` has (community_id, entities, summary), ``groups`` (group) of ids; a community in no group stays.
    """
    g = groups.withColumn("new_id", F.array_join(F.array_sort("group"), "_")).select("new_id", F.explode("group").alias("community_id"))
    x = summaries.join(g, "community_id", "left").withColumn("new_id", F.coalesce("new_id", "community_id"))
    ordered = F.array_sort(F.collect_list(F.struct("community_id", "summary")))
    return x.groupBy(F.col("new_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities")))).alias("members"), F.array_join(F.transform(ordered, lambda s: s["summary"]), "\n").alias("summary")).withColumnRenamed("new_id", "community_id")


def described(items: DataFrame, key: str, texts: DataFrame, text_key: str, text: str, fallback: str = "") -> DataFrame:
    """``text`` joined by cleaned key, then by raw key, then a default."""
    clean = lambda c: F.regexp_replace(F.trim(c), r'^"+|"+$', "")
    t = texts.groupBy(F.col(text_key).alias("_k")).agg(F.min(text).alias("_t"))
    x = items.join(t.select(F.col("_k").alias("_k1"), F.col("_t").alias("_t1")), clean(F.col(key)) == F.col("_k1"), "left")
    x = x.join(t.select(F.col("_k").alias("_k2"), F.col("_t").alias("_t2")), F.col(key) == F.col("_k2"), "left")
    return x.withColumn(text, F.coalesce("_t1", "_t2", F.lit(fallback))).drop("_k1", "_k2", "_t1", "_t2")


def relations_between(pairs: DataFrame, edges: DataFrame, left_out: tuple[str, ...] = ("SAME_AS", "MENTIONED_IN")) -> DataFrame:
    """Columns ``a, b, kind``: the relation types that stand between the two nodes of each pair, in either direction."""
    e = edges.filter(~F.col("kind").isin(*left_out)).select(F.least("src", "dst").alias("_lo"), F.greatest("src", "dst").alias("_hi"), "kind").distinct()
    p = pairs.select("a", "b", F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi"))
    return p.join(e, ["_lo", "_hi"]).select("a", "b", "kind").distinct()


def resolve_safely(candidates: DataFrame, texts: DataFrame, edges: DataFrame) -> DataFrame:
    """Columns ``a, match, method``: each pending node with the first candidate that is surely the same, null and ``keep`` where none is.

    ``candidates`` has (a, b, rk, name_a, name_b), ``texts`` (id, text) of the chunks that mention a node, ``edges`` (src, dst, kind).
    A candidate matches by a text of either node that names both as one; only nodes without such a match are matched
    by a relation that says so, where no relation of the pair speaks against it. Nodes are matched against the nodes as they
    were, all at once.
    """
    t = texts.select("id", "text").filter("text IS NOT NULL")
    a = candidates.join(t, F.col("a") == F.col("id")).select("a", "b", "rk", "name_a", "name_b", "text")
    b = candidates.join(t, F.col("b") == F.col("id")).select("a", "b", "rk", "name_a", "name_b", "text")
    told = a.unionByName(b).filter(alias_evidence(F.col("name_a"), F.col("name_b"), F.col("text")) != "")
    first = lambda df, n: df.groupBy("a").agg(F.min_by("b", F.struct("rk", "b")).alias(n))
    meaning = relations_between(candidates, edges).withColumn("m", relation_meaning(F.col("kind"))).groupBy("a", "b").agg(F.max(F.col("m") == "NEGATIVE").alias("no"), F.max(F.col("m") == "POSITIVE").alias("yes"))
    related = candidates.join(meaning.filter("yes AND NOT no"), ["a", "b"])
    out = candidates.select("a").distinct().join(first(told, "t"), "a", "left").join(first(related, "r"), "a", "left")
    method = F.when(F.col("t").isNotNull(), "regex").when(F.col("r").isNotNull(), "relation_positive").otherwise("keep")
    return out.select("a", F.coalesce("t", "r").alias("match"), method.alias("method"))


def confidence_needed(cluster_size: Column) -> Column:
    """Confidence a model's match needs, by the size of the cluster it would join."""
    return F.when(cluster_size <= 2, 0.70).when(cluster_size <= 4, 0.85).otherwise(0.95)


def resolve_with_model(safe: DataFrame, answers: DataFrame, clusters: DataFrame, most: int = 8) -> DataFrame:
    """Columns ``a, match, method``: what ``resolve_safely`` kept apart is matched by a model's answer that is sure enough.

    ``answers`` has (a, b, confidence), one row per node asked about, ``clusters`` (id, size). A cluster of ``most`` nodes takes no more.
    """
    x = safe.join(answers.select("a", F.col("b").alias("_b"), "confidence"), "a", "left").join(clusters.select(F.col("id").alias("_b"), "size"), "_b", "left")
    size = F.coalesce("size", F.lit(1))
    sure = (F.col("method") == "keep") & F.col("_b").isNotNull() & (F.col("confidence") >= confidence_needed(size)) & (size < most)
    sure = F.coalesce(sure, F.lit(False))
    doubt = (F.col("method") == "keep") & F.col("_b").isNotNull()
    return x.select("a", F.when(sure, F.col("_b")).otherwise(F.col("match")).alias("match"), F.when(sure, "llm").when(doubt, "below_threshold_or_cluster_full").otherwise(F.col("method")).alias("method"))


def pending(nodes: DataFrame, skipped: list[str]) -> DataFrame:
    """Canonical nodes that no resolution has looked at yet, without those of the skipped types."""
    return nodes.filter(F.col("is_canonical") & F.col("resolved").isNull() & ~F.coalesce(F.col("type").isin(*skipped), F.lit(False)))


def without_relations(edges: DataFrame, kind: str | None) -> DataFrame:
    """Edges without those of a type; none at all for None."""
    return edges.filter("false") if kind is None else edges.filter(~F.col("kind").eqNullSafe(F.lit(kind)))


def summary_blocks(summaries: DataFrame) -> DataFrame:
    """Columns ``community_id, block``: a community's part of the context of a global search; the parts are read in order of id."""
    head = F.concat(F.lit("[Nhóm "), F.col("community_id").cast("string"), F.lit("] (gồm: "), F.array_join("entities", ", "), F.lit(")\n"))
    return summaries.select("community_id", F.concat(head, F.col("summary")).alias("block"))


def edge_texts(items: DataFrame, edges: DataFrame) -> DataFrame:
    """``description`` of vector items (src, tgt, description) filled in from edges (src, tgt, description): by the pair, then by the pair without quotes, else empty; ``text`` to embed added."""
    bare = lambda c: F.regexp_replace(c, r'^"+|"+$', "")
    raw = edges.select(F.col("src").alias("_s"), F.col("tgt").alias("_t"), F.col("description").alias("_d"))
    known = raw.unionByName(raw.select(bare(F.col("_s")).alias("_s"), bare(F.col("_t")).alias("_t"), "_d")).groupBy("_s", "_t").agg(F.min("_d").alias("_d"))
    one, two = known.select("_s", "_t", F.col("_d").alias("_d1")), known.select(F.col("_s").alias("_s2"), F.col("_t").alias("_t2"), F.col("_d").alias("_d2"))
    x = items.join(one, (F.col("src") == F.col("_s")) & (F.col("tgt") == F.col("_t")), "left").join(two, (bare(F.col("src")) == F.col("_s2")) & (bare(F.col("tgt")) == F.col("_t2")), "left")
    found = F.coalesce(F.nullif("description", F.lit("")), "_d1", "_d2", F.lit(""))
    x = x.withColumn("description", found).drop("_s", "_t", "_d1", "_s2", "_t2", "_d2")
    pair = F.concat("src", F.lit(" -> "), "tgt")
    return x.withColumn("text", F.concat(F.lit("search_document: "), F.trim(F.when(F.col("description") != "", F.concat(pair, F.lit(": "), "description")).otherwise(pair))))
