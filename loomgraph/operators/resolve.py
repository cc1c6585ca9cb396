"""Entity resolution: alias seeds, blocked string comparison, context embeddings, canonical names, merge roots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.config import EngineConfig
from loomgraph.frames import apart, stacked
from loomgraph.functions.text import normalize_name
from loomgraph.functions.vectors import cosine, mean_vectors


def alias_decisions(entities: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """duplicate and canonical of entities (name) whose name, or normalised name, is a seed's surface (surface, canonical); by: columns that stay."""
    exact = seeds.select(F.col("surface").alias("name"), F.col("canonical").alias("_exact"))
    loose = seeds.select(F.col("surface").alias("_norm"), F.col("canonical").alias("_loose"))
    rows = entities.withColumn("_norm", normalize_name("name")).join(exact, "name", "left").join(loose, "_norm", "left")
    found = rows.withColumn("canonical", F.coalesce("_exact", "_loose"))
    return found.where(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("name"))).select(*by, F.col("name").alias("duplicate"), "canonical", "ord")


def _pieces(form: Column, threshold: float, distance: int) -> tuple[Column, Column]:
    """Keys by which two forms meet if they are within the gate: those of a form as the shorter one, and as the longer one.

    The longer form allows d edits: distance, or (1 - threshold) of its length. Cut into d + 1 parts, the shorter one then keeps
    one part unchanged in the longer one, at a place that differs by no more than the edits leave. A key is d, the shorter length, the part's
    number and the part itself.
    """
    length = F.length(form)
    edits = lambda n: F.greatest(F.lit(distance), F.floor((1 - threshold) * n + 1e-9)).cast("int")
    cut = lambda n, i, d: F.floor(i * n / (d + 1)).cast("int")
    key = lambda d, n, i, at, size: F.struct(d.alias("d"), n.alias("n"), i.alias("i"), F.substring(form, at + 1, size).alias("s"))
    longest = F.greatest(length + distance, F.floor(length / threshold + 1e-9)).cast("int")
    allowed = F.array_distinct(F.transform(F.sequence(length, longest), edits))
    shorter = F.transform(allowed, lambda d: F.transform(F.sequence(F.lit(0), d), lambda i: key(d, length, i, cut(length, i, d), cut(length, i + 1, d) - cut(length, i, d))))

    def of_length(n: Column) -> Column:
        d, gap = edits(length), length - n

        def of_part(i: Column) -> Column:
            at, size = cut(n, i, d), cut(n, i + 1, d) - cut(n, i, d)
            low = F.greatest(F.lit(0), at - F.floor((d - gap) / 2)).cast("int")
            high = F.least(length - size, at + F.floor((d + gap) / 2)).cast("int")
            return F.transform(F.sequence(low, high), lambda a: key(d, n, i, a, size))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), of_part))

    longer = F.transform(F.sequence(F.greatest(F.lit(0), length - edits(length)), length), of_length)
    return F.flatten(shorter), F.flatten(longer)


#: Forms of a set (by, label) up to which all its pairs are made.
_FEW = 64


def candidates(entities: DataFrame, threshold: float = 0.86, distance: int = 2, by: Sequence[str] = (), equal: bool = True) -> DataFrame:
    """Pairs of one label that pass the string gate: a_name, b_name (a before b by ord), similarity, distance.

    equal: with all pairs of names of one normalised form, whose number is the square of such names; see equal_pairs.

    entities: name, label, ord, mention_count. Names are compared once for each pair of normalised forms, and only where the
    forms share a part that any pair within the gate must share (see _pieces), so no label is compared with itself as a whole.
    by: columns that keep sets of entities apart; only rows that agree in them meet.
    """
    forms = entities.select(*by, "label", normalize_name("name").alias("form")).distinct()
    keys, x, y = [*by, "label"], F.col("form").alias("fx"), F.col("form").alias("fy")
    before = (F.length("fx") < F.length("fy")) | ((F.length("fx") == F.length("fy")) & (F.col("fx") < F.col("fy")))
    few, many = None, forms
    if by:
        # a small set has fewer pairs than its forms have keys
        sized = forms.join(apart(forms.groupBy(*keys).agg(F.count("*").alias("_n"))), keys)
        few, many = sized.where(F.col("_n") <= _FEW), sized.where(F.col("_n") > _FEW)
    shorter, longer = _pieces(F.col("form"), threshold, distance)
    left, right = many.select(*keys, x, F.explode(shorter).alias("key")).distinct(), many.select(*keys, y, F.explode(longer).alias("key")).distinct()
    met = apart(left).join(apart(right), [*keys, "key"]).where((F.length("fx") < F.length("fy")) | (F.col("fx") < F.col("fy"))).select(*keys, "fx", "fy").distinct()
    if few is not None:
        met = stacked(met, apart(few.select(*keys, x)).join(apart(few.select(*keys, y)), keys).where(before))
    pairs = stacked(met, forms.select(*by, "label", F.col("form").alias("fx"), F.col("form").alias("fy"))) if equal else met
    edits = F.levenshtein("fx", "fy")
    similarity = F.when(F.col("fx") == F.col("fy"), F.lit(1.0)).otherwise(1.0 - edits / F.greatest(F.length("fx"), F.length("fy"), F.lit(1)))
    gated = pairs.withColumn("similarity", similarity).withColumn("distance", edits).where((F.col("similarity") >= threshold) | (F.col("distance") <= distance))
    named = entities.withColumn("form", normalize_name("name"))
    side = lambda p, f: named.select(*by, F.col("label"), F.col("form").alias(f), F.col("name").alias(f"{p}_name"), F.col("ord").alias(f"{p}_ord"), F.col("mention_count").alias(f"{p}_count"))
    both = gated.join(apart(side("p", "fx")), [*by, "label", "fx"]).join(apart(side("q", "fy")), [*by, "label", "fy"])
    both = both.where(F.col("p_name") != F.col("q_name")).where((F.col("fx") != F.col("fy")) | (F.col("p_ord") < F.col("q_ord")))
    first = F.col("p_ord") < F.col("q_ord")
    pick = lambda c, yes: F.when(first if yes else ~first, F.col(f"p_{c}")).otherwise(F.col(f"q_{c}"))
    return both.select(*by, "label", *[pick(c, yes).alias(f"{s}_{c}") for s, yes in (("a", True), ("b", False)) for c in ("name", "ord", "count")], "similarity", "distance")


def _in_classes(entities: DataFrame, by: Sequence[str]) -> DataFrame:
    """entities with `form`, those whose normalised form is another name's, too."""
    rows = entities.select(*by, "label", normalize_name("name").alias("form"), "name", "ord", "mention_count")
    several = rows.groupBy(*by, "label", "form").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(apart(several), [*by, "label", "form"], "left_semi")


def equal_pairs(entities: DataFrame, seeds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of the pairs of names with one normalised form, for each name the first one that it loses, as rows of candidates().

    A name loses to an earlier one of no lower rank (seeded, then mentioned more, then shorter), else to a later one of a higher rank. The first
    earlier one stands among the names that outrank all before them: it is the lowest of these that is not below the name itself.
    So each name finds it by two sorts of its class, and no pair is made beyond.
    """
    canonicals = seeds.select(F.col("canonical").alias("name"), F.lit(True).alias("_seeded")).distinct()
    own = _in_classes(entities, by).join(canonicals, "name", "left")
    plain = lambda c: F.when(F.col("_seeded"), F.lit(0).cast("long")).otherwise(c.cast("long"))
    own = own.withColumn("_rank", F.struct(F.col("_seeded").isNull().cast("int").alias("s"), plain(-F.col("mention_count")).alias("n"), plain(F.length("name")).alias("l")))
    keys = [*by, "label", "form"]
    place = Window.partitionBy(*keys)
    before = F.min("_rank").over(place.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_top", before.isNull() | (F.col("_rank") < before))
    own = own.withColumn("_one", F.when(F.col("_top"), F.struct("ord", "name", "mention_count")))
    later = F.last("_one", True).over(place.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1))
    above = F.last("_one", True).over(place.orderBy("_rank", "ord").rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_later", later).withColumn("_above", above).withColumn("_to", F.when(F.col("_top"), F.col("_later")).otherwise(F.col("_above")))
    return _as_pairs(own.where("_to IS NOT NULL"), by, F.struct("ord", "name", "mention_count"), F.col("_to"))


def _as_pairs(rows: DataFrame, by: Sequence[str], x: Column, y: Column) -> DataFrame:
    rows = rows.select(*by, "label", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    side = lambda s: [F.col(f"{s}.name").alias(f"{s}_name"), F.col(f"{s}.ord").alias(f"{s}_ord"), F.col(f"{s}.mention_count").alias(f"{s}_count")]
    return rows.select(*by, "label", *side("a"), *side("b"), F.lit(1.0).alias("similarity"), F.lit(0).alias("distance"))


#: Names that are compared with the names of a class at a time.
_STEP = 256


def equal_pairs_near(entities: DataFrame, seeds: DataFrame, embeddings: DataFrame, cosine_from: float, sure_from: float, by: Sequence[str] = ()) -> DataFrame:
    """equal_pairs() where a pair of names with embeddings (name, embedding) counts only from the cosine cosine_from on.

    Pairs below sure_from may still be refused, so those before the first sure one are given, too. A class of names is one unit
    of work with space in proportion to its names: blocks of names in their order meet those that have lost to none yet.
    """
    canonicals = seeds.select(F.col("canonical").alias("name"), F.lit(True).alias("_seeded")).distinct()
    own = _in_classes(entities, by).join(canonicals, "name", "left").join(embeddings.select("name", "embedding"), "name", "left")
    keys = [*by, "label", "form"]
    # a place instead of ord, which may be of any type
    own = own.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).withColumn("seeded", F.col("_seeded").isNotNull()).withColumn("length", F.length("name"))

    def losses(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        n = table.num_rows
        seeded, counts, lengths = (table.column(c).to_numpy() for c in ("seeded", "mention_count", "length"))
        order = np.lexsort((np.where(seeded, 0, lengths), np.where(seeded, 0, -counts), ~seeded))
        keyed = np.stack([~seeded, np.where(seeded, 0, -counts), np.where(seeded, 0, lengths)], axis=1)[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], (keyed[1:] != keyed[:-1]).any(axis=1))))
        vectors = table.column("embedding").to_pylist()
        size = max((len(v) for v in vectors if v), default=0)
        held = np.zeros((n, size))
        known = np.array([bool(v) for v in vectors])
        for i in np.flatnonzero(known):
            held[i, : len(vectors[i])] = vectors[i]
        norms = np.sqrt((held * held).sum(axis=1))
        held /= np.where(norms == 0, 1.0, norms)[:, None]
        found, waiting = [], np.arange(n)
        for earlier in (True, False):
            for first in range(0, n, _STEP):
                if not len(waiting):
                    break
                block = np.arange(first, min(first + _STEP, n))
                beats = (block[:, None] < waiting) & (rank[block][:, None] <= rank[waiting]) if earlier else (block[:, None] > waiting) & (rank[block][:, None] < rank[waiting])
                score = np.where(known[block][:, None] & known[waiting], held[block] @ held[waiting].T, 2.0)
                # what rounding may decide either way is left to the exact comparison
                passes, sure = beats & (score >= cosine_from - 1e-9), beats & (score >= sure_from + 1e-9)
                stop = np.where(sure.any(axis=0), sure.argmax(axis=0), len(block))
                i, j = np.nonzero(passes & (np.arange(len(block))[:, None] <= stop))
                found.append(np.stack([block[i], waiting[j]], axis=1))
                waiting = waiting[stop == len(block)]
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        x, y = table.take(pa.array(pairs.min(axis=1))), table.take(pa.array(pairs.max(axis=1)))
        sides = {f"{s}_{c}": t.column(c) for s, t in (("a", x), ("b", y)) for c in ("name", "place")}
        return pa.table({k: x.column(k) for k in keys} | sides)

    fields = {f.name: f.dataType for f in own.schema.fields}
    schema = StructType()
    for k in keys:
        schema = schema.add(k, fields[k])
    for s in "ab":
        schema = schema.add(f"{s}_name", "string").add(f"{s}_place", "integer")
    met = own.select(*keys, "name", "place", "mention_count", "seeded", "length", "embedding").groupBy(*keys).applyInArrow(losses, schema).drop("a_place", "b_place")
    side = lambda s: own.select(*keys, F.col("name").alias(f"{s}_name"), F.struct("ord", "name", "mention_count").alias(s))
    rows = met.join(side("a"), [*keys, "a_name"]).join(side("b"), [*keys, "b_name"])
    return _as_pairs(rows, by, F.col("a"), F.col("b"))


def canonical(a_name: Column, b_name: Column, a_count: Column, b_count: Column, a_seeded: Column | None = None, b_seeded: Column | None = None) -> Column:
    """The name that stays: a seed's canonical (by the flags, a first), else the one mentioned more, else the shorter, a first."""
    picked = F.when(a_count > b_count, a_name).when(b_count > a_count, b_name).when(F.length(a_name) <= F.length(b_name), a_name).otherwise(b_name)
    if a_seeded is not None and b_seeded is not None:
        picked = F.when(a_seeded, a_name).when(b_seeded, b_name).otherwise(picked)
    return picked


def context_embeddings(mentions: DataFrame, chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """name and mean embedding of the chunks that mention it; with names (name) only for these, filtered before the join."""
    rows = mentions.select(F.col("entity").alias("name"), F.col("chunk_id").alias("id")).distinct()
    if names is not None:
        rows = rows.join(names.select("name").distinct(), "name", "left_semi")
    return mean_vectors(rows.join(chunks.where("embedding IS NOT NULL").select("id", "embedding"), "id"), "name", "embedding")


def names_to_embed(entities: DataFrame, threshold: float = 0.86, distance: int = 2) -> DataFrame:
    """name of the entities that stand in any pair of candidates()."""
    pairs = candidates(entities, threshold, distance, equal=False)
    return stacked(pairs.select(F.col("a_name").alias("name")), pairs.select(F.col("b_name").alias("name")), _in_classes(entities, ()).select("name")).distinct()


def plan(entities: DataFrame, seeds: DataFrame, embeddings: DataFrame | None = None, config: EngineConfig | None = None, same: Column | Callable[[DataFrame], DataFrame] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Merge decisions: duplicate, canonical, string_score, embed_score, reason, ord; each duplicate once.

    Alias seeds come first, then pairs by place (prefix blocks before label blocks). embeddings: name, embedding; pairs
    without both pass on strings alone. same: what settles pairs in the ambiguous band of the embedding score: a condition over a_name and
    b_name, or a function that gets these pairs, each once, and adds `same`; without it they pass. by: columns that keep sets of entities apart; each set
    is planned as if alone, and its decisions carry them.
    """
    c = (config or EngineConfig()).matching
    alias = alias_decisions(entities, seeds, by).select(*by, "duplicate", "canonical", F.lit(1.0).alias("string_score"), F.lit(None).cast("double").alias("embed_score"), F.lit("alias_seed").alias("reason"), F.struct(F.lit(0).alias("k"), F.col("ord").cast("long").alias("o"), F.lit(0).cast("long").alias("p")).alias("ord"))
    # of the pairs of one form only those that may decide; see equal_pairs
    if embeddings is None:
        alike = equal_pairs(entities, seeds, by)
    else:
        alike = equal_pairs_near(entities, seeds, embeddings, c.cosine - c.band, c.cosine + c.band if same is not None else c.cosine - c.band, by)
    pairs = stacked(candidates(entities, c.similarity, c.edits, by, equal=False), alike)
    if embeddings is None:
        pairs = pairs.withColumn("embed_score", F.lit(None).cast("double"))
    else:
        side = lambda p: embeddings.select(F.col("name").alias(f"{p}_name"), F.col("embedding").alias(f"{p}_v"))
        pairs = pairs.join(side("a"), "a_name", "left").join(side("b"), "b_name", "left").withColumn("embed_score", F.when(F.col("a_v").isNotNull() & F.col("b_v").isNotNull(), cosine("a_v", "b_v")))
    es = F.col("embed_score")
    pairs = pairs.where(es.isNull() | (es >= c.cosine - c.band))
    reason = F.when(es.isNull(), "string").otherwise("string+embed")
    if same is not None:
        band = es.isNotNull() & (F.abs(es - c.cosine) <= c.band)
        if isinstance(same, Column):
            pairs = pairs.where(~band | same)
        else:
            settled = same(_cut(pairs.where(band)))
            pairs = stacked(pairs.where(~band), settled.where("same").drop("same"))
        reason = F.when(band, "llm").otherwise(reason)
    canonicals = seeds.select("canonical").distinct()
    for p in "ab":
        pairs = pairs.join(canonicals.select(F.col("canonical").alias(f"{p}_name"), F.lit(True).alias(f"{p}_seeded")), f"{p}_name", "left")
    keep = canonical(F.col("a_name"), F.col("b_name"), F.col("a_count"), F.col("b_count"), F.col("a_seeded"), F.col("b_seeded"))
    prefix = F.left(normalize_name("a_name"), F.lit(4)) == F.left(normalize_name("b_name"), F.lit(4))
    order = F.struct(F.when(prefix, 1).otherwise(2).alias("k"), F.col("a_ord").cast("long").alias("o"), F.col("b_ord").cast("long").alias("p"))
    fuzzy = pairs.select(*by, F.when(keep == F.col("a_name"), F.col("b_name")).otherwise(F.col("a_name")).alias("duplicate"), keep.alias("canonical"), F.col("similarity").alias("string_score"), "embed_score", reason.alias("reason"), order.alias("ord"))
    rows = stacked(alias, fuzzy).where("duplicate <> canonical")
    return rows.groupBy(*by, "duplicate").agg(F.min_by(F.struct("canonical", "string_score", "embed_score", "reason", "ord"), "ord").alias("d")).select(*by, "duplicate", "d.*")


def merge_roots(decisions: DataFrame) -> DataFrame:
    """duplicate and root: where the chain of canonicals ends, by pointer jumping (the logarithm of the longest chain).

    decisions: duplicate (each once), canonical, ord. In a ring of decisions the last one by ord would merge a name
    with itself; it is left out, so its duplicate is the root.
    """
    base = _cut(decisions.where("duplicate <> canonical").select("duplicate", "canonical", "ord"))
    walk = base.select("duplicate", F.col("canonical").alias("at"), F.col("ord").alias("top"))
    still = 0
    for _ in range(base.count().bit_length() + 1):
        nxt = walk.select(F.col("duplicate").alias("at"), F.col("at").alias("to"), F.col("top").alias("above"))
        walk = _cut(walk.join(apart(nxt), "at", "left").select("duplicate", F.coalesce("to", "at").alias("at"), F.greatest("top", F.coalesce("above", "top")).alias("top")))
        still = walk.select("at").join(apart(base.select(F.col("duplicate").alias("at"))), "at", "left_semi").count()
        if not still:
            break
    if not still:
        return walk.select("duplicate", F.col("at").alias("root"))
    # after so many jumps, names that still move stand on a ring and have seen all of it
    ring = walk.select(F.col("at").alias("duplicate")).distinct().join(base.select("duplicate"), "duplicate", "left_semi").join(walk.select("duplicate", "top"), "duplicate")
    return merge_roots(base.join(ring, "duplicate", "left").where(F.col("top").isNull() | (F.col("ord") != F.col("top"))).select("duplicate", "canonical", "ord"))


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round in the shared folder."""
    from loomgraph.plans.store import checkpointed

    return checkpointed(df)


def clusters(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """name and cluster of every entity: its root, or itself."""
    return entities.join(apart(roots.select(F.col("duplicate").alias("name"), "root")), "name", "left").select("name", F.coalesce("root", "name").alias("cluster"))
