"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of distinct five-word shingles; two are linked where 100 * intersection >= 75 * union.

1. Equal sets are one class at once, by a 128-bit digest of the set; only one document of each class goes on. A class
   has a number of its own (node), in the order of its smallest doc_id, so a doc_id may stand on several texts.
2. Signatures of 96 minima are cut into 32 bands of 3; documents that agree in a band share a bucket. A pair
   at similarity 0.75 shares no bucket with probability (1 - 0.75**3)**32 = 2.4e-8.
3. Each bucket first proposes its members against its smallest one, never all pairs. A proposal is compared
   signature batch by signature batch; it is pruned as soon as the posterior probability of a similarity of 0.75 or
   more, with the uniform prior, falls below `miss`. What survives is verified on the full sets.
4. Verified links are joined to components. A pair inside a component needs no look any more. Of the documents in buckets
   that still hold several components, only those can have a link to another one that share a rare shingle with it:
   shingles of one component only come first, then the others by rising frequency, and of two linked sets the smaller
   has a shared shingle among its first 1/7, the other the same one among its first 1/4. Documents are put together
   by such shingles; texts that have only a common passage are out here, so this step grows with the input.
   A group is looked at in blocks of bounded size: inside a block the documents outside the group's most frequent component
   meet all others: again signature batches first, then full sets. A block gives only the
   links that join components, never its pairs, and no link between different components is lost to the star of step 3.
   What a block compares are pairs, and a document goes to each block it meets, so time and rows grow by the square of the
   documents of one group that lie outside its frequent component, once these fill several blocks: of sets that agree in about
   6/7 of their shingles or hang together by such sets, and are yet in different components after step 3.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.llm.common import Sieve, batches, files_for, grouped, in_small_batches, looked_up, materialize, release, slices, text_of, trim, utf8
from loomgraph.llm.words import mix, shingles, word_hashes

WIDTH, THRESHOLD = 5, 0.75
BANDS, ROWS = 32, 3
HASHES = BANDS * ROWS
STEPS = (16, 32, 64, HASHES)
#: A block holds at most so many documents and about so many shingles.
BLOCK, BLOCK_SHINGLES = 512, 1 << 22
_random = np.random.Generator(np.random.PCG64(97))
_A = _random.integers(1, 2**64, HASHES, np.uint64, endpoint=False) | np.uint64(1)
_B = _random.integers(0, 2**64, HASHES, np.uint64, endpoint=False)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 96 minima of each non-empty set; empty sets have rows of zeros."""
    out = np.zeros((len(offsets) - 1, HASHES), np.uint32)
    sizes = np.diff(offsets)
    docs = np.flatnonzero(sizes)
    first = 0
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(offsets[docs], offsets[docs[first]] + (1 << 15), "right")) - 1)
        last = min(max(last, first + 1), len(docs))
        own = docs[first:last]
        x = values[offsets[own[0]] : offsets[own[-1] + 1]]
        starts = offsets[own] - offsets[own[0]]
        h = np.empty_like(x)
        for k in range(HASHES):
            np.multiply(x, _A[k], out=h)
            np.add(h, _B[k], out=h)
            out[own, k] = np.minimum.reduceat(h, starts) >> np.uint64(32)
        first = last
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each band of each row; bands never share keys but by chance."""
    s = signature.astype(np.uint64).reshape(len(signature), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        h = mix(h ^ s[:, :, k]) + np.uint64(0x632BE59BD9B4E019)
    return h.view(np.int64)


def least_matches(miss: float) -> list[int]:
    """For each step of STEPS, the fewest equal minima with which a pair may go on.

    With a uniform prior, the posterior of the similarity after m of n matches is Beta(m + 1, n - m + 1), and its
    mass from THRESHOLD on is the probability that a binomial of n + 1 trials at THRESHOLD is at most m.
    """
    found = []
    for n in STEPS:
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
        found.append(m)
    return found


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of row pairs of signatures, those that no step prunes: their places and their matches."""
    at, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, few in zip(STEPS, least, strict=True):
        matches = matches + (a[at, done:n] == b[at, done:n]).sum(axis=1)
        keep = matches >= few
        at, matches, done = at[keep], matches[keep], n
    return at, matches


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity, on all their shingles."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 4 * len(small) < 3 * len(large):
        return False
    at = np.searchsorted(large, small)
    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _digests(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """high and low: the 128-bit digest of each set, zeros for empty ones."""
    sums = np.zeros((2, len(offsets) - 1), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for row, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47), strict=True):
            row[full] = np.add.reduceat(mix(values ^ np.uint64(salt)), offsets[full])
    return [pa.array(row.view(np.int64)) for row in sums]


def _digest(text: Column) -> Column:
    """A struct of the digest high and low of the text's set."""

    @F.arrow_udf("high long, low long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_digests(*_sets(pa.table({"text": texts}))), ["high", "low"])

    return run(text)


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return shingles(*word_hashes(*utf8(table.column("text"))), WIDTH)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest and its signature."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches(rows, "text", 4 << 20):
            values, offsets = _sets(table)
            n = np.diff(offsets)
            digests = _digests(values, offsets)
            signed = signatures(values, offsets)
            stored = [signed[i].tobytes() if n[i] else None for i in range(len(n))]
            columns = [table.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), *digests, pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "high", "low", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, signature binary")


def _banded(signed: DataFrame) -> DataFrame:
    """One row for each band of each document: bucket and doc."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                keys = band_keys(_matrix(batch.column("signature")))
                docs = np.repeat(batch.column("doc").to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(docs)], ["bucket", "doc"])

    return signed.select("doc", "signature").mapInArrow(run, "bucket long, doc long")


def _matrix(column: pa.Array) -> np.ndarray:
    return utf8(column)[0].view(np.uint32).reshape(len(column), HASHES)


def _verified(pairs: DataFrame, signed: DataFrame, sets: DataFrame, miss: float) -> DataFrame:
    """The pairs (a, b) that are links: first by signature, then by full sets."""
    least = least_matches(miss)

    def prune(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if batch.num_rows:
                at, _ = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), least)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at))], ["a", "b"])

    def confirm(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            (x, xs), (y, ys) = utf8(batch.column("va")), utf8(batch.column("vb"))
            keep = [linked(x[xs[i] : xs[i + 1]].view(np.uint64), y[ys[i] : ys[i + 1]].view(np.uint64)) for i in range(batch.num_rows)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    def both(pairs: DataFrame, table: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
        for side, name in zip("ab", names, strict=True):
            pairs = pairs.join(table.select(F.col("doc").alias(side), F.col(value).alias(name)), side)
        return pairs.select("a", "b", *names)

    pruned = both(pairs, signed, "signature", ("sa", "sb")).mapInArrow(prune, "a long, b long")
    return both(pruned, sets, "shingles", ("va", "vb")).mapInArrow(confirm, "a long, b long")


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """node and root (the smallest node reachable) of every node of the links (a, b), by large and small stars.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones; rounds go on
    until nothing changes (about the logarithm of the longest chain). Each round is a written table.
    """
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).alias("mark")
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", files)
    seen = edges.agg(mark).first()["mark"]
    while seen["n"]:
        sides = stacked(edges, edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, edges = edges, materialize(stacked(small, low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", files)
        now = edges.agg(mark).first()["mark"]
        release(old)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


class Roots:
    """Components inside a block: union-find over places."""

    def __init__(self, roots: np.ndarray):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(r, i) for i, r in enumerate(roots.tolist())]

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[j] = i
        return i != j


def _joins(group: pa.Table, least: list[int]) -> list[tuple[int, int]]:
    """Links of a block that join components: rows of the first part (own = x) against the second, or after them if it is one."""
    docs, own, n = (group.column(c).to_numpy() for c in ("doc", "own", "n_shingles"))
    x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
    roots = Roots(group.column("root").to_numpy())
    signs = _matrix(group.column("signature").combine_chunks())
    raw, at = utf8(group.column("shingles"))
    values, number = np.unique(raw.view(np.uint64), return_inverse=True)
    at = at // 8
    marked = np.zeros(len(values), bool)
    out = []
    places = np.arange(len(docs))
    for i in np.flatnonzero(own == x):
        to = places[i + 1 :] if x == y else np.flatnonzero(own == y)
        to = to[4 * np.minimum(n[to], n[i]) >= 3 * np.maximum(n[to], n[i])]
        to = np.array([j for j in to.tolist() if roots.find(j) != roots.find(i)], np.int64)
        if not len(to):
            continue
        to = to[survivors(np.broadcast_to(signs[i], (len(to), HASHES)), signs[to], least)[0]]
        marked[number[at[i] : at[i + 1]]] = True
        for j in to.tolist():
            if roots.find(j) != roots.find(i):
                both = int(marked[number[at[j] : at[j + 1]]].sum())
                if 100 * both >= 75 * (int(n[i]) + int(n[j]) - both) and roots.join(i, j):
                    out.append((int(docs[i]), int(docs[j])))
        marked[number[at[i] : at[i + 1]]] = False
    return out


def _rare(rows: DataFrame, files: int) -> DataFrame:
    """group and doc of the documents that may have a link to another component: prefix filtering on all shingles.

    rows: doc, root, n_shingles, shingles. Linked sets of n and m >= n shingles share at least 6/7 of n and 3/4 of m. So
    in any one order of the shingles the first one they share is among the first n/7 + 1 and m/4 + 1 of the two.
    """

    def spell(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(found, 100):
            values, at = utf8(batch.column("shingles"))
            times = np.diff(at) // 8
            columns = [np.repeat(batch.column(c).to_numpy(), times) for c in ("doc", "root", "n_shingles")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (values.view(np.int64), *columns)], ["shingle", "doc", "root", "n"])

    grams = rows.select("doc", "root", "n_shingles", "shingles").mapInArrow(spell, "shingle long, doc long, root long, n long")
    several = F.min("root") != F.max("root")
    crossing = grams.groupBy("shingle").agg(F.count("*").alias("docs"), several.alias("several")).where("several").select("shingle", "docs")
    crossing = materialize(crossing, "crossing", files)
    own = Window.partitionBy("doc")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("docs", "shingle")) - 1
    ranked = looked_up(grams, crossing, "shingle").withColumn("place", place).where(F.col("place") <= F.floor(F.col("n") / 4))
    ranked = materialize(ranked.select("shingle", "doc", "root", (F.col("place") <= F.floor(F.col("n") / 7)).alias("early")), "ranked", files)
    stars = ranked.groupBy("shingle").agg(F.min("doc").alias("centre"), several.alias("several"), F.bool_or("early").alias("early"))
    stars = materialize(stars.where("several AND early").select("shingle", "centre"), "centres", files)
    groups = components(looked_up(ranked, stars, "shingle").where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")), files)
    release(crossing, ranked, stars)
    return stacked(groups.select(F.col("root").alias("group"), F.col("node").alias("doc")), groups.select(F.col("root").alias("group"), F.col("root").alias("doc")).distinct())


def _dealt(members: DataFrame, roots: DataFrame, signed: DataFrame, sets: DataFrame, files: int) -> DataFrame:
    """The documents to be compared, once for each block (group, x, y) they go to.

    top is the most frequent component of a group (the smallest of those); documents of top itself, which are linked
    already, have blocks of their own, and two of these never meet.
    """
    known = members.join(roots.withColumnRenamed("node", "doc"), "doc", "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"))
    mixed = known.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("bucket")
    mixed = materialize(mixed, "mixed", files)
    rows = looked_up(known, mixed, "bucket").select("doc", "root").distinct()
    rows = materialize(rows.join(signed.select("doc", "n_shingles"), "doc").join(sets, "doc"), "open", files)
    kept = materialize(rows.drop("shingles").join(_rare(rows, files), "doc"), "kept", files)
    held = kept.groupBy("group", "root").agg(F.count("*").alias("n"))
    tops = held.groupBy("group").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("top"), F.count("*").alias("roots")).where("roots > 1")
    kept = looked_up(kept, materialize(tops.select("group", "top"), "tops", files), "group")
    is_top = F.col("root") == F.col("top")

    def blocks(which: Column) -> Column:
        count, size = F.count_if(which), F.coalesce(F.sum(F.when(which, F.col("n_shingles"))), F.lit(0))
        return F.greatest(F.lit(1), F.ceil(count / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    sizes = materialize(kept.groupBy("group").agg(blocks(is_top).alias("n_top"), blocks(~is_top).alias("n_rest")), "sizes", files)
    lot = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    kept = looked_up(kept, sizes, "group").withColumn("own", F.when(is_top, F.col("n_rest") + lot("n_top")).otherwise(lot("n_rest")))
    last = F.when(is_top, F.col("n_rest") - 1).otherwise(F.col("n_rest") + F.col("n_top") - 1)
    kept = kept.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    kept = kept.select("group", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc", "root")
    kept = kept.join(signed, "doc").join(sets, "doc")
    return kept.repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "doc")


def _open_links(dealt: DataFrame, miss: float) -> DataFrame:
    """Links a, b between components that _dealt puts into one block."""
    least = least_matches(miss)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(found, ("group", "x", "y")):
            out = _joins(group, least)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])
        trim()

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs, over whole texts.

    Null and empty texts and texts of white space have no shingles and are linked with nothing; with fewer than five
    words the whole sequence is the one shingle. component_id is the smallest doc_id reachable over links, the
    row's own included; kept says that they are equal. Repeated rows are one class; rows that repeat a doc_id with another
    text are each compared, and the links of all of them hold for that id. A null doc_id is not compared: component_id is null, kept true. Other
    columns are not read; an empty table gives an empty result. miss: the posterior probability below which a
    candidate is pruned.
    """
    return _labels(docs, miss).select("doc_id", "n_shingles", "component_id", F.equal_null("doc_id", "component_id").alias("kept"))


def _labels(docs: DataFrame, miss: float) -> DataFrame:
    """doc_id, n_shingles, the digest high and low, root, owner and component_id of every row of docs.

    root numbers the component of the row's own text, and owner is that component's smallest doc_id; both are null
    without shingles or doc_id. component_id is the smallest doc_id where the rows of one doc_id count as linked.
    """
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    files = files_for(docs)
    rows = materialize(_signed(texts), "signed", files)
    usable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    least = usable.groupBy("high", "low").agg(F.min("doc_id").alias("first"))
    # numbers rise over the ranges: the smallest node of a component has its smallest doc_id
    least = least.repartitionByRange("first", "high", "low").sortWithinPartitions("first", "high", "low")
    classes = materialize(least.withColumn("node", F.monotonically_increasing_id()), "classes", files)
    signed = usable.withColumnRenamed("doc_id", "first").join(classes, ["high", "low", "first"]).select(F.col("node").alias("doc"), "n_shingles", "signature")
    signed = materialize(signed.dropDuplicates(["doc"]), "representatives", files)
    banded = _banded(signed)
    shared = banded.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).where("centre <> last").select("bucket", "centre")
    shared = materialize(shared, "shared", files)
    members = materialize(looked_up(banded, shared, "bucket"), "members", files)
    release(shared)
    candidates = materialize(members.select(F.col("doc").alias("node")).distinct().join(classes, "node"), "candidates", files)
    passes = Sieve(candidates, "first").test()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches((b.filter(passes(b.column("place"))) for b in found), "text", 4 << 20):
            values, offsets = _sets(table)
            digests = _digests(values, offsets)
            stored = [values[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [table.column("doc_id").combine_chunks(), *digests, pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["first", "high", "low", "shingles"])

    # the sieve spares a shuffle of all texts; what it lets through is joined exactly. One Python worker does both
    wanted = texts.where("doc_id IS NOT NULL").withColumn("place", Sieve.place("doc_id")).mapInArrow(run, "first long, high long, low long, shingles binary")
    sets = wanted.join(candidates, ["first", "high", "low"]).select(F.col("node").alias("doc"), "shingles")
    sets = materialize(sets.dropDuplicates(["doc"]), "sets", files)

    stars = members.where("doc <> centre").select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct()
    links = materialize(_verified(stars, signed, sets, miss), "links", files)
    roots = components(links, files)
    more = materialize(_open_links(_dealt(members, roots, signed, sets, files), miss), "links", files)
    if more.take(1):
        roots = components(stacked(links, more), files)
    release(members, candidates, signed, sets, links, more)
    return _labelled(rows, classes, roots, files)


def _labelled(rows: DataFrame, classes: DataFrame, roots: DataFrame, files: int) -> DataFrame:
    owners = roots.join(classes.select(F.col("node").alias("root"), F.col("first").alias("owner")), "root").select("node", "root", "owner")
    named = rows.select("doc_id", "n_shingles", "high", "low").join(classes, ["high", "low"], "left").join(owners, "node", "left")
    usable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    root, owner = (F.when(usable, F.coalesce(a, b)) for a, b in (("root", "node"), ("owner", "first")))
    named = named.select("doc_id", "n_shingles", "high", "low", root.alias("root"), owner.alias("owner"), F.coalesce(owner, "doc_id").alias("component_id"))
    digests = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("high", "low")])
    several = materialize(digests.where("min_high <> max_high OR min_low <> max_low").select("doc_id"), "several", files)
    if not several.take(1):
        return named
    # all components with one owner hold that doc_id, so owners stand for them
    ties = named.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    tied = components(ties, files).select(F.col("node").alias("component_id"), F.col("root").alias("tie"))
    return named.join(tied, "component_id", "left").withColumn("component_id", F.coalesce("tie", "component_id")).drop("tie")


def deduplicated(docs: DataFrame, miss: float = 1e-6) -> DataFrame:
    """One row of docs of each group of equal or linked texts, under the group's smallest doc_id; all columns stay.

    Rows of one doc_id whose texts are neither equal nor linked all stay, and so do rows with a null doc_id. A doc_id's
    rows without shingles count as equal; of rows with equal shingles the one with the smallest hash of all its columns stays, whatever
    their order. Very long texts are read whole; extra columns stay, whatever their names; an empty table gives an empty one.
    """
    files = files_for(docs)
    labels = materialize(_labels(docs, miss), "labels", files).where("doc_id IS NOT NULL")
    counted = labels.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("owner") != F.col("doc_id")).alias("gone"))
    odd = materialize(counted.where("n > 1 OR gone").select("doc_id", (F.col("n") > 1).alias("again")), "odd", files)
    # rows that the sieve does not know stay where they are; the others are joined exactly
    known = Sieve(odd, "doc_id").passes("doc_id")
    row = F.struct("*").alias("row")
    doubtful = docs.where(known).select("doc_id", row).join(odd, "doc_id", "left")
    alone = doubtful.where("again IS NULL").select("row.*")
    # of a doc_id on several rows each text is judged by itself
    kept = labels.where("owner IS NULL OR owner = doc_id").join(odd.where("again"), "doc_id", "left_semi").groupBy("doc_id", "root").agg(F.min(F.struct("high", "low")).alias("d")).select("doc_id", "d.*")
    repeated = doubtful.where("again").withColumn("d", _digest(text_of(F.col("row")["text"]))).select("doc_id", "d.high", "d.low", "row")
    repeated = repeated.join(kept, ["doc_id", "high", "low"]).groupBy("doc_id", "high", "low").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return stacked(docs.where(~known), alone, repeated)
