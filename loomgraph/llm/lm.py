"""Deleted interpolation: a bigram model whose estimates are mixed by buckets of context frequency.

  P(w | h) = k2[b] * c(h w) / c(h) + k1[b] * c(w) / N + k0[b] / (V + 1),   b = the bucket of c(h)

The counts are those of the training texts. The weights of each bucket are learned by expectation-maximisation on counts
held out of the training texts: a tenth of them is set aside, the estimates come from the rest, and all tokens
of the tenth count. These enter as a histogram over (bucket, P2, P1) on a logarithmic grid of fixed size,
so the data are read once however many rounds the maximisation takes.

Counting and look-up run as messages between batches of text and ranges of hashed keys. A batch of documents is
reduced to its distinct words and bigrams before anything moves; each distinct key goes once towards the range that
owns it, the range adds up the counts of all batches, and answers each batch in the batch's own order. So a
very common word costs one key for each batch, and no range and no task gets more than its even share of hashes.

Messages do not go to all ranges at once. A sender cuts its keys into 2**fan_bits parts; the parts of 2**fan_bits
senders that hold the same leading bits meet in a node, which merges them and is a sender of the next level, until
one node holds each range. So there are 2**fan_bits messages for each batch and level, of about one size at any
input, and the levels follow its logarithm (one up to 256 batches, which are 1.5 GB of text, two up to 400 GB, three up to 100 TB).
Answers go back by the same way. Batches and nodes are numbered without gaps, so tasks get even numbers of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.frames import stacked
from loomgraph.llm.common import batches, fold_of, grouped, in_small_batches, materialize, numbered, partitions_for, release, slices, text_of, trim, utf8
from loomgraph.llm.words import hash_of, mix, word_hashes

#: The symbol at the end of a text, which no word equals, as none holds a space; it is also the context of a first word.
END = np.uint64(hash_of("end of text"))
#: Bits of a bigram's hash that a message carries beside the leading bits of its range.
KEPT = 40
GRID, FLOOR, BUCKETS = 10, -12.0, 32
RETAINED, DELETED, OUTSIDE = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes."""
    values = values.astype("<u8")
    used = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([used]) + zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[:used]).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return out.reshape(-1).view("<i8").astype(np.int64)


def pack_keys(keys: np.ndarray, bits: int, kept: int) -> bytes:
    """Ascending hashes that agree in their leading bits, of which kept further ones are stored as differences."""
    kept = min(kept, 64 - bits)
    return pack(np.diff((keys << np.uint64(bits)) >> np.uint64(64 - kept), prepend=np.uint64(0)))


def unpack_keys(data: bytes, prefix: int, bits: int, kept: int) -> np.ndarray:
    kept = min(kept, 64 - bits)
    return (np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64) << np.uint64(64 - bits - kept)) | np.uint64(prefix << (64 - bits))


def bigrams(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key of each token together with the one before it, which is END at the start of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = END
    return mix(before * np.uint64(0x9FB21C651E98DF25) + tokens)


def _encode(most_bytes: int):
    """Batches of documents as their distinct words (hashes, ascending) and the texts as numbers of these."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = int(np.random.default_rng().integers(1 << 62))
        for nth, table in enumerate(batches(rows, "text", most_bytes)):
            words, at = word_hashes(*utf8(table.column("text")))
            sizes = np.diff(at) + 1
            tokens = np.full(int(sizes.sum()), END, np.uint64)
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(tokens), bool)
            inner[last] = False
            tokens[inner] = words
            keys, number = np.unique(tokens, return_inverse=True)
            rank = np.argsort(-np.bincount(number), kind="stable")  # frequent words get small numbers
            place = np.empty_like(rank)
            place[rank] = np.arange(len(rank))
            folds = table.column("fold").to_numpy().astype(np.uint8)
            ids = table.column("doc_id").combine_chunks()
            deleted = np.repeat(folds, sizes) == DELETED
            held = None
            if deleted.any():
                _, pair = np.unique(bigrams(tokens, sizes), return_inverse=True)
                before = np.empty_like(number)
                before[1:] = number[:-1]
                before[last - sizes + 1] = np.searchsorted(keys, END)
                held = pack(np.concatenate([number[deleted], before[deleted], pair[deleted]]))
            known = np.asarray(ids.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            columns = [[ids.fill_null(0).to_numpy().tobytes()], [known.tobytes()], [pack(sizes)], [folds.tobytes()], [keys.tobytes()], [pack(rank)], [pack(place[number])], [held], [lot], [nth]]
            yield _batch(columns, _BATCH)
        trim()

    return run


_BATCH = "ids binary, known binary, sizes binary, folds binary, words binary, rank binary, stream binary, held binary, lot long, nth long"
_KINDS = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    """The columns as a record batch of the schema."""
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _tokens(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each token's place among them, and sizes of the texts of a stored batch."""
    return np.frombuffer(row["words"], np.uint64), unpack(row["rank"])[unpack(row["stream"])], unpack(row["sizes"])


class Levels:
    """How many senders stand at each level, and who sends to whom.

    Level 0 are the batches. A sender of level l is a group and the leading l * bits bits of its keys; its number
    is prefix * groups[l] + group. 2**bits groups of a level are one group of the next; the last level has one.
    """

    def __init__(self, batches: int, bits: int):
        self.bits, self.groups = bits, [batches]
        while len(self.groups) == 1 or self.groups[-1] > 1:
            self.groups.append(-(-self.groups[-1] >> bits))

    @property
    def last(self) -> int:
        return len(self.groups) - 1

    def split(self, level: int, sender: int) -> tuple[int, int]:
        """Prefix and group."""
        return divmod(sender, self.groups[level])

    def node(self, level: int, sender: int, part: int) -> int:
        """The node of the next level that gets a part of the sender's keys."""
        prefix, group = self.split(level, sender)
        return ((prefix << self.bits) + part) * self.groups[level + 1] + (group >> self.bits)


ASKED = "node long, sender long, part int, uk binary, ua binary, ub binary, bk binary, ba binary, bb binary"
#: For every key of a part, in its order: counts in the retained texts and in all training texts.
REPLY = "to long, part int, ur binary, ut binary, br binary, bt binary"
TOTALS = ", n_a long, v_a long, n_t long, v_t long"
STATE = "to long, uk binary, ua binary, ub binary, bk binary, ba binary, bb binary, senders binary, parts binary, sizes binary, back binary"


def _messages(levels: Levels, level: int, sender: int, words: np.ndarray, pairs: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    """A sender's keys and their counts (of words retained and deleted, of pairs likewise), cut by the next bits."""
    bits = levels.bits * (level + 1)
    edges = np.arange(1, 1 << levels.bits, dtype=np.uint64) << np.uint64(64 - levels.bits)
    cuts = [[0, *np.searchsorted(keys << np.uint64(levels.bits * level), edges).tolist(), len(keys)] for keys in (words, pairs)]
    columns: list[list] = [[] for _ in ASKED.split(", ")]
    for part in range(1 << levels.bits):
        (a, b), (c, d) = ((x[part], x[part + 1]) for x in cuts)
        if a < b or c < d:
            values = (levels.node(level, sender, part), sender, part, pack_keys(words[a:b], bits, 64), pack(counts[0][a:b]), pack(counts[1][a:b]), pack_keys(pairs[c:d], bits, KEPT), pack(counts[2][c:d]), pack(counts[3][c:d]))
            for column, v in zip(columns, values, strict=True):
                column.append(v)
    return _batch(columns, ASKED)


def _ask(levels: Levels):
    """The distinct keys of each batch with their counts in both training parts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stored in slices(rows, 1):
            row = stored.to_pylist()[0]
            words, number, sizes = _tokens(row)
            fold = np.repeat(np.frombuffer(row["folds"], np.uint8), sizes)
            pairs, pair = np.unique(bigrams(words[number], sizes), return_inverse=True)
            counts = [np.bincount(at[fold == f], minlength=len(keys)) for keys, at in ((words, number), (pairs, pair)) for f in (RETAINED, DELETED)]
            yield _messages(levels, 0, row["to"], words, pairs, counts)

    return run


def _ask_on(levels: Levels, level: int):
    """The merged keys of each node of a level, for the next one."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stored in slices(rows, 1):
            row = stored.to_pylist()[0]
            yield _messages(levels, level, row["to"], np.frombuffer(row["uk"], np.uint64), np.frombuffer(row["bk"], np.uint64), [unpack(row[c]) for c in ("ua", "ub", "ba", "bb")])

    return run


def _merged(group: pa.Table, prefix: int, bits: int) -> dict[str, list]:
    """For words (u) and pairs (b) of a node's messages: distinct keys, the place of every message's keys among them, the messages' sizes, both counts."""
    out = {}
    for kind, kept in (("u", 64), ("b", KEPT)):
        keys = [unpack_keys(k, prefix, bits, kept) for k in group.column(kind + "k").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpack(c) for c in group.column(kind + f).to_pylist()]), len(distinct)).astype(np.int64) for f in "ab"]
        out[kind] = [distinct, at, [len(k) for k in keys], *sums]
    return out


def _merge(levels: Levels, level: int):
    """Nodes between the levels: what their senders asked, as one sender's keys, and who asked for which."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows, ("node",)):
            node = group.column("node")[0].as_py()
            own = _merged(group, levels.split(level, node)[0], levels.bits * level)
            (uk, u_at, u_n, ua, ub), (bk, b_at, b_n, ba, bb) = own["u"], own["b"]
            numbers = [pack(group.column(c).to_numpy()) for c in ("sender", "part")]
            yield _batch([[x] for x in (node, uk.tobytes(), pack(ua), pack(ub), bk.tobytes(), pack(ba), pack(bb), *numbers, pack(np.array([*u_n, *b_n])), pack(np.concatenate([u_at, b_at])))], STATE)
        trim()

    return run


def _replies(senders: np.ndarray, parts: np.ndarray, sizes: tuple[list[int], list[int]], at: tuple[np.ndarray, np.ndarray], totals: list[np.ndarray]) -> list[list]:
    """Columns of REPLY: what each sender asked for, out of totals (words retained and all, pairs likewise)."""
    columns = [senders.tolist(), parts.tolist()]
    for k, values in enumerate(totals):
        cuts = np.cumsum([0, *sizes[k // 2]]).tolist()
        columns.append([pack(values[at[k // 2][a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return columns


def _answer(levels: Levels):
    """The last level: adds up the counts of each range over all batches; answers in the order of each sender's keys."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(rows, ("node",)):
            own = _merged(group, levels.split(levels.last, group.column("node")[0].as_py())[0], levels.bits * levels.last)
            (_, u_at, u_n, ua, ub), (_, b_at, b_n, ba, bb) = own["u"], own["b"]
            columns = _replies(group.column("sender").to_numpy(), group.column("part").to_numpy(), (u_n, b_n), (u_at, b_at), [ua, ua + ub, ba, ba + bb])
            sums = (ua.sum(), (ua > 0).sum(), (ua + ub).sum(), (ua + ub > 0).sum())
            yield _batch([*columns, *[[int(x), *[0] * (len(u_n) - 1)] for x in sums]], REPLY + TOTALS)
        trim()

    return run


def _answer_on(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes between the levels hand on what they were told."""
    for row, told in _pairs(rows):
        sizes = unpack(row["sizes"]).tolist()
        half, back = len(sizes) // 2, unpack(row["back"])
        cut = sum(sizes[:half])
        columns = _replies(unpack(row["senders"]), unpack(row["parts"]), (sizes[:half], sizes[half:]), (back[:cut], back[cut:]), [_joined(told, c) for c in ("ur", "ut", "br", "bt")])
        yield _batch(columns, REPLY)
    trim()


def _paired(rows: DataFrame, replies: DataFrame, tasks: int) -> DataFrame:
    """Each row (by to) and behind it the replies it gets, in the order of their parts."""
    both = stacked(rows.withColumn("part", F.lit(-1)), replies, allow_missing=True)
    return _dealt(both, "to", tasks, "part")


def _dealt(rows: DataFrame, key: str, tasks: int, *order: str) -> DataFrame:
    """rows in tasks of even numbers of keys (numbers without gaps), those of a key together, one key after another."""
    return rows.repartitionById(tasks, F.pmod(key, F.lit(tasks)).cast("int")).sortWithinPartitions(key, *order)


def _pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Table]]:
    """Out of _paired(): each row as a dict, and its replies."""
    for group in grouped(rows, ("to",)):
        if group.column("part")[0].as_py() == -1:
            yield group.slice(0, 1).to_pylist()[0], group.slice(1)


def _joined(told: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *[unpack(x) for x in told.column(column).to_pylist()]])


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket for each doubling of the context's count."""
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _grid(p: np.ndarray) -> np.ndarray:
    """Places of probabilities on the logarithmic grid; 0 for probability 0."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.maximum(np.rint((np.log10(p) - FLOOR) * GRID), 0) + 1, 0).astype(np.int64)


CELLS = "bucket long, p2 long, p1 long, n long"


def _histogram(n: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(-FLOOR * GRID) + 2
        for row, told in _pairs(rows):
            uni, bi = _joined(told, "ur"), _joined(told, "br")
            word, before, pair = unpack(row["held"]).reshape(3, -1)
            context = uni[before]
            p2 = bi[pair] / np.maximum(context, 1)
            cell = (bucket_of(context) * width + _grid(np.minimum(p2, 1))) * width + _grid(uni[word] / max(n, 1))
            cells, counts = np.unique(cell, return_counts=True)
            yield _batch([cells // width**2, cells // width % width, cells % width, counts], CELLS)
        trim()

    return run


def learn_weights(cells: np.ndarray, v: int, rounds: int = 300) -> np.ndarray:
    """EM over the histogram (bucket, p2, p1, n): one row of weights (k2, k1, k0) for each bucket.

    Buckets without held-out tokens get the weights learned over all; without any, fixed ones.
    """
    value = lambda g: np.where(g > 0, 10.0 ** ((g - 1) / GRID + FLOOR), 0.0)

    def learn(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        p = np.stack([value(rows[:, 1]), value(rows[:, 2]), np.full(len(rows), 1 / (v + 1))], axis=1)
        k = start
        for _ in range(rounds):
            share = p * k
            share /= share.sum(axis=1, keepdims=True)
            new = (share * rows[:, 3:]).sum(axis=0) / rows[:, 3].sum()
            if np.abs(new - k).max() < 1e-9:
                break
            k = new
        return np.maximum(k, 1e-6) / np.maximum(k, 1e-6).sum()

    start = np.array([0.3, 0.6, 0.1])
    common = learn(cells, start) if len(cells) else start
    out = np.tile(common, (BUCKETS, 1))
    for b in range(BUCKETS):
        own = cells[cells[:, 0] == b]
        if len(own):
            out[b] = learn(own, common)
    out[0, 0] = 0.0  # an unseen context says nothing
    out[0] /= out[0].sum()
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(weights: np.ndarray, n: int, v: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, told in _pairs(rows):
            words, number, sizes = _tokens(row)
            uni, bi = _joined(told, "ut"), _joined(told, "bt")
            _, pair = np.unique(bigrams(words[number], sizes), return_inverse=True)
            count = uni[number]
            first = np.cumsum(sizes) - sizes
            context = np.empty_like(count)
            context[1:] = count[:-1]
            context[first] = uni[np.searchsorted(words, END)]
            k = weights[bucket_of(context)]
            p1 = count / n if n else np.full(len(count), 1 / (v + 1))
            p = k[:, 0] * np.minimum(bi[pair] / np.maximum(context, 1), 1.0) + k[:, 1] * p1 + k[:, 2] / (v + 1)
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
            ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["known"], np.uint8) == 0)
            outside = np.frombuffer(row["folds"], np.uint8) == OUTSIDE
            yield _batch([ids, outside, sizes, np.add.reduceat((count > 0).astype(np.int64), first), np.full(len(sizes), n), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)], SCORES)
        trim()

    return run


def interpolated_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, batch_bytes: int = 6 << 20, fan_bits: int = 8) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod folds is not held_out, and scores every row.

    SCORES: n_tokens (words and one end), n_known (tokens that training texts hold), train_tokens (all training
    tokens), base_score (log10 of the add-a-half unigram model), score (log10 of the interpolated model). Null
    and empty texts have the end alone; a text longer than batch_bytes is a batch of its own; a null doc_id counts as the empty
    text for the fold; repeated rows are texts of their own, and count again where they train; other columns are not read; an
    empty table gives an empty result. Without training rows both models are uniform over the one unknown word.
    """
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    fold = F.when(fold_of("doc_id", folds) == held_out, OUTSIDE).when(F.floor(crc / folds) % 10 == 0, DELETED).otherwise(RETAINED)
    texts = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), fold.alias("fold"))
    stored, n = numbered(materialize(texts.mapInArrow(_encode(batch_bytes), _BATCH), "batches"), "to")
    if not n:
        return spark.createDataFrame([], SCORES)
    levels, states, tasks = Levels(n, fan_bits), [], min(n, partitions_for(docs, 16))
    asked = stored.select("to", "sizes", "folds", "words", "rank", "stream").mapInArrow(_ask(levels), ASKED)
    for level in range(1, levels.last):
        nodes = _dealt(asked, "node", tasks).mapInArrow(_merge(levels, level), STATE)
        states.append(materialize(nodes, "nodes"))
        asked = states[-1].select("to", "uk", "ua", "ub", "bk", "ba", "bb").mapInArrow(_ask_on(levels, level), ASKED)
    replies = materialize(_dealt(asked, "node", tasks).mapInArrow(_answer(levels), REPLY + TOTALS), "replies")
    total = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_a", "v_a", "n_t", "v_t")]).first()
    replies_of = replies.drop("n_a", "v_a", "n_t", "v_t")
    replies_of._loom_path = replies._loom_path
    for level in range(levels.last - 1, 0, -1):
        state = states.pop()
        own = state.select("to", "senders", "parts", "sizes", "back")
        handed = materialize(_paired(own, replies_of, tasks).mapInArrow(_answer_on, REPLY), "replies")
        release(state, replies_of)
        replies_of = handed

    held = _paired(stored.where("held IS NOT NULL").select("to", "held"), replies_of.select("to", "part", "ur", "br"), tasks)
    cells = held.mapInArrow(_histogram(total["n_a"]), CELLS).groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n"))
    # at most BUCKETS * grid * grid cells, whatever the input
    weights = learn_weights(np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4), total["v_a"])

    ready = _paired(stored.drop("held"), replies_of.select("to", "part", "ut", "bt"), tasks)
    out = ready.mapInArrow(_scores(weights, total["n_t"], total["v_t"]), SCORES)
    out._loom_weights = weights
    return out
