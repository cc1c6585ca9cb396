"""Token counts with the whole-token shortcut.

Offline, once for each vocabulary, every string of it is encoded alone by the library; those that come
out as one token, and that the pre-tokeniser leaves whole, are proven: as a pre-token they count one.
A text is then cut into pre-tokens; the proven ones are counted by a set look-up, and only the rest
goes through the merges, each different one once while it stays in a bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import in_small_batches, slices, text_of
from loomgraph.llm.tokens import byte_letters, encoder, vocabulary_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_counters: dict[str, Counter] = {}


class Counter:
    """Counts tokens of texts as the tokenizers library does for a byte-level BPE file."""

    def __init__(self, path: str, memory: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memory = memory
        self.proven = self.prove()
        self.merged = Merged(encoder(path).coder.encode_ordinary)

    def prove(self) -> frozenset[str]:
        """The vocabulary's strings that are one pre-token and encode alone as one token.

        Needs no text: the strings come from the vocabulary, the proof from the library's own encoding.
        """
        letters = byte_letters()
        strings = []
        for token in self.library.get_vocab(with_added_tokens=False):
            try:
                strings.append(bytes(letters[c] for c in token).decode())
            except UnicodeDecodeError:  # part of a character: never a pre-token
                continue
        whole = [s for s in strings if self.cut(s) == [s]]
        return frozenset(s for s, e in zip(whole, self.library.encode_batch(whole, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):  # the library cuts at these strings first
            return len(self.library.encode(text, add_special_tokens=False).ids)
        pieces = self.cut(text)
        rest = [p for p in pieces if p not in self.proven]
        if len(self.merged) > self.memory:
            self.merged.clear()
        return len(pieces) - len(rest) + sum(map(self.merged.__getitem__, rest))


class Merged(dict):
    """The number of tokens of pre-tokens that are not proven, by merging each when first asked for."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.merge(piece))
        return n


def counter(name: str) -> Counter:
    """One counter for each Python worker and vocabulary."""
    if name not in _counters:
        _counters[name] = Counter(vocabulary_path(name))
    return _counters[name]


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row of docs, whole texts.

    Counts are those of the tokenizers library without added special tokens; special strings inside a
    text count as their one token, the library's default. Null text is empty: 0 bytes, 0 tokens. A null
    doc_id stays null; repeated rows each give a row; other columns are not read. No rows, no result rows.
    vocabulary: a byte-level BPE .json file, by its public name or as an absolute path.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in slices(rows):
            counts = [own.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return slim.mapInArrow(run, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
