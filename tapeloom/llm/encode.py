"""Token ids of a whole corpus, every distinct word encoded once.

Documents are cut into pre-tokens (the public pattern); a block of documents keeps the sequence of its
words as numbers and its list of distinct words. The distinct words of all blocks are shuffled by word, every one
is encoded once where it lands, its ids are joined back to the blocks' lists, and in the blocks the documents are put
together again by position.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pattern by which the byte-level vocabularies split a text before any merge.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Encoding:
    """``vocabulary`` is the path of a byte-level BPE file on the driver; its bytes travel as a broadcast
    variable (a fixed size). A block ends with the document that brings it to ``block_chars``."""

    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json"
    block_chars: int = 4_000_000


class _Numbers(dict):
    """Numbers words in the order in which they are first seen."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


_BLOCKS = "block long, doc_ids array<long>, lengths array<int>, word_at array<int>, words array<string>"
_WORDS = "block long, number int, word string"
_IDS = "block long, number int, ids array<int>"


def _cut(block_chars: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(PRE_TOKENS).findall
        part, count = TaskContext.get().partitionId(), 0
        docs, lengths, at, chars, numbers = [], [], [], 0, _Numbers()

        def close() -> pa.RecordBatch:
            block = (part << 32) + count
            flat = np.concatenate(at) if at else np.zeros(0, np.int32)
            row = [[block], [docs], [np.asarray(lengths, np.int32)], [flat], [list(numbers)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["block", "doc_ids", "lengths", "word_at", "words"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = find(text) if text else []
                docs.append(doc)
                lengths.append(len(words))
                at.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                chars += len(text or "") + 1
                if chars >= block_chars:
                    yield close()
                    count += 1
                    docs, lengths, at, chars, numbers = [], [], [], 0, _Numbers()
        if docs:
            yield close()

    return cut


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            words = b["words"][i].values
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), b["block"][i].as_py())), pa.array(np.arange(len(words), dtype=np.int32)), words], names=["block", "number", "word"])


def _encode(vocabulary):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(vocabulary.value)
        tokenizer.encode_special_tokens = True
        for b in batches:
            got = tokenizer.encode_batch(b["word"].to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b["word"], pa.array([e.ids for e in got], pa.list_(pa.int32()))], names=["known", "ids"])

    return encode


def _assemble(counts_only: bool):
    def assemble(blocks: pa.Table, words: pa.Table) -> pa.Table:
        out = []
        words = words.sort_by("number").combine_chunks()
        lists = words["ids"].combine_chunks() if words.num_rows else pa.array([], pa.list_(pa.int32()))
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy()
        size = np.diff(offsets)
        for row in range(blocks.num_rows):
            docs = blocks["doc_ids"][row].values
            lengths = blocks["lengths"][row].values.to_numpy()
            at = blocks["word_at"][row].values.to_numpy()
            each = size[at]
            ends = np.concatenate([[0], np.cumsum(each)])
            doc_ends = ends[np.concatenate([[0], np.cumsum(lengths)])]
            if counts_only:
                out.append(pa.table([docs, pa.array(np.diff(doc_ends).astype(np.int64))], names=["doc_id", "n_tokens"]))
                continue
            take = np.arange(ends[-1]) - np.repeat(ends[:-1] - offsets[:-1][at], each)
            ids = pa.ListArray.from_arrays(pa.array(doc_ends.astype(np.int32)), pa.array(flat[take].astype(np.int32)))
            out.append(pa.table([docs, ids], names=["doc_id", "ids"]))
        return pa.concat_tables(out)

    return assemble


def _encoded(documents: DataFrame, rules: Encoding, counts_only: bool) -> DataFrame:
    spark: SparkSession = documents.sparkSession
    with open(rules.vocabulary, "rb") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    blocks = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(rules.block_chars), _BLOCKS).repartition("block")
    words = blocks.mapInArrow(_words, _WORDS)
    encoded = words.select("word").distinct().mapInArrow(_encode(vocabulary), "known string, ids array<int>")
    # The number of distinct words has no bound, so their table is never broadcast.
    ids = words.join(encoded.hint("merge"), F.col("word") == F.col("known")).select("block", "number", "ids")
    schema = "doc_id long, n_tokens long" if counts_only else "doc_id long, ids array<int>"
    return blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(counts_only), schema)


def encode_corpus(documents: DataFrame, rules: Encoding = Encoding()) -> DataFrame:
    """doc_id and ids of every row of ``documents`` (doc_id, text), without special tokens.

    A null and an empty text both have the empty list of ids; blank text has the ids of its white space.
    Special tokens' strings are ordinary text. Repeated rows give repeated results, a null doc_id stays
    null, other columns are ignored; an empty table gives none.

    Shuffled are the blocks (a number per pre-token) and each block's distinct words, there and back. A word has one row
    a block, however often it occurs there; to be encoded it is combined within every partition first. In the join a
    word of most blocks is a hot key of the blocks' side, whose partition Spark splits at run time
    (spark.sql.adaptive.skewJoin), sending the word's one row to every part. Blocks are numbered by
    partition, which is repeatable as long as the input's partitions are (a scan's are).
    """
    return _encoded(documents, rules, counts_only=False)


def count_tokens(documents: DataFrame, rules: Encoding = Encoding()) -> DataFrame:
    """doc_id and n_tokens of every row, by the same way as :func:`encode_corpus`."""
    return _encoded(documents, rules, counts_only=True)


def token_bytes(spark: SparkSession, rules: Encoding = Encoding()) -> DataFrame:
    """The vocabulary as a table: id and the token's bytes."""
    import json

    with open(rules.vocabulary, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    rows = [(i, bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode()) for t, i in vocabulary.items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, rules: Encoding = Encoding()) -> DataFrame:
    """doc_id and text of encoded documents, by a join with the token-byte table (a fixed size, broadcast).

    A document without ids has the empty text. Bytes that are no UTF-8 are decoded with replacement marks.
    """
    spelled = F.broadcast(token_bytes(encoded.sparkSession, rules))
    at = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(spelled, "id")
    joined = at.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    text = F.decode(F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])), "UTF-8")
    return encoded.select("doc_id").join(joined.select("doc_id", text.alias("text")), "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
