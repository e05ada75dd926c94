"""SentencePiece encoding and decoding over a table of distinct chunks.

With this model no piece holds the whitespace mark after another character, so
a text falls into chunks (a run of marks and what follows up to the next mark)
whose segmentations are independent. A task takes a block of whole texts, makes
the table of the block's distinct chunks, segments each of them once and joins
the ids back by position. A block is bounded (`BLOCK_CHARS`, or one text), texts
never leave their task, and nothing is shuffled: the table of all chunks of a
corpus grows with it, and joining it back would move every text.

Defined cases: a null text is empty; an empty text has no ids and decodes to an
empty text; repeated rows are encoded each; a row with a null id keeps it; other
columns are dropped by the query and kept by `encoded`.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import table, whole_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=2)
def processor(path: str):
    """The model, once a worker; fails where a piece could hold a mark after another character."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if not pieces_keep_marks_first(sp):
        raise ValueError(f"{path}: chunks can't be segmented apart with this model")
    return sp


def pieces_keep_marks_first(sp) -> bool:
    """What the chunks rest on: a mark only stands at a piece's start or in a piece of marks alone."""
    return all(MARK not in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without its first mark (which the library's dummy prefix adds)."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))]


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose texts have about `BLOCK_CHARS` characters."""
    for batch in batches:
        texts, start, size = batch.column(column).to_pylist(), 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_CHARS or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def encode_block(sp, texts: list[str]) -> Iterator[list[int]]:
    """The ids of each text; every distinct chunk of the block is segmented once."""
    each = [chunks(t) for t in texts]
    distinct = list(dict.fromkeys(chain.from_iterable(each)))
    ids = dict(zip(distinct, sp.encode(distinct, num_threads=1)))
    if "" in ids:
        ids[""] = [sp.piece_to_id(MARK)]  # a lone mark; the library gives an empty text no prefix
    for own in each:
        yield list(chain.from_iterable(map(ids.__getitem__, own)))


def encoded(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """`docs` with ids array<int> and decoded string."""
    rows = docs.withColumn(text, whole_text(text)).drop("ids", "decoded")
    fields = pa.schema([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        for part, texts in blocks(batches, text):
            ids = list(encode_block(sp, texts))
            extra = [pa.array(ids, fields.field(0).type), pa.array([sp.decode(x) if x else "" for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=[*part.schema.names, "ids", "decoded"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(encode, ", ".join([*kinds, "ids array<int>", "decoded string"]))


def digested(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): as `encoded`, with digests in place of the lists, which stay in the task."""
    rows = docs.select(key, whole_text(text).alias(text))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model_path)
        names = [str(i) for i in range(sp.get_piece_size())]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part, texts in blocks(batches, text):
            out: list[tuple[int, str, str]] = []
            for ids in encode_block(sp, texts):
                out.append((len(ids), sha(",".join(map(names.__getitem__, ids))), sha(sp.decode(ids) if ids else "")))
            n, a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def model_path() -> str:
    """The model's place on this machine; the file comes with the tokenizers' package on every machine."""
    return os.fspath(public_tokenizers.path(MODEL))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"), model_path())
