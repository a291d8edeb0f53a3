"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.batches import slices
from graphloom.llm.wordbpe import encoder

#: Where the vocabulary file lies on every executor; a parameter of all functions here.
BYTE_BPE_50K = os.environ.get("GRAPHLOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"


def encode_documents(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and ids (array<int>) of each row's text, without special tokens.

    Null and empty texts give an empty array, strings of special tokens are ordinary
    text, whole texts are encoded whatever their length. Every input row gives one
    row; further columns are ignored; an empty table gives an empty result. No row
    is shuffled: each partition is encoded where it is read.
    """

    def run(batches):
        words = encoder(vocabulary)
        for part in slices(batches, "text"):
            values, offsets = words.flat(part.column("text").to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and text of encoded rows; null and empty ids give an empty text."""

    def run(batches):
        words = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes = pc.fill_null(pc.list_value_length(part.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = words.decode_flat(sizes, pc.list_flatten(part.column("ids")).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def count_tokens(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """doc_id and n_tokens (int) of each row's text; 0 for null and empty ones."""

    def run(batches):
        words = encoder(vocabulary)
        for part in slices(batches, "text"):
            sizes = pa.array(words.count(part.column("text").to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes], names=["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens int")
