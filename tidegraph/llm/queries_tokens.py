"""Queries over token ids: the bit-plane store and the packed sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import packing, token_store
from .common import materialise, scratch_path, table, temporary


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _with_crc(df: DataFrame, wanted: str) -> DataFrame:
    """``wanted`` columns and, from ``tokens``, the crc32 of the ids."""
    names = [x.split()[0] for x in wanted.split(", ")]
    at = df.columns.index("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(at)
            found = {
                "n_tokens": pa.array([len(x.as_py()) // 4 for x in tokens], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.as_buffer()) for x in tokens], pa.int64()),
            }
            columns = [found[n] if n in found else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, wanted)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    documents = table(spark, sf_dir, "documents")
    written = materialise(token_store.write_tokens(documents, folder, vocabulary("byte_bpe_50k.json"), True), "shards")
    read = token_store.read_tokens(spark, folder, written)
    digests = _with_crc(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return materialise(digests, "digests")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(documents: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids; nulls, ties and repeated rows as ``packing`` has them."""
    wanted = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    with temporary(documents.sparkSession) as keep:
        packed = packing.pack(documents, vocabulary("word_bpe_49k.json"), False)
        return keep(materialise(_with_crc(packed, wanted), "digests"))


QUERIES = {"op7_token_store": op7_token_store, "op8_best_fit_packing": op8_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
