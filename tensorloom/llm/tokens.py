"""BPE encoding and decoding of whole texts (the transducer of bpe.py, an Arrow map without a shuffle)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices
from .worker import held


def encoder(path: str, engine: str = "transducer"):
    """One encoder a Python worker, so that pieces already seen stay known from task to task."""
    from .bpe import Encoder

    return held((path, engine), lambda: Encoder(path, engine))


def noted(blocks, into: bytearray):
    """blocks again, one at a time, added up on the way."""
    for b in blocks:
        into += b
        yield b


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs: its id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded string.

    tokenizer: the path of a tokenizers file, on every worker. Null texts count as empty: no ids, decoded "". Repeated
    rows and null ids are kept as they are; other columns are not read. Texts of any length are encoded and decoded in one
    go, block by block; only a row's results are whole.
    """

    def run(batches):
        from .bpe import Decoder

        enc = encoder(tokenizer)
        dec = Decoder(enc.bpe)
        for part in slices(batches, "text", keep=True):
            ids, texts = [], []
            for t in part.column(1).to_pylist():
                own = bytearray()
                texts.append("".join(dec.blocks(noted(enc.blocks(t or ""), own))))
                ids.append(bytes(own))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame) -> DataFrame:
    """Digest columns of encode_decode()'s rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
