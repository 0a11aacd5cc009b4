"""Training-order materialisation: fixed-stride shards in a keyed random order.

The documents' tokens form one stream that is cut every ``length`` ids. Sequence
j goes to global slot P(j), where P is a keyed Feistel permutation of the
smallest even-bit domain that holds all sequences, walked along its cycle until
it lands inside: a bijection of 0..n-1 that needs no shuffle of indices and no
state. Slots are dealt to shards by range; a shard is a file of ``per_shard``
records of ``length`` ids, so slot s lies at byte ``s % per_shard * stride`` of
shard ``s // per_shard``. Reading in training order is sequential and may resume
at any slot. Shards are written under another name and renamed, so a retried
task, or a job run again, replaces a file by the same bytes.

Defined results: null text is empty (the end id alone); the last sequence is
filled up with ``PAD``; no rows give no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, shared_dir
from .tokens import id_type, tokenised, tokenizer_path

LENGTH = 2048
PER_SHARD = 1024
PAD = 0
KEY = 20_24
ROUNDS = 6


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit finaliser (multiply and xor-shift)."""
    x = (x + np.uint64(key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``index``."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)

    def feistel(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (mix(right, key * ROUNDS + r + 1) & mask)
        return (left << half) | right

    x = feistel(np.asarray(index, np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = feistel(x[out])
    return x.astype(np.int64)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_training_order(docs: DataFrame, out_dir: str | None = None, key: int = KEY, length: int = LENGTH, per_shard: int = PER_SHARD, tokenizer: str | None = None) -> DataFrame:
    """Write the shards; one row per sequence: slot, sequence_id, shard, byte_offset, n_ids, ids_crc32, path of the shard.

    The result is the written shards' manifest. ``out_dir`` must be shared by all executors.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    out_dir, dtype = out_dir or shared_dir(spark), id_type(path)
    tokens = tokenised(docs, path)
    # one number for each task that tokenised; a row's place follows from its own
    base, total = {}, 0
    for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        base[r.part], total = total, total + r.n
    count = -(-total // length)
    width = dtype.itemsize

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            out: list[list] = []
            for part, before, n, raw in zip(b.part, b.before, b.n, b.ids):
                at, done = base[part] + before, 0
                while done < n:
                    take = min(n - done, length - (at + done) % length)
                    piece = raw[done * width : (done + take) * width]
                    if out and out[-1][0] * length + out[-1][1] + len(out[-1][2]) // width == at + done and (at + done) % length:
                        out[-1][2] += piece  # goes on where the row before ended
                    else:
                        out.append([(at + done) // length, (at + done) % length, bytearray(piece)])
                    done += take
            part = pd.DataFrame({"sequence_id": [x[0] for x in out], "offset": [x[1] for x in out], "ids": [pack(bytes(x[2])) for x in out]})
            part.insert(0, "slot", permute(part.sequence_id.to_numpy(np.int64), count, key))
            part.insert(0, "shard", part.slot // per_shard)
            yield part

    dealt = tokens.select("part", "before", "n", "ids").mapInPandas(slices, "shard long, slot long, sequence_id long, offset long, ids binary")
    # a shard is a bounded range of slots: one task writes it front to back. Ranges are known, so nothing is sampled
    shards = max(1, -(-count // per_shard))
    parts = min(shards, 20_000)
    dealt = dealt.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("shard", "slot", "offset")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        fs, root = file_system(out_dir)
        fs.create_dir(root, recursive=True)
        shard = slot = sequence = -1
        buffer, sink, temp, made = bytearray(), None, "", []

        def end_record() -> None:
            if slot >= 0:
                ids = np.frombuffer(bytes(buffer), dtype)
                made.append((slot, sequence, shard, slot % per_shard * length * width, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                full = np.full(length, PAD, dtype)
                full[: len(ids)] = ids
                sink.write(full.tobytes())
                buffer.clear()

        def end_shard() -> None:
            if sink is not None:
                sink.close()
                fs.move(temp, f"{root}/{shard_name(shard)}")

        for b in batches:
            for to, s, q, ids in zip(b.shard, b.slot, b.sequence_id, b.ids):
                if s != slot:
                    end_record()
                    if to != shard:
                        end_shard()
                        temp = f"{root}/.{shard_name(to)}.{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(temp)
                    shard, slot, sequence = to, s, q
                buffer += unpack(ids)
            if made:
                yield pd.DataFrame(made, columns=MANIFEST)
                made.clear()
        end_record()
        end_shard()
        yield pd.DataFrame(made, columns=MANIFEST)

    made = dealt.mapInPandas(write, "slot long, sequence_id long, shard long, byte_offset long, n_ids long, ids_crc32 long")
    path = F.concat(F.lit(f"{out_dir.rstrip('/')}/shard-"), F.lpad(F.col("shard").cast("string"), 8, "0"), F.lit(".bin"))
    return made.withColumn("path", path)


MANIFEST = ["slot", "sequence_id", "shard", "byte_offset", "n_ids", "ids_crc32"]


def read_slots(out_dir: str, start: int, stop: int, dtype: np.dtype, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Records of slots start..stop-1 in training order; may begin anywhere."""
    fs, root = file_system(out_dir)
    stride, slot = length * np.dtype(dtype).itemsize, start
    while slot < stop:
        shard = slot // per_shard
        with fs.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(slot % per_shard * stride)
            while slot < stop and slot // per_shard == shard:
                yield np.frombuffer(f.read(stride), dtype)
                slot += 1


def op4_training_order(spark, sf_dir: str) -> DataFrame:
    return write_training_order(documents(spark, sf_dir))
