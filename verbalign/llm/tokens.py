"""Token ids of documents, by a public tokenizer file.

The file of the ``tokenizers`` library is the parameter. Where it holds a plain
byte-level BPE whose ids are in merge order, as the 50k file does, its
vocabulary is handed to the faster BPE core of ``tiktoken``, which gives the same
ids at a fifth of the time; any other file is run by its own library. Special
tokens' strings in a text are ordinary text either way.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_columns, materialise, text_of

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 1


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


def _fast_core(path: str):
    """The file's vocabulary in tiktoken's core, or None if it is of another kind."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout"):
        return None
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(vocab[m] != 256 + i for i, m in enumerate(merges)):
        return None
    byte = _byte_of_letter()
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Texts to arrays of ids (as bytes), each ending in ``END_ID``."""

    def __init__(self, path: str, fast: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = True
        self.dtype = np.dtype("<u2") if self.tk.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.core = _fast_core(path) if fast else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.core is not None:
            ids = map(self.core.encode_ordinary, texts)
        else:
            ids = (e.ids for e in self.tk.encode_batch(texts, add_special_tokens=False))
        return [np.array([*x, END_ID], self.dtype).tobytes() for x in ids]


def tokenised(docs: DataFrame, path: str | None = None, batch: int = 400) -> DataFrame:
    """A table in the shared folder, a row for each of ``docs``.

    row_id, part, before, source_before, id, no_id, source, n (ids with the end),
    ids (little-endian). ``row_id`` tells apart rows that repeat a doc_id; ``part``
    is the task that wrote the row, ``before`` the ids it wrote ahead of it and
    ``source_before`` those of the same source. All are fixed once the table is
    written, so a place in a whole stream needs only a sum per part.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        encoder, at, total, queue = Encoder(path), part_id << 33, 0, {}
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                ids = encoder.encode(list(part.text))
                n = np.array([len(x) // encoder.dtype.itemsize for x in ids], np.int64)
                ahead = np.empty(len(part), np.int64)
                for i, (source, size) in enumerate(zip(part.source, n.tolist())):
                    ahead[i] = queue.get(source, 0)
                    queue[source] = ahead[i] + size
                yield pd.DataFrame({"row_id": np.arange(at, at + len(part)), "part": part_id, "before": total + np.cumsum(n) - n, "source_before": ahead, "id": part.id.to_numpy(), "no_id": part.no_id.to_numpy(), "source": part.source.to_numpy(), "n": n, "ids": ids})
                at, total = at + len(part), total + n.sum()

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(*id_columns(), F.coalesce(source, F.lit("")).alias("source"), text_of().alias("text"))
    return materialise(rows.mapInPandas(run, "row_id long, part long, before long, source_before long, id long, no_id boolean, source string, n long, ids binary"))


def id_type(path: str | None = None) -> np.dtype:
    return Encoder(path or tokenizer_path()).dtype


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
