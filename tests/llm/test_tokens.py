"""Token ids, packing and training order: round trips."""

import random
import zlib

import numpy as np
import pytest

from verbalign.llm import materialise, packing
from verbalign.llm.tokens import Encoder, tokenizer_path

from .test_dedup import docs


def ids_of(texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path())
    tk.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in tk.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    pool = ["word ", "Wörter ", "it's ", "  ", "\n", "\n\n", "\t", " ", "漢字", "123 ", "!!", "<|endoftext|>", "é", "😀"]
    return ["".join(r.choice(pool) for _ in range(r.choice([0, 1, 5, 40, 400]))) for _ in range(60)] + ["", None, "long " * 9000]


def test_fast_core_gives_the_librarys_ids(texts):
    e = Encoder(tokenizer_path())
    assert e.core is not None
    got = e.encode([t or "" for t in texts])
    assert all(np.frombuffer(g, e.dtype).tolist() == w.tolist() for g, w in zip(got, ids_of(texts)))


def test_other_tokenizer_runs_by_its_library():
    e = Encoder(tokenizer_path("word_bpe_49k.json"))
    assert e.core is None
    assert np.frombuffer(e.encode(["two words"])[0], e.dtype).tolist()[-1] == 1


def check(rows, texts, window=2048):
    ids = ids_of(texts)
    whole = {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        whole.setdefault(r.doc_id, []).append((r.start, r.length))
    assert len(whole) == len(texts)
    for doc, parts in whole.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= window and sum(s < window for s in sizes) <= 1
    assert sorted(sequences) == list(range(len(sequences)))


def test_packing(spark, texts):
    d = docs(spark, texts).drop("source")
    d = d.selectExpr("*", "case when doc_id % 3 = 0 then 'big' when doc_id % 7 = 0 then null else 'small' end as source")
    check(packing.pack(d).collect(), texts)
    check(packing.pack(d, window=256, block=1000, weights={"big": 3.0, "small": 1.0, "none": 2.0}).collect(), texts, 256)
    assert packing.pack(d.limit(0)).collect() == []


def test_packing_of_odd_rows(spark):
    rows = [(None, "a b", None), (None, "a b", None), (2**60 + 1, None, "x"), (2**60 + 1, "", "x"), (5, "c", "y")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as n", "2 as lo", "3 as part")
    got = packing.pack(d).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == sorted([(0, 3), (0, 3), (2**60 + 1, 1), (2**60 + 1, 1), (5, 2)])


def deviations(rows, weight):
    share = {}
    for r in rows:
        own = share.setdefault(r.sequence_id, {})
        own[r.source] = own.get(r.source, 0) + r.length
    full = [s for k, s in share.items() if k < max(share)]
    return [sum(abs(s.get(x, 0) / 2048 - w) for x, w in weight.items()) for s in full]


@pytest.mark.parametrize("sources", [2, 20, 200])
def test_every_window_holds_the_mixture(spark, sources):
    d = docs(spark, [f"alpha beta {i} gamma " * (20 + i % 37) for i in range(600)]).drop("source").selectExpr("*", f"cast(doc_id % {sources} as string) as source")
    rows = packing.pack(d, block=30_000).collect()
    total = sum(r.length for r in rows)
    weight = {}
    for r in rows:
        weight[r.source] = weight.get(r.source, 0) + r.length / total
    got = deviations(rows, weight)
    assert len(got) > 20 and sum(got) / len(got) < 0.1


def test_given_weights_hold_until_a_queue_ends(spark):
    d = docs(spark, ["alpha beta gamma " * 400] * 40).drop("source").selectExpr("*", "case when doc_id < 10 then 'a' when doc_id < 30 then 'b' else 'c' end as source")
    rows = packing.pack(d, weights={"a": 1.0, "b": 3.0}, block=5000).collect()
    mixed = 20 * 1201 * 4 // 3 // 2048  # windows until b ends
    assert max(deviations([r for r in rows if r.sequence_id < mixed], {"a": 0.25, "b": 0.75, "c": 0})) < 0.01
    assert all(r.source == "c" for r in rows if r.sequence_id > 30 * 1201 // 2048)


def test_shares_of_a_queue_by_block():
    clock = packing.Clock(np.array([1000.0, 10.0]), np.array([100.0, 10.0]), 8)
    for total, w in ((1000, 100.0), (10, 10.0)):
        parts = [x for first in range(0, total, 300) for x in packing.shares(clock, "s", total, w, first, min(first + 300, total))]
        got = sorted((lo, hi, b) for p in parts for lo, hi, b in zip(p.lo, p.hi, p.block))
        assert got[0][0] == 0 and got[-1][1] == total and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(got, got[1:]))
        assert all(clock.count(b, total, w) <= lo and hi <= clock.count(b + 1, total, w) for lo, hi, b in got)


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1000, 4097])
def test_permutation(n):
    p = materialise.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    if n > 50:
        assert (p != np.arange(n)).mean() > 0.9 and (p != materialise.permute(np.arange(n), n, key=5)).any()


def test_training_order(spark, texts, tmp_path):
    out = str(tmp_path / "shards")
    rows = materialise.write_training_order(docs(spark, texts), out, length=64, per_shard=16).collect()
    stream = np.concatenate(ids_of(texts))
    # the stream's order is the writer's; its pieces are whole
    rows = sorted(rows, key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows))) and len(rows) == -(-len(stream) // 64)
    records = list(materialise.read_slots(out, 0, len(rows), np.dtype("<u2"), 64, 16))
    by_sequence = {r.sequence_id: rec[: r.n_ids] for r, rec in zip(rows, records)}
    back = np.concatenate([by_sequence[i] for i in range(len(rows))])
    assert sorted(back.tolist()) == sorted(stream.tolist())
    assert all(zlib.crc32(rec[: r.n_ids].astype("<u4").tobytes()) == r.ids_crc32 for r, rec in zip(rows, records))
    assert np.array_equal(np.concatenate(list(materialise.read_slots(out, 20, 23, np.dtype("<u2"), 64, 16))), np.concatenate(records[20:23]))
    assert materialise.write_training_order(docs(spark, []), str(tmp_path / "none")).collect() == []
