import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from stacklight.llm import packing

from .util import EDGE, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def verify(rows, texts, max_len):
    """Every id in exactly one piece, right digests, sequences gapless from 0 and full but the last."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s, pieces in by_seq.items():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at == max_len or s == max(by_seq)
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_encoder_equals_the_files_own_library():
    enc = packing.encoder(PATH)
    for t in ["", "a  b\n\n c", "<|endoftext|>", "x <|endoftext|>  y", "日本 é \x00 ", "don't 1234 !!", " " * 50 + "z", "a" * 3000]:
        assert enc(t) == ids_of(t)[:-1]


def test_pack_brute_force(spark):
    texts = {i: (f"word{i} " * (i * 7 % 90)) for i in range(60)} | {100: None, 101: "", 102: "long " * 3000}
    df = docs(spark, [(i, t, f"src{i % 3}") for i, t in texts.items()]).repartition(3)
    rows = packing.pack(df, PATH, max_len=64, window_sequences=4).collect()
    verify(rows, texts, 64)


def test_windows_hold_the_target_proportions(spark):
    df = docs(spark, [(i, "a b c d e f g h i " * 60, "big" if i % 4 else "small") for i in range(80)]).repartition(4)
    rows = packing.pack(df, PATH, max_len=64, window_sequences=4, proportions={"big": 1, "small": 1}).collect()
    held = {}
    for r in rows:
        w = held.setdefault(r.sequence_id // 4, {})
        w[r.source_queue] = w.get(r.source_queue, 0) + r.length
    small = sum(w.get("=small", 0) for w in held.values())
    for k in range(small // 128 - 1):  # until the small source runs out
        assert abs(held[k]["=small"] - held[k]["=big"]) <= 2


def test_many_sources_share_queues(spark):
    texts = {i: "text " * (60 if i == 7 else 20) for i in range(30)}
    df = docs(spark, [(i, t, f"s{i}") for i, t in texts.items()])
    rows = packing.pack(df, PATH, max_len=64, max_queues=4).collect()
    assert "=s7" in {r.source_queue for r in rows} and len({r.source_queue for r in rows}) <= 4
    verify(rows, texts, 64)
    rows = packing.pack(df, PATH, max_len=64, window_sequences=2, max_queues=4, proportions={"s3": 1, "s4": 1}).collect()
    assert {r.source_queue for r in rows} <= {"=s3", "=s4", "#0", "#1"}
    verify(rows, texts, 64)


def test_encoder_on_a_whole_table():
    own, enc = Tokenizer.from_file(PATH), packing.encoder(PATH)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    assert texts and all(enc(t) == own.encode(t, add_special_tokens=False).ids for t in texts if t)


def test_edge_cases(spark):
    rows = packing.pack(docs(spark, [(*r, None) for r in EDGE]), PATH, max_len=16).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in EDGE)
    assert packing.pack(docs(spark, []), PATH).collect() == []
