import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stacklight.llm import transducer

from .util import EDGE, docs

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endof", "\x1c\x1d 's'll ''s 'S it's’s", "x" * 3000, "ab" * 2000 + " '", "\r\n\t  \n a  ", "꟎ 1⅕ ՘⿾ \U0001c880", "日本語 😀👨‍👩‍👧 é é", "\u0000 � ퟿\U0010ffff"]


@pytest.fixture(scope="module")
def own():
    return Tokenizer.from_file(PATH)


def test_like_the_vocabularys_library(spark, own):
    rng = random.Random(3)
    parts = ["the ", "Straße", " 12", "\n\n", "'ll", " naïve", "  ", "!?", "x1", " ", "　", "ſ", "²"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randrange(60))) for _ in range(80)]
    df = docs(spark, [*EDGE, *((100 + i, t) for i, t in enumerate(texts))])
    for size in (1, 30, 1 << 16):
        got = transducer.round_trip(df, PATH, size).collect()
        assert len(got) == len(EDGE) + len(texts)
        want = sorted((d if d is not None else -1, np.array(e := own.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), own.decode(e, skip_special_tokens=False)) for d, t in [(r.doc_id, r.text) for r in df.collect()])
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), r.text) for r in got) == want
        assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert transducer.round_trip(docs(spark, []), PATH).collect() == []


def test_every_code_point_splits_alike(own):
    v = transducer.vocabulary(PATH)
    for lo in range(0, 0x110000, 256):
        s = "".join(f"a{c}1{c}!{c}{c} " for c in map(chr, range(lo, lo + 256)) if not 0xD800 <= ord(c) < 0xE000)
        assert v.split(s) == [s[a:z] for _, (a, z) in own.pre_tokenizer.pre_tokenize_str(s)]


def test_merging_side_by_side(own):
    v, rng = transducer.vocabulary(PATH), random.Random(9)
    words = ["", "a", " the", "<|endoftext|>", "x" * 65, "ab" * 400, "日本語", *("".join(rng.choices("aeinrst hl'é0", k=rng.randrange(1, 30))) for _ in range(3000))]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.merge_all(words)] == [v.merge(w) for w in words]
    assert v.merge_all([]) == [] and v.merge_all(["", "q"]) == [b"", np.array(v.merge("q"), "<u4").tobytes()]
    whole = [w for w in words if w and len(v.words(w)) == 1]
    assert [v.merge(w) for w in whole] == [own.encode(w, add_special_tokens=False).ids for w in whole]


def entries(rng, n):
    words = {bytes(rng.choices(b"abc", k=rng.randrange(0, 6))) for _ in range(n)}
    return [(w, tuple(rng.choices(range(4), k=rng.randrange(0, 4)))) for w in words]


@pytest.mark.parametrize("n", [0, 1, 2, 12, 60, 250])
def test_lexicon(tmp_path, n):
    rng = random.Random(n)
    for case in range(20):
        rows = entries(rng, n) if case % 2 else [(w, (7,)) for w, _ in entries(rng, n)]
        (tmp_path / f"{case}").write_bytes(transducer.compile_lexicon(rows))
        lex, held = transducer.Lexicon(str(tmp_path / f"{case}")), dict(rows)
        asked = [*held, b"", b"abcabcabc", b"d", *(w for w, _ in entries(rng, 40))]
        assert [None if x is None else tuple(np.frombuffer(x, "<u4").tolist()) for x in lex.look_up(asked)] == [held.get(w) for w in asked]
        # minimal: as many states as there are different futures of prefixes, apart from what all of a future's ids begin with
        futures = set()
        for p in {w[:i] for w in held for i in range(len(w) + 1)} | {b""}:
            rest = {w[len(p) :]: ids for w, ids in held.items() if w.startswith(p)}
            common = 0
            while p and rest and all(len(ids) > common for ids in rest.values()) and len({ids[common] for ids in rest.values()}) == 1:
                common += 1
            futures.add(tuple(sorted((w, ids[common:]) for w, ids in rest.items())))
        assert len(lex.final) == len(futures)


def test_word_counts_and_the_query(spark, tmp_path, own):
    df = docs(spark, [(1, "a b a b a"), (2, " a"), (3, None)])
    assert {r.word: r.n for r in transducer.word_counts(df, PATH).collect()} == {"a": 1, " b": 2, " a": 3}
    from stacklight.llm import queries

    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    row = next(r for r in queries.op11_bpe_transducer(spark, str(tmp_path)).collect() if r.doc_id == 1)
    ids = own.encode("a b a b a", add_special_tokens=False).ids
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(b"a b a b a").hexdigest())
