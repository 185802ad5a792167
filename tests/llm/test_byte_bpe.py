import hashlib
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from waymesh.llm import bpe_transducer, byte_bpe

from .conftest import HOSTILE

tiktoken = pytest.importorskip("tiktoken")

SPEC = byte_bpe.vocabulary()
RANKS = byte_bpe.ranks_of(SPEC)
WANT = tiktoken.Encoding("public", pat_str=byte_bpe.pattern(), mergeable_ranks=RANKS, special_tokens={})
CODER = byte_bpe.Coder(SPEC, byte_bpe.pattern(), byte_bpe.newer_characters())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aeinrstlou '\n", max_size=80), st.text("abc é日本語🙂\x1c\x85͸", max_size=40)))
def test_ids_are_the_librarys(text):
    assert CODER.encode(text).tolist() == WANT.encode_ordinary(text)


def test_characters_of_newer_tables():
    newer = regex.findall(f"[{byte_bpe.newer_characters()}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    for text in (f"a{c}b 1{c}2 {c}!" for c in [*newer[:50], *newer[-50:], "\U00010ee7", "\U00016ea7"]):
        assert CODER.encode(text).tolist() == WANT.encode_ordinary(text)


def brute(raw, ranks):
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_any_ranks_and_forgotten_steps(monkeypatch):
    """Small vocabularies in any order of ranks, some of whose tokens no merges make; blocks and steps of a few."""
    monkeypatch.setattr(bpe_transducer, "STEPS", 40)
    monkeypatch.setattr(bpe_transducer, "BLOCK", 7)
    rnd = random.Random(5)
    for _ in range(150):
        tokens = {bytes([b]) for b in range(256)}
        for _ in range(rnd.randint(1, 25)):
            tokens.add(bytes(rnd.choice(b"abc") for _ in range(rnd.randint(2, 5))))
        order = list(range(len(tokens)))
        rnd.shuffle(order)
        ranks = dict(zip(sorted(tokens), order, strict=True))
        machine = bpe_transducer.Transducer(ranks)
        for _ in range(20):
            raw = bytes(rnd.choice(b"abcx") for _ in range(rnd.randint(1, 40)))
            assert machine.encode(raw) == ([ranks[raw]] if raw in ranks else brute(raw, ranks))


def test_long_match_in_little_memory():
    word = "".join(random.Random(2).choice("abcdefghij") for _ in range(60_000))
    assert CODER.encode(word).tolist() == WANT.encode_ordinary(word)
    assert CODER.encode(" " * 50_000 + "a").tolist() == WANT.encode_ordinary(" " * 50_000 + "a")


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError, match="single bytes"):
        bpe_transducer.Transducer({b"a": 0})


@settings(max_examples=200, deadline=None)
@given(st.text("aé日🙂 ", max_size=40), st.integers(1, 5))
def test_streamed_characters_are_whole(text, step):
    pieces = bpe_transducer.Pieces({bytes([b]): b for b in range(256)})
    stream, out = bpe_transducer.Decoder(pieces), ""
    raw = np.frombuffer(text.encode(), np.uint8)
    for k in range(0, len(raw), step):
        out += stream.feed(raw[k : k + step]).decode()  # each part is text by itself
    assert out + stream.close().decode() == text and stream.state == bpe_transducer.WHOLE


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list(b"a\xc2\xc1\xa9\xe0\xa0\x9f\xed\x80\xf0\x90\x8f\xf4\xf5\xff")), max_size=6), st.integers(1, 3))
def test_state_machine_knows_text(raw, step):
    raw = bytes(raw)
    pieces = bpe_transducer.Pieces({bytes([b]): b for b in range(256)})
    stream = bpe_transducer.Decoder(pieces)
    out = b"".join(stream.feed(np.frombuffer(raw[k : k + step], np.uint8)) for k in range(0, len(raw), step)) + stream.close()
    try:
        raw.decode()
        text = True
    except UnicodeDecodeError:
        text = False
    assert out == raw and (stream.state == bpe_transducer.WHOLE) == text


def test_unknown_ids(spark):
    with pytest.raises(Exception, match="doesn't have"):
        byte_bpe.decode(spark.createDataFrame([(1, [5, 60_000])], "doc_id long, ids array<int>"), SPEC).collect()


def test_round_trip_of_hostile_rows(frame, hostile):
    got = byte_bpe.decode(byte_bpe.encode(hostile)).collect()
    want = sorted((str(i), tuple(WANT.encode_ordinary(t or "")), (t or "").encode(), True) for i, t in HOSTILE)
    assert sorted((str(r.doc_id), tuple(r.ids), bytes(r.decoded), r.is_text) for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(hostile.limit(0))).count() == 0
    # ids in the middle of a character
    assert [r.is_text for r in byte_bpe.decode(byte_bpe.encode(frame([(1, "🙂")])).selectExpr("doc_id", "slice(ids, 1, 1) AS ids")).collect()] == [False]


def test_query_equals_the_library(spark):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: WANT.encode_ordinary(r.text or "") for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = byte_bpe.op13_byte_bpe(spark, d).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), sha(",".join(map(str, want[r.doc_id]))), sha(texts[r.doc_id]))
