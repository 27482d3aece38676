import hashlib
import struct
from types import SimpleNamespace

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from nightjar.llm import pieces as P
from nightjar.llm import sp_codec, token_counts
from nightjar.llm.catalog import PIECE_MODEL
from pyspark.sql import functions as F

TEXTS = [None, "", " ", "   ", "\n", "\n\n a", "▁", "▁▁ x", "a▁b", "<s>hi</s> <unk>", "<0x0A>", "日本語 テスト", "😀 x 😀", "\t tab\r\n", "  lead", "trail  ",
         "a" * 70_000, " " * 3_000, "0123 45", "é" * 10, "\x00a\x00", "the same", "the same", "word " * 30_000, "x" * 63 + " " + "x" * 64 + " " + "x" * 65]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def frame(spark, texts):
    rows = [(i if t != "the same" else None, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_encoding_is_the_librarys(spark, library):
    rows = sp_codec.encode(frame(spark, TEXTS).withColumn("key", F.coalesce("text", F.lit("<null>"))), PIECE_MODEL, keep=("doc_id", "key")).collect()
    assert sorted(r.key for r in rows) == sorted("<null>" if t is None else t for t in TEXTS)
    for r in rows:
        text = "" if r.key == "<null>" else r.key
        want = library.encode(text, add_eos=True)
        assert r.ids == want and r.decoded == library.decode(want)
        data = text.encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data
        assert all(a == b for a, b in zip(r.ends, r.starts[1:])) and r.starts[-1] == r.ends[-1] == len(data)


def test_digests_and_counts(spark, library):
    df = frame(spark, TEXTS)
    want = sorted((hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len(ids))
                  for ids in (library.encode(t or "", add_eos=True) for t in TEXTS))
    got = sp_codec.digests(sp_codec.encode(df, PIECE_MODEL)).collect()
    assert sorted((r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in got) == want
    counted = token_counts.count_tokens(df, PIECE_MODEL)
    assert counted.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expect = sorted(((i if t != "the same" else -1), len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in enumerate(TEXTS))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counted.collect()) == expect


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sp_codec.encode(none, PIECE_MODEL).count() == 0 and token_counts.count_tokens(none, PIECE_MODEL).count() == 0


def test_small_blocks_and_hot_words_give_the_same_counts(spark, library, monkeypatch):
    texts = [f"the common words and the rare{i} one " * (1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PIECE_MODEL).collect()}
    assert got == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    model = P.pieces(PIECE_MODEL)
    rows = list(token_counts._frequencies(model, [model.normaliser.text(t) for t in texts], 7, 16))
    hot = (7 * 0x9E3779B1 >> 16) % 16
    where = {bucket for bucket, tokens, *_ in rows if "▁common".encode() in tokens}
    assert where == {hot}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    model = P.pieces(PIECE_MODEL)
    ids, n, starts, ends = sp_codec.encode_block(model, [text, "", text], True)
    want = model.library.encode(text, add_eos=True)
    assert ids.tolist() == want + [model.end] + want and n.tolist() == [len(want), 1, len(want)]
    data = text.encode()
    assert b"".join(data[a:b] for a, b in zip(starts[:n[0]], ends[:n[0]])) == data


def test_colliding_hashes_fall_back_to_the_strings(monkeypatch):
    monkeypatch.setattr(P, "run_hashes", lambda codes, starts, ends, k: (ends - starts).astype(np.uint64) if k == 0 else starts.astype(np.uint64))
    model = P.Pieces(PIECE_MODEL)
    ids, n, *_ = sp_codec.encode_block(model, ["some words of equal size same more"], False)
    assert ids.tolist() == model.library.encode("some words of equal size same more", add_eos=True)


def compiled(rules: dict[str, str]) -> bytes:
    """A character map in the published format: a double array over UTF-8 bytes, then the strings."""
    strings, at = b"", {}
    for new in rules.values():
        at.setdefault(new, len(strings)) if new in at else at.update({new: len(strings)})
        strings += new.encode() + b"\0"
    tree: dict = {}
    for old, new in rules.items():
        node = tree
        for c in old.encode():
            node = node.setdefault(c, {})
        node[-1] = at[new]
    units, used, bases = {0: 0}, {0}, set()

    def place(node: dict, pos: int) -> None:
        labels = [0 if c == -1 else c for c in node]
        base = next(b for b in range(1, 1 << 16) if b not in bases and all((b ^ c) not in used for c in labels) and (pos ^ b) < (1 << 21))
        bases.add(base)
        for c in labels:
            used.add(base ^ c)
        units[pos] = units.get(pos, 0) | ((pos ^ base) << 10) | ((1 << 8) if -1 in node else 0)
        for c, child in node.items():
            if c == -1:
                units[base] = child | (1 << 31)
            else:
                units[base ^ c] = c
                place(child, base ^ c)

    place(tree, 0)
    size = max(units) + 257
    array = b"".join(struct.pack("<I", units.get(i, 0)) for i in range(size))
    return struct.pack("<I", len(array)) + array + strings


def test_longest_prefix_map_and_alignment():
    spec = SimpleNamespace(precompiled_charsmap=compiled({"ﬁ": "fi", "a": "b", "ab": "Z", "abc": "yy", "　": " ", "x": ""}),
                           add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True)
    n = P.Normaliser(spec)
    text, origin = n.aligned("abd ﬁ　xabcq")
    assert text == "▁Zd▁fi▁yyq"
    data = text.encode()
    assert len(origin) == len(data) + 1
    source = "abd ﬁ　xabcq".encode()
    spans = {}
    for piece in ("Z", "d", "fi", "yy", "q"):
        a = data.index(piece.encode())
        spans[piece] = (origin[a], origin[a + len(piece)])
    assert source[slice(*spans["Z"])] == b"ab" and source[slice(*spans["d"])] == b"d"
    assert source[slice(*spans["fi"])] == "ﬁ".encode() and source[slice(*spans["q"])] == b"q"
    trim = P.Normaliser(SimpleNamespace(precompiled_charsmap=b"", add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True))
    assert trim.aligned("  a   b  ")[0] == "▁a▁b" and trim.aligned("   ")[0] == ""
