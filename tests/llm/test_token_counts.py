"""Token counts by distinct pre-tokens against the library over whole texts."""

import random

import pytest

from promptscreen.llm import token_counts as C

DOCS = "doc_id long, text string, n_bytes string, pieces int"


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=C.model_path(C.MODEL))


def counted(spark, data, **options):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], DOCS).repartition(3)
    return sorted((tuple(r) for r in C.count_tokens(df, **options).collect()), key=repr)


def expected(model, data):
    return sorted(((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in data), key=repr)


BITS = ["a", "the", "The", " ", "  ", "\n", "\r\n", "\t", "▁", "é", "é", "ﬁ", "日本語", "🙂", "👩‍👩‍👧", "​", "\xa0", " ", "\x00", "\x1c", " ", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "0", "12345", "={}();", "�", "\U0010ffff", "İ", "ß", "a" * 300, " " * 40]


def test_pretokens(model):
    """Cut at pre-tokens, strings of odd Unicode have as many pieces as whole."""
    rng = random.Random(4)
    counts = C.piece_counter(C.model_path(C.MODEL))
    for k in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25)))
        if k % 4 == 0:
            text = "".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0xE000, 0x11000)])) for _ in range(20))
        assert sum(counts(C.pretokens(text))) == len(model.encode(text)), repr(text)


def test_odd_rows(spark, model):
    data = [(1, None), (2, ""), (3, " "), (4, "a b a"), (4, "a b a"), (None, "x y"), (None, None), (5, "wörter " * 40_000), (6, "x" * 100_000), (7, "\n\n ▁ "), (8, "<s> a</s>")]
    for common in (0, 2, C.COMMON):
        assert counted(spark, data, common=common) == expected(model, data)
    assert counted(spark, []) == []


def test_one_pretoken_in_all_rows(spark, model):
    """What many documents share is summed where they are; long pre-tokens too."""
    data = [(i, f"common {'long' * 500} {i * 7919 % 101} x{i}") for i in range(300)]
    for common in (0, 1, 3, C.COMMON):
        assert counted(spark, data, common=common) == expected(model, data)


def test_common_is_bounded(spark):
    vocab = spark.createDataFrame([(f"w{i}", 1 + 1000 // (i + 1), i) for i in range(500)], "pretoken string, uses long, pieces long")
    for most in (0, 1, 10, 499, 500, 1000):
        got = C.common_counts(vocab, most)
        assert len(got) <= most and all(v == int(k[1:]) for k, v in got.items())
        if 1 <= most < 500:
            assert "w0" in got or most == 0
    assert len(C.common_counts(vocab, 500)) == 500


def test_query(spark, sf, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = C.op13_token_counts(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(model.encode(docs[r.doc_id] or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_other_vocabularies_are_refused(tmp_path):
    """A model whose pieces may cross a space is not counted by pre-tokens."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(C.model_path(C.MODEL), "rb") as f:
        m.ParseFromString(f.read())
    m.pieces[-1].piece = "of▁the"
    path = tmp_path / "other.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="cannot be cut"):
        C.piece_counter(str(path))
