import base64
import random
from pathlib import Path

import pytest
import tiktoken

from tickforge.llm import bpe

DATA = Path(bpe.VOCABULARY).read_bytes()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
TIKTOKEN = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=RANKS, special_tokens={})


def naive(data):
    """Merging by scanning all pairs again and again."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        ranked = [(RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in RANKS]
        if not ranked:
            return [RANKS[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def texts(seed, n=150):
    r = random.Random(seed)
    alphabet = "abcdefgh ABC  \n\t'123.,!?äßéñ中文日本語🙂👍́​­\x00�"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 90))) for _ in range(n)] + ["<|endoftext|> a <|endoftext|>", "we'll they're I'm", " " * 999, "\n\n\n x", "１２３ ½ Ⅷ"]


@pytest.mark.parametrize("seed", range(3))
def test_texts_against_a_public_implementation(seed):
    e = bpe.Encoder(DATA)
    sample = [*texts(seed), "", None]
    ids, counts = e.encode(sample)
    at = 0
    for text, n in zip(sample, counts, strict=True):
        assert ids[at : at + n].tolist() == TIKTOKEN.encode_ordinary(text or "")
        at += n
    assert at == len(ids)
    assert e.count(sample).tolist() == counts.tolist()


def test_pieces_against_naive_merging():
    r = random.Random(9)
    tree = bpe.SegmentTreeBPE(RANKS)
    for _ in range(150):
        data = bytes(r.choice(b"aabcde etnr\xe4\xb8\xad\xff") for _ in range(r.randrange(0, 50)))
        assert tree.merge(data) == naive(data)


def test_very_long_piece():
    data = b"ab" * 40_000
    assert bpe.SegmentTreeBPE(RANKS).merge(data) == TIKTOKEN.encode_ordinary(data.decode())


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_IDS", 10)
    e = bpe.Encoder(DATA)
    for text in texts(5, 40):
        assert e.encode([text])[0].tolist() == TIKTOKEN.encode_ordinary(text)


def test_rows(spark):
    data = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x"), (1, "Hello world", "x"), (5, "long " * 50_000, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids string")
    got = [(r.doc_id, r.ids) for r in bpe.encode_texts(df).collect()]
    assert sorted(got, key=str) == sorted(((i, TIKTOKEN.encode_ordinary(t or "")) for i, t, _ in data), key=str)
    assert bpe.encode_texts(df.limit(0)).collect() == []
