import os
import random

import pytest

from heliograph.llm import tokens

FOLDER = tokens.TOKENIZER_DIR
pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(FOLDER, "byte_bpe_50k.json")), reason="no vocabulary files")

TEXTS = [
    None, "", " ", "it's", "we'Ll 12345678 ½ ⅷ ٣٤", "x  y\n\n z\t\t", "   hi \x1c\x1d there\u0085x", "<|endoftext|> ok", "日本語のテキスト" * 40, "👨‍👩‍👧👍🏽",
    "\r\n\r\n", "é̈", "ﬁ ﷽ \U0001f600\U00020000", "a" * 2000, "ab" * 300, "-" * 1000, "word " * 500,
    "a" * 256, "ab" * 128 + "c", "x " + "日本" * 43 + " y", "文字" * 30_000, "".join(chr(97 + i * i % 23) for i in range(100_000)),
]


@pytest.fixture(scope="module")
def expected():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("learn", [True, False])
def test_ids(spark, expected, learn):
    rng = random.Random(4)
    alphabet = "ab cd'sé日 \n\t1२½.,!—\xa0🙂"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(80)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, ids int")
    if learn:
        encoded = tokens.encode_documents(df)
    else:
        encoded = tokens.Tokenizer().encode(df)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert [i for i, t in enumerate(texts) if got[i] != expected(t)] == []


def test_other_vocabulary(spark):
    import base64

    import tiktoken

    name = "byte_bpe_multi_50k.tiktoken"
    with open(os.path.join(FOLDER, name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    texts = ["Olá, ação e coração 2024", "日本語のテキスト", "größer"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = tokens.encode_documents(df, tokens.Tokenizer(name)).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [own.encode_ordinary(t) for t in texts]


def test_round_trip_and_empty(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    t = tokens.Tokenizer()
    got = {r.doc_id: r.back for r in t.decode(tokens.encode_documents(df, t).select("doc_id", "ids"), text_col="back").collect()}
    assert [i for i, x in enumerate(TEXTS) if got[i] != (x or "")] == []
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_counts(spark, expected):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert [i for i, t in enumerate(TEXTS) if got[i] != len(expected(t))] == []


def test_heap_merges_are_the_fold(expected):
    rng = random.Random(9)
    ranks = {bytes.fromhex(k): r for k, r in tokens.Tokenizer().ranks.items()}
    for size in (1, 2, 3, 10, 300):
        for _ in range(200):
            word = "".join(rng.choice("abcdeé") for _ in range(size))
            assert tokens.merged_ids(word.encode(), ranks) == expected(word)


def test_long_words_cost_no_square():
    import time

    ranks = {bytes.fromhex(k): r for k, r in tokens.Tokenizer().ranks.items()}
    spent = []
    for size in (50_000, 400_000):
        word = bytes(97 + i * i * 7 % 23 for i in range(size))
        start = time.perf_counter()
        tokens.merged_ids(word, ranks)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 30 * spent[0]
