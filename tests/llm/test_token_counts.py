import random

import public_tokenizers
from tokenizers import Tokenizer

from wardline.llm.token_counts import PrefixCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", "it's we'll they're 'tis 's 'll 'l don''t", "a  b", "a \n\n b\t", "x<|endoftext|>y", " <|endoftext|> <|endoftext|><|endof", "!<|endoftext|>!", "é è  ü  　z", "a   b \nc", "😀😀 日本語テキスト", "1234567 12.5", "a\x1c b\x85 c\x0b\x0cd", "''s '", "  's  'll   're", "Ünïcödé'S", "é x", "-" * 90, "aaaa" * 60, "\r\n\r\n  x"]


def real(spark, n):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(n).collect()]


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    rnd = random.Random(3)
    made = ["".join(rnd.choice("ab'sl l  \n\té<|>1!") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts = [None, *ODD, *made, *real(spark, 200), "word " * 40000]
    d = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    out = token_counts(d, PATH).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 512), (t[:80], r, n)
        if n > 512:
            cut = t.encode()[: r.bytes_in_limit].decode()
            assert len(lib.encode(cut, add_special_tokens=False).ids) <= 512
            more = t[len(cut) : len(cut) + 1]
            assert len(lib.encode(cut + more, add_special_tokens=False).ids) > 512
        else:
            assert r.bytes_in_limit == r.n_bytes
    assert token_counts(d.limit(0), PATH).count() == 0


def test_every_prefix(spark):
    lib, counter = Tokenizer.from_file(PATH), PrefixCounter(PATH)
    for t in ODD + [x[:400] for x in real(spark, 15)]:
        counts = counter.prefixes(t)
        assert len(counts) == len(t.encode())
        for k in range(1, len(t) + 1):
            assert counts[len(t[:k].encode()) - 1] == len(lib.encode(t[:k], add_special_tokens=False).ids), (t, k)
