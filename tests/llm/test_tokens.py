import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.isdir(tokens.TOKENIZERS), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def small():
    return tokens.Coder(tokens.ranks_file("byte_bpe_50k"), leaf=8, reach=2)


PIECES = ["the ", "word", " ", "  ", "\n", "\n\n", "'", "'ll", "'s", "don't ", "12", "3.14 ", "é", "漢字", "🙂", "<|endoftext|>", "_", "--", "\t", " ", "　", "​", "a" * 30, "x y ", "\r\n", ". "]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=120))
def test_tree_gives_what_one_pass_gives(text):
    coder = _coder()
    text = text.encode("utf-8", "replace").decode()
    assert coder.encode(text) == coder.encode_once(text)
    assert coder.decode(coder.encode(text)) == text


def _coder(kept={}):  # noqa: B006
    if not kept:
        kept[0] = tokens.Coder(tokens.ranks_file("byte_bpe_50k"), leaf=4, reach=1)
    return kept[0]


def test_against_the_other_library(small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ("".join(PIECES), "plain words in a row " * 300, "a" * 5000, " " * 3000 + "x", "漢字かな" * 500, "<|endoftext|>" * 3):
        assert small.encode(text) == t.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " ", 0), (4, "same text", 0), (4, "same text", 0), (5, "long words " * 20_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = tokens.encoded(df, F.col("text")).collect()
    assert len(got) == 6 and [list(r["ids"]) for r in got if r["doc_id"] in (1, 2)] == [[], []]
    back = tokens.encoded(df.withColumn("doc_id", F.struct("doc_id", "text")), F.col("text")).select("doc_id.text", tokens.decoder(spark)("ids").alias("b"))
    assert back.filter(F.coalesce("text", F.lit("")) != F.col("b")).count() == 0
    assert tokens.encoded(df.limit(0), F.col("text")).count() == 0
