import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.tokens import counter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def ours(texts):
    data = [t.encode() for t in texts]
    return counter(PATH).counts(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])).tolist()


def library(texts):
    return [len(x) for x in LIBRARY.encode(texts, num_threads=1)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("abtheing \n", max_size=80), st.text("▁ <s>/0xAé漢", max_size=40)), min_size=1, max_size=5))
def test_any_text(texts):
    assert ours(texts) == library(texts)


def test_long_runs():
    texts = [" " * 5000, "a" * 4000, "ab" * 3000, "the" * 2000, "=" * 3001, "1234567890" * 300, "the quick brown fox " * 900, "", "<s></s><unk><0x0A>", "\0\n\t\r"]
    assert ours(texts) == library(texts)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: (len(r.text.encode()), n, n > 4096) for r, n in zip(docs.collect(), library([r.text for r in docs.collect()]))}
    assert {r.doc_id: tuple(r)[1:] for r in token_counts(docs, PATH).collect()} == want


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, 9, "x"), (None, "", 9, "x"), (2, "a b", 9, None), (2, "a b", 9, None)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, id string"), PATH).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (None, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False)], key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
