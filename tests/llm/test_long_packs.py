"""Packing: ids of very long runs are those of the tokenizers library, and names that clash are refused."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import pack

LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " " * 1_000_000 + "y", "\t \n" * 400_000, "\u00a0" * 1_000_000 + "<|endoftext|>"]


def test_ids():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(LONG, pack.encode(LONG), strict=True):
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, pack.END_ID]


def test_report(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate([*LONG, "short", None])], "doc_id long, text string")
    rows = pack.report(docs).orderBy("doc_id", "start").collect()
    for i, text in enumerate([*LONG, "short", ""]):
        ids, own = pack.encode([text])[0], [r for r in rows if r.doc_id == i]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].astype(np.dtype("<u4")).tobytes())


def test_names(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string").withColumn("part", F.lit(1))
    with pytest.raises(ValueError, match="names of results"):
        pack.pieces(docs, keep=["doc_id", "part"])
