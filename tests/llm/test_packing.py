import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import edge_rows, frame
from tokenizers import Tokenizer

from storyloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(tokenizer, docs, got, limit=4096):
    """docs: (id, text); pieces join to the ids of each row, lengths are powers of two, numbers are 1, 2, 3 by bucket."""
    assert sorted(r.sequence_id for r in got) == list(range(1, len(got) + 1)) and all(r.offset == 0 for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths) and all(n & (n - 1) == 0 and 0 < n <= limit for n in lengths)
    want = defaultdict(int)
    for i, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        start = 0
        while start < len(ids):
            n = min(limit, 1 << (len(ids) - start).bit_length() - 1)
            want[i, start, n, zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()), len(ids)] += 1
            start += n
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert have == want


def test_edges(spark, edge, none, tokenizer):
    check(tokenizer, [(i, t) for i, t, _ in edge_rows()], packing.pack(edge).collect())
    check(tokenizer, [(i, t) for i, t, _ in edge_rows()], packing.pack(edge, limit=8).collect(), 8)
    assert packing.pack(none).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge, limit=100)


def check_texts(encoder, tokenizer, texts):
    got = encoder.texts([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_as_in_the_whole_text(monkeypatch, tokenizer):
    texts = ["Don't  STOP 'tis o'clock !!'s 12345 é ́x   y\x1cz\x85w Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul <|endoftext|>a b<|startoftext|>",
             "漢字かな交じり文 한국어 각 👩‍👩‍👧 ﬁ Å Ω", "\x00\x01 \t\v\f\r\n", "U.S.A. a.'s x,'tis 3.14,15 q!!? é.,? ≠ a≠b k&amp;l#m% …. <|endoftext|>.,a.<|endoftext|>!", "a" * 5000 + " " + "'s" * 300, ""]
    check_texts(packing.Encoder(PATH), tokenizer, texts)
    monkeypatch.setattr(packing, "SLICE", 7)
    monkeypatch.setattr(packing, "MEMORY", 3)
    check_texts(packing.Encoder(PATH), tokenizer, texts)


def test_query_and_buckets(spark, tokenizer, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(tokenizer, [(r.doc_id, r.text) for r in docs.collect()], queries.QUERIES["op13_packing"](spark, folder).collect())
    packed = packing.pack(docs, ids=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed.collect())
    packing.write_buckets(packed, f"{tmp_path}/buckets")
    back = spark.read.parquet(f"{tmp_path}/buckets")
    assert back.where("size(ids) <> length").isEmpty() and back.count() == packed.count()
