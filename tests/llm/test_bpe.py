import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridcells.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.vocabulary(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(max_size=80) | st.text(alphabet="abeinorst ñéß\n0.", max_size=200))
@settings(max_examples=400, deadline=None)
def test_as_the_library(ours, theirs, text):
    assert ours.encode(text).tolist() == theirs.encode_ordinary(text)
    assert ours.decode(ours.encode(text).tolist()) == text.encode()


def test_merges_alone_reach_what_the_table_says(ours):
    for word in (" internationalisation", "Donaudampfschifffahrt", "aaaaaaaaaaaaaaaaaaab", "ééééñññ"):
        assert bpe.Prefixes(ours, word.encode()).ids() == ours.merge(word.encode())


def test_pairs_as_plain_merging(ours):
    assert ours.ordered
    rng = np.random.default_rng(1)
    some = rng.integers(0, len(ours.tokens), (4000, 2)).tolist()
    some += [(ours.ranks[a], ours.ranks[b]) for a in (b"th", b" ", b"in", b"aa", b"a", b"e") for b in (b"e", b"th", b"g", b"a", b"aa", b"r", b"ing")]
    for left, right in some:
        assert ours.stays_apart(left, right) == (ours.merge(ours.tokens[left] + ours.tokens[right]) == [left, right])


@given(st.text(alphabet="abcdeinrstñé ", max_size=60), st.text(alphabet="aeinñ", max_size=12), st.data())
@settings(max_examples=150, deadline=None)
def test_appends_prefixes_and_edits(ours, text, more, data):
    raw = text.encode()
    table = bpe.Prefixes(ours)
    for i in range(len(raw)):
        table.append(raw[i:i + 1])
    assert table.last == bpe.Prefixes(ours, raw).last
    end = data.draw(st.integers(0, len(raw)))
    assert table.ids(end) == ours.merge(raw[:end]) or not end
    start = data.draw(st.integers(0, end))
    table.edit(start, end, more.encode())
    assert table.last == bpe.Prefixes(ours, raw[:start] + more.encode() + raw[end:]).last


def test_edits_stop_where_entries_agree(ours):
    raw = ("the quick brown fox " * 400).encode()
    table = bpe.Prefixes(ours, raw)
    assert table.edit(3000, 3005, b"slow ") < 3 * ours.longest
    assert table.last == bpe.Prefixes(ours, raw[:3000] + b"slow " + raw[3005:]).last


def test_documents(spark, documents, odd_documents, theirs):
    for df in (documents.where("doc_id % 4 = 1"), odd_documents):
        out = bpe.digests(bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)).collect()
        both = bpe.digests(bpe.encode(df, PATH, public_tokenizers.PATTERN, and_decode=True)).collect()
        assert sorted(map(tuple, out), key=str) == sorted(map(tuple, both), key=str)
        want = []
        for r in df.select("doc_id", "text").collect():
            ids, raw = theirs.encode_ordinary(r.text or ""), (r.text or "").encode()
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()))
        assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert bpe.encode(odd_documents.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
