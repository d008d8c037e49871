import hashlib
import json
import random
import struct

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridcells.llm import bpe_automaton
from gridcells.llm.queries import bpe_automaton_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ours():
    return bpe_automaton.automaton(PATH)


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@given(st.text(max_size=80) | st.text(alphabet="abeinorst ñéß\n0.'<|>endoftx", max_size=200)
       | st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "the", "\n", "<|", "'s", "  "]), max_size=12).map("".join))
@settings(max_examples=500, deadline=None)
def test_as_the_library(ours, theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


@given(st.lists(st.integers(0, 50_256), max_size=30))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_as_the_library_does(ours, theirs, ids):
    assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_split_classes_of_all_characters(ours, theirs):
    texts = ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}\n" for c in range(k, k + 64) if not 0xD800 <= c < 0xE000) for k in range(0, 0x30000, 64)]
    for text, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text) == e.ids


def plain_merges(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    parts = [word[i:i + 1] for i in range(len(word))]
    for u, v in merges:                                      # in order, each from left to right
        i = 0
        while i < len(parts) - 1:
            if (parts[i], parts[i + 1]) == (u, v):
                parts[i:i + 2] = [u + v]
            i += 1
    return parts


def test_automaton_accepts_exactly_what_merging_gives():
    rng = random.Random(7)
    for _ in range(120):
        labels, merges, named = [b"a", b"b", b"c"], [], []
        for _ in range(rng.randint(0, 9)):
            u, v = rng.randrange(len(labels)), rng.randrange(len(labels))
            if labels[u] + labels[v] not in labels:
                merges.append((u, v, len(labels)))
                named.append((labels[u], labels[v]))
                labels.append(labels[u] + labels[v])
        machine = bpe_automaton.Automaton(labels, merges)
        for _ in range(25):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            want = [labels.index(p) for p in plain_merges(word, named)]
            assert machine.accepts(want)
            assert np.frombuffer(machine.run_together([word])[0], np.int32).tolist() == want
            assert np.frombuffer(machine.run_alone(word), np.int32).tolist() == want
            other, at = [], 0
            while at < len(word):                            # any other way to spell the word is refused
                t = rng.choice([i for i, x in enumerate(labels) if word.startswith(x, at)])
                other.append(t)
                at += len(labels[t])
            assert machine.accepts(other) == (other == want)


def test_long_matches(ours, theirs):
    for text in ("x" * 5000, " " * 3000, "aab" * 2000, "naïve" * 900, "0123456789" * 300):
        assert ours.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_files_of_other_kinds_are_refused(tmp_path):
    spec = json.load(open(PATH))
    for part, key, value in (("model", "dropout", 0.1), ("model", "ignore_merges", True), ("pre_tokenizer", "add_prefix_space", True)):
        file = tmp_path / f"{key}.json"
        file.write_text(json.dumps(spec | {part: spec[part] | {key: value}}))
        with pytest.raises(ValueError):
            bpe_automaton.automaton(str(file))
    for merges in ([(0, 1, 3), (2, 1, 3)], [(3, 0, 2), (0, 1, 3)]):
        with pytest.raises(ValueError):
            bpe_automaton.Automaton([b"a", b"b", b"aba", b"ab"], merges)


def test_documents(spark, documents, odd_documents, theirs):
    for df in (documents.where("doc_id % 4 = 1"), odd_documents):
        rows = df.select("doc_id", "text").collect()
        ids = [e.ids for e in theirs.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
        got = bpe_automaton.encode(df, PATH)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((r.doc_id, i) for r, i in zip(rows, ids, strict=True)), key=str)
        assert sorted(map(tuple, bpe_automaton.decode(got, PATH).collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in rows), key=str)
        small = bpe_automaton.encode(df, PATH, remember=10, n_bytes=1 << 12)
        assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)
    assert bpe_automaton.encode(odd_documents.limit(0), PATH).count() == 0


def test_query(spark, theirs):
    folder = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe_automaton_digests(spark, folder).collect())) == sorted(want)
