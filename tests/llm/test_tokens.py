import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakline.llm import packing, token_files
from cloakline.llm.tokens import Encoder, tokenizer_path

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def brute(path, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_word_memory_gives_the_library_ids(name):
    encoder = Encoder(tokenizer_path(name), most_words=20)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=255), st.sampled_from(" \n\t'sſİ漢é<|>")), max_size=40), max_size=4))
    def check(texts):
        assert list(encoder.encode_all(texts, 30)) == [np.array(encoder.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, mode):
    ids = np.array(ids, "<u4")
    assert (token_files.from_planes(token_files.to_planes(ids, mode), len(ids), mode) == ids).all()


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_file_reads_any_document(mode):
    rng = np.random.default_rng(1)
    docs = [(None if k == 3 else k, rng.integers(0, 50_000, rng.integers(0, 90)).astype("<u4").tobytes()) for k in range(40)]
    sink = io.BytesIO()
    writer = token_files.PlaneWriter(sink, block_ids=64, mode=mode)
    for d in docs:
        writer.add(*d)
    n = writer.close()
    assert n == len(sink.getvalue())

    class Source(io.BytesIO):
        def size(self):
            return n

    reader = token_files.PlaneReader(Source(sink.getvalue()))
    assert [reader.ids(k) for k in reversed(range(40))] == [d[1] for d in reversed(docs)]
    assert [x[0] for x in reader.documents()] == [d[0] for d in docs]


def test_token_files_round_trip(spark, documents):
    path = tokenizer_path("word_bpe_49k.json")
    got = token_files.token_files(documents, path, 1, chars_per_file=9000, block_ids=100).collect()
    rows = sorted(got, key=lambda r: r.start)
    assert len(rows) == documents.count() and [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 4, 5, 6, 7]
    texts = {r.doc_id: r.text for r in documents.collect()}
    at = 0
    for r in rows:
        ids = brute(path, texts[r.doc_id]) + [1]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_token_files_of_an_empty_table(spark, documents):
    assert token_files.token_files(documents.limit(0), tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_packing_covers_each_id_once(spark, documents):
    path = tokenizer_path("byte_bpe_50k.json")
    pieces = packing.pack(documents.coalesce(1), path, tiers=(256, 128, 64), step_tokens=512, flush_tokens=3000).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = np.array(brute(path, texts[doc]) + [0], "<u4").tobytes()
        copies = 2 if doc == 4 else 1
        own.sort(key=lambda p: p.start)
        assert sum(p.length for p in own) == copies * len(ids) // 4
        for p in own:
            assert p.doc_tokens == len(ids) // 4 and bytes(p.ids) == ids[4 * p.start : 4 * (p.start + p.length)] and zlib.crc32(bytes(p.ids)) >= 0
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0] + [p.length for p in own])[:-1])
        total = sum(p.length for p in own)
        assert total <= 256 and total & (total - 1) == 0
        assert len({(p.tier, p.step_group) for p in own}) == 1
    steps = defaultdict(int)
    for seq in by_seq.values():
        steps[seq[0].step_group] += sum(p.length for p in seq)
    assert max(steps.values()) <= 512


def test_packing_of_an_empty_table(spark, documents):
    assert packing.pack(documents.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
