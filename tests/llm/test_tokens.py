import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tablewise.llm import packing, tokencount

from .conftest import rows_of_documents

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "  a  b  ", "x▁y ▁ z", "\n a", "a \n b", "don't  stop", "<s> </s> <unk>", "<|endoftext|>a <|endoftext|>", "é 漢字 🙂 a",
       "a\u00a0b \u2003 c", "1 22 333 4444", "\t\ttabs \t", "a " * 50, "\x1c a \x1f", "!!! ... ??? a!b", " \u2028 x"]


def texts():
    rnd = random.Random(5)
    return ODD + ["".join(rnd.choice("ab c  \nd'é1.") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]


def test_piece_counter_equals_the_library():
    path = P.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = tokencount.PieceCounter(path, most=100)
    assert counter.runs
    for i in range(0, 1500, 100):
        part = texts()[i:i + 100]
        assert counter.count(part) == [len(x) for x in plain.encode(part)]


def test_piece_ids_equal_the_library():
    path = P.path("byte_bpe_50k.json")
    whole, ids = Tokenizer.from_file(path), packing.PieceIds(path, most=100)
    for i in range(0, 1500, 100):
        part = texts()[i:i + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.encode(part)] == [e.ids for e in whole.encode_batch(part, add_special_tokens=False)]


def test_counts_and_cache(docs, no_docs, tmp_path):
    path = P.path("piece_bpe_32k.model")
    plain = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r[0], len((r[1] or "").encode()), len(plain.encode(r[1] or ""))) for r in rows_of_documents())
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = tokencount.count_tokens(docs, path, cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
        stored = docs.sparkSession.read.parquet(cache)
        assert stored.count() == len({r[1] or "" for r in rows_of_documents()})
    assert tokencount.count_tokens(no_docs, path).count() == 0
    assert tokencount.count_tokens(docs, P.path("word_bpe_49k.json")).count() == docs.count()


@pytest.mark.parametrize("most", [64, 2048])
def test_packing(docs, most):
    path = P.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = Counter()
    for r in rows_of_documents():
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        head = len(ids) % most
        edges = ([0] if head else []) + list(range(head, len(ids), most)) + [len(ids)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want[r[0], n, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack_documents(docs, path, most).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    total = sum(r.length for r in got)
    assert len(filled) <= -(-total // most) * 1.05 + 1


def test_packing_empty(no_docs):
    assert packing.pack_documents(no_docs, P.path("byte_bpe_50k.json")).count() == 0


def test_sweeps_place_everything():
    rnd = random.Random(1)
    for most in (1, 7, 100):
        counts = {n: rnd.randint(0, 40) for n in range(1, most + 1)}
        placed, room = Counter(), defaultdict(list)
        for length, lo, n, each, first, offset in packing.sweeps(counts, most):
            assert lo == placed[length]
            placed[length] += n * each
            for s in range(first, first + n):
                room[s] += [(offset + i * length, length) for i in range(each)]
        assert +placed == +Counter(counts)
        for spans in room.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= most
