"""Token files: exact round trip, prefix sums and selective reads."""

import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quorumlake.llm.common import fresh_path
from quorumlake.llm.tokenfile import digests, read_index, read_tokens, write_tokens


def test_round_trip(spark, docs_of):
    path = P.path("word_bpe_49k.json")
    rows = [(i * 7 % 101, f"Word{i} it's naïve <|endoftext|> {'long ' * i}") for i in range(101)] + [(200, None), (201, ""), (202, "\x1c x\x85y"), (50, "again"), (None, "no id"), (203, "word " * 50000)]
    at = fresh_path(spark, "test")
    write_tokens(docs_of(rows), at, path)
    tk, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, digests(spark, at).collect()), key=lambda r: r[1])
    assert got == want
    assert sorted(map(tuple, read_index(spark, at).collect()), key=lambda r: r[1]) == [w[:3] for w in want]
    assert {r.doc_id: len(r.tokens) for r in read_tokens(spark, at, 3, 5).collect()} == {w[0]: w[2] for w in want if w[0] in (3, 4, 5)}


def test_empty(spark, docs_of):
    at = fresh_path(spark, "test")
    write_tokens(docs_of([]), at, P.path("word_bpe_49k.json"))
    assert digests(spark, at).count() == 0


def test_other_vocabulary(spark, docs_of):
    path, at = P.path("byte_bpe_50k.json"), fresh_path(spark, "test")
    rows = [(i, f"Word{i}  it's\n\tnaïve <|endoftext|> {'long ' * i}") for i in range(30)]
    write_tokens(docs_of(rows), at, path)
    tk = Tokenizer.from_file(path)
    got = {r.doc_id: list(r.tokens) for r in read_tokens(spark, at, 0, 99).collect()}
    assert got == {i: tk.encode(t, add_special_tokens=False).ids + [2] for i, t in rows}
