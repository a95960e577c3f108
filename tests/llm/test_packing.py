import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import binpack, packing
from opslens.llm.tokens import ChunkIds, vocabulary_path
from tests.llm.data import awkward, documents


@pytest.fixture(scope="module")
def cache():
    return ChunkIds(vocabulary_path(None), most=50)


@given(st.text(alphabet="aAbéÉßİΣñ²1,.'’<|>\n\t ́ 　漢ǅ", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_tokenizer(cache, text):
    for t in (text, text + "<|endoftext|> it's " + text):
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == cache.whole.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 90), max_size=60))
@settings(max_examples=100, deadline=None)
def test_balance_places_every_token_once(lengths):
    pieces, n = packing.balance(lengths, 20, 1.0, 0.1)
    seen = {d: [] for d in range(len(lengths))}
    filled = [0] * n
    for d, at, size, seq, off in pieces:
        seen[d].append((at, size))
        assert off == filled[seq]
        filled[seq] += size
    assert all(0 < f <= 20 for f in filled)
    assert 20 * n - sum(lengths) < 20  # less than one sequence of padding
    for d, parts in seen.items():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end == lengths[d]


@given(st.lists(st.integers(1, 90), max_size=60))
@settings(max_examples=100, deadline=None)
def test_best_fit_against_a_plain_search(lengths):
    got = binpack.best_fit(lengths, 20)
    room, want = [], sum(n // 20 for n in lengths)
    for n in sorted((n % 20 for n in lengths if n % 20), reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(20 - n)
    assert len(got) == want + len(room)
    assert sorted(sum(p[2] for p in s) for s in got) == sorted([20] * want + [20 - r for r in room])
    covered = sorted((d, at + k) for s in got for d, at, n in s for k in range(n))
    assert covered == [(d, k) for d, n in enumerate(lengths) for k in range(n)]


def test_pieces_of_awkward_rows(spark, cache):
    rows = awkward()
    got = packing.pack(documents(spark, rows), capacity=64, window_tokens=3000).collect()
    want = sorted(((i, (cache.ids(t or "") + b"\x01\0\0\0")) for i, t in rows), key=lambda r: (str(r[0]), len(r[1])))
    pieces = sorted(got, key=lambda r: (str(r["doc_id"]), r["start"]))
    ids = {}
    for i, body in want:
        ids.setdefault(i, body)
    for r in pieces:
        body = ids[r["doc_id"]][4 * r["start"]:4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(body) and r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
    assert sum(r["length"] for r in got) == sum(len(b) // 4 for _, b in want)
    for seq in {r["sequence_id"] for r in got}:
        own = sorted((r for r in got if r["sequence_id"] == seq), key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 64


def test_matrix_round_trip(spark, cache, tmp_path):
    rows = awkward()
    packed = binpack.pack_matrix(documents(spark, rows), capacity=64, window_tokens=3000)
    binpack.write_matrix(packed, str(tmp_path / "m"))
    got = spark.read.parquet(str(tmp_path / "m")).collect()
    assert binpack.matrix([bytes(r["ids"]) for r in got], 64).shape == (len(got), 64)
    pieces = []
    for r in got:
        row = np.frombuffer(bytes(r["ids"]), "<u2")
        assert r["position_resets"] == r["cu_seqlens"][:-1] and r["cu_seqlens"][-1] == r["n_tokens"]
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            pieces.append((str(doc), start, row[a:b].tolist()))
    want = {str(i): [*np.frombuffer(cache.ids(t or ""), "<u4").tolist(), binpack.END_ID] for i, t in rows}
    for doc, start, part in pieces:
        assert want[doc][start:start + len(part)] == part
    assert sum(len(p[2]) for p in pieces) == sum(
        len(np.frombuffer(cache.ids(t or ""), "<u4")) + 1 for _, t in rows)


def test_empty_tables(spark):
    none = documents(spark, [])
    assert packing.pack(none).count() == 0 and binpack.pack_matrix(none).count() == 0
