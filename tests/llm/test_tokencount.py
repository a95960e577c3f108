import random

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import tokencount
from tests.llm.data import awkward, documents, prose

PATH = tokencount.model_path(None)


def whole(text):
    return len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text or ""))


def by_chunks(text, chunk, overlap, widen=4):
    """The count of one text by the module's own chunks and splices, without Spark."""
    enc = tokencount.worker_encoder(PATH)
    while True:
        at = tokencount.windows(len(text), chunk, overlap)
        got = [enc.tokens(text[a:b]) for a, b in at]
        total, failed = sum(len(ids) for ids, _ in got), False
        for k in range(1, len(at)):
            lo = at[k][0]
            (a, ae), (b, be) = got[k - 1], got[k]
            ae, be = ae + at[k - 1][0] - 1, be + lo - 1
            left, right = ae > lo, be <= lo + overlap
            off = tokencount.splice((a[left], ae[left], enc.width[a[left]]), (b[right], be[right], enc.width[b[right]]), lo)
            failed |= off is None
            total -= off or 0
        if not failed:
            return total
        chunk, overlap = chunk * widen, overlap * widen


@given(st.text(alphabet="ab e\n\té漢字🙂  th=in<s>0x", max_size=400), st.integers(8, 40), st.integers(1, 7))
@settings(max_examples=600, deadline=None)
def test_spliced_chunks_equal_the_whole_text(text, chunk, overlap):
    enc = tokencount.worker_encoder(PATH)
    assert enc.splices
    assert by_chunks(text + "x" * 50, chunk, overlap) == len(enc.model.encode(text + "x" * 50))


def test_offsets_follow_the_text():
    enc = tokencount.worker_encoder(PATH)
    for text in ("a  b", "Ａé漢\t🙂x", "==== a"):
        ids, ends = enc.tokens(text)
        assert ends[-1] == len(text) + 1


def test_counts_of_awkward_and_huge_texts(spark):
    rnd = random.Random(5)
    rows = awkward() + [(20 + i, t) for i, t in enumerate((
        prose(rnd, 20_000), "=" * 90_000, prose(rnd, 5000) + "a" * 70_000 + prose(rnd, 5000), "漢字🙂" * 30_000, " " * 100_000,
        "ab" * 40_000 + "\n" * 60_000, "<s>" * 30_000))] + [(20, prose(rnd, 30_000)), (None, prose(rnd, 9_000))]
    got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(
        documents(spark, rows), chunk=1 << 12, overlap=64).collect()))
    want = sorted((i or -1, len((t or "").encode()), whole(t), whole(t) > 4096) for i, t in rows)
    assert got == want
    assert tokencount.count_tokens(documents(spark, [])).count() == 0


def test_bad_chunks_are_refused(spark):
    with pytest.raises(ValueError):
        tokencount.count_tokens(documents(spark, []), chunk=10, overlap=10)
