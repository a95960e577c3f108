"""Token counts of whole texts, huge ones by overlap resynchronisation.

Short texts are encoded as they are, in the scan. A text over ``chunk`` characters is cut into chunks that reach ``overlap``
characters back into the chunk before; the chunks are dealt over all tasks and encoded with offsets. Two neighbours are
spliced at a token that both have at the same place. That place is proven stable: pair merging resolves a text into
tokens exactly if it resolves every two adjacent tokens into themselves (until a merge first crosses a boundary, each
side evolves as it does alone), and left of the common token's end all adjacent pairs stand in the left chunk's
encoding, right of its start all stand in the right one's. So the splice is the encoding of the whole, and only counts
need to be kept: the tokens of all chunks, less those of the left chunk after the common token and those of the right
one up to it. Where an overlap holds no common token, the text goes through again with chunks and overlaps ``widen``
times as long; a chunk as long as the text needs no splice, so rounds end.

This holds for pair-merging piece models that leave the text as it is but for a blank mark in front and blanks read as
marks. Texts under any other model (``unigram``, or with a normaliser that rewrites them) are encoded whole.

Null and empty texts count nothing; repeated rows are counted alike, each on its own; a null id is kept; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import cut, slices, texts

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP, WIDEN = 1 << 16, 1 << 10, 4
_PROBE = "  Ａﬁ  é\t\n x "


def model_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Encoder:
    """The library's encoder and, per id, the characters that a token takes up of the marked text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.width = np.zeros(m.get_piece_size(), np.int64)
        for i in range(len(self.width)):
            # bytes of one character outside the vocabulary: the first takes its place, the others none
            self.width[i] = (int(m.id_to_piece(i)[3:-1], 16) & 0xC0 != 0x80) if m.is_byte(i) else len(m.id_to_piece(i))
        plain = m.normalize(_PROBE) == "▁" + _PROBE.replace(" ", "▁")
        kinds = range(len(self.width))
        # byte pieces stand for unknown characters, so no run of them is one token
        self.splices = plain and _merges(m) and any(map(m.is_byte, kinds)) and not any(map(m.is_unused, kinds))

    def counts(self, bodies: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(bodies, num_threads=1)]

    def tokens(self, body: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ends count from the mark in front of the body, which is character 0."""
        ids = np.array(self.model.encode(body, num_threads=1), np.int64)
        return ids, np.cumsum(self.width[ids])


def _merges(model) -> bool:
    """Whether the model merges pairs. Such a model's scores are falling whole numbers, the negated order of merges."""
    scores = [model.get_score(i) for i in range(model.get_piece_size()) if not (
        model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return all(s <= 0 and s == int(s) for s in scores)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; workers are reused, so it outlives a task."""
    home = sys.modules.setdefault("_token_encoders_of_this_worker", types.ModuleType("_token_encoders_of_this_worker"))
    made = getattr(home, "made", None)
    if made is None or made[0] != path:
        home.made = made = (path, Encoder(path))
    return made[1]


def windows(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(from, to) of the chunks of n characters."""
    last = max(1, -(-n // chunk))
    return [(max(0, i * chunk - overlap), min(n, (i + 1) * chunk)) for i in range(last)]


def splice(left: tuple, right: tuple, lo: int) -> int | None:
    """What joining two neighbours takes off the sum of their counts; None without a token that both have.

    ``left`` and ``right`` are (ids, ends, widths), with places in the whole text: the left chunk's tokens that end
    after ``lo``, where the overlap begins, and the right one's up to its end. Tokens are the same if id and end are.
    The mark in front of the right chunk is no part of the text, so a token that holds it does not count.
    """
    (a, a_end, a_width), (b, b_end, b_width) = left, right
    both, i, j = np.intersect1d(a_end, b_end, return_indices=True)
    same = (a[i] == b[j]) & (b_end[j] - b_width[j] >= lo) & (a_width[i] > 0)
    if not same.any():
        return None
    end = int(both[np.flatnonzero(same)[-1]])
    return int((a_end > end).sum() + (b_end <= end).sum())


PIECE = "part long, seam long, side int, n long, lo long, ids binary, ends binary"
_PIECE = pa.schema([("part", pa.int64()), ("seam", pa.int64()), ("side", pa.int32()), ("n", pa.int64()),
                    ("lo", pa.int64()), ("ids", pa.binary()), ("ends", pa.binary())])


def encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Chunks (part, no, last, lo, body) to counts (seam null) and what the seams on both sides need."""

    def run(batches):
        enc = worker_encoder(path)
        for batch in batches:
            for part, no, last, lo, body in zip(*(c.to_pylist() for c in batch.columns)):
                ids, ends = enc.tokens(body)
                ends += lo - 1  # the mark stands before the first character
                hi = lo + len(body)
                rows = [(part, None, 0, len(ids), lo, None, None)]
                for seam, side, at, kept in ((no, 1, lo, ends <= lo + overlap), (no + 1, 0, hi - overlap, ends > hi - overlap)):
                    if 0 < seam <= last:
                        rows.append((part, seam, side, 0, at, ids[kept].astype("<i4").tobytes(), ends[kept].astype("<i8").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PIECE)], schema=_PIECE)

    return chunks.mapInArrow(run, PIECE)


def spliced(pieces: DataFrame, path: str) -> DataFrame:
    """(part, off, failed) of every seam: two rows meet in one, by (part, seam)."""
    side = lambda k: F.max(F.when(F.col("side") == k, F.struct("lo", "ids", "ends")))
    seams = pieces.where("seam is not null").groupBy("part", "seam").agg(side(0).alias("l"), side(1).alias("r")).select(
        "part", "l.ids", "l.ends", F.col("r.ids").alias("ids2"), F.col("r.ends").alias("ends2"), F.col("r.lo").alias("lo"))
    schema = pa.schema([("part", pa.int64()), ("off", pa.int64()), ("failed", pa.int32())])

    def run(batches):
        width = worker_encoder(path).width
        for batch in batches:
            off = []
            for i in range(batch.num_rows):
                (a, b), (a_end, b_end) = ([np.frombuffer(batch.column(c)[i].as_py(), t) for c in cs]
                                          for cs, t in (((1, 3), "<i4"), ((2, 4), "<i8")))
                lo = batch.column(5)[i].as_py()
                off.append(splice((a, a_end, width[a]), (b, b_end, width[b]), lo))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(off, pa.int64()), pa.array(
                [int(x is None) for x in off], pa.int32())], schema=schema)

    return seams.mapInArrow(run, "part long, off long, failed int")


def count_tokens(docs: DataFrame, *, model: str | None = None, limit: int = 4096, chunk: int = CHUNK,
                 overlap: int = OVERLAP, widen: int = WIDEN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    if not 0 < overlap < chunk or widen < 2:
        raise ValueError("0 < overlap < chunk and widen >= 2 are needed")
    path = model_path(model)
    if not worker_encoder(path).splices:
        chunk = 1 << 40  # no proof for this kind of model: whole texts only
    rows = texts(docs, key, text)
    short = rows.where(F.length("text") <= chunk)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def whole(batches):
        enc = worker_encoder(path)
        for batch in batches:
            body = batch.column(1)
            for a, b in slices(batch, 1):
                part = body.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).cast(pa.int64()), pc.binary_length(part).cast(pa.int64()),
                     pa.array(enc.counts(part.to_pylist()), pa.int64())], schema=schema)

    done = short.mapInArrow(whole, "doc_id long, n_bytes long, n_tokens long")
    # huge texts get a number of their own, so that repeated and null ids stay apart; it is fixed by the written table
    left = cut(rows.where(F.length("text") > chunk).withColumn("part", F.monotonically_increasing_id()))
    while not left.isEmpty():
        size, reach = chunk, overlap

        def cuts(batches, size=size, reach=reach):
            for batch in batches:
                for part, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    body = body.as_py()
                    at = windows(len(body), size, reach)
                    for no, (lo, hi) in enumerate(at):
                        yield pa.RecordBatch.from_pydict({
                            "part": pa.array([part], pa.int64()), "no": pa.array([no], pa.int64()),
                            "last": pa.array([len(at) - 1], pa.int64()), "lo": pa.array([lo], pa.int64()), "body": [body[lo:hi]]})

        chunks = left.select("part", "text").mapInArrow(cuts, "part long, no long, last long, lo long, body string")
        pieces = cut(encoded(chunks.repartition("part", "no"), path, reach))
        seams = cut(spliced(pieces, path))
        total = pieces.groupBy("part").agg(F.sum("n").alias("n"))
        off = seams.groupBy("part").agg(F.sum("off").alias("off"), F.max("failed").alias("failed"))
        got = total.join(off, "part", "left").select(
            "part", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n_tokens"), F.coalesce("failed", F.lit(0)).alias("failed"))
        ok = got.where("failed = 0").select("part", "n_tokens")
        done = done.unionByName(left.join(ok, "part").select(
            "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens"))
        if seams.where("failed = 1").isEmpty():
            break
        left = cut(left.join(got.where("failed = 1").select("part"), "part", "left_semi"))
        chunk, overlap = chunk * widen, overlap * widen
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
