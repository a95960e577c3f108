"""Personal data: patterns first, then terms that disclose them.

The patterns (email, ip, card, phone) name protected entities: the value itself and those parts of it that recur in other
values (``entities_of``: domain and name parts of an address, network, telephone exchange). How strongly a term discloses
an entity is estimated from co-occurrence in the corpus: over documents, ``PMI(entity; term) / IC(entity)``, where a term
co-occurs with an entity if it stands within ``window`` words of a mention. The share of the term's documents in which it
does so is smoothed by one more document that holds the entity as often as any. A term whose ratio reaches ``threshold``,
near the entity in at least ``least_texts`` documents of different text, discloses it. It is generalised to its initial at
each of its places in every document that holds the entity; from ``remove_from`` on it is removed from all documents.
The window serves the estimate only, and words of any length can be terms; a run of characters outside ASCII is one word.

Work: one pass finds mentions and the terms near them (rows as many as those words and entities). Terms that reach the
least number of texts are marked in a bit table of fixed size, with which a second pass counts in how many documents each
of them stands, and so are the disclosing ones for a third pass that finds their places; a full table only lets more words
through to the exact joins. No document text is shuffled for the report.

Null texts are empty; overlapping spans are all reported, and replaced as one; rows with the same id and text share one
result; rows without id are reported like others; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.rows import cut, slices, texts
from opslens.llm.wordscan import Powers, Words, word_hash

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. A digit run is entered at its first digit, where a match must start if there is
# any, and an address at the characters before its @; so long runs cost one pass.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NAME = re.compile(r"[^\x00-\x60\x7B-\x7F]{2,}")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TABLE_BITS = 22


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0]) if len(m[0]) < 40 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(ch.isdigit() for ch in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def entities_of(kind: int, value: str) -> list[str]:
    """What a mention stands for: the value in one spelling, and the parts of it that other values share."""
    value, digits = value.translate(LOWER), re.sub("[^0-9]", "", value)
    if kind == 0:
        local, _, domain = value.partition("@")
        return [f"email:{value}", f"domain:{domain}", *(f"name:{n}" for n in dict.fromkeys(NAME.findall(local)))]
    if kind == 1:
        parts = [p.lstrip("0") or "0" for p in value.split(".")]
        return [f"ip:{'.'.join(parts)}", f"net:{'.'.join(parts[:3])}"]
    return [f"card:{digits}"] if kind == 2 else [f"phone:{digits}", f"exchange:{digits[:-4]}"]


def clear(found, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the words touch no base span."""
    if not found:
        return np.ones(len(start), bool)
    at = np.searchsorted([a for a, *_ in found], end) - 1
    return (at < 0) | (np.maximum.accumulate([b for *_, b in found])[at] <= start)


def near(text: str, found, window: int):
    """(span, words) for each base span: the words within ``window`` words of it that touch no base span."""
    low = text.translate(LOWER)
    words = np.fromiter((x for m in TERM.finditer(low) for x in m.span()), np.int64).reshape(-1, 2)
    start, end = words.T
    free = clear(found, start, end)
    for a, kind, b in found:
        i, j = np.searchsorted(end, a, "right"), np.searchsorted(start, b)
        at = np.concatenate([np.arange(max(0, i - window), i), np.arange(j, min(j + window, len(words)))])
        yield (a, kind, b), {low[start[x]:end[x]] for x in at[free[at]]}


def mentions(docs: DataFrame, *, window: int = 10) -> DataFrame:
    """One row per document: counts, base spans, the entities held, and the terms near each mention."""
    kinds = ("doc_id long, text_hash long, base string, n array<long>, held array<string>, near array<struct<"
             "entity:string,term:string>>")
    near_type = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), near_type]

    def terms(body, found):
        return sorted({(e, w) for (a, kind, b), words in near(body, found, window)
                       for e in entities_of(kind, body[a:b]) for w in words})

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, out = batch.slice(lo, 1000), [[], [], [], []]
                for body in part.column(1):
                    body = body.as_py()
                    found = spans_of(body)
                    out[0].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found))
                    out[1].append([sum(k == i for _, k, _ in found) for i in range(len(KINDS))])
                    out[2].append(sorted({e for a, k, b in found for e in entities_of(k, body[a:b])}))
                    out[3].append([{"entity": e, "term": w} for e, w in terms(body, found)] if found else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), *map(pa.array, out, types[2:])],
                    names=["doc_id", "text_hash", "base", "n", "held", "near"])

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(run, kinds)


def bit_table(terms: DataFrame) -> np.ndarray:
    """Marks of the hashes of all terms; at most 2**TABLE_BITS bits come back, however many terms there are."""
    def marks(batches):
        for batch in batches:
            h = np.array([word_hash(t) >> (64 - TABLE_BITS) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(h >> 6), "bit": pa.array(h & 63)})

    got = terms.mapInArrow(marks, "word long, bit long").distinct().groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("bits")).collect()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    for r in got:
        table[r["word"]] = np.uint64(r["bits"] & (2**64 - 1))
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def document_counts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(term, n_term): documents that hold a word whose bit is set."""
    def run(batches):
        powers, got = Powers(), {}

        def flush():
            made = pa.RecordBatch.from_pydict({"term": pa.array(list(got), pa.string()),
                                               "n": pa.array(list(got.values()), pa.int64())})
            got.clear()
            return made

        shift = np.uint64(64 - TABLE_BITS)
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                w = Words(body.slice(a, b - a).to_pylist(), powers)
                at = np.flatnonzero(table[(w.hash >> shift).astype(np.int64)])
                _, first = np.unique(w.hash[at] ^ (w.doc[at].astype(np.uint64) << np.uint64(40)), return_index=True)
                for i in at[first]:
                    term = w.buf[w.start[i]:w.end[i]].tobytes().decode("utf-8", "replace")
                    got[term] = got.get(term, 0) + 1
                if len(got) > 100_000:
                    yield flush()
        if got:
            yield flush()

    return texts(docs).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing(found: DataFrame, docs: DataFrame, *, threshold: float = 0.8, least_texts: int = 2,
               remove_from: float = 0.95) -> DataFrame:
    """(entity, term) pairs over the threshold with what stands for the term: its initial, or nothing."""
    per_doc = found.select("doc_id", "text_hash", F.explode("near").alias("m")).select(
        "doc_id", "text_hash", "m.entity", "m.term").distinct()
    pairs = cut(per_doc.groupBy("entity", "term", "text_hash").agg(F.count("*").alias("n"))
                .groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"))
                .where(F.col("texts") >= least_texts))
    table = bit_table(pairs.select("term").distinct())
    if not table.any():
        return docs.sparkSession.createDataFrame([], "entity string, term string, action string")
    n = F.lit(float(found.count()))
    entities = found.select("doc_id", "text_hash", F.explode("held").alias("entity")).groupBy("entity").agg(
        F.count("*").alias("n_entity"))
    n_term = document_counts(docs, table)
    # the share of the entity's information content that the term gives away; a term in a document counts once. An
    # entity that every document holds has no content to give away
    p = F.col("n_entity") / n
    share = (F.least("n_both", "n_entity", "n_term") + p) / (F.col("n_term") + F.lit(1.0))
    judged = pairs.join(entities.where(F.col("n_entity") < n), "entity").join(n_term, "term").withColumn(
        "ratio", F.log(share / p) / -F.log(p))
    return judged.where(F.col("ratio") >= threshold).select(
        "entity", "term", F.when(F.col("ratio") < remove_from, F.concat(F.substring("term", 1, 1), F.lit("."))).otherwise(
            "").alias("action"))


def places(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, term, start, end): every word outside base spans whose bit is set, in characters."""
    def run(batches):
        powers, shift = Powers(), np.uint64(64 - TABLE_BITS)
        for batch in batches:
            body = batch.column(1).cast(pa.binary())
            for a, b in slices(batch, 1):
                part = body.slice(a, b - a).to_pylist()
                w = Words(part, powers)
                at = np.flatnonzero(table[(w.hash >> shift).astype(np.int64)])
                if not len(at):
                    continue
                # characters before each byte: all bytes but those that carry one on
                chars = np.zeros(len(w.buf) + 1, np.int64)
                np.cumsum((w.buf & 0xC0) != 0x80, out=chars[1:])
                doc, keep = w.doc[at], np.ones(len(at), bool)
                start, end = (chars[x[at]] - chars[w.at[doc]] for x in (w.start, w.end))
                for lo, hi in zip(first := np.flatnonzero(np.diff(doc, prepend=-1)), [*first[1:], len(doc)]):
                    keep[lo:hi] = clear(spans_of(part[doc[lo]].decode()), start[lo:hi], end[lo:hi])
                at, doc, start, end = at[keep], doc[keep], start[keep], end[keep]
                terms = [w.buf[w.start[i]:w.end[i]].tobytes().decode("utf-8", "replace") for i in at]
                rows = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(terms, pa.string()),
                     pa.array(start), pa.array(end)], names=["doc_id", "text_hash", "term", "start", "end"])

    return texts(docs).withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, text_hash long, term string, start long, end long")


def same_document(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (
        F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def marked(found: DataFrame, docs: DataFrame, told: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, extra): the places of removed terms in all documents, of others where their entity is held."""
    at = cut(places(docs, table).join(told.groupBy("term").agg(F.min("action").alias("action")), "term"))
    held = found.select("doc_id", "text_hash", F.explode("held").alias("entity")).distinct()
    some = at.where("action <> ''").join(told.select("term", "entity"), "term").alias("a").join(
        held.alias("h"), (F.col("a.entity") == F.col("h.entity")) & same_document("a", "h"), "left_semi").drop("entity")
    return at.where("action = ''").unionByName(some).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "action"))).alias("extra"))


def analyse(docs: DataFrame, *, window: int = 10, **how) -> DataFrame:
    """(doc_id, text_hash, base, n, extra): ``extra`` has the spans of disclosing terms and what stands for them."""
    found = cut(mentions(docs, window=window))
    told = cut(disclosing(found, docs, **how))
    left = found.select("doc_id", "text_hash", "base", "n")
    none = F.array().cast("array<struct<start:long,end:long,action:string>>")
    table = bit_table(told.select("term").distinct())
    if not table.any():
        return left.withColumn("extra", none)
    hits = marked(found, docs, told, table)
    return left.alias("l").join(hits.alias("h"), same_document("l", "h"), "left").select(
        "l.*", F.coalesce("h.extra", none).alias("extra"))


def report(docs: DataFrame, **how) -> DataFrame:
    """The contract's columns and the number of disclosing terms."""
    got = analyse(docs, **how)
    n = [F.col("n")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    base = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    kinds = F.array(*map(F.lit, KINDS))
    keyed = F.concat(
        F.transform(base, lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), F.array_position(
            kinds, F.split(x, ":")[0]).cast("int").alias("rank"), x.alias("span"))),
        F.transform("extra", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS) + 1).alias("rank"), F.concat_ws(
            ":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")).alias("span"))))
    spans = F.array_join(F.transform(F.sort_array(F.array_distinct(keyed)), lambda x: x["span"]), ",")
    return got.select("doc_id", *n, F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"),
                      F.size("extra").cast("long").alias("n_term"))


def redact(text: str, base: str, extra) -> str:
    """The text with every span replaced: base spans by [KIND], terms by their general form or nothing."""
    marks = []
    for s in filter(None, (base or "").split(",")):
        kind, a, b = s.split(":")
        marks.append((int(a), int(b), f"[{kind.upper()}]"))
    marks += [(e["start"], e["end"], e["action"] or "") for e in extra or ()]
    out, at, last = [], 0, -1
    for a, b, put in sorted(marks):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """The rows with sanitised texts, all columns kept; texts without spans stay as they are."""
    names = docs.columns
    free = "_pii"
    while any(n.lower().startswith(free) for n in names):  # names that no column of the table has
        free += "_"
    found = analyse(docs, **how).where("base <> '' or size(extra) > 0").dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias(f"{free}id"), F.col("text_hash").alias(f"{free}hash"), F.col("base").alias(f"{free}base"),
        F.col("extra").alias(f"{free}extra"))
    both = docs.join(found, docs["doc_id"].eqNullSafe(found[f"{free}id"]) & (
        F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found[f"{free}hash"]), "left").drop(f"{free}id", f"{free}hash")

    def run(batches):
        at = names.index(text)
        for batch in batches:
            base, extra = batch.column(len(names)), batch.column(len(names) + 1)
            body = batch.column(at).to_pylist()
            for i in np.flatnonzero(base.is_valid().to_numpy(zero_copy_only=False)):
                body[i] = redact(body[i] or "", base[int(i)].as_py(), extra[int(i)].as_py())
            kept = batch.select(names)
            yield kept.set_column(at, kept.schema.field(at), pa.array(body, kept.schema.field(at).type))

    return both.mapInArrow(run, docs.schema)
