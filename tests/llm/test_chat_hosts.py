import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from opslens.llm import chat, hosts, queries
from tests.compare import compare, open_duckdb

PIECES = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>\n", "<", "​", "[", "s>", "a", "\n", "\\", "é"]


@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.lists(st.sampled_from(PIECES), max_size=4).map("".join))
@settings(max_examples=500, deadline=None)
def test_turns_read_back(text, role):
    body, lo, hi = chat.turn_text(role, text)
    assert chat.turns_of(body * 2) == [(role, text)] * 2
    assert chat.unescape(body[lo:hi]) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROL)


def talk():
    rnd = random.Random(2)
    rows = [(1, t, ("user", "assistant")[t % 2], "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(9))))
            for t in range(30)]
    rows += [(2, 0, "system", "be brief " * 10)] + [(2, t, ("assistant", "user")[t % 2], "word " * t) for t in range(1, 25)]
    rows += [(3, 0, "assistant", "long " * 3000), (3, 1, "user", None), (3, None, None, "x"), (3, 1, "user", None)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (4, 0, "system", "alone")]
    return rows


@pytest.mark.parametrize("budget", [40, 120, 100_000])
def test_digest_equals_brute_force(spark, budget):
    rows = talk()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window")
    made = chat.windows(table, budget=budget)
    got = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        learnt = "".join(text for *_, role, text in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    windows = made.collect()
    assert sum(len(w["text"]) for w in windows) == sum(r["formatted_chars"] for r in got.values())
    for w in windows:
        turns = chat.turns_of(w["text"])
        assert w["n_tokens"] <= budget or len(turns) - w["n_repeated"] == 1 + (turns[0][0] == "system" and not w["window"])
        if w["conv_id"] == 2:
            assert turns[0] == ("system", "be brief " * 10)
    assert len(windows) == len(got) if budget == 100_000 else len(windows) > len(got)
    assert chat.digest(chat.windows(table.limit(0))).count() == 0


URLS = ["http://a.example.com/en/1", "https://A.Example.COM/de/2?x=/en/", "http://www.example.com/en/3#t", "ftp://b.net/es/4",
        "http://b.net/fr/", "http://b.net/en/5", "http://c.net", "http://org.org/es/6", "no scheme/com/", None, "",
        "http://", "http://x.co.uk/a", "://y.com/", "http://z.net?/es/", "http://xnet/es/", "http://com/en/", "http://é.com/ß?q"]


def test_reputation_against_sql(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, u, "h") for i, u in enumerate(URLS * 2)]
    rows += [(1000 + i, f"http://h{rnd.randrange(9)}.d{rnd.randrange(5)}.{rnd.choice(['net', 'com', 'org'])}/"
              f"{rnd.choice(['es', 'fr', 'en'])}/{i}", None) for i in range(800)]
    rows += [(None, "http://b.net/en/7", None)]
    for part, name in ((rows, "full"), ([], "none"), (rows[:3], "few")):
        d = tmp_path / name
        spark.createDataFrame(part, "page_id long, url string, html string").coalesce(1).write.parquet(str(d / "p"))
        file = next((d / "p").glob("*.parquet"))
        con = __import__("duckdb").connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{file}'")
        msg, _, _ = compare(spark, con, str(d), name, lambda s, x: hosts.judge(s.read.parquet(f"{x}/p")),
                            queries.SQL["op6_host_reputation"])
        assert msg == f"ok {len(part)}", msg


def test_registered_queries_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    for name, sql in queries.SQL.items():
        msg, _, _ = compare(spark, open_duckdb(sf), sf, name, queries.QUERIES[name], sql)
        assert msg.startswith("ok"), msg
