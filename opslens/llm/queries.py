"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import (
    binpack, chat, collocations, dartminhash, decontaminate, hosts, licenses, metricjoin, packing, pii, termtree,
    tokencount, toxicity,
)
from opslens.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii_disclosure(s, d):
    """Personal data of every document, and the terms that disclose it."""
    return pii.report(table(s, d, "documents"))


@query
def op2_toxicity_nbsvm(s, d):
    """Toxicity score of every document."""
    docs = table(s, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(s, d, "labels")))


@query
def op3_license_index(s, d):
    """Licence phrases and notices of every document."""
    return licenses.scan(table(s, d, "documents"))


@query
def op4_cost_packing(s, d):
    """Pieces of all documents, balanced by attention cost."""
    return packing.pack(table(s, d, "documents"))


@query
def op5_qgram_decontamination(s, d):
    """Benchmark items found in documents."""
    return decontaminate.find(table(s, d, "documents"), table(s, d, "benchmark"))


@query
def op6_host_reputation(s, d):
    """Verdict on every page."""
    return hosts.judge(table(s, d, "pages"))


@query
def op7_chat_windows(s, d):
    """All conversations and one full of control strings, formatted and read back."""
    own = s.createDataFrame([(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))],
                            "conv_id long, turn long, role string, text string")
    all_ = table(s, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.windows(all_))


@query
def op8_dartminhash(s, d):
    """Near-duplicate class of every document."""
    return dartminhash.classes(table(s, d, "documents"))


@query
def op9_packed_matrix(s, d):
    """Every document's ids in packed rows of 2048."""
    return binpack.pack_matrix(table(s, d, "documents"))


@query
def op10_metric_join(s, d):
    """Links and components of all vectors."""
    return metricjoin.near_duplicates(table(s, d, "embeddings"))


@query
def op11_token_resync(s, d):
    """Token counts of every document."""
    return tokencount.count_tokens(table(s, d, "documents"))


@query
def op12_term_tree(s, d):
    """The 50 best documents of every benchmark item."""
    return termtree.rank(table(s, d, "documents"), table(s, d, "benchmark"))


@query
def op13_tile_collocations(s, d):
    """Each language's 2000 best phrases of two and three words."""
    return collocations.mine(table(s, d, "documents"))


_RULES = ", ".join(f"('{says}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')"
                   for says, rule in hosts.RULES)
_TWO = ", ".join(f"'{x}'" for x in hosts.TWO_LABELS)


def _strength(level: str) -> str:
    """The prior strength of a level, as in hosts.strength."""
    return f"""k_{level} AS (
  SELECT CASE WHEN coalesce(n, 0) = 0 OR bad = 0 OR bad = n THEN 1000.0 WHEN k < 2 THEN 0.5
         ELSE CASE WHEN rho > 0 THEN least(1000.0, greatest(0.5, 1 / rho - 1)) ELSE 1000.0 END END AS k
  FROM (SELECT *, CASE WHEN n - nn / n - (k - 1) > 0
           THEN (bb - n * (bad / n) * (bad / n) - (bad / n) * (1 - bad / n) * (k - 1))
                / ((bad / n) * (1 - bad / n) * (n - nn / n - (k - 1))) ELSE 1.0 END AS rho
        FROM (SELECT count(*)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn,
                     sum(bad * bad / n::DOUBLE) AS bb FROM {level} WHERE n > 0)))"""


SQL["op6_host_reputation"] = f"""
WITH rules(says, rule, name, prefix) AS (VALUES {_RULES}),
cutup AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN ''
                  ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{hosts.UPPER}', '{hosts.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cutup),
ruled AS (
  SELECT p.*, (SELECT r.rule FROM rules r WHERE (p.host = r.name OR ends_with(p.host, '.' || r.name))
               AND starts_with(p.path, r.prefix) ORDER BY length(r.rule) DESC LIMIT 1) AS rule FROM parts p),
said AS (SELECT ruled.*, r.says AS verdict FROM ruled LEFT JOIN rules r USING (rule)),
host0 AS (SELECT host, count(verdict) AS n, count(*) FILTER (verdict = 'block') AS bad FROM said GROUP BY host),
cutdown AS (SELECT *, string_split(host, '.') AS l FROM host0),
hosts AS (
  SELECT host, n, bad, array_to_string(l[-2:], '.') IN ({_TWO}) AS deep,
         CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-3:], '.')
              ELSE array_to_string(l[-2:], '.') END AS domain,
         CASE WHEN array_to_string(l[-2:], '.') IN ({_TWO}) THEN array_to_string(l[-2:], '.')
              ELSE array_to_string(l[-1:], '.') END AS suffix FROM cutdown),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
{_strength('hosts')}, {_strength('domains')}, {_strength('suffixes')},
p0 AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS p FROM hosts),
s AS (SELECT suffix, (bad + k * p) / (n + k) AS m FROM suffixes, k_suffixes, p0),
d AS (SELECT domain, suffix, (bad + k * m) / (n + k) AS m FROM domains JOIN s USING (suffix), k_domains),
h AS (SELECT host, n, k, (bad + k * m) / (n + k) AS m FROM hosts JOIN d USING (domain, suffix), k_hosts)
SELECT page_id, said.host, path, rule,
       coalesce(verdict, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (n + k + 1)) > 0.5 THEN 'block' ELSE 'allow' END)
         AS verdict
FROM said LEFT JOIN h USING (host)
"""

_TERMS = (f"regexp_extract_all(translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}'), "
          f"'{termtree.TERM.pattern}')")
SQL["op12_term_tree"] = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM docs) GROUP BY ALL),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs),
m AS (SELECT r, 100 - 50 + ((50 * len(t) * n_docs) // n_terms) AS m FROM docs, s WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT item_id, r, doc_id, sum(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
                                 * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN m USING (r), s GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
      FROM scored WHERE score > 0) WHERE rank <= 50
"""

SQL["op13_tile_collocations"] = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{hosts.UPPER}', '{hosts.LOWER}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS ws
  FROM documents),
grams AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
       FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM pieces)),
f1 AS (SELECT lang, a, count(*) AS n FROM grams GROUP BY ALL),
f2 AS (SELECT lang, a, b, count(*) AS n FROM grams WHERE b IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, a, b, c, count(*) AS n FROM grams WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f1 GROUP BY lang),
longer AS (SELECT lang, a, b, max(n) AS most FROM (
             SELECT lang, a, b, n FROM f3 UNION ALL SELECT lang, b, c, n FROM f3) GROUP BY ALL),
two AS (SELECT f2.lang, f2.a || ' ' || f2.b AS phrase, f2.n AS a, x.n AS l, y.n AS r,
               (1000000 * f2.n::HUGEINT * f2.n) // (x.n::HUGEINT * y.n) AS score
        FROM f2 JOIN f1 x ON f2.lang = x.lang AND f2.a = x.a JOIN f1 y ON f2.lang = y.lang AND f2.b = y.a
        LEFT JOIN longer k ON f2.lang = k.lang AND f2.a = k.a AND f2.b = k.b
        WHERE f2.n >= 10 AND (k.most IS NULL OR 100 * k.most < 50 * f2.n)),
cuts AS (SELECT f3.*, x.n AS l1, yz.n AS r1, xy.n AS l2, z.n AS r2,
                (1000000 * f3.n::HUGEINT * f3.n) // (x.n::HUGEINT * yz.n) AS s1,
                (1000000 * f3.n::HUGEINT * f3.n) // (xy.n::HUGEINT * z.n) AS s2
         FROM f3 JOIN f1 x ON f3.lang = x.lang AND f3.a = x.a JOIN f1 z ON f3.lang = z.lang AND f3.c = z.a
         JOIN f2 xy ON f3.lang = xy.lang AND f3.a = xy.a AND f3.b = xy.b
         JOIN f2 yz ON f3.lang = yz.lang AND f3.b = yz.a AND f3.c = yz.b),
both_ AS (SELECT * FROM two UNION ALL
          SELECT lang, a || ' ' || b || ' ' || c, n, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END,
                 CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM both_)
JOIN total USING (lang) WHERE rank <= 2000
"""
