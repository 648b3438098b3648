"""The queries in DuckDB's SQL, written apart from the DataFrame plans: tokens, for one, by splitting and stripping."""

from __future__ import annotations

_WORDS = r"list_filter(list_transform(regexp_split_to_array({0}, '[ \t\n\r\f]+'), lambda x: regexp_replace(lower(x), '^[^a-z]+|[^a-z]+$', '', 'g')), lambda x: x <> '')"
_LINES = "lines AS (SELECT row_number() OVER () AS ln, line FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents))"
_TOKENS = f"{_LINES}, tokens AS (SELECT ln, {_WORDS.format('line')} AS w FROM lines)"
_FIRST = f"{_TOKENS}, firsts AS (SELECT ln, unnest(list_distinct(w[1:100])) AS word FROM tokens)"
_PMI = f"""{_FIRST}, freq AS (SELECT word, count(*) AS n FROM firsts GROUP BY word HAVING count(*) >= 10),
pruned AS (SELECT f.ln, f.word, freq.n FROM firsts f JOIN freq USING (word)),
total AS (SELECT count(*) AS n FROM tokens WHERE len(w) > 0),
pmi AS (SELECT a.word AS x, b.word AS y, count(*)::bigint AS cnt, round(log10(count(*)::double / (any_value(a.n)::double * any_value(b.n)) * (SELECT n FROM total)), 6) AS pmi
  FROM pruned a JOIN pruned b ON a.ln = b.ln AND a.word <> b.word GROUP BY a.word, b.word HAVING count(*) >= 10)"""
#: pmi_pairs takes whole lines
_PMI_WHOLE = _PMI.replace("unnest(list_distinct(w[1:100]))", "unnest(list_distinct(w))")
_BIGRAMS = f"""{_TOKENS}, grams AS (SELECT unnest(list_zip(w[1:-2], w[2:])) AS g FROM tokens WHERE len(w) > 1),
counted AS (SELECT g[1] AS l, g[2] AS r, count(*) AS n FROM grams GROUP BY ALL), marginal AS (SELECT l, sum(n) AS total FROM counted GROUP BY l)"""
_POSTINGS = f"docs AS (SELECT doc_id AS doc, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), postings AS (SELECT term, doc, count(*)::bigint AS tf FROM (SELECT doc, unnest(w) AS term FROM docs) GROUP BY ALL)"
_HAS = f"docs AS (SELECT doc_id AS doc, text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents), " + ", ".join(f"has_{t} AS (SELECT DISTINCT doc FROM docs WHERE list_contains(w, '{t}'))" for t in ("the", "of", "der", "und"))
_NESTED = "((SELECT doc FROM has_the INTERSECT SELECT doc FROM has_of) UNION (SELECT doc FROM has_der INTERSECT SELECT doc FROM has_und))"
_VINT = "CASE WHEN {0} <= 127 THEN 1 WHEN {0} < 256 THEN 2 WHEN {0} < 65536 THEN 3 WHEN {0} < 16777216 THEN 4 WHEN {0} < 4294967296 THEN 5 ELSE 9 END"
_GRAPH = """follows AS (SELECT user_id AS src, event_type, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events),
edges AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM follows UNION ALL SELECT src, -ascii(event_type) FROM follows) WHERE dst IS NOT NULL),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src)"""


def _ppr(sources: tuple[int, ...], iterations: int = 3) -> str:
    own = ", ".join(f"({s})" for s in sources)
    parts = [_GRAPH, f"sources(s) AS (VALUES {own})", "r0 AS (SELECT s AS source, id, CASE WHEN s = id THEN 1.0::double ELSE 0.0::double END AS p FROM sources, nodes)"]
    for i in range(iterations):
        parts.append(f"in{i} AS (SELECT r.source, e.dst AS id, sum(r.p / d.n) AS p FROM r{i} r JOIN edges e ON r.id = e.src JOIN deg d ON d.src = e.src GROUP BY r.source, e.dst)")
        parts.append(f"lost{i} AS (SELECT s AS source, greatest(0, 1 - coalesce((SELECT sum(p) FROM in{i} WHERE source = s), 0)) AS m FROM sources)")
        parts.append(f"r{i + 1} AS (SELECT r.source, r.id, 0.85 * coalesce(n.p, 0) + CASE WHEN r.source = r.id THEN 0.15 + 0.85 * l.m ELSE 0 END AS p FROM r{i} r JOIN lost{i} l USING (source) LEFT JOIN in{i} n ON n.source = r.source AND n.id = r.id)")
    return ", ".join(parts)


def _models(ids: str) -> str:
    return f"models AS (SELECT m AS model_id, f::int AS feature, (((f * 37 + m * 11) % 101) - 50) / 1000.0::double AS weight FROM range(1000) a(f), (VALUES {ids}) b(m))"


_INSTANCES = f"""instances AS (SELECT d.doc_id AS docid, CASE WHEN l.quality = 0 THEN 'spam' ELSE 'ham' END AS label,
  list_transform({_WORDS.format("coalesce(d.text, '')")}, lambda x: ((length(x) * 31 + ascii(x)) % 1000)::int) AS f FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_EACH = f"""{_INSTANCES}, {_models('(0), (1), (2)')}, counted AS (SELECT docid, feature, count(*) AS n FROM (SELECT docid, unnest(f) AS feature FROM instances) GROUP BY ALL),
each_one AS (SELECT i.docid, i.label, k.model_id, coalesce((SELECT sum(m.weight * c.n) FROM counted c JOIN models m USING (feature) WHERE c.docid = i.docid AND m.model_id = k.model_id), 0)::double AS s
  FROM instances i, (SELECT DISTINCT model_id FROM models) k)"""
_DATE = "contains(strftime({0}, '%Y-%m-%d'), '1996-01')"
_PRICE = "l_extendedprice::decimal(12,2) * (1 - l_discount::decimal(4,2))"

ORACLES: dict[str, str] = {
    "word_count": f"WITH {_TOKENS} SELECT word, count(*)::bigint AS cnt FROM (SELECT unnest(w) AS word FROM tokens) GROUP BY word",
    "prefix_count": f"WITH {_TOKENS} SELECT word[1:2] AS prefix, count(*)::bigint AS cnt FROM (SELECT unnest(w) AS word FROM tokens) GROUP BY ALL",
    "line_frequency": f"WITH {_FIRST} SELECT word, count(*)::bigint AS cnt FROM firsts GROUP BY word HAVING count(*) >= 10",
    "line_total": f"WITH {_TOKENS} SELECT count(*)::bigint AS cnt FROM tokens WHERE len(w) > 0",
    "pmi_pairs": f"WITH {_PMI_WHOLE} SELECT x, y, cnt, pmi FROM pmi",
    "pmi_stripes": f"WITH {_PMI} SELECT x AS word, y AS neighbour, pmi FROM pmi",
    "pmi_neighbours": f"WITH {_PMI}, ranked AS (SELECT x, y, pmi, row_number() OVER (PARTITION BY x ORDER BY pmi DESC, y)::int AS rank FROM pmi) SELECT x, rank, y, pmi FROM ranked WHERE rank <= 3",
    "bigram_rel_freq_pairs": f'WITH {_BIGRAMS} SELECT l AS "left", r AS "right", round(n::double / total::double, 9) AS value FROM counted JOIN marginal USING (l) UNION ALL SELECT l, \'*\', total::double FROM marginal',
    "bigram_rel_freq_stripes": f'WITH {_BIGRAMS} SELECT l AS "left", r AS "right", round(n::double / total::double, 9) AS value FROM counted JOIN marginal USING (l)',
    "inverted_index": f"WITH {_POSTINGS} SELECT term, count(*)::bigint AS df, sum(tf)::bigint AS total_tf, min(doc)::bigint AS first_doc, max(doc)::bigint AS last_doc FROM postings GROUP BY term",
    "postings_gap": f"WITH {_POSTINGS} SELECT term, doc, (doc - lag(doc, 1, 0) OVER (PARTITION BY term ORDER BY doc))::bigint AS gap, tf FROM postings",
    "postings_vint": f"WITH {_POSTINGS}, gaps AS (SELECT term, doc // 65536 AS block, doc - lag(doc, 1, 0) OVER (PARTITION BY term, doc // 65536 ORDER BY doc) AS gap, tf FROM postings) SELECT term, block::bigint AS block, count(*)::bigint AS df, ({_VINT.format('count(*)')} + sum({_VINT.format('gap')} + {_VINT.format('tf')}))::bigint AS n_bytes FROM gaps GROUP BY term, block",
    "boolean_and": f"WITH {_HAS} SELECT doc FROM has_the INTERSECT SELECT doc FROM has_of",
    "boolean_or": f"WITH {_HAS} SELECT doc FROM has_the UNION SELECT doc FROM has_der",
    "boolean_nested": f"WITH {_HAS} SELECT doc FROM {_NESTED}",
    "boolean_snippets": f"WITH {_HAS}, found AS (SELECT doc FROM has_the INTERSECT SELECT doc FROM has_of) SELECT doc, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS line FROM docs WHERE doc IN (SELECT doc FROM found)",
    "wide_row_index": f"WITH {_POSTINGS} SELECT term, doc, tf FROM postings",
    "wide_row_retrieval": f"WITH {_HAS} SELECT doc FROM {_NESTED}",
    "graph_adjacency": f"WITH {_GRAPH}, o AS (SELECT src, count(*) AS n, min(dst) AS a, max(dst) AS b FROM edges GROUP BY src), i AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst) SELECT id AS node, coalesce(o.n, 0)::bigint AS outdeg, coalesce(i.n, 0)::bigint AS indeg, a::bigint AS least, b::bigint AS greatest FROM nodes LEFT JOIN o ON id = src LEFT JOIN i ON id = i.dst",
    "graph_stats": f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes)::bigint AS nodes, (SELECT count(*) FROM edges)::bigint AS edges, (SELECT count(*) FROM deg)::bigint AS active, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM deg))::bigint AS dangling",
    "ppr_single": f"WITH {_ppr((3,))} SELECT source::bigint AS source, id, round(p, 9) AS p FROM r3",
    "ppr_multi": f"WITH {_ppr((3, 7))} SELECT source::bigint AS source, id, round(p, 9) AS p FROM r3",
    "ppr_topk": f"WITH {_ppr((3, 7))}, ranked AS (SELECT source::bigint AS source, id, round(p, 8) AS p, row_number() OVER (PARTITION BY source ORDER BY round(p, 8) DESC, id)::int AS rank FROM r3) SELECT source, rank, id, p FROM ranked WHERE rank <= 10",
    "q1_shipped_count": f"SELECT count(*)::bigint AS cnt FROM lineitem WHERE {_DATE.format('l_shipdate')}",
    "q2_order_attr": f"SELECT o_orderpriority, o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {_DATE.format('l_shipdate')}) ORDER BY o_orderkey, o_orderpriority LIMIT 20",
    "q3_part_supplier": f"SELECT l_orderkey, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE {_DATE.format('l_shipdate')} ORDER BY l_orderkey, p_name, s_name LIMIT 20",
    "q4_nation_count": f"SELECT n_nationkey, n_name, count(*)::bigint AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE {_DATE.format('l_shipdate')} GROUP BY n_nationkey, n_name ORDER BY n_nationkey",
    "q5_monthly_nation": "SELECT strftime(l_shipdate, '%Y-%m') AS month, n_name, count(*)::bigint AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (3, 24) GROUP BY ALL",
    "q6_pricing_summary": f"""WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity::decimal(12,2))::double AS sum_qty, sum(l_extendedprice::decimal(12,2))::double AS sum_base_price, sum({_PRICE})::double AS sum_disc_price,
  sum({_PRICE} * (1 + l_tax::decimal(4,2)))::double AS sum_charge, sum(l_discount::decimal(4,2))::double AS sum_disc, count(*)::double AS count_order FROM lineitem WHERE {_DATE.format('l_shipdate')} GROUP BY l_returnflag, l_linestatus)
SELECT l_returnflag, l_linestatus, sum_qty, sum_base_price, sum_disc_price, sum_charge, round(sum_qty / count_order, 6) AS avg_qty, round(sum_base_price / count_order, 6) AS avg_price, round(sum_disc / count_order, 6) AS avg_disc, count_order FROM s""",
    "q7_unshipped_revenue": f"""SELECT c_name, o_orderkey, sum({_PRICE})::double AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01' AND strftime(l_shipdate, '%Y-%m-%d') > '1996-01-01'
GROUP BY c_name, o_orderkey, orders.o_orderdate, o_orderpriority ORDER BY revenue DESC, c_name, o_orderkey LIMIT 10""",
    "spam_train": f"""WITH RECURSIVE {_INSTANCES}, numbered AS (SELECT row_number() OVER (ORDER BY docid) AS i, (label = 'spam')::int AS y, list_transform(range(1000), lambda k: 0::double) AS zero, f FROM instances),
flat AS (SELECT i, y, unnest(f) AS feature FROM numbered), counted AS (SELECT i, any_value(y) AS y, feature, count(*) AS n FROM flat GROUP BY i, feature),
dense AS (SELECT i, any_value(c.y) AS y, list(coalesce(c.n, 0)::double ORDER BY k) AS v FROM (SELECT d.i, d.y, r.k, c.n FROM numbered d CROSS JOIN range(1000) r(k) LEFT JOIN counted c ON c.i = d.i AND c.feature = r.k) c GROUP BY i),
descent(i, w) AS (SELECT 0::bigint, list_transform(range(1000), lambda k: 0::double) UNION ALL
  SELECT d.i, list_transform(list_zip(s.w, d.v), lambda z: z[1] + z[2] * 0.002::double * (d.y - 1 / (1 + exp(-list_inner_product(s.w, d.v))))) FROM descent s JOIN dense d ON d.i = s.i + 1),
final AS (SELECT unnest(w) AS weight, unnest(range(1000)) AS feature FROM descent WHERE i = (SELECT max(i) FROM numbered))
SELECT feature::int AS feature, round(weight, 9) + 0.0 AS weight FROM final WHERE feature IN (SELECT feature FROM flat)""",
    "spam_apply": f"WITH {_EACH}, scored AS (SELECT docid, label, round(s, 6) + 0.0 AS score FROM each_one WHERE model_id = 0) SELECT docid, label, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM scored",
    "spam_ensemble_average": f"WITH {_EACH}, scored AS (SELECT docid, label, sum(s) / 3 AS score FROM each_one GROUP BY docid, label) SELECT docid, label, round(score, 6) + 0.0 AS score, CASE WHEN round(score, 9) > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM scored",
    "spam_ensemble_vote": f"WITH {_EACH}, scored AS (SELECT docid, label, (2 * sum((round(s, 9) > 0)::int) - 3)::double AS score FROM each_one GROUP BY docid, label) SELECT docid, label, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM scored",
}

_TWICE = """twice AS (SELECT docid, label, f FROM instances UNION ALL SELECT docid, label, list_concat(f, f) FROM instances),
numbered AS (SELECT row_number() OVER () AS i, * FROM twice), flat AS (SELECT i, unnest(f) AS feature FROM numbered),
sums AS (SELECT i, sum(weight) AS s FROM flat JOIN models USING (feature) WHERE model_id = 0 GROUP BY i)"""
# the same answers by another way: through an index, or through text written and read back
ORACLES |= {
    "boolean_index_and": ORACLES["boolean_and"],
    "boolean_index_or": ORACLES["boolean_or"],
    "boolean_index_nested": ORACLES["boolean_nested"],
    "index_file": ORACLES["boolean_nested"],
    "ppr_repeated_source": f"WITH {_ppr((3,))} SELECT source::bigint AS source, id, round(p, 9) AS p FROM r3 UNION ALL SELECT 3::bigint, id, 0.0::double FROM nodes",
    "q1_substring": "SELECT count(*)::bigint AS cnt FROM lineitem WHERE contains(strftime(l_shipdate, '%Y-%m-%d'), '01-01')",
    "spam_apply_repeated": f"WITH {_INSTANCES}, {_models('(0)')}, {_TWICE}, scored AS (SELECT docid, label, round(coalesce(s, 0)::double, 6) + 0.0 AS score FROM numbered LEFT JOIN sums USING (i)) SELECT docid, label, score, CASE WHEN score > 0 THEN 'spam' ELSE 'ham' END AS prediction FROM scored",
    "spam_models_text": ORACLES["spam_ensemble_average"],
    "adjacency_text": ORACLES["graph_adjacency"],
    "tbl_pricing_summary": ORACLES["q6_pricing_summary"],
}
