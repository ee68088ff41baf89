"""SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from tallyweave.llm.licenses import rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP1 = f"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item FROM dw JOIN iw USING (n, s)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
prs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
lnk AS (SELECT a, b FROM prs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 90 * (x.n + y.n - o)),
e AS (SELECT a, b FROM lnk UNION SELECT b, a FROM lnk),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""


def _spaced(pattern: str) -> str:
    """A rule for words that each have a blank on both sides: RE2 has no lookaround."""
    return " " + pattern.removeprefix("(?<![^ ])").removesuffix("(?![^ ])").replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?") + " "


def op3() -> str:
    values = ", ".join(f"({_quoted(r.label)}, [{', '.join(map(_quoted, r.keywords))}], {_quoted(_spaced(r.pattern))}, {r.priority}, {r.weight}::DOUBLE, {str(r.base).lower()})" for r in rules())
    count = "len(list_filter(string_split({}, ' '), lambda e: e <> ''))"
    return f"""
WITH r(label, keywords, pattern, priority, weight, base) AS (VALUES {values}),
d AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS norm, len({_WORDS}) AS n_words FROM documents),
t AS (SELECT doc_id, r.*, ' ' || replace(norm, ' ', '  ') || ' ' AS spaced FROM d, r WHERE len(list_filter(keywords, lambda k: contains(norm, k))) > 0),
m AS (SELECT *, string_split_regex(spaced, pattern) AS p, regexp_extract_all(spaced, pattern) AS x FROM t WHERE regexp_matches(spaced, pattern)),
u AS (SELECT doc_id, label, priority, weight, base, p, x, unnest(range(1, len(x) + 1)) AS i FROM m),
v AS (SELECT doc_id, label, priority, weight, base, list_sum(list_transform(p[1:i], lambda q: {count.format("q")})) + coalesce(list_sum(list_transform(x[1:i - 1], lambda q: {count.format("q")})), 0) AS first, {count.format("x[i]")} AS n FROM u),
det AS (SELECT *, first + n - 1 AS last FROM v),
s AS (SELECT *, last > coalesce(max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC, priority, label, weight, base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS stays FROM det),
b AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM det WHERE base GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(CASE WHEN base THEN 1.0 ELSE weight END) AS score FROM s WHERE stays OR base GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
"""


OP11 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1) USING (vec_id)
"""

#: Every frequent itemset, grown by one item at a time, then those of which no larger one has the same support.
OP12 = """
WITH RECURSIVE r AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT count(DISTINCT sale_id) AS total, greatest(5, CAST(ceil(count(DISTINCT sale_id) / 20000) AS BIGINT)) AS least FROM r),
it AS (SELECT item_id, count(*) AS s FROM r GROUP BY 1 HAVING count(*) >= (SELECT least FROM t)),
k AS (SELECT r.* FROM r JOIN it USING (item_id)),
grow AS (SELECT [item_id] AS items, item_id AS e, list(sale_id) AS sales FROM k GROUP BY item_id
  UNION ALL SELECT list_append(items, item_id), item_id, sales FROM (SELECT items, e, k.item_id, list(u.sale) AS sales FROM (SELECT items, e, unnest(sales) AS sale FROM grow) u JOIN k ON k.sale_id = u.sale AND k.item_id > u.e GROUP BY items, e, k.item_id) WHERE len(sales) >= (SELECT least FROM t)),
f AS (SELECT items, len(sales) AS support FROM grow),
sub AS (SELECT list_filter(items, lambda x: x <> c) AS items, max(support) AS m FROM (SELECT items, support, unnest(items) AS c FROM f) GROUP BY 1),
cl AS (SELECT f.items, f.support FROM f LEFT JOIN sub USING (items) WHERE coalesce(m, 0) < f.support),
ru AS (SELECT z.items, z.c, f.support AS a, it.s FROM (SELECT items, support, unnest(items) AS c FROM cl WHERE len(items) > 1) z JOIN f ON f.items = list_filter(z.items, lambda x: x <> z.c) JOIN it ON it.item_id = z.c WHERE 100 * z.support >= 60 * f.support AND z.support * (SELECT total FROM t) > f.support * it.s),
ag AS (SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS txt FROM ru GROUP BY 1)
SELECT array_to_string(items, ',') AS items, len(items) AS n_items, support, coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(txt, '')) AS rules_sha256 FROM cl LEFT JOIN ag USING (items)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, id, unnest(w) AS term FROM d),
vo AS (SELECT lang, term, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN vo USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(total) AS alln FROM vo GROUP BY 1),
n AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM grp LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS cnt, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.n + v.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (vo.total + 1)) // (v.alln + v.v)::HUGEINT AS q FROM vo JOIN n USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE cnt > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200
"""
