"""DuckDB SQL for the queries that SQL can express."""

from tidemark.llm import licenses as _licenses

_SCHEDULE = """
CASE (source_rank - 1) % 3
 WHEN 0 THEN least(({u}) * 1.0::DOUBLE, 1.0)
 WHEN 1 THEN least(CASE WHEN ({u}) * 1.125::DOUBLE < 0.75 THEN (sqrt(greatest(({u}) * 1.125::DOUBLE * (-4.0::DOUBLE) + 4.0, 0.0)) - 2.0) / (-2.0::DOUBLE)
   WHEN ({u}) * 1.125::DOUBLE < 1.125 THEN 0.5 + (sqrt(greatest((({u}) * 1.125::DOUBLE - 0.75) * (-2.0::DOUBLE) + 1.0, 0.0)) - 1.0) / (-1.0::DOUBLE) ELSE 1.0 END, 1.0)
 ELSE least(CASE WHEN ({u}) * 1.125::DOUBLE < 0.375 THEN (sqrt(greatest(({u}) * 1.125::DOUBLE * 2.0::DOUBLE + 0.25, 0.0)) - 0.5) / 1.0::DOUBLE
   WHEN ({u}) * 1.125::DOUBLE < 1.125 THEN 0.5 + (sqrt(greatest((({u}) * 1.125::DOUBLE - 0.375) * 4.0::DOUBLE + 1.0, 0.0)) - 1.0) / 2.0::DOUBLE ELSE 1.0 END, 1.0)
END"""

OP5 = rf"""
WITH sized AS (
 SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM totals),
weighed AS (SELECT *, [3, 1, 2][((source_rank - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM ranked),
ratios AS (SELECT *, source_size * (6 // weight) AS ratio FROM weighed),
filled AS (SELECT *,
  sum(source_size) OVER () * 3 - 4 * coalesce(sum(source_size) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  2 * sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS per FROM ratios),
opened AS (SELECT *, rest * weight <= source_size * 2 * per AS open FROM filled),
level AS (SELECT rest, per FROM opened WHERE open ORDER BY ratio LIMIT 1),
targets AS (SELECT o.source, o.source_size, o.source_rank,
  CASE WHEN o.open THEN (l.rest * o.weight)::DOUBLE / l.per::DOUBLE ELSE (2 * o.source_size)::DOUBLE END AS target,
  CASE WHEN o.open THEN (l.rest * o.weight) // l.per ELSE 2 * o.source_size END AS quota
  FROM opened o CROSS JOIN level l),
placed AS (SELECT s.doc_id, s.size, t.source_size::BIGINT AS source_size, t.target, t.source_rank, t.quota::BIGINT AS quota,
  coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
parted AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size END AS rounds FROM placed),
taken AS (SELECT *, greatest(0, least(size, quota - rounds * source_size - start)) AS part FROM parted),
summed AS (SELECT *, (size * rounds + part)::BIGINT AS taken,
  start + source_size * (rounds - CASE WHEN part > 0 THEN 0 ELSE 1 END) AS last FROM taken)
SELECT doc_id, size, source_size, target, taken,
 CASE WHEN taken > 0 THEN {_SCHEDULE.format(u="start::DOUBLE / quota::DOUBLE")} + 0.0 END AS position,
 CASE WHEN taken > 0 THEN {_SCHEDULE.format(u="last::DOUBLE / quota::DOUBLE")} + 0.0 END AS last_position
FROM summed"""


#: Escaping adds a character to each backslash and to each control string; a
#: turn's markers take 23 characters besides role and text.
OP2 = r"""
WITH turns AS (
 SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
 UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
 sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum(23 + length(role) + length(text) + len(regexp_extract_all(role || ' ' || text, '\\|</?s>|\[/?INST\]')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


OP8 = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ' ', 'g'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
itemed AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
lengths AS (SELECT item_id, words, least(13, len(words)) AS n FROM itemed WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(words[k:k + n - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS k FROM lengths)),
places AS (SELECT doc_id, n, k, array_to_string(words[k:k + n - 1], ' ') AS w
 FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM worded CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT p.doc_id, p.n, p.k, x.item_id FROM places p JOIN windows x USING (n, w)),
covered AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


OP7 = """
WITH whole AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
 FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""


OP6 = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, k, md5(array_to_string(words[k:k + 19], ' ')) AS w FROM (SELECT *, unnest(range(1, len(words) - 18)) AS k FROM worded)),
later AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM later),
places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM worded),
kept AS (SELECT p.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM places p ANTI JOIN gone g USING (doc_id, i) GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM worded w LEFT JOIN kept k USING (doc_id)"""


def _op4() -> str:
    """The licence scan; its tables of sentences and rules are those of the operator.

    Rules take their runs out of the distinct sequences one after the other, a rule a step.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    sentences = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in _licenses.known().items())
    cuts = ", ".join(f"({k}, {quote(cut)})" for k, cut in enumerate(_licenses.CUTS))
    rules = ", ".join(f"({k}, {quote(name)}, {quote(''.join(f'<{i}>' for i in run))})" for k, (name, run) in enumerate(_licenses.RULES))
    names = list(dict.fromkeys(name for name, _ in _licenses.RULES))

    def holders(s: str) -> str:
        for pattern, usual in _licenses.HOLDERS:
            s = f"regexp_replace({s}, {quote(pattern)}, {quote(usual)})"
        return s

    return rf"""
WITH RECURSIVE known(s, i) AS (VALUES {sentences}), cuts(cut, how) AS (VALUES {cuts}), rules(k, name, run) AS (VALUES {rules}),
units AS (SELECT doc_id, cut, unnest(parts) AS part, generate_subscripts(parts, 1) AS k
 FROM (SELECT doc_id, cut, CASE cut WHEN 0 THEN regexp_split_to_array(text, {quote(_licenses.CUTS[0])}) ELSE regexp_split_to_array(text, {quote(_licenses.CUTS[1])}) END AS parts FROM documents, cuts)),
tagged AS (SELECT doc_id, cut, k, CASE WHEN regexp_matches(part, {quote(_licenses.TAGGED)})
 THEN list_transform(regexp_extract_all(regexp_replace(part, {quote(_licenses.TAGGED)}, ''), {quote(_licenses.IDENTIFIER)}), lambda n: {quote(_licenses.TAG)} || ' ' || regexp_replace(n, '\+$', '-or-later')) ELSE [part] END AS parts FROM units),
pieces AS (SELECT doc_id, cut, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM tagged),
normal AS (SELECT doc_id, cut, k, j, {holders("replace(trim(regexp_replace(lower(part), '[^\\p{L}\\p{N}]+', ' ', 'g')), 'licence', 'license')")} AS s FROM pieces),
ids AS (SELECT doc_id, coalesce(string_agg('<' || i || '>', '' ORDER BY k, j) FILTER (cut = 0), '') AS over_ids, coalesce(string_agg('<' || i || '>', '' ORDER BY k, j) FILTER (cut = 1), '') AS within_ids
 FROM normal JOIN known USING (s) GROUP BY doc_id),
best AS (SELECT *, CASE WHEN length(within_ids) - length(replace(within_ids, '<', '')) > length(over_ids) - length(replace(over_ids, '<', '')) THEN within_ids ELSE over_ids END AS ids FROM ids),
steps AS (SELECT ids, 0 AS k, ids AS rest, []::VARCHAR[] AS held FROM (SELECT over_ids AS ids FROM best UNION SELECT within_ids FROM best)
 UNION ALL SELECT s.ids, s.k + 1, replace(s.rest, r.run, ''), CASE WHEN contains(s.rest, r.run) THEN list_append(s.held, r.name) ELSE s.held END FROM steps s JOIN rules r USING (k)),
matched AS (SELECT ids, rest, held FROM steps WHERE k = {len(_licenses.RULES)}),
named AS (SELECT b.doc_id, b.ids, list_concat(o.held, w.held) AS held, m.rest
 FROM best b JOIN matched o ON o.ids = b.over_ids JOIN matched w ON w.ids = b.within_ids JOIN matched m ON m.ids = b.ids)
SELECT d.doc_id, coalesce(replace(replace(replace(ids, '><', ','), '<', ''), '>', ''), '') AS sentence_ids,
 coalesce(array_to_string(list_filter([{", ".join(map(quote, names))}], lambda n: list_contains(held, n)), ','), '') AS licenses,
 coalesce(length(rest) - length(replace(rest, '<', '')), 0)::BIGINT AS n_unmatched
FROM documents d LEFT JOIN named USING (doc_id)"""


OP4 = _op4()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = rf"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (SELECT r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM split),
keyed AS (SELECT *, trim(translate(line, '{_UPPER}', '{_LOWER}'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM placed),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM keyed WHERE key NOT IN (SELECT key FROM common) GROUP BY r)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)"""


OP12 = """
WITH whole AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
 FROM whole a JOIN whole b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


OP13 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM docs)
 LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY 1) USING (lang)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v))::BIGINT AS p FROM groups JOIN kept USING (lang) LEFT JOIN counts c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM kept),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
more AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part FROM pairs UNION ALL SELECT *, 'term' FROM more)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM ranked QUALIFY part = 'pair' OR rank <= 50"""
