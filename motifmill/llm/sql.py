"""DuckDB SQL for the queries that SQL can express."""

#: Targets by raising one common level until they add up; documents by cumulated size in the order of md5(doc_id).
_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM d GROUP BY source),
caps AS (SELECT *, (source_no % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM per),
levels AS (
  SELECT *, row_number() OVER o AS nth,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM caps WINDOW o AS (ORDER BY cap / weight, source_no)),
level AS (SELECT min_by(level, nth) AS level FROM levels WHERE cap / weight >= level),
targets AS (
  SELECT source, source_size, source_no, least(cap, coalesce((SELECT level FROM level) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.source_no, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
  FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (whole + CASE WHEN size > 0 AND ahead + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END)::BIGINT AS copies,
         (ahead + size / 2.0::DOUBLE) / nullif(target, 0) AS share
  FROM placed)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken,
       CASE WHEN copies > 0 AND target > 0 THEN round(greatest(0, least(1, CASE source_no % 3
         WHEN 0 THEN CASE WHEN share * 1.5 <= 1 THEN (sqrt(greatest(9 - 8 * (share * 1.5), 0)) - 3) / -4 ELSE 0.5 + (share * 1.5 - 1) END
         WHEN 1 THEN share
         ELSE CASE WHEN share * 1.5 <= 0.5 THEN share * 1.5 ELSE 0.5 + (sqrt(greatest(1 + 8 * (share * 1.5 - 0.5), 0)) - 1) / 4 END END)), 6) END AS position
FROM counted
"""

#: Turns are calls and results by number; a call's order is its place among the conversation's call turns.
_OP6 = r"""
WITH calls AS (
  SELECT conv_id, turn, text, 'c' || turn AS call_id FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL),
results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min({'turn': turn, 'content': text}) AS result, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
places AS (
  SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) - 1 AS order_no FROM calls GROUP BY conv_id, call_id)
SELECT c.conv_id, c.call_id, c.turn, 'ask' AS name, r.result.turn AS result_turn, coalesce(r.n_results, 0)::BIGINT AS n_results,
       p.order_no::BIGINT AS order_no, false AS cyclic, coalesce(length(c.text), 0) > 0 AND c.turn >= 0 AS valid,
       concat_ws(',', CASE WHEN c.text IS NULL THEN 'missing text' END, CASE WHEN c.text = '' THEN 'range text' END, CASE WHEN c.turn < 0 THEN 'range turn' END) AS errors,
       '{"arguments":{' || coalesce('"text":' || to_json(c.text)::VARCHAR || ',', '') || '"turn":' || c.turn || '},"call_id":' || to_json(c.call_id)::VARCHAR
       || ',"name":"ask","result":' || coalesce(to_json(r.result.content)::VARCHAR, 'null') || '}' AS json
FROM calls c JOIN places p USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id)
"""


def _license_scan() -> str:
    """Words, rolling 3-grams and diagonals as lists and joins; the templates are those of the operator."""
    from motifmill.llm import licenses as L

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(wording)})" for i, (label, wording) in enumerate(L.TEMPLATES))
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), '{L.UPPER}', '{L.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    at = lambda phrase: "list_filter(range(1, len(w) + 1), lambda i: " + " AND ".join(f"w[i + {j}] = {quoted(x)}" for j, x in enumerate(phrase)) + ")"
    places = ", ".join(f"{at(phrase)} AS p{i}" for i, (phrase, _) in enumerate(L.PHRASES))
    every = "flatten([" + ", ".join(f"p{i}" for i in range(len(L.PHRASES))) + "])"
    found = "list_filter([" + ", ".join(f"CASE WHEN len(p{i}) > 0 THEN {quoted(label)} END" for i, (_, label) in enumerate(L.PHRASES)) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {words("text")} AS w FROM documents),
t AS (SELECT template, label, {words("wording")} AS w FROM (VALUES {templates}) v(template, label, wording)),
tg AS (SELECT template, label, len(w) AS t_len, i - 1 AS t_pos, w[i:i + 2] AS g FROM t, range(1, 60) r(i) WHERE i <= len(w) - 2),
dg AS (SELECT rn, i - 1 AS pos, w[i:i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) r(i)),
votes AS (SELECT rn, template, label, t_len, pos - t_pos AS diagonal, list(DISTINCT t_pos) AS places FROM dg JOIN tg USING (g) GROUP BY ALL),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY rn, template ORDER BY diagonal) AS span
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rn, template ORDER BY diagonal) <= {L.SLACK} THEN 0 ELSE 1 END AS fresh FROM votes)),
covered AS (SELECT rn, label, len(list_distinct(flatten(list_transform(flatten(list(places)), lambda x: [x, x + 1, x + 2])))) / t_len AS cover
  FROM spans GROUP BY rn, template, label, t_len, span),
best AS (SELECT rn, list(DISTINCT label) AS more, max(cover) AS best FROM covered WHERE cover >= {L.LEAST_COVER} GROUP BY rn),
base AS (SELECT rn, doc_id, len(w) AS n_words, {every} AS every, {found} AS found FROM (SELECT *, {places} FROM d))
SELECT doc_id, n_words::BIGINT AS n_words, len(every)::BIGINT AS n_base, (list_min(every) - 1)::BIGINT AS first_word, (list_max(every) - 1)::BIGINT AS last_word,
       array_to_string(list_sort(found), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more, [])))), ',') AS labels,
       CASE WHEN len(every) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM base LEFT JOIN best USING (rn)
"""

#: Counts by the filters that documents fail; every order's steps add them up.
_OP11 = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS filter, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own,
  coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS ahead FROM orders, range(1, 6) r(step)),
s AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (mask & (own | ahead) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & ahead = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & ahead > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & ahead = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & ahead = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM s
"""

#: Every document's score for every item that shares a term with it.
_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT rn, term, count(*) AS tf FROM (SELECT rn, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nn),
m AS (SELECT rn, doc_id, 10 + (90 * len(w)::BIGINT * nn) // ll AS m FROM d, s WHERE len(w) > 0),
sc AS (SELECT item_id, rn, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (rn) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Base 32 from five hexadecimal digits at a time.
_OP13 = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) % 32 + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id OR last_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to, url FROM r
"""


ORACLES = {"op11_filter_interactions": _OP11, "op12_length_strata": _OP12, "op13_warc_salvage": _OP13, "op10_license_scan": _license_scan(), "op6_tool_call_links": _OP6, "op5_curriculum_mix": _OP5}
