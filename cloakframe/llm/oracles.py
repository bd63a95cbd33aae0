"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

import re

from . import license_scan as scans

_PLAIN = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"unnest(regexp_extract_all({_PLAIN.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w"

RANKED_SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents), t AS (SELECT r, doc_id, {_TERMS} FROM d),
  n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
  q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_TERMS} FROM benchmark)), f AS (SELECT r, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL),
  g AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY w),
  s AS (SELECT item_id, r, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN f USING (w) JOIN g USING (w) JOIN n USING (r), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM s JOIN n USING (r) WHERE score > 0 WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10"""


def _doubled(pattern: str) -> str:
    """A pattern for texts in which every word stands between two spaces of its own: no look-ahead is needed then."""
    return re.sub(" [?]", "\0", pattern).replace(" ", "  ").replace("\0", "(?:  )?")


def license_scan() -> str:
    """Every rule whose keyword is met on every text, and the detections that nothing suppresses, by definition."""
    rules = scans.rules()
    rows = [(i, r.label, r.keyword, f" (?:{_doubled(r.pattern)}) ", r.priority) for i, r in enumerate(rules)]
    rows += [(-1 - i, label, phrase, f" {_doubled(phrase)} ", scans.BASE_CONFIDENCE) for i, (phrase, label) in enumerate(scans.BASE)]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(_doubled(k))}, {quoted(p)}, {n})" for i, a, k, p, n in rows)
    count = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    words = f"trim(regexp_replace({_PLAIN.format(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    within = "SELECT 1 FROM x AS c WHERE c.r = x.r AND c.rule >= 0 AND c.first <= x.first AND c.next >= x.next AND (c.priority > x.priority OR (c.priority = x.priority AND (c.next - c.first > x.next - x.first OR (c.next - c.first = x.next - x.first AND c.rule < x.rule))))"
    return f"""WITH rules(rule, label, keyword, pattern, priority) AS (VALUES {values}),
  t AS (SELECT r, doc_id, CASE WHEN v = '' THEN '' ELSE ' ' || replace(v, ' ', '  ') || ' ' END AS w FROM (SELECT row_number() OVER () AS r, doc_id, {words} AS v FROM documents)),
  m AS (SELECT r, rule, label, priority, string_split_regex(w, pattern) AS pieces, regexp_extract_all(w, pattern) AS found FROM t JOIN rules ON contains(w, ' ' || keyword)),
  a AS (SELECT r, rule, label, priority, list_transform(pieces, lambda p: {count('p')}) AS skipped, list_transform(found, lambda p: {count('p')}) AS taken, unnest(range(1, len(found) + 1)) AS i FROM m),
  x AS (SELECT r, rule, label, priority, CAST(list_sum(skipped[1:i]) + coalesce(list_sum(taken[1:i - 1]), 0) AS BIGINT) AS first, CAST(list_sum(skipped[1:i]) + list_sum(taken[1:i]) AS BIGINT) AS next FROM a),
  s AS (SELECT * FROM x WHERE rule < 0 OR NOT EXISTS ({within})),
  g AS (SELECT r, count(*) FILTER (rule < 0) AS n_base, min(first) FILTER (rule < 0) AS first_word, max(first) FILTER (rule < 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (rule < 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) / 100 AS score, count(*) FILTER (rule >= 0) AS n_detections FROM s GROUP BY r)
SELECT doc_id, CAST({count('w')} AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_detections, 0) AS n_detections
FROM t LEFT JOIN g USING (r)"""


def conversation_repair() -> str:
    """The damage, the faults, and the cheapest edits by one step of a table of four states for each row of a conversation."""
    table = "list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(place, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, crcs[xor(c, b) % 256 + 1])), 4294967295)"

    def then(state: str, cost: str, edit: str, row: str | None, unless: str = "false") -> str:
        text = f"list_append({state}.t, {row})" if row else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL AND NOT ({unless}) THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {text}}} END"

    gone = "bad"  # blank and duplicate rows must go
    delete = lambda s: then(s, "4", "D", None)
    keep = lambda s, initial: then(s, "more", "K", "role || ':' || text", f"{gone} OR substr(role, 1, 1) <> '{initial}'")
    rerole = lambda s, role: then(s, "3 + more", "R", f"'{role}:' || text", gone)
    insert = lambda s, role: then(s, "3", "I", f"'{role}:'")
    user = ", ".join(f"{keep(s, 'u')}, {rerole(s, 'user')}" for s in ("e", "s", "a"))
    start = "{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}", "{'c': CAST(3 AS BIGINT), 'a': 'I', 't': ['user:']}", "{'c': CAST(6 AS BIGINT), 'a': 'II', 't': ['user:', 'assistant:']}"
    return f"""WITH RECURSIVE k AS (SELECT {table} AS crcs),
  p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place FROM conversations),
  h AS (SELECT p.* EXCLUDE (place), {crc} % 20 AS fault FROM p, k),
  d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS again FROM h WHERE fault <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i FROM d),
  f AS (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) NOT IN ('.', '!', '?') AS cut,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') AS odd FROM o),
  z AS (SELECT *, blank OR seen AS bad, CASE WHEN cut THEN 3 ELSE 0 END AS more FROM f),
  dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {start[0]} AS e, CASE WHEN false THEN {start[0]} END AS s, {start[1]} AS u, {start[2]} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT conv_id, i, e1, s1, u2, list_min([a1, {insert('u2', 'assistant')}]) FROM (SELECT *, list_min([u1, {insert('e1', 'user')}, {insert('s1', 'user')}, {insert('a1', 'user')}]) AS u2 FROM (
      SELECT z.conv_id, z.i, {delete('e')} AS e1, list_min([{delete('s')}, {keep('e', 's')}]) AS s1, list_min([{delete('u')}, {user}]) AS u1, list_min([{delete('a')}, {keep('u', 'a')}, {rerole('u', 'assistant')}]) AS a1
      FROM dp JOIN z ON z.conv_id IS NOT DISTINCT FROM dp.conv_id AND z.i = dp.i + 1))),
  w AS (SELECT conv_id, list_min([e, a]) AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
  c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (odd) AS illegal FROM z GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit, sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id"""
