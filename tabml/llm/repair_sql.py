"""SQL of the conversation repair: repairs are built from the last row to the first, the best for each of four states."""

from __future__ import annotations


def _edit(cost: str, letter: str, lines: str, state: str) -> str:
    """One more edit in front of the best repair of the rest from a state on."""
    return f"struct_pack(c := {cost} + {state}.c, a := '{letter}' || {state}.a, t := {lines} || {state}.t)"


def _row_edits(p: int) -> str:
    """The best repair of a row and the rest from state p (0 nothing, 1 system, 2 user, 3 assistant said last)."""
    stays, line = "truncated::BIGINT", "[role || ':' || text]"
    to, role = (3, "assistant") if p == 2 else (2, "user")
    keeps = [f"WHEN initial = '{role[0]}' THEN {_edit(stays, 'K', line, f'h{to}')}"]
    keeps += [f"WHEN initial = 's' THEN {_edit(stays, 'K', line, 'h1')}"] * (p == 0)
    set_line = f"['{role}:' || text]"
    return (f"list_min([{_edit('3', 'D', '[]::VARCHAR[]', f'h{p}')}, CASE WHEN goes THEN NULL {' '.join(keeps)} END, "
            f"CASE WHEN NOT goes THEN {_edit(f'2 + {stays}', 'R', set_line, f'h{to}')} END]) AS b{p}")


def _inserted(p: int) -> str:
    """The best of the rest from state p when turns may be put in front of it."""
    user, answer = _edit("2", "I", "['user:']", "b2"), _edit("2", "I", "['assistant:']", "b3")
    both = _edit("4", "II", "['user:', 'assistant:']", "b3")
    return f"list_min([b{p}, {', '.join({2: [answer], 3: [user]}.get(p, [user, both]))}]) AS h{p}"


NONE = "struct_pack(c := 1000000000::BIGINT, a := '', t := []::VARCHAR[])"
DONE = "struct_pack(c := 0::BIGINT, a := '', t := []::VARCHAR[])"

REPAIR = rf"""
WITH RECURSIVE crc(i, k, c) AS (
    SELECT i, 0, i::BIGINT FROM range(256) t(i) UNION ALL
    SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
spelt AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, t,
           [4294967295] || [ord(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS bytes
    FROM conversations, steps),
hashed AS (SELECT *, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM spelt),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM hashed, range(2) r(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i,
           left(role, 1) AS initial, rtrim(text, E' \t\n\x0B\x0C\r') AS body FROM damaged),
judged AS (
    SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
rows AS (SELECT *, blank OR duplicate AS goes, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated FROM judged),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           sum(blank::INT)::BIGINT AS blank, sum(duplicate::INT)::BIGINT AS duplicate, sum(truncated::INT)::BIGINT AS truncated,
           coalesce(sum((pair NOT IN ('su', 'ua', 'au'))::INT), 0)::BIGINT AS illegal
    FROM rows GROUP BY conv_id),
rest(conv_id, i, b0, b1, b2, b3) AS (
    SELECT conv_id, n + 1, {DONE}, {NONE}, {NONE}, {DONE} FROM counts
    UNION ALL
    SELECT conv_id, i, {', '.join(_row_edits(p) for p in range(4))}
    FROM (SELECT r.*, {', '.join(_inserted(p) for p in range(4))} FROM rest s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.i - 1)),
best AS (SELECT conv_id, {_inserted(0)} FROM rest WHERE i = 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(h0.c, 0) AS cost, coalesce(h0.a, '') AS audit, sha256(coalesce(array_to_string(h0.t, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id"""
