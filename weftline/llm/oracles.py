"""DuckDB SQL that computes what the newer queries return, by plainer ways than theirs."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii(substr({text}, i::INT, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: {step}), 4294967295)"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text: str) -> str:
    field = lambda f: f"coalesce(strlen(({f})::VARCHAR) || ':' || ({f})::VARCHAR, '-')"
    return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: Levels by recursion over all trees, siblings by a self join, roots folded by a list of left and right siblings.
MERKLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf('text')} END AS shown
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
up(tree, lvl, pos, h, n) AS (
  SELECT tree, 0, pos, leaf, n FROM p
  UNION ALL
  SELECT tree, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY tree, lvl, pos // 16, n),
sub AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, h, n) AS (
  SELECT 0, pos, h, n FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
nodes AS (SELECT tree, lvl, pos, h FROM up WHERE n > 1 UNION ALL SELECT NULL, 1000 + lvl, pos, h FROM top WHERE n > 1),
sib AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.tree IS NOT DISTINCT FROM b.tree AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 GROUP BY a.tree, a.lvl, a.pos),
steps AS (
  SELECT p.tree, p.pos, lvl, l, r FROM p JOIN sib s ON s.tree = p.tree AND s.pos = p.pos // (16 ** s.lvl)::BIGINT
  UNION ALL
  SELECT p.tree, p.pos, lvl, l, r FROM p JOIN sub ON sub.tree = p.tree JOIN sib s ON s.lvl >= 1000 AND s.pos = sub.pos // (16 ** (s.lvl - 1000))::BIGINT),
paths AS (SELECT tree, pos, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || '|' || r ORDER BY lvl) AS sides FROM steps GROUP BY tree, pos)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       list_reduce(list_concat([shown], coalesce(sides, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root,
       folded_root = top.h AS verified
FROM p JOIN sub USING (tree) CROSS JOIN (SELECT h FROM top WHERE n = 1) top LEFT JOIN paths ON paths.tree = p.tree AND paths.pos = p.pos
"""


def _permuted(x: str, n: str, name: str) -> str:
    """The swap-or-not network of the mix for x in 0 .. n-1; name: an SQL string that tells permutations apart. Rounds and keys are packed in one integer."""
    key = f"('0x' || substr(md5('mix:key:' || {name} || ':' || r), 1, 12))::BIGINT % {n} * 32 + r"
    partner = f"((e // 32 - x + {n}) % {n})"
    step = f"CASE WHEN ascii(md5('mix:' || {name} || ':' || (e % 32) || ':' || greatest(x, {partner}))) % 2 = 1 THEN {partner} ELSE x END"
    return f"list_reduce(list_concat([{x}::BIGINT], list_transform(range(24), lambda r: {key})), lambda x, e: {step})"


#: Targets from the sources sorted by size over weight; the sources that come first stop at twice their size.
MIX = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(text, '')) AS digest
  FROM documents),
w AS (SELECT key, source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM (SELECT key, source, sum(size)::BIGINT AS source_size FROM d GROUP BY key, source)),
c AS (SELECT *, (3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS num, (2 * sum(weight) OVER after)::BIGINT AS den, row_number() OVER o AS k
      FROM w WINDOW o AS (ORDER BY source_size / weight, key), before AS (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
first AS (SELECT k, num, den FROM c WHERE weight * num <= 2 * source_size * den ORDER BY k LIMIT 1),
s AS (SELECT key, source_size, CASE WHEN c.k < f.k THEN (2 * source_size)::DOUBLE ELSE (weight * f.num)::DOUBLE / f.den::DOUBLE END AS target, floor(target + 0.5)::BIGINT AS words
      FROM c CROSS JOIN first f),
passes AS (SELECT key, pass, source_size // 256 AS full_blocks, greatest(0, least(words - pass * source_size, source_size)) AS todo FROM s CROSS JOIN (VALUES (0), (1)) v(pass)),
i AS (SELECT key, pass, full_blocks, todo, unnest(range((todo + 255) // 256)) AS i FROM passes),
slots AS (
  SELECT key, least(256, todo - i * 256) AS words, CASE WHEN i < full_blocks THEN {_permuted('i', 'greatest(full_blocks, 1)', "key || ':' || pass")} ELSE full_blocks END AS block FROM i),
rows AS (SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, size, digest ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start, row_number() OVER () AS row FROM d),
pieces AS (SELECT row, key, start, size, unnest(range(start // 256, (start + size - 1) // 256 + 1)) AS block FROM rows WHERE size > 0),
taken AS (SELECT row, sum(greatest(0, least(start + size - p.block * 256, words) - greatest(start - p.block * 256, 0)))::BIGINT AS taken
          FROM pieces p JOIN slots USING (key, block) GROUP BY row)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0) AS taken, source FROM rows JOIN s USING (key) LEFT JOIN taken USING (row)
"""


def _best(code: str, keep: str, fill: str, drop: str) -> str:
    """The least of a row's arcs as a string of cost and letters; each of keep, fill and drop is the suffix that follows, as such a string."""
    arc = lambda cost, letter, rest: f"printf('%012d', {rest}[:12]::BIGINT + {cost}) || '{letter}' || {rest}[13:]"
    late = f"CASE WHEN {code} = 'T' THEN 3 ELSE 0 END"
    kept = f"CASE WHEN {code} = 'B' OR {keep} IS NULL THEN NULL ELSE {arc(late, 'K', keep)} END"
    filled = f"CASE WHEN {code} = 'B' THEN NULL ELSE {arc(f'(3 + {late})', 'R', fill)} END"
    return f"least({arc('4', 'D', drop)}, {filled}, {kept})"


def _insert(rest: str) -> str:
    return f"printf('%012d', {rest}[:12]::BIGINT + 3) || 'I' || {rest}[13:]"


#: Of each state before each row the cheapest and least suffix, from the last row back: cost and letters in one string, so that `least` decides.
REPAIR = f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
crc AS (SELECT *, {_crc32('name')} % 20 AS kind FROM raw),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, LATERAL unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows),
faults AS (SELECT *, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS tail, role[:1] AS initial,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, CASE WHEN tail = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
coded AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'B' WHEN fault = 'truncated' THEN 'T' ELSE 'W' END AS code,
                 coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n FROM coded GROUP BY conv_id),
walk(conv_id, pos, a, s, u, e) AS (
  SELECT conv_id, n, '000000000000', '000000000006II', '000000000003I', '000000000000' FROM counts
  UNION ALL
  SELECT conv_id, pos - 1, least(a1, {_insert('u2')}), least(s1, {_insert('u2')}), u2, least(e1, {_insert('u2')})
  FROM (SELECT *, least(u1, {_insert('e1')}, {_insert('a0')}) AS u2 FROM (
    SELECT w.conv_id, w.pos, NULL::VARCHAR AS a0,
           {_best('code', "CASE initial WHEN 's' THEN s WHEN 'u' THEN u END", 'u', 'a')} AS a1,
           {_best('code', "CASE initial WHEN 'u' THEN u END", 'u', 's')} AS s1,
           {_best('code', "CASE initial WHEN 'a' THEN e END", 'e', 'u')} AS u1,
           {_best('code', "CASE initial WHEN 'u' THEN u END", 'u', 'e')} AS e1
    FROM walk w JOIN coded c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.pos = w.pos))),
done AS (SELECT conv_id, a[:12]::BIGINT AS cost, a[13:] AS audit FROM walk WHERE pos = 0),
letters AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS i FROM done WHERE audit <> ''),
steps AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS line FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
lines AS (SELECT s.*, c.role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, first_value(letter = 'K' AND c.initial = 's') OVER (PARTITION BY s.conv_id ORDER BY line, i) AS sys
          FROM steps s LEFT JOIN coded c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.pos = s.pos WHERE letter <> 'D'),
hashes AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS h FROM lines GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""
