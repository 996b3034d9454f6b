"""DuckDB SQL for the text operators that SQL can express."""

from .license_scan import LOWER, PHRASES, UPPER

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_PHRASE_ROWS = ", ".join(f"({_sql_list(p.split())}, '{label}')" for p, label in PHRASES)
# fixed values: the notices as they are printed, their telling phrases and labels
_NOTICES = """
('mit', 'mit license', 'Released under the MIT License.'),
('mit', 'mit license', 'Licensed under the MIT License.'),
('mit', 'any person obtaining a copy of this software', 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software'),
('mit', 'deal in the software without restriction', 'to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
('apache-2', 'apache license version 2', 'Licensed under the Apache License, Version 2.0.'),
('apache-2', 'apache license version 2', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
('apache-2', 'distributed under the license is distributed on an as is basis', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
('gpl-3', 'gnu general public license version 3', 'This work is licensed under the GNU General Public License, version 3.'),
('gpl-3', 'gnu general public license as published by the free software foundation either version 3', 'it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
('gpl-2', 'gnu general public license as published by the free software foundation either version 2', 'it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.'),
('lgpl-3', 'gnu lesser general public license as published by the free software foundation either version 3', 'it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
('agpl-3', 'gnu affero general public license as published by the free software foundation either version 3', 'it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
('bsd', 'bsd license', 'Released under the BSD License.'),
('bsd', 'redistribution and use in source and binary forms', 'Redistribution and use in source and binary forms, with or without modification, are permitted'),
('bsd', 'redistributions of source code must retain', 'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.'),
('mpl-2', 'mozilla public license v 2', 'subject to the terms of the Mozilla Public License, v. 2.0.'),
('isc', 'permission to use copy modify', 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted'),
('zlib', 'alter it and redistribute it freely', 'Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely'),
('boost', 'any person or organization obtaining a copy', 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license'),
('unlicense', 'free and unencumbered software', 'This is free and unencumbered software released into the public domain.'),
('cc-by-nc', 'cc by nc', 'Licensed under CC BY-NC 4.0.'),
('cc-by-sa', 'cc by sa', 'Licensed under CC BY-SA 4.0.'),
('cc-by', 'cc by 4', 'Licensed under CC BY 4.0.'),
('cc-by', 'creative commons attribution 4', 'This work is licensed under a Creative Commons Attribution 4.0 International License.'),
('cc-by-nc', 'attribution noncommercial 4', 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.'),
('cc-by-sa', 'attribution sharealike 4', 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.'),
('cc0', 'waived all copyright and related or neighboring rights', 'has waived all copyright and related or neighboring rights to this work')"""

_SHINGLES = rf"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
         FROM words),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets)"""



def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a string expression's UTF-8 bytes."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"
    bits = "list_reduce([xor(a, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, o: {bits}), 4294967295::BIGINT)"


ORACLES = {
    "op3_license_scan": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM d),
phrases(p, label) AS (VALUES {_PHRASE_ROWS}),
notices(label, telling, printed) AS (VALUES {_NOTICES}),
notice_words AS (SELECT label, telling, regexp_extract_all(translate(printed, '{UPPER}', '{LOWER}'), '{_WORD}') AS t FROM notices),
templates AS (SELECT label, ' ' || telling || ' ' AS telling, list_distinct(t) AS s,
              CAST(pow(2, ceil(log2(ceil(1.25 * len(t))))) AS BIGINT) AS size FROM notice_words),
starts AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM w WHERE list_has_any(w, ['license', 'by'])),
places AS (SELECT doc_id, i, label FROM starts, phrases WHERE w[i + 1:i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM places GROUP BY 1),
told AS (SELECT doc_id, w, label, telling, s, size FROM w, templates WHERE contains(' ' || array_to_string(w, ' ') || ' ', telling)),
blocks AS (SELECT doc_id, w, label, telling, s, size, unnest(range(0, len(w), size)) AS i FROM told),
held AS (SELECT doc_id, label, len(list_intersect(s, w[i + 1:i + 2 * size])) / len(s) AS c FROM blocks
         WHERE 10 * len(list_intersect(s, w[i + 1:i + 2 * size])) >= 8 * len(s)
           AND contains(' ' || array_to_string(w[i + 1:i + 2 * size], ' ') || ' ', telling)),
own AS (SELECT doc_id, list(DISTINCT label) AS own, max(c) AS c FROM held GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE {_SHINGLES},
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
          WHERE 100 * k >= 75 * (len(a.s) + len(b.s) - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM sets s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op12_prefix_trie": rf"""
WITH turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS pos,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS n, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM turns GROUP BY 1),
convs AS (SELECT o.conv_id, o.n, o.h, o.conv_id - o.conv_id % 20 AS source, least(o.h, coalesce(s.n, 0)) AS k
          FROM own o LEFT JOIN own s ON s.conv_id = o.conv_id - o.conv_id % 20),
rebuilt AS (SELECT c.conv_id, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.source AND t.pos < c.h
            UNION ALL SELECT c.conv_id, t.pos - c.h + c.k, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
paths AS (SELECT conv_id, pos + 1 AS depth, text,
                 list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM rebuilt
          UNION ALL SELECT conv_id, 0, '', [] FROM convs),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words
          FROM paths GROUP BY 1, 2),
member AS (SELECT p.conv_id AS c, p.depth, n.conv_id, n.n_convs, n.words FROM paths p JOIN nodes n ON n.path = p.path),
links AS (SELECT DISTINCT a.conv_id, a.depth, b.conv_id AS below, b.depth AS below_depth, b.n_convs, b.words
          FROM member a JOIN member b ON a.c = b.c AND b.depth >= a.depth),
children AS (SELECT conv_id, depth, count(*) FILTER (below_depth = depth + 1) AS n_children FROM links GROUP BY 1, 2),
sums AS (SELECT l.conv_id, l.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((l.n_convs - 1) * l.words) AS saved_tokens
         FROM links l JOIN children c ON c.conv_id = l.below AND c.depth = l.below_depth GROUP BY 1, 2),
ends AS (SELECT m.conv_id, m.depth, string_agg(m.c, ',' ORDER BY m.c) AS ids
         FROM member m JOIN (SELECT c, max(depth) AS depth FROM member GROUP BY 1) e ON e.c = m.c AND e.depth = m.depth GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN member p ON p.c = n.conv_id AND p.depth = n.depth - 1
JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth JOIN sums s ON s.conv_id = n.conv_id AND s.depth = n.depth
LEFT JOIN ends e ON e.conv_id = n.conv_id AND e.depth = n.depth""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
sums AS (SELECT run, {_crc32("key")} AS h, k FROM
         (SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2)),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM
          (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums)
          WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS r(i)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
         UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
         UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, encode(other)) AS other, max(m) AS m FROM near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
          FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS last, 0 AS steps FROM forms
         UNION ALL SELECT w.word, f.form, w.steps + 1 FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, (SELECT arg_max(w.last, w.steps) FROM walk w WHERE w.word = f.word) AS root, f.n, f.n_near, f.form_n FROM forms f""",
}
