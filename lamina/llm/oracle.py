"""DuckDB counterparts of the corpus queries, where SQL can express them.

Only grouping by exact similarity can: the other operators train models, hash, sample, or give back ids of a vocabulary.
"""

#: Distinct shingles of each text, pairs of texts by the shingles that they share, and the least key that each reaches.
_OP6 = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
 s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) end) as shingle from w),
 n as (select doc_id, count(*) as n from s group by 1),
 p as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id group by 1, 2),
 l as (select a, b from p join n m on a = m.doc_id join n o on b = o.doc_id where 100 * shared >= 80 * (m.n + o.n - shared)),
 r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
 c as (select a as doc_id, min(b) as least from r group by 1)
 select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) as component_id, least(w.doc_id, coalesce(c.least, w.doc_id)) = w.doc_id as kept
 from w left join n using (doc_id) left join c using (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op6_near_dedup": _OP6}
