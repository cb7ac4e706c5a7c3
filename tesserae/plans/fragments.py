"""SQL fragments for the equivalents of queries, in DuckDB's dialect."""

from __future__ import annotations

CJK = r"[々〇\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]+"


def windows(run: str, size: int) -> str:
    return f"list_transform(range(1, greatest(length({run}) - {size} + 1, 1) + 1), lambda i: substr({run}, i::int, {size}))"


def tokens(text: str) -> str:
    words = rf"list_filter(string_split_regex(lower(regexp_replace({text}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9_]+'), lambda w: length(w) >= 2)"
    return f"coalesce(list_concat({words}, flatten(list_transform(regexp_extract_all({text}, '{CJK}'), lambda r: {windows('r', 2)}))), [])"


def features(text: str) -> str:
    plain = rf"trim(regexp_replace(lower({text}), '\s+', ' ', 'g'))"
    run = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]+"
    grams = f"flatten(list_transform(regexp_extract_all({plain}, '{run}'), lambda r: case when length(r) <= 2 then [r] else list_concat({windows('r', 2)}, {windows('r', 3)}) end))"
    found = f"list_distinct(list_concat(regexp_extract_all({plain}, '[a-z0-9_]{{2,}}'), {grams}))"
    compact = f"replace({plain}, ' ', '')"
    return f"coalesce(case when len({found}) > 0 then {found} when length({compact}) = 0 then [] else list_distinct({windows(compact, 3)}) end, [])"


#: Questions of the search: those of the results whose id is divisible by 50.
QUESTIONS = """
turns as (
    select session_id, t.turn_id as turn_id, min(t.question) as question
    from (select session_id, unnest(turns) as t from eval_sessions) group by all
), queries as (
    select r.result_id as query_id, t.question as query
    from query_results r join turns t on t.session_id = r.session_id and t.turn_id = r.turn_id
    where r.result_id % 50 = 0 and t.question is not null
)"""

TEXT = "concat_ws(' ', rel_path, coalesce(section_header, ''), content)"

BM25 = f"""
with {QUESTIONS}, toks as (
    select chunk_no, {tokens(TEXT)} as toks from chunks
), lens as (select count(*) as n, avg(len(toks)) as avgdl from toks),
posts as (select chunk_no, token, dl, count(*) as tf from (select chunk_no, len(toks) as dl, unnest(toks) as token from toks) group by all),
raw as (select token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) as raw, count(*) as df from posts, lens group by token, n),
terms as (select token, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
asked as (select query_id, token, count(*) as qf from (select query_id, unnest({tokens('query')}) as token from queries) group by all),
scores as (
    select query_id, chunk_no, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
    from asked join terms using (token) join posts using (token), lens group by all
)"""

#: Hashed vectors of postings: counts per slot and their norm.
SLOTS = """, {2} as (select {1}, ('0x' || left(md5(token), 4))::int % 64 as slot, sum(tf)::double as n from {0} group by all), {2}_norm as (select {1}, sqrt(sum(n * n)) as norm from {2} group by all)"""

#: Lexical and vector lists of 40, each over its query's best, in one outer union with ranks.
HYBRID = BM25 + SLOTS.format("posts", "chunk_no", "slots") + SLOTS.format("(select query_id, token, qf as tf from asked)", "query_id", "qslots") + """,
dots as (select query_id, chunk_no, sum(qslots.n * slots.n) as dot from qslots join slots using (slot) group by all),
cosines as (select q.query_id, s.chunk_no, round(coalesce(dot, 0) / (q.norm * s.norm), 6) as score from qslots_norm q cross join slots_norm s left join dots d on d.query_id = q.query_id and d.chunk_no = s.chunk_no),
dense as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_no) as k from cosines) where k <= 40),
lexical as (select * from (select query_id, chunk_no, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as k from scores join chunks using (chunk_no)) where k <= 40),
a as (select query_id, chunk_no, score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) as s from lexical),
b as (select query_id, chunk_no, score / coalesce(nullif(max(score) over (partition by query_id), 0), 1) as s from dense),
u as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.chunk_no, b.chunk_no) as chunk_no, coalesce(a.s, 0) as lexical_score, coalesce(b.s, 0) as dense_score from a full join b on a.query_id = b.query_id and a.chunk_no = b.chunk_no),
fused as (select *, row_number() over (partition by query_id order by score desc, chunk_no) as rank from (select *, round(0.45 * lexical_score + 0.45 * dense_score, 6) as score from u))"""
