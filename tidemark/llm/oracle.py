"""DuckDB SQL for the registered text queries that it can express.

The others are held against plain Python in the tests: the engine has no CRC
and no 64-bit hash of the same kind, cannot list all matches of a pattern with
their places, and is too slow on whole tables for pairs of texts.
"""

_WORDS = (
    "regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
)

_CONTAMINATION = f"""
    with bw as (select cast(item_id as varchar) as item, {_WORDS.format('text')} as w from benchmark),
    win as (
        select item, array_to_string(w, ' ') as win, len(w) as n from bw where len(w) between 1 and 9
        union select item, array_to_string(w[s:s + 9], ' '), 10
        from (select item, w, unnest(range(1, len(w) - 8)) as s from bw where len(w) >= 10)),
    dw as (select doc_id, {_WORDS.format('text')} as w from documents),
    places as (
        select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as win
        from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s
              from dw, (select distinct n from win) where len(w) >= n)),
    hits as (select distinct doc_id, item, s, places.n from places join win using (win)),
    covered as (select doc_id, count(*) as n_hit
                from (select distinct doc_id, unnest(range(s, s + n)) as p from hits) group by doc_id),
    items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
              from (select distinct doc_id, item from hits) group by doc_id)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from dw left join covered using (doc_id) left join items using (doc_id)"""

_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn')"

_CHAT = rf"""
    with t as (
        select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
        union all select -7, 0, 'user', '\### Assistant: </turn> ok'
        union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
    g as (
        select conv_id, count(*) as n_turns,
               string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as turns,
               coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '') as loss,
               sum(length({_ESCAPED.format('text')}) + 16
                   + length(replace({_ESCAPED.format('role')}, '>', '\g'))) as formatted_chars,
               string_agg(role, ',' order by turn, role, text) as roles
        from t group by conv_id)
    select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
           cast(formatted_chars as bigint) as formatted_chars,
           case roles when 'user,assistant' then 'completion' when 'system,user,assistant' then 'instruction'
                else 'messages' end as layout
    from g"""

ORACLE = {"op3_decontaminate": _CONTAMINATION, "op9_chat": _CHAT}
