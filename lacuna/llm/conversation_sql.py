"""SQL with the same rows as the conversation queries, for DuckDB, which has no CRC-32: it is worked out bit by bit."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The CRC-32 of an ASCII string expression: its reflected polynomial, byte after byte, from all ones to their complement."""
    bits = "lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end"
    step = f"lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), {bits})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda k: ascii(k)::BIGINT)), {step}), 4294967295)"


_BLANK = r"'^[\x20\x09-\x0D]*$'"

REPAIR = f"""with recursive r as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 fault from conversations),
x as (select conv_id, turn, case fault when 4 then 'user' else role end role, case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end text, unnest(range(case fault when 0 then 0 when 3 then 2 else 1 end)) copy from r),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) i from x),
s as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 seen, regexp_matches(text, {_BLANK}) blank from o),
t as (select *, blank or seen must, not (blank or seen) and not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') cut, role[1] initial, lag(role[1]) over (partition by conv_id order by i) before from s),
ins(a, b, made, how) as (values ('E', 'E', '', ''), ('E', 'U', chr(10) || 'user:', 'I'), ('E', 'A', chr(10) || 'user:' || chr(10) || 'assistant:', 'II'), ('S', 'S', '', ''), ('S', 'U', chr(10) || 'user:', 'I'), ('S', 'A', chr(10) || 'user:' || chr(10) || 'assistant:', 'II'), ('U', 'U', '', ''), ('U', 'A', chr(10) || 'assistant:', 'I'), ('A', 'A', '', ''), ('A', 'U', chr(10) || 'user:', 'I')),
step(b, c, as_) as (values ('E', 'S', 's'), ('E', 'U', 'u'), ('S', 'U', 'u'), ('A', 'U', 'u'), ('U', 'A', 'a'), ('E', 'E', 'd'), ('S', 'S', 'd'), ('U', 'U', 'd'), ('A', 'A', 'd')),
w as (select distinct conv_id, 0::BIGINT i, 'E' place, '00000000' way, '' made from conversations
union all
select conv_id, i, place, min(way), arg_min(made, way) from (
select w.conv_id, t.i, step.c place, printf('%08d', w.way[1:8]::BIGINT + 5 * len(ins.how) + case when as_ = 'd' then 2 else 5 * cut::INT + (initial <> as_)::INT end) || w.way[9:] || ins.how || case when as_ = 'd' then 'D' when initial = as_ then 'K' else 'R' end way,
w.made || ins.made || case when as_ = 'd' then '' when initial = as_ then chr(10) || role || ':' || text else chr(10) || case as_ when 'u' then 'user:' else 'assistant:' end || text end made
from w join t on t.conv_id is not distinct from w.conv_id and t.i = w.i + 1 join ins on ins.a = w.place join step on step.b = ins.b
where as_ = 'd' or (not must and (initial = as_ or as_ <> 's'))) group by 1, 2, 3),
e as (select w.conv_id, min(printf('%08d', w.way[1:8]::BIGINT + 5 * len(ins.how)) || w.way[9:] || ins.how) way, arg_min(w.made || ins.made, printf('%08d', w.way[1:8]::BIGINT + 5 * len(ins.how)) || w.way[9:] || ins.how) made
from w join (select conv_id, max(i) i from w group by 1) z on z.conv_id is not distinct from w.conv_id and z.i = w.i join ins on ins.a = w.place and ins.b in ('E', 'A') group by 1),
f as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::BIGINT gaps, count_if(blank)::BIGINT blank, count_if(not blank and seen)::BIGINT duplicate, count_if(cut)::BIGINT truncated, count_if(before is not null and before || initial not in ('su', 'ua', 'au'))::BIGINT illegal from t group by 1)
select e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, way[1:8]::BIGINT as cost, way[9:] audit, sha256(made[2:]) repaired_sha256 from e left join f on f.conv_id is not distinct from e.conv_id"""

TRIE = f"""with own as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) k, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) turn_sha, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) words from conversations where conv_id is not null),
ids as (select distinct conv_id, conv_id - conv_id % 20 base, {crc32("conv_id::VARCHAR")} % 4 h from own),
mixed as (select ids.conv_id, k, turn_sha, words from ids join own on own.conv_id = base and k <= h union all select ids.conv_id, k + 100, turn_sha, words from ids join own using (conv_id) where k > h),
turns as (select *, row_number() over (partition by conv_id order by k) depth from mixed),
place as (select conv_id, 0 depth, '' prefix, 0 words from ids union all select conv_id, depth, sha256(string_agg(turn_sha, ',') over (partition by conv_id order by depth)), words from turns),
size as (select *, max(depth) over (partition by conv_id) turns, min(conv_id) over (partition by depth, prefix) node, count(*) over (partition by depth, prefix) n_convs from place),
nodes as (select depth, node, any_value(n_convs) n_convs, any_value(words) words, coalesce(string_agg(conv_id, ',' order by conv_id) filter (turns = depth), '') ends from size group by 1, 2),
up as (select nodes.*, size.node parent from nodes left join size on size.conv_id = nodes.node and size.depth = nodes.depth - 1),
kids as (select up.*, coalesce(c.n, 0) n_children from up left join (select depth - 1 depth, parent, count(*) n from up where parent is not null group by 1, 2) c on c.depth = up.depth and c.parent = up.node),
sums as (select size.depth, size.node, count_if(n_children = 0)::BIGINT n_leaves, sum((kids.n_convs - 1) * kids.words)::BIGINT saved from kids join size on size.conv_id = kids.node and size.depth <= kids.depth group by 1, 2)
select node conv_id, depth::BIGINT depth, parent parent_conv_id, n_convs::BIGINT n_convs, n_children::BIGINT n_children, n_leaves, saved saved_tokens, sha256(ends) ends_sha256 from kids join sums using (depth, node)"""
