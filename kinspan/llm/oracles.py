"""DuckDB SQL for the queries that SQL can express over whole tables."""

from kinspan.llm import decontamination, embedding_dedup

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP4 = f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= {embedding_dedup.COSINE}
), reach(a, b) as (select a, b from l union select r.a, l.b from reach r join l on l.a = r.b),
n as (select a, count(*) n from l group by 1), c as (select a, min(b) b from reach group by 1)
select e.vec_id, coalesce(n.n, 0) n_links, least(coalesce(c.b, e.vec_id), e.vec_id) component_id, least(coalesce(c.b, e.vec_id), e.vec_id) = e.vec_id kept
from embeddings e left join n on n.a = e.vec_id left join c on c.a = e.vec_id
"""

OP8 = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) size, substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) h from documents),
s as (select source, sum(size) source_size from d group by 1),
w as (select *, [5.0, 2.0, 1.0][(row_number() over (order by source is null, source) - 1) % 3 + 1] w from s),
f as (select *, 2.0 * source_size / w fills, 1.5 * sum(source_size) over () budget from w),
g as (select *, budget - coalesce(sum(2.0 * source_size) over o, 0) room, sum(w) over () - coalesce(sum(w) over o, 0) left_w from f
      window o as (order by fills, source is null, source rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, case when lv is null then 2.0 * source_size else least(2.0 * source_size, lv * w) end target
      from (select *, (select min_by(room / left_w, fills) from g x where x.room / x.left_w <= x.fills) lv from g)),
q as (select *, least(floor(coalesce(target / nullif(source_size, 0), 0)), 2) whole from t),
r as (select d.*, q.source_size, q.target, q.whole, q.target - q.whole * q.source_size want,
      coalesce(sum(size) over (partition by d.source order by h, doc_id rows between unbounded preceding and 1 preceding), 0) before
      from d join q on d.source is not distinct from q.source)
select doc_id, cast(size as bigint) size, cast(source_size as bigint) source_size, cast(target as double) target,
  cast(size * (whole + case when whole < 2 and want > 0 and want - before >= size / 2.0 then 1 else 0 end) as bigint) taken from r
"""

OP9 = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) a from documents),
g as (select doc_id, unnest(range(1, len(a) - 33)) i, a from d where len(a) >= 35),
r as (select doc_id, i, array_to_string(a[i:i + 34], ' ') run from g),
m as (select doc_id, i from (select *, count(*) over (partition by run) c from r) where c > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) p from m),
w as (select doc_id, unnest(a) word, unnest(range(1, len(a) + 1)) p from d),
k as (select w.doc_id, string_agg(word, ' ' order by w.p) kept, count(*) n from w left join gone on gone.doc_id = w.doc_id and gone.p = w.p where gone.p is null group by 1)
select d.doc_id, cast(len(a) as bigint) n_words, cast(len(a) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256 from d left join k on k.doc_id = d.doc_id
"""


def _tokens(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


OP10 = f"""
with i as (select item_id, w, len(w) n, least(len(w), {decontamination.SHINGLE}) k from (select distinct item_id, {_tokens('text')} w from benchmark) where len(w) > 0),
ig as (select item_id, n, k, w, unnest(range(1, n - k + 2)) q from i),
ic as (select item_id, n, k, array_to_string(w[q:q + k - 1], ' ') g, count(*) c from ig group by 1, 2, 3, 4),
d as (select doc_id, {_tokens('text')} w from documents),
ks as (select distinct k from i),
dg as (select doc_id, k, w, unnest(range(1, len(w) - k + 2)) p from d, ks where len(w) >= k),
h as (select doc_id, p, item_id, n t, least(n, size) n, ic.k, g, c from (select doc_id, k, p, len(w) size, array_to_string(w[p:p + k - 1], ' ') gram from dg) x join ic on ic.k = x.k and ic.g = x.gram),
s as (select distinct doc_id, item_id, t, n, k, unnest(range(greatest(p - (n - k), 1), p + 1)) s from h),
m as (select s.doc_id, s.item_id, s.t, s.n, s.k, s.s, h.g, least(count(*), any_value(c)) as shared from s join h on h.doc_id = s.doc_id and h.item_id = s.item_id and h.p between s.s and s.s + s.n - s.k group by all),
v as (select doc_id, item_id, n, s, sum(shared) b, t + n - 2 * k + 2 both_n from m group by doc_id, item_id, t, n, k, s),
z as (select v.doc_id, item_id, n, s, b / (both_n - b) sim from v join d on d.doc_id = v.doc_id where s + n - 1 <= len(d.w)),
best as (select doc_id, item_id, max(sim) similarity from z where sim >= {decontamination.SIMILARITY} group by 1, 2)
select best.doc_id, best.item_id, cast(min(z.s) - 1 as integer) as "start", cast(any_value(z.n) as integer) n_words, cast(similarity as double) similarity
from best join z on z.doc_id = best.doc_id and z.item_id = best.item_id and z.sim = best.similarity group by best.doc_id, best.item_id, similarity
"""

#: crc32 of a text of ASCII characters, byte by byte over its table.
_CRC_TABLE = "select list(v order by i) tab from (select i, list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) v from range(256) r(i))"


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


OP11 = f"""
with recursive crc as ({_CRC_TABLE}),
o as (select conv_id, coalesce(role, '') r, coalesce(text, '') t, row_number() over (partition by conv_id order by turn nulls first, role, text) i from conversations where conv_id is not null),
c as (select conv_id, {_crc("cast(conv_id as varchar)")} % 6 h from (select distinct conv_id from o), crc),
m as (select c.conv_id, o.i, o.r, o.t from c join o on o.conv_id = c.conv_id - c.conv_id % 100 and o.i <= h union all
      select c.conv_id, o.i, o.r, o.t from c join o on o.conv_id = c.conv_id and o.i > h),
n as (select conv_id, row_number() over (partition by conv_id order by i) d, length(t) size, sha256(length(r) || ':' || r || t) k from m),
p(conv_id, d, size, path) as (
  select conv_id, cast(0 as bigint), cast(0 as bigint), sha256('') from c union all
  select n.conv_id, n.d, n.size, sha256(p.path || n.k) from p join n on n.conv_id = p.conv_id and n.d = p.d + 1),
l as (select conv_id, max(d) last from p group by 1),
node as (select path, d, any_value(size) size, min(p.conv_id) conv_id, count(*) n,
    sha256(coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (where d = last), '')) ends
  from p join l on l.conv_id = p.conv_id group by 1, 2),
link as (select distinct b.path, a.path parent from p a join p b on b.conv_id = a.conv_id and b.d = a.d + 1),
kids as (select parent, count(*) n from link group by 1),
under as (select distinct a.path top, b.path from p a join p b on b.conv_id = a.conv_id and b.d >= a.d),
sums as (select top, count(*) filter (where kids.n is null) leaves, sum((node.n - 1) * node.size) saved from under join node on node.path = under.path left join kids on kids.parent = under.path group by 1)
select node.conv_id, node.d depth, up.conv_id parent_conv_id, node.n n_convs, coalesce(kids.n, 0) n_children, leaves n_leaves, cast(saved as bigint) saved_tokens, node.ends ends_sha256
from node join sums on sums.top = node.path left join link on link.path = node.path left join node up on up.path = link.parent left join kids on kids.parent = node.path
"""

#: Least (cost, audit, repaired text) as one text: cost in 9 digits, audit, U+0001, turns each after a line feed.
_NEXT = (2, 2, 3, 2)
_NAME = {2: "user", 3: "assistant"}


def _edit(cost: str, letter: str, turn: str, state: int) -> str:
    """What stands in x.s{state}, after one more edit at its front."""
    s = f"x.s{state}"
    cost = f"lpad(cast(cast(left({s}, 9) as integer) + {cost} as varchar), 9, '0')"
    rest = f"substr({s}, 10, strpos({s}, chr(1)) - 9)"
    return f"({cost} || '{letter}' || {rest} || {turn} || substr({s}, strpos({s}, chr(1)) + 1))"


def _insert(q: int) -> str:
    return _edit("5", "I", f"chr(10) || '{_NAME[_NEXT[q]]}:'", _NEXT[q])


def _closed(rows: str) -> str:
    """The rows with turns inserted first: two at most."""
    once = f"select * replace ({', '.join(f'least(s{q}, {_insert(q)}) as s{q}' for q in range(4))}) from ({rows}) x"
    return f"select * replace ({', '.join(f'least(s{q}, {_insert(q)}) as s{q}' for q in range(4))}) from ({once}) x"


def _row_edits(q: int) -> str:
    keep = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[q]
    kept = " ".join(f"when left(o.role, 1) = '{c}' then " + _edit("5 * cast(fault = 3 as integer)", "K", "chr(10) || o.role || ':' || o.text", to) for c, to in keep.items())
    rerole = _edit("1 + 5 * cast(fault = 3 as integer)", "R", f"chr(10) || '{_NAME[_NEXT[q]]}:' || o.text", _NEXT[q])
    drop = _edit("2", "D", "''", q)
    return f"case when fault in (1, 2) then {drop} else least({drop}, {rerole}, case {kept} end) end"


_FAR = "'900000000' || chr(1)"
OP12 = f"""
with recursive crc as ({_CRC_TABLE}),
raw as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t, {_crc("(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '))")} % 20 how from conversations, crc),
d as (select conv_id, turn, case when how = 4 then 'user' else r end "role", case when how in (0, 1) then '' when how = 2 then regexp_replace(t, '[.!?]', '', 'g') else t end "text" from raw where how <> 0
      union all select conv_id, turn, r, t from raw where how = 3),
e as (select *, rtrim("text", chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) v, row_number() over w i, count(*) over (partition by conv_id) n, lag("role") over w before
      from d window w as (partition by conv_id order by turn nulls first, "role", "text")),
o as (select *, case when v = '' then 1 when row_number() over (partition by conv_id, "role", "text" order by i) > 1 then 2 when right(v, 1) not in ('.', '!', '?') then 3 else 0 end fault from e),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where fault = 1) blank, count(*) filter (where fault = 2) duplicate, count(*) filter (where fault = 3) truncated,
    count(*) filter (where i > 1 and left(before, 1) || left("role", 1) not in ('su', 'ua', 'au')) illegal from o group by 1),
v(conv_id, i, s0, s1, s2, s3) as (
  {_closed(f"select conv_id, max(n) + 1 i, '000000000' || chr(1) s0, {_FAR} s1, {_FAR} s2, '000000000' || chr(1) s3 from o group by 1")}
  union all
  {_closed(f"select x.conv_id, o.i, {', '.join(f'{_row_edits(q)} s{q}' for q in range(4))} from v x join o on o.conv_id is not distinct from x.conv_id and o.i = x.i - 1")}
),
best as (select conv_id, s0 s from v where i = 1)
select r.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(cast(left(s, 9) as bigint), 0) "cost", coalesce(substr(s, 10, strpos(s, chr(1)) - 10), '') audit, sha256(coalesce(substr(s, strpos(s, chr(1)) + 2), '')) repaired_sha256
from (select distinct conv_id from raw) r left join facts on facts.conv_id is not distinct from r.conv_id left join best on best.conv_id is not distinct from r.conv_id
"""

ORACLE = {"op4_embedding_dedup": OP4, "op8_mixing": OP8, "op9_substring_dedup": OP9, "op10_decontamination": OP10, "op11_prefix_trie": OP11, "op12_turn_repair": OP12}
