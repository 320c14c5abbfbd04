"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from .license_scan import BLANK, CUE, FILE_NAME, NOTICE, SPLIT, TEMPLATES, _words


def _terms(x: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({x}), '{SPLIT}'), lambda w: trim(w, '.-')), lambda w: w <> '')"


def license_sql(path: str, threshold: float = 0.6) -> str:
    """Documents as files; licence texts, weights, cosines, inheritance."""
    rows = ", ".join(f"({k}, '{name}', '{w}', {words.count(w)})" for k, (name, text) in enumerate(TEMPLATES) for words in [_words(text)] for w in sorted(set(words)))
    part = f"regexp_replace(part, '{NOTICE}', ' ', 'g')"
    return f"""
with tpl(k, licence, term, tf) as (values {rows}),
p as (select doc_id, {path} as path, coalesce(text, '') as text from documents),
f as (select doc_id, regexp_replace(path, '/?[^/]*$', '') as dir, regexp_extract(path, '([^/]*)$', 1) as name, text,
  case when regexp_matches(text, '{CUE}') then list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{CUE}')) else [] end as lines,
  case when regexp_matches(text, '{CUE}') then list_filter(string_split_regex(text, '{BLANK}'), lambda l: regexp_matches(l, '{CUE}')) else [] end as blocks from p),
g as (select *, regexp_matches(name, '{FILE_NAME}') or (len(lines) > 0 and 4*len({_terms("array_to_string(lines, ' ')")}) >= 3*len({_terms('text')})) as is_file from f),
q as (select doc_id, list_concat(case when is_file then [text] else [] end, lines, list_filter(blocks, lambda b: contains(b, chr(10))), case when len(blocks) > 1 then [array_to_string(blocks, chr(10))] else [] end) as parts from g),
s as (select doc_id, unnest(range(len(parts))) as n, unnest(parts) as part from q),
w as (select doc_id, n, unnest({_terms(part)}) as term from s),
sp as (select doc_id, n, term, count(*) as tf from w group by 1, 2, 3),
cnt as (select count(*) as total from s),
df as (select term, count(*) as df from sp group by 1),
idf as (select term, ln((1 + any_value(total))/cast(1 + coalesce(any_value(df), 0) as double)) + 1 as idf from (select term from df union select term from tpl) left join df using (term) cross join cnt group by 1),
sw as (select doc_id, n, term, tf*idf as v from sp join idf using (term)),
tw as (select k, licence, term, tf*idf/sqrt(sum(tf*idf*tf*idf) over (partition by k)) as v from tpl join idf using (term)),
nm as (select doc_id, n, sqrt(sum(v*v)) as norm from sw group by 1, 2),
c as (select sw.doc_id, sw.n, k, licence, round(sum(sw.v*tw.v)/any_value(norm), 6) as cosine from sw join tw using (term) join nm on nm.doc_id = sw.doc_id and nm.n = sw.n group by 1, 2, 3, 4),
b as (select doc_id, max(cosine) as cosine, arg_min(licence, (-cosine, licence)) as declared from c where cosine >= {threshold} group by 1),
r as (select g.doc_id, dir, is_file, cosine, declared from g left join b using (doc_id)),
d as (select dir, arg_min(declared, (-cosine, declared)) as licence from r where is_file and declared is not null group by 1),
a as (select dir, unnest(range(case when dir = '' then 1 else len(string_split(dir, '/')) + 1 end)) as depth from (select distinct dir from r where declared is null)),
e as (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') as above from a),
i as (select e.dir, arg_max(d.licence, depth) as licence, arg_max(above, depth) as licence_dir from e join d on d.dir = e.above group by 1)
select doc_id, declared, cosine, coalesce(declared, licence) as licence,
  case when declared is not null then case when is_file then 'file' else 'header' end when licence is not null then 'inherited' else 'none' end as origin,
  case when declared is null then licence_dir end as licence_dir
from r left join i on declared is null and i.dir = r.dir
"""


def lloyd_sql(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Lloyd's rounds over all vectors and all centroids, one component to a row."""
    near = lambda c: f"select n, arg_min(c, (d, c)) as c, min(d) as d from (select v.n, m.c, sum((v.x - m.x)*(v.x - m.x)) as d from v join {c} m using (i) group by 1, 2) group by 1"
    steps = "".join(
        f""",
a{r} as materialized ({near(f"m{r}")}),
m{r + 1} as materialized (select m{r}.c, m{r}.i, coalesce(q, m{r}.x) as x from m{r} left join
  (select c, i, cast(sum(x) as bigint) as s, count(*) as z, (s - ((s % z) + z) % z) // z as q from v join a{r} using (n) group by 1, 2) using (c, i))"""
        for r in range(rounds)
    )
    return f"""
with e as materialized (select row_number() over () as n, vec_id, embedding as v from embeddings
  where len(embedding) = {dims} and len(list_filter(embedding, lambda t: t is null or not isfinite(t))) = 0),
v as materialized (select n, vec_id, i, cast(floor(1024*cast(t as double)) as bigint) as x from (select n, vec_id, unnest(v) as t, unnest(range({dims})) as i from e)),
f as (select n, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from e order by sha256('{seed}:' || vec_id) limit {k}),
m0 as materialized (select c, i, x from v join f using (n)){steps},
z as materialized ({near(f"m{rounds}")}),
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from m{rounds} group by 1)
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, centroid_sha256
from z join e using (n) join h using (c)
"""
