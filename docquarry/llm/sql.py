"""DuckDB SQL for the rows of the corpus queries that SQL can express. Token counts and the models have none."""

from __future__ import annotations

from . import decontaminate, mixing, sharding, top_k, url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _when(of: str, weights: dict, otherwise: str) -> str:
    return f"case {of} " + " ".join(f"when '{k}' then {v}" for k, v in weights.items()) + f" else {otherwise} end"


def _url_filters() -> str:
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules) + " end"
    verdict = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules) + " end"
    sites = ", ".join(f"'{s}'" for s in url_filter.LISTED_SITES)
    return f"""
with rest as (
    select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as r from pages
), parts as (
    select page_id, regexp_matches(r, '^[^?#]*\\?') as has_query, {_LOWER.format("regexp_extract(r, '^[^/?#]*')")} as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest
), canonical as (
    select *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') as url from parts
), listed as (
    select distinct url from canonical where has_query and list_has_any(string_split(host, '.'), [{sites}])
)
select page_id, host, path, {rule} as rule,
    coalesce({verdict}, case when host <> '' and url in (select url from listed) then 'block' else 'allow' end) as verdict
from canonical"""


def _sharding() -> str:
    n = sharding.SHARDS
    return f"""
with recursive crc_table as (
    select list(v order by i) as t from (
        select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)
    )
), bytes as (
    select doc_id, encode(coalesce(text, '')) as b from documents
), checked as (
    select doc_id, octet_length(b) + {sharding.OVERHEAD} as size,
        xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::bigint)),
            lambda c, x: xor(c >> 8, t[(xor(c & 255, x) + 1)::int]))) as text_crc32
    from bytes, crc_table
), jumps as (
    select distinct doc_id as id, (coalesce(doc_id, 0)::hugeint + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as k, 0::bigint as b, 0::bigint as j, 0 as small from documents
    union all
    select id, nk, j, least(floor((j + 1)::double * (2147483648.0::double / ((nk // 8589934592::hugeint) + 1)::double)), {n + 1})::bigint, case when j < {n} then j else small end
    from (select *, (k * 2862933555777941757::hugeint + 1) % 18446744073709551616::hugeint as nk from jumps where j <= {n})
), shards as (
    select id, max(small)::int as shard, max(b)::int as grown_shard from jumps group by id
), places as (
    select c.*, shard, grown_shard, md5(concat_ws(':', coalesce(doc_id::varchar, '-'), size, text_crc32)) as place from checked c join shards s on c.doc_id is not distinct from s.id
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard, row_number() over (partition by shard order by place, doc_id) - 1 as slot, grown_shard from places"""


def _top_k() -> str:
    return f"""
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
    select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint as score from v as q join v on q.vec_id <> v.vec_id and len(q.e) = len(v.e) where q.vec_id % 100 = 0
), ranked as (
    select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scores
)
select * from ranked where rank <= {top_k.K}"""


def _mixing(epochs: int = 2) -> str:
    domains = {s: f"'{d}'" for d, sources in mixing.DOMAINS.items() for s in sources}
    weights = {"domain": mixing.DOMAIN_WEIGHTS, "lang": mixing.LANGUAGE_WEIGHTS, "source": mixing.SOURCE_WEIGHTS}
    sql = f"""
with rows_ as (
    select doc_id, coalesce(lang, '(none)') as lang, coalesce(source, '(none)') as source, {_when("coalesce(source, '(none)')", domains, "'other'")} as domain,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0)::bigint as n_tokens, coalesce(md5(text), '-') as digest from documents
), leaves as (
    select domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {epochs} as cap from rows_ group by all
), given0 as (
    select least(sum(tokens) * {mixing.SHARE[0]} // {mixing.SHARE[1]}, sum(cap))::hugeint as given from leaves
)"""
    levels = ["domain", "lang", "source"]
    for depth, level in enumerate(levels):
        own, parent = ", ".join(levels[: depth + 1]), levels[:depth]
        family = f"partition by {', '.join(parent)}" if parent else ""
        using = f"join given{depth} using ({', '.join(parent)})" if parent else f", given{depth}"
        sql += f""", nodes{depth} as (
    select * from (select {own}, sum(cap)::hugeint as cap, {_when(level, weights[level], "1")}::hugeint as weight from leaves group by {own}) {using}
), ordered{depth} as (
    select *, given - coalesce(sum(cap) over ({family} order by cap / weight, {level} rows between unbounded preceding and 1 preceding), 0)::hugeint as left_,
        sum(weight) over ({family} order by cap / weight, {level} rows between current row and unbounded following)::hugeint as open_ from nodes{depth}
), filled{depth} as (
    select *, cap * open_ <= weight * left_ as filled from ordered{depth}
), rest{depth} as (
    select *, given - coalesce(sum(cap) filter (filled) over ({family}), 0)::hugeint as rest, coalesce(sum(weight) filter (not filled) over ({family}), 0)::hugeint as all_ from filled{depth}
), part{depth} as (
    select *, case when filled then cap else weight * rest // greatest(all_, 1) end as part from rest{depth}
), given{depth + 1} as (
    select {own}, case when filled then cap else part + case when count(*) filter (not filled) over ({family} order by {level} rows between unbounded preceding and current row)
        <= rest - coalesce(sum(part) filter (not filled) over ({family}), 0)::hugeint then 1 else 0 end end as given from part{depth}
)"""
    return (
        sql
        + f""", plans as (
    select *, (given // tokens)::int as last, given % tokens as rest from given3 join leaves using (domain, lang, source) where given > 0
), placed as (
    select *, md5(concat_ws(':', '{mixing.SEED}', last, coalesce(doc_id::varchar, '-'), digest)) as place from rows_ join plans using (domain, lang, source)
), ahead as (
    select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as ahead from placed
), taken as (
    select *, unnest(range(last + case when ahead < rest then 1 else 0 end)) as epoch from ahead
)
select doc_id, domain, lang, source, epoch::int as epoch, n_tokens, given::bigint as leaf_budget from taken"""
    )


def _decontamination() -> str:
    words = lambda t: f"coalesce(regexp_extract_all({_LOWER.format(t)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"
    w = decontaminate.WINDOW
    return f"""
with items as (
    select item_id, {words("text")} as w from benchmark
), windows as (
    select distinct item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as gram
    from (select item_id, w, least({w}, len(w)) as n, unnest(range(1, len(w) - least({w}, len(w)) + 2)) as i from items where len(w) > 0)
), lengths as (
    select distinct n from windows
), docs as (
    select row_number() over () as r, doc_id, {words("text")} as w from documents
), grams as (
    select r, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') as gram from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n)
), hits as (
    select r, i, n, item_id from grams join windows using (n, gram)
), hit_words as (
    select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hits) group by r
), hit_items as (
    select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by r
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and {decontaminate.LEAST_SHARE} * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit_words using (r) left join hit_items using (r)"""


def _near_dups() -> str:
    return f"""
with recursive docs as (
    select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) as w from documents
), shingles as (
    select distinct doc_id, gram from (
        select doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from docs where len(w) > 0)
    )
), sizes as (
    select doc_id, count(*) as n from shingles group by doc_id
), links as (
    select a, b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from shingles x join shingles y on x.gram = y.gram and x.doc_id <> y.doc_id group by all)
    join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 75 * (p.n + q.n - shared)
), reached as (
    select doc_id as a, doc_id as b from documents union select r.a, l.b from reached r join links l on r.b = l.a
), least_ as (
    select a as doc_id, min(b) as component_id from reached group by a
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, d.doc_id = component_id as kept from docs d join least_ using (doc_id) left join sizes using (doc_id)"""


def _warc() -> str:
    base32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {10 * p + 1}, 10))::bigint >> {s}) & 31)::int + 1, 1)" for p in range(4) for s in range(35, -1, -5))
    return f"""
with payloads as (
    select page_id, octet_length(encode(coalesce(html, ''))) as bytes, sha1(encode(coalesce(html, ''))) as h from pages
), firsts as (
    select *, min(page_id) over (partition by h) as first, row_number() over (partition by h order by page_id nulls last) as turn from payloads
)
select page_id, bytes::bigint as payload_bytes, {base32} as payload_digest, case when turn = 1 then 'response' else 'revisit' end as record_type, case when turn > 1 then first end as refers_to from firsts"""


ORACLES = {
    "op2_url_filters": _url_filters(),
    "op3_sharding": _sharding(),
    "op4_exact_top_k": _top_k(),
    "op5_mixing": _mixing(),
    "op6_decontamination": _decontamination(),
    "op8_minhash_near_dedup": _near_dups(),
    "op10_warc": _warc(),
}
