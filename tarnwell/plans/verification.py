"""Verifier and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwell.functions import checks as C
from tarnwell.functions import redaction as X
from tarnwell.functions import verdicts as V
from tarnwell.plans._registry import registry, table, texts

QUERIES, query = registry()

_EDGE = "(^|[^0-9A-Za-z_])", "($|[^0-9A-Za-z_])"
_LUHN = "list_sum(list_transform(generate_series(1, length(x)), lambda i: case when i % 2 = 1 then substr(reverse(x), i, 1)::int else (case when substr(reverse(x), i, 1)::int * 2 > 9 then substr(reverse(x), i, 1)::int * 2 - 9 else substr(reverse(x), i, 1)::int * 2 end) end)) % 10 = 0"
_PII = rf"""
ssn as (
  select doc_id, bool_or(not (x[1:3] in ('000', '666') or x[1] = '9' or x[4:5] = '00' or x[6:9] = '0000')) as hit
  from (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_EDGE[0]}\d{{3}}[- ]?\d{{2}}[- ]?\d{{4}}{_EDGE[1]}')), '[^0-9]', '', 'g') as x from documents) group by doc_id),
card as (
  select doc_id, bool_or({_LUHN}) as hit
  from (select doc_id, regexp_replace(unnest(regexp_extract_all(text, '{_EDGE[0]}((?:\d[ -]?){{12,18}}\d){_EDGE[1]}')), '[^0-9]', '', 'g') as x from documents) group by doc_id),
pii as (
  select doc_id, list_filter([case when ssn.hit then 'ssn' end, case when card.hit then 'creditCard' end,
    case when regexp_matches(text, '{C.PII["email"]}') then 'email' end, case when regexp_matches(text, '{C.PII["phoneUS"]}') then 'phoneUS' end,
    case when regexp_matches(text, '{C.PII["ipv4"]}') then 'ipv4' end], lambda k: k is not null) as kinds, octet_length(encode(text)) as bytes
  from documents left join ssn using (doc_id) left join card using (doc_id))"""


def _docs(s, d):
    return texts(s, d)


@query(f"with {_PII} select doc_id, array_to_string(kinds, ',') as kinds, case when bytes > 1048576 then 'reject' when len(kinds) > 0 then 'repair' else 'pass' end as verdict from pii")
def pii_flags(s, d):
    found = _docs(s, d).select("doc_id", C.pii_kinds(F.col("text")).alias("k"), (F.octet_length("text") > C.LIMIT).alias("long"))
    return found.select("doc_id", F.array_join("k", ",").alias("kinds"), F.when(F.col("long"), "reject").otherwise(C.pii_verdict(F.col("k"))["type"]).alias("verdict"))


def _redacted(x: str) -> str:
    for _, p, r in X.COMMON:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


@query(f"select doc_id, md5({_redacted('text')}) as digest, length({_redacted('text')})::int as n from documents")
def redact_documents(s, d):
    clean = _docs(s, d).select("doc_id", X.redact(F.col("text")).alias("c"))
    return clean.select("doc_id", F.md5("c").alias("digest"), F.length("c").alias("n"))


@query(
    "with a as (select doc_id, text as t0, regexp_replace(text, '%s', '%s', 'g') as t1 from documents), b as (select *, regexp_replace(t1, '%s', '%s', 'g') as t2 from a), c as (select *, regexp_replace(t2, '%s', '%s', 'g') as t3 from b), e as (select *, regexp_replace(t3, '%s', '%s', 'g') as t4 from c)"
    % tuple(v for _, p, r in X.COMMON for v in (p, r))
    + " select doc_id, array_to_string(list_filter([case when t1 <> t0 then 'email' end, case when t2 <> t1 then 'us-phone' end, case when t3 <> t2 then 'bearer-token' end, case when t4 <> t3 then 'aws-access-key' end], lambda x: x is not null), ',') as applied from e"
)
def redactions_applied(s, d):
    return _docs(s, d).select("doc_id", F.array_join(X.redact_with_names(F.col("text"))["applied"], ",").alias("applied"))


@query(
    "select doc_id, array_to_string(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{i}' end" for i, p in C.SECRETS) + "], lambda x: x is not null), ',') as ids from documents"
)
def secret_ids(s, d):
    return _docs(s, d).select("doc_id", F.array_join(C.secret_ids(F.col("text")), ",").alias("ids"))


@query(
    rf"""select event_id, regexp_matches(v, '{C.SEMVER}') as semver, regexp_matches('u' || user_id::varchar || '@' || event_type || '.org', '{C.EMAIL}') as email,
  regexp_matches('+' || user_id::varchar, '{C.E164}') as e164, regexp_matches(md5(props), '^([0-9A-Fa-f]{{2}})+$') as hex, regexp_matches(md5(props), '{C.UUID}') as uuid
from (select *, (user_id % 5)::varchar || '.' || (event_id % 7)::varchar || case when event_id % 3 = 0 then '' else '.0' || (event_id % 4)::varchar end as v from events)"""
)
def format_verdicts(s, d):
    e = table(s, d, "events")
    v = F.concat((F.col("user_id") % 5).cast("string"), F.lit("."), (F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(".0"), (F.col("event_id") % 4).cast("string"))))
    ok = lambda x: x["type"] == "pass"
    address = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@"), "event_type", F.lit(".org"))
    return e.select("event_id", ok(C.semver(v)).alias("semver"), ok(C.email(address)).alias("email"), ok(C.e164(F.concat(F.lit("+"), F.col("user_id").cast("string")))).alias("e164"), ok(C.hex_string(F.md5("props"))).alias("hex"), ok(C.uuid(F.md5("props"))).alias("uuid"))


@query("select l_orderkey, l_linenumber, case when l_discount between 0 and 0.07 then 'pass' else 'repair' end as discount, case when l_quantity > 1 and l_quantity < 50 then 'pass' else 'repair' end as quantity from lineitem")
def numeric_range(s, d):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.in_range(F.col("l_discount"), 0.0, 0.07)["type"].alias("discount"), C.in_range(F.col("l_quantity"), 1, 50, True)["type"].alias("quantity"))


@query("select o_orderkey, count(l_orderkey) as parts, case when abs(coalesce(round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2), 0) - o_totalprice) <= 0.5 then 'pass' else 'repair' end as verdict from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_totalprice")
def order_sum_check(s, d):
    part = (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("p")
    sums = table(s, d, "lineitem").select("l_orderkey", part).groupBy("l_orderkey").agg(F.round(F.sum("p"), 2).alias("p"), F.count("*").alias("n"))
    j = table(s, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("parts"), C.check(F.abs(F.coalesce("p", F.lit(0.0)) - F.col("o_totalprice")) <= 0.5, "sum", "differs")["type"].alias("verdict"))


@query(
    """with x as (select l_orderkey, list(l_shipdate order by l_linenumber, l_shipdate) as a from lineitem group by l_orderkey),
f as (select l_orderkey, list_filter(generate_series(1, len(a) - 1), lambda i: a[i + 1] < a[i])[1] as broken_at from x)
select l_orderkey, broken_at::int as broken_at, case when broken_at is null then 'pass' else 'repair' end as verdict from f"""
)
def monotonic_check(s, d):
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_shipdate"))), lambda x: x["l_shipdate"]).alias("a"))
    return rows.select("l_orderkey", C.first_break(F.col("a")).alias("broken_at"), C.monotonic(F.col("a"))["type"].alias("verdict"))


@query("select doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'que')::int)::int as found, case when contains(lower(text), 'the') and contains(lower(text), 'que') then 'pass' else 'repair' end as all_of, case when contains(lower(text), 'the') or contains(lower(text), 'que') then 'pass' else 'repair' end as any_of from documents")
def required_terms(s, d):
    c, t = F.col("text"), ["the", "que"]
    return _docs(s, d).select("doc_id", F.size(C.terms_found(c, t)).alias("found"), C.requires(c, t)["type"].alias("all_of"), C.requires(c, t, False)["type"].alias("any_of"))


@query(r"select doc_id, case when regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(idiot|scum|worthless|pathetic)($|[^\p{L}\p{N}_])') then 'reject' else 'pass' end as verdict from documents")
def prohibited_terms(s, d):
    return _docs(s, d).select("doc_id", C.prohibits(F.col("text"), ["idiot", "scum", "worthless", "pathetic"], True)["type"].alias("verdict"))


@query(
    r"""with c as (select event_id, event_type || case when event_id % 3 = 0 then '' else ' [k' || (event_id % 7)::varchar || ']' end || case when event_id % 2 = 0 then ' [ k' || user_id::varchar || ' ]' else '' end as t from events),
x as (select event_id, regexp_extract_all(t, '\[\s*([A-Za-z0-9_\-:]+)\s*\]', 1) as ids from c)
select event_id, len(ids)::int as cited, array_to_string(list_filter(ids, lambda i: i not in ('k1', 'k2', 'k3')), ', ') as unknown, case when len(ids) = 0 or len(list_filter(ids, lambda i: i not in ('k1', 'k2', 'k3'))) > 0 then 'repair' else 'pass' end as verdict from x"""
)
def citation_check(s, d):
    k = lambda c: (F.col(c)).cast("string")
    t = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit(" [k"), (F.col("event_id") % 7).cast("string"), F.lit("]"))), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" [ k"), k("user_id"), F.lit(" ]"))).otherwise(""))
    known = F.array(F.lit("k1"), F.lit("k2"), F.lit("k3"))
    e = table(s, d, "events").select("event_id", t.alias("t"))
    return e.select("event_id", F.size(C.cited(F.col("t"))).alias("cited"), F.array_join(F.filter(C.cited(F.col("t")), lambda x: ~F.array_contains(known, x)), ", ").alias("unknown"), C.citations_known(F.col("t"), known)["type"].alias("verdict"))


@query(
    """select doc_id, case when length(text) not between 20 and 20000 then 'length' when len(string_split(text, chr(10))) > 40 then 'line-count' when not contains(lower(text), 'the') then 'required-terms' end as first_failure,
case when contains(lower(text), 'idiot') then 'reject' when length(text) not between 20 and 20000 or len(string_split(text, chr(10))) > 40 or not contains(lower(text), 'the') then 'repair' else 'pass' end as all_verdict from documents"""
)
def verifier_chain(s, d):
    c = F.col("text")
    soft = [(0, "a", C.length_between(c, 20, 20000)), (10, "b", C.lines_between(c, 1, 40)), (20, "c", C.requires(c, ["the"]))]
    first, all_ = V.first_failure(soft), V.all_failures([*soft, (30, "d", C.prohibits(c, ["idiot"]))])
    return _docs(s, d).select("doc_id", first["diagnostic"]["verifier"].alias("first_failure"), all_["type"].alias("all_verdict"))


@query("select event_id, json_valid(props) as parses, json_extract_string(props, '$.k')::bigint as k from events")
def json_parse_props(s, d):
    return table(s, d, "events").select("event_id", (C.json_parses(F.col("props"))["type"] == "pass").alias("parses"), F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("select doc_id, len(string_split(text, chr(10)))::int as lines, contains(text, chr(65533)) as replaced, length(text)::int as graphemes from documents")
def line_count(s, d):
    from tarnwell.functions import text as T

    return _docs(s, d).select("doc_id", C.line_count(F.col("text")).alias("lines"), (C.encoding(F.col("text"))["type"] != "pass").alias("replaced"), T.graphemes(F.col("text")).alias("graphemes"))


@query("select page_id, case when not starts_with(lower(url), 'https:') then 'scheme' end as problem from pages")
def url_safety(s, d):
    return table(s, d, "pages").select("page_id", C.url_problem(F.col("url")).alias("problem"))


@query(
    r"""with p as (
  select p_partkey, ['/src/', '/home/.ssh/', '/a/.git/', '/x/secrets/', '/k/', '/a/%2egit/', '/100%/'][p_partkey % 7 + 1] || replace(p_name, ' ', '_')
    || ['.pem', '.txt', '/.env.local', '.tfstate', '%2Epfx', '/ID_RSA', '/.net%72c', '/x+y%zz'][p_partkey % 8 + 1] as path
  from part),
d as (select p_partkey, case when regexp_matches(path, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') then path else url_decode(path) end as path from p)
select p_partkey, case
  when regexp_matches(path, '(?i)(^|/)\.git(/|$)') then '(^|/)\.git(/|$)'
  when regexp_matches(path, '(?i)(^|/)\.env(\..*)?$') then '(^|/)\.env(\..*)?$'
  when regexp_matches(path, '(?i)(^|/)id_rsa(\..*)?$') then '(^|/)id_rsa(\..*)?$'
  when regexp_matches(path, '(?i)(^|/)\.ssh(/|$)') then '(^|/)\.ssh(/|$)'
  when regexp_matches(path, '(?i)\.tfstate(\.[^/]*)?$') then '\.tfstate(\.[^/]*)?$'
  when regexp_matches(path, '(?i)(^|/)\.netrc$') then '(^|/)\.netrc$'
  when regexp_matches(path, '(?i)(^|/)secrets?(/|$)') then '(^|/)secrets?(/|$)'
  when regexp_matches(path, '(?i)\.pem$') then '\.pem$'
  when regexp_matches(path, '(?i)\.pfx$') then '\.pfx$' end as reason
from d"""
)
def path_denylist(s, d):
    at = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % n + 1).cast("int"))
    path = F.concat(at(["/src/", "/home/.ssh/", "/a/.git/", "/x/secrets/", "/k/", "/a/%2egit/", "/100%/"], 7), F.replace("p_name", F.lit(" "), F.lit("_")), at([".pem", ".txt", "/.env.local", ".tfstate", "%2Epfx", "/ID_RSA", "/.net%72c", "/x+y%zz"], 8))
    return table(s, d, "part").select("p_partkey", path.alias("path")).select("p_partkey", C.denied_path(F.col("path")).alias("reason"))


@query(
    """with w as (select doc_id, text, substr(text, 1, 3) as old from documents)
select doc_id, ((length(text) - length(replace(text, old, ''))) // length(old))::bigint as n, case when (length(text) - length(replace(text, old, ''))) // length(old) = 1 then 'pass' else 'repair' end as verdict from w where length(old) > 0"""
)
def edit_exact_match(s, d):
    w = _docs(s, d).select("doc_id", "text", F.left("text", F.lit(3)).alias("old")).filter(F.length("old") > 0)
    return w.select("doc_id", C.occurrences(F.col("text"), F.col("old")).alias("n"), C.edit_matches_once(F.col("text"), F.col("old"), F.lit("#"))["type"].alias("verdict"))


@query(
    """with g as (select c_custkey, ['read', case when c_acctbal > 0 then 'write' else 'read' end, lower(c_mktsegment)] as granted, case when c_nationkey % 2 = 0 then ['write', 'read'] else ['admin', 'building'] end as required from customer)
select c_custkey, array_to_string(list_sort(list_filter(required, lambda r: not list_contains(granted, r))), ', ') as missing, len(list_filter(required, lambda r: not list_contains(granted, r))) = 0 as allowed from g"""
)
def policy_scopes(s, d):
    granted = F.array(F.lit("read"), F.when(F.col("c_acctbal") > 0, "write").otherwise("read"), F.lower("c_mktsegment"))
    required = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("write"), F.lit("read"))).otherwise(F.array(F.lit("admin"), F.lit("building")))
    v = C.scopes(required, granted)
    return table(s, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.array_except(required, granted)), ", ").alias("missing"), (v["type"] == "pass").alias("allowed"))
