"""Groups of registry entries by their rules, over the delivered entries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.operators import rules
from meridia.plans.core_sql import SHARED_EXACT, _af, _in, _nt
from meridia.session import cut, table


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return cut(rules.entry_facts(table(spark, d, "hotel_registry_entries")))


def same_name_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each name of several entries, which of the three rules its entries fulfil."""
    return rules.same_name_groups(_facts(spark, d))


def numbered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entries that seed a group of numbered houses."""
    return rules.numbered_groups(_facts(spark, d))


def artifact_groups(spark: SparkSession, d: str) -> DataFrame:
    """Entries that seed a group of a name and its numbered likes."""
    return rules.artifact_groups(_facts(spark, d))


def numbered_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different entries by the rule of numbered houses, and by that of names and their numbered likes."""
    f = _facts(spark, d)
    one = lambda rule, name: rules.neighbours(f, rule).where("a < b").selectExpr("a", "b", f"'{name}' as rule")
    return one(rules.numbered_pair, "numbered").unionByName(one(rules.artifact_pair, "artifact"))


def shadow_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries that only sum up their numbered siblings."""
    return rules.shadow_entries(_facts(spark, d))


def _host(x: str) -> str:
    url = f"regexp_extract(trim({x}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)"
    bare = f"regexp_extract(regexp_replace({x}, '^https?://', ''), '^([^/]*)', 1)"
    return f"regexp_replace(lower(trim(case when {url} <> '' then {url} else {bare} end)), '^www\\.', '')"


def _own(f: str, x: str) -> str:
    return f"list_filter(list_transform(coalesce(contacts.{f}, []), lambda v: {x}), lambda v: v <> '' and v not in {_in(SHARED_EXACT)})"


def _same(c: str) -> str:
    return f"coalesce(l.{c} = r.{c}, false)"


def _apart(c: str) -> str:
    return f"coalesce(l.{c} <> r.{c}, false)"


def _meet(c: str) -> str:
    return f"len(list_intersect(l.{c}, r.{c})) > 0"


_PLACE = "coalesce(contains(l.place, r.place) or contains(r.place, l.place), false)"
_NUM = "regexp_extract({}.address, '^([0-9]+[A-Z]?)', 1)"
_NEAR = f"({_NUM.format('l')} <> '' and {_NUM.format('l')} = {_NUM.format('r')} and levenshtein(l.address, r.address)::double / greatest(length(l.address), length(r.address)) <= 0.25)"
_ADDRESS = f"coalesce(l.address <> '' and r.address <> '' and (contains(l.address, r.address) or contains(r.address, l.address) or {_NEAR}), false)"
_BOTH = "(l.address is not null and r.address is not null)"
_CONTACT = f"({_meet('phones')} or {_meet('emails')} or {_meet('domains')} or {_meet('hosts')})"
_OPERATOR = f"(l.operator is null or r.operator is null or {_same('operator')} or {_meet('phones')} or {_meet('emails')})"
_STRICT = f"""(not {_apart('postcode')} and not (l.place is not null and r.place is not null and not {_PLACE})
  and case when {_BOTH} then {_ADDRESS} else {_same('postcode')} and {_same('locality')} end)"""
_IN = "coalesce({0}.locality <> '' and contains(coalesce(l.district, r.district, ''), {0}.locality), false)"
_ONE = f"case when l.place is null or r.place is null then l.place is not null or r.place is not null else {_PLACE} or ({_IN.format('l')} <> {_IN.format('r')}) end"
_STRONG = f"(not {_apart('postcode')} and not {_apart('district')} and case when {_BOTH} then {_ADDRESS} else {_ONE} end)"
_AT = f"({_PLACE} or ({_BOTH} and {_ADDRESS}))"
_NUMBER = "coalesce(regexp_matches({}.suffix, '^[0-9]+[A-Z]?$'), false)"
_FITS = "({0}.suffix is null or (regexp_matches({0}.suffix, '^[0-9]+[A-Z]?$') and regexp_extract({0}.suffix, '^([0-9]+)', 1)::bigint <= 100))"
_HEAD = f"l.issues = 0 and r.issues = 0 and {_same('base')} and trim(l.base) <> '' and {_same('postcode')} and {_CONTACT}"
_NUMBERED = f"({_HEAD} and {_NUMBER.format('l')} and {_NUMBER.format('r')} and {_AT} and {_OPERATOR})"
_ARTIFACT = f"""({_HEAD} and {_FITS.format('l')} and {_FITS.format('r')} and ({_AT} or (not {_BOTH} and {_same('district')}))
  and case when l.suffix is not null and r.suffix is not null then {_OPERATOR} else l.operator is null or r.operator is null or {_same('operator')} end)"""
_E = f"""
e as (select distinct on (_id) _id as id, name.normalized as name, name.basename as base, name.suffix as suffix, establishmenttype as kind, len(coalesce(issues, [])) as issues,
  case when location.district is not null then {_nt('location.district')} end as district, case when location.locality is not null then {_nt('location.locality')} end as locality,
  case when location.locality is not null then regexp_replace(regexp_replace({_nt('location.locality')}, '\\bK\\b', 'KATO', 'g'), '\\bP\\b', 'PANO', 'g') end as place,
  case when location.postcode is not null then {_nt('location.postcode')} end as postcode, case when location.address is not null then {_af(_nt('location.address'))} end as address,
  case when operator is not null then {_nt('operator')} end as operator, capacity.rooms as rooms, capacity.beds as beds, coalesce(contacts.phones, []) as phones, coalesce(contacts.emails, []) as emails,
  {_own('domains', "regexp_replace(lower(trim(v)), '^www[.]', '')")} as domains, {_own('websites', _host('v'))} as hosts
  from hotel_registry_entries where status = 'ready')"""


def _group_sql(rule: str, extra: str = "true") -> str:
    return f"""with {_E},
near as (select l.id as a, r.id as b, r.suffix as s from e l join e r on l.base = r.base where {rule}),
g as (select a, list(b) as m, bool_or(s is null) as bare, bool_or(coalesce(regexp_matches(s, '^[0-9]+[A-Z]?$') and regexp_extract(s, '^([0-9]+)', 1)::bigint <= 100, false)) as number from near group by a having count(*) > 1),
p as (select g.a, count(*) as pairs from g join near n on list_contains(g.m, n.a) and list_contains(g.m, n.b) and n.a < n.b group by g.a)
select g.a as id, len(m) as members, list_min(m) as first from g join p on p.a = g.a where pairs = len(m) * (len(m) - 1) / 2 and {extra}"""


SQL = {
    "same_name_groups": f"""with {_E},
p as (select l.name, bool_and({_CONTACT} and {_STRICT} and {_OPERATOR}) as usual, bool_and({_CONTACT} and {_STRONG} and {_OPERATOR}) as strong from e l join e r on l.name = r.name and l.id < r.id group by 1),
w as (select *, first_value(rooms) over (partition by name order by id) as fr, first_value(beds) over (partition by name order by id) as fb from e),
s as (select name, count(*) as members, count(distinct coalesce(kind, chr(1))) as kinds, count(distinct coalesce(rooms::varchar, 'n') || '|' || coalesce(beds::varchar, 'n')) as sizes,
  bool_and(coalesce(rooms = fr, true) and coalesce(abs(beds - fb) <= 10, true)) as fit from w group by 1 having count(*) > 1)
select s.name, members, usual and kinds > 1 as multi_type, strong and kinds = 1 and sizes = 1 as strong_identity, usual and kinds = 1 and fit as collapse from s join p on p.name = s.name""",
    "numbered_groups": _group_sql(_NUMBERED),
    "artifact_groups": _group_sql(_ARTIFACT, "bare and number"),
    "numbered_pairs": f"""with {_E} select l.id as a, r.id as b, 'numbered' as rule from e l join e r on l.base = r.base and l.id < r.id where {_NUMBERED}
union all select l.id, r.id, 'artifact' from e l join e r on l.base = r.base and l.id < r.id where {_ARTIFACT}""",
    "shadow_entries": f"""with {_E}, s as (select l.id, l.rooms as lr, l.beds as lb, count(*) as siblings, count(r.rooms) as nr, count(r.beds) as nb, sum(r.rooms) as sr, sum(r.beds) as sb, max(r.rooms) as mr, max(r.beds) as mb
  from e l join e r on l.base = r.base and l.kind = r.kind and l.postcode = r.postcode and l.suffix is null and regexp_matches(r.suffix, '^[0-9]+$') and trim(l.base) <> '' and ({_meet('phones')} or {_meet('domains')}) and {_ADDRESS}
  where l.rooms is not null and l.beds is not null group by 1, 2, 3)
select id, siblings from s where siblings >= 3 and nr = siblings and nb = siblings and lr > mr and lb > mb and sr <> 0 and sb <> 0 and abs(sr - lr) / sr <= 0.2 and abs(sb - lb) / sb <= 0.2""",
}

QUERIES = {f.__name__: f for f in (same_name_groups, numbered_groups, artifact_groups, numbered_pairs, shadow_entries)}
