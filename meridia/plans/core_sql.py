"""The core queries in SQL, written apart from the operators they check."""

from __future__ import annotations

# Fixed values, stated apart from the operators' own: a wrong word there would else be wrong here too.
GENERIC_SUFFIXES = ("HOTEL", "HOTELS", "APARTMENT", "APARTMENTS", "APTS", "APT", "SUITE", "SUITES", "RESIDENCE", "BOUTIQUE")
STOP_WORDS = (
    "AND", "APARTMENT", "APARTMENTS", "APT", "APTS", "BEACH", "BOUTIQUE", "BY", "GUEST", "GUESTHOUSE", "HOLIDAY",
    "HOSTEL", "HOTEL", "HOTELS", "HOUSE", "RESORT", "SPA", "SUITE", "SUITES", "THE", "VILLAGE",
)
STREET_WORDS = ("AVENUE", "STREET", "ROAD", "LANE", "DRIVE", "BOULEVARD", "SQUARE", "COURT", "PLACE", "CRESCENT", "WAY", "LEOFOROS", "ODOS")
SHARED_EXACT = ("atlanticahotels.com", "kanikahotels.com", "leonardo-hotels-cyprus.com", "leonardo-hotels.com", "leonardo-hotels.co", "louis-hotels.com", "louishotels.com", "tsokkos.com")
SHARED_SUFFIX = (
    "atlanticahotels.com", "booking.com", "expedia.com", "ihg.com", "kanikahotels.com", "leonardo-hotels-cyprus.com",
    "leonardo-hotels.com", "louis-hotels.com", "louishotels.com", "marriott.com", "radissonhotels.com", "tsokkos.com",
)
SOCIAL_HOSTS = ("facebook.com", "instagram.com", "linkedin.com", "tiktok.com", "x.com")
AGGREGATOR_HOSTS = ("booking.com", "expedia.com", "hotels.com", "tripadvisor.com")

_WS = r"[\s ]+"


def _squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _nt(x: str) -> str:
    quoted = f"regexp_replace(coalesce({x}, ''), '[’‘`´]', '''', 'g')"
    return f"upper({_squeeze(f'''regexp_replace(replace({quoted}, '&', ' AND '), '[.,;:()\\[\\]{{}}/\\\\–—-]', ' ', 'g')''')})"


def _pt(x: str) -> str:
    return f"upper({_squeeze(f'''regexp_replace(coalesce({x}, ''), '[.,;:()\\[\\]{{}}/\\\\–—-]', ' ', 'g')''')})"


def _it(x: str) -> str:
    return f"upper({_squeeze(f'''coalesce({x}, '')''')})"


def _pl(x: str) -> str:
    return f"upper(trim(regexp_replace(coalesce({x}, ''), '[,\\s]+', ' ', 'g')))"


def _mn(x: str) -> str:
    return f"trim(regexp_replace(replace(upper(coalesce({x}, '')), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _rn(x: str) -> str:
    return f"array_to_string(list_filter(string_split({_mn(x)}, ' '), lambda w: w <> '' and not list_contains({_STOP}, w)), ' ')"


def _hn(x: str) -> str:
    return f"trim(regexp_replace({_nt(x)}, '( ([1-5] ?[*]|[ABC] ?''|N ?/ ?A|N A|[ΑΆ]ΝΕΥ( ?Α)?|WITHOUT STAR))+$', ''))"


def _mk(x: str) -> str:
    return f"regexp_replace(regexp_replace({_hn(x)}, '^THE (\\S)', '\\1'), '(\\S)( ({'|'.join(GENERIC_SUFFIXES)}))+$', '\\1')"


def _pc(x: str) -> str:
    return f"upper(regexp_replace(coalesce({x}, ''), '\\s+', '', 'g'))"


def _ph(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9+]', '', 'g')"


def _j(*xs: str) -> str:
    return " || '|' || ".join(f"coalesce(({x})::varchar, '')" for x in xs)


def _in(xs: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _host(x: str) -> str:
    t = f"regexp_replace(regexp_replace(lower(trim({x})), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#@]*@', '')"
    return f"nullif(regexp_replace(regexp_extract({t}, '^[^/?#:]+'), '^www\\.', ''), '')"


def _pm(x: str) -> str:
    dg = f"regexp_replace(regexp_replace({x}, '[^0-9]', '', 'g'), '^00357', '357')"
    return f"case when {dg} = '' then null when length({dg}) = 8 then '357' || {dg} else {dg} end"


def _em(x: str) -> str:
    t = f"lower(regexp_replace({x}, '\\s+', '', 'g'))"
    return f"case when regexp_matches({t}, '^[^@]+@[^@]+\\.[^@]+$') then {t} end"


def _shared(x: str) -> str:
    return f"coalesce({x} in {_in(SHARED_SUFFIX)} or regexp_matches({x}, '\\.({'|'.join(s.replace('.', chr(92) + '.') for s in SHARED_SUFFIX)})$'), false)"


def _af(x: str) -> str:
    one = f"regexp_replace({x}, '\\b(STR|ST)\\b', 'STREET', 'g')"
    return f"regexp_replace({one}, '\\b(AVE|AV)\\b', 'AVENUE', 'g')"


_BASE = r"^(.*?)(\s+(NO\s*)?(\d+[A-Z]?))$"
_LAST = "(select _id from geo_import_runs where status = 'COMPLETED' and importkind = 'HOTELS' order by startedat desc, _id desc limit 1)"
_P0, _E0 = "list_extract(contacts.phones, 1)", "list_extract(contacts.emails, 1)"


def _hav(x1: str, y1: str, x2: str, y2: str, r: int) -> str:
    return f"2 * {r} * asin(least(1.0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"


def _tagp(n: str) -> str:
    return f"""json_extract_string(sourceproperties::json, '$."{n}"')"""


_contact = "coalesce(case when trim(list_extract(contacts.phones, 1)) <> '' then trim(list_extract(contacts.phones, 1)) end, case when trim(list_extract(contacts.emails, 1)) <> '' then trim(list_extract(contacts.emails, 1)) end)"
_filled = lambda x: f"(coalesce(trim({x}), '') <> '')"


def _arr(*xs: str) -> str:
    return "[" + ", ".join(xs) + "]"


def _contacts(phones: str, mails: str, sites: str) -> str:
    return f"""list_distinct(list_filter(list_transform({phones}, lambda x: 'p:' || {_pm('x')}) || list_filter(list_transform({mails}, lambda x: 'e:' || {_em('x')}), lambda x: not {_shared("regexp_extract(x, '^[^@]*@(.*)$', 1)")})
      || list_filter(list_transform({sites}, lambda x: 'd:' || {_host('x')}), lambda x: not {_shared("substr(x, 3)")}), lambda x: x is not null))"""


_SIDES = f"""
cand as (
  select _id as cid, 30 * ({_tagp('phone')} is not null)::int + 25 * ({_tagp('email')} is not null)::int + 20 * ({_tagp('website')} is not null)::int + 10 * ({_tagp('stars')} is not null)::int
      + case when source.id like 'relation/%' then 8 when source.id like 'way/%' then 5 else 0 end as richness,
    {_mn('name')} as raw, {_rn('name')} as red,
    {_contacts(_arr(_tagp('phone'), _tagp('contact:phone'), _tagp('contact:mobile')), _arr(_tagp('email'), _tagp('contact:email')), _arr(_tagp('website'), _tagp('contact:website'), _tagp('url')))} as contacts,
    nullif({_mn(_tagp('addr:postcode'))}, '') as code, nullif({_mn(_tagp('addr:street'))}, '') as street, nullif({_mn(_tagp('addr:city'))}, '') as city
  from (select distinct on (_id) * from hotel_geo_candidates where source.importrunid = {_LAST})),
hot as (
  select _id as hid, {_mn('canonicalname')} as raw, {_rn('canonicalname')} as red, {_contacts("contacts.phones", "contacts.emails", "contacts.websites")} as contacts,
    nullif({_mn('location.postcode')}, '') as code, nullif({_mn('location.address')}, '') as street, nullif({_mn('location.locality')}, '') as city
  from canonical_hotels where status = 'active'),
pr as (
  select *, c.red as a, h.red as b, len(list_intersect(c.contacts, h.contacts)) > 0 as strong, (c.raw = h.raw and c.raw <> '') as rawx, (c.red = h.red and c.red <> '') as redx,
    list_distinct(string_split(c.red, ' ')) as wa, list_distinct(string_split(h.red, ' ')) as wb,
    coalesce(c.code = h.code, false) or coalesce(contains(c.street, h.street) or contains(h.street, c.street), false) or coalesce(c.city = h.city, false) as addr
  from cand c join hot h on true),
sc as (
  select cid, hid, richness, strong, rawx, redx, addr, a <> '' and b <> '' and (contains(a, b) or contains(b, a)) or rawx or redx as compat,
    greatest(case when rawx or redx then 1.0 else 0.0 end, case when a = '' or b = '' then 0.0 when a = b then 1.0
      when contains(a, b) or contains(b, a) then least(length(a), length(b))::double / greatest(length(a), length(b)) else 1.0 - levenshtein(a, b)::double / greatest(length(a), length(b)) end,
      case when a = '' or b = '' then 0.0 else len(list_intersect(wa, wb))::double / least(len(wa), len(wb)) end) as ns
  from pr),
prop as (
  select * from (select cid, hid, richness, ns, case when strong and compat then 100 when strong and ns >= 0.72 then 92 when addr and ns >= 0.82 then 82 when rawx then 80 when redx then 60 end as score from sc) where score is not null),
named as (select *, case score when 100 then 'CONTACT_AND_COMPATIBLE_NAME' when 92 then 'CONTACT_AND_FUZZY_NAME' when 82 then 'ADDRESS_AND_STRONG_NAME' when 80 then 'RAW_EXACT_NAME' else 'REDUCED_EXACT_NAME' end as reason from prop),
rk as (select *, rank() over (partition by cid order by score desc, richness desc) as rc, rank() over (partition by hid order by score desc, richness desc) as rh from named),
mut as (select * from (select *, sum((rc = 1)::int) over (partition by cid) as tc, sum((rh = 1)::int) over (partition by hid) as th from rk) where rc = 1 and rh = 1 and tc = 1 and th = 1)
"""
_POINTS = f"""
pts as (select distinct on (_id) _id as pid, point.coordinates[1] as x, point.coordinates[2] as y from hotel_geo_candidates where source.importrunid = {_LAST}),
okp as (select * from pts where abs(x) <= 180 and abs(y) <= 90 and not (x = 0 and y = 0)),
bea as (select distinct on (_id) _id as cid, point.coordinates[1] as bx, point.coordinates[2] as by_, geometry from beach_profiles where datasetversion = 4 and lifecycle.status = 'ACTIVE'),
okb as (select * from bea where abs(bx) <= 180 and abs(by_) <= 90 and not (bx = 0 and by_ = 0))
"""
_KNN = f"select pid, cid, x, y, bx, by_, geometry, {_hav('x', 'y', 'bx', 'by_', 6378100)} as m, row_number() over (partition by pid order by {_hav('x', 'y', 'bx', 'by_', 6378100)}, cid) as rank from okp join okb on true"
_BEACH = "(select distinct on (_id) _id, json_extract_string(sourceproperties::json, '$.surface') as surface, json_extract_string(sourceproperties::json, '$.name') as label, lifecycle.status as status from beach_profiles where datasetversion = {})"
_DIFF = f"""(select coalesce(o._id, n._id) as _id, case when o._id is null then 'INSERTED' when n._id is null then 'MISSING' when o.surface is not distinct from n.surface and o.label is not distinct from n.label
  and o.status is not distinct from n.status then 'UNCHANGED' else 'UPDATED' end as action from {_BEACH.format('{0}')} o full join {_BEACH.format('4')} n on o._id = n._id)"""
_GRP = "(select d.dup_group, e.* from registry_duplicates d join (select distinct on (_id) * from hotel_registry_entries) e on e._id = d.entryid)"

SQL = {
    "text_names": f"""select seq, {_nt('name')} as name_text, {_pt('name')} as plain, {_mn('name')} as match, {_rn('name')} as reduced, {_hn('name')} as hotel, {_mk('name')} as match_key,
        {_it('operatorname')} as ident, {_pl('locality')} as place from raw_hotels""",
    "text_keys": f"""select seq, {_j(_hn('name'), _pc('postcode'), _ph(_P0), 'rooms', 'beds')} as strict_key, {_j(_mk('name'), _pc('postcode'), _ph(_P0), 'rooms', 'beds')} as soft_key,
        {_j(_hn('name'), _it('establishmenttype'), _it('region'), _it('locality'), _pc('postcode'), _it('operatorname'), _ph(_P0))} as merge_key,
        {_j("'rkv1'", _hn('name'), _nt('establishmenttype'), _nt('region'), _nt('locality'), _pc('postcode'), _nt('address'))} as registry_key,
        {_j("'component-v1'", _pt('name'), _pt('establishmenttype'), _pc('postcode'), _pt('address'))} as component_key from raw_hotels""",
    "canonical_keys": f"""with k as (select _id, 'chv1|' || kind || '|' || {_nt('canonicalname')} || '|' || {_nt('location.district')} || '|' || {_nt('location.locality')} || '|' as head, {_pc('location.postcode')} as p,
          {_nt('location.address')} as a, {_nt('operator')} as o, {_nt(_contact)} as c, {_filled('canonicalname')} as hn, {_filled('location.postcode')} as hp, {_filled('location.address')} as ha, {_filled('operator')} as ho,
          {_contact} is not null as hc, {_filled('location.district')} or {_filled('location.locality')} as hl,
          array_to_string(list_sort(contacts.phones), ',') || '|' || array_to_string(list_sort(contacts.emails), ',') || '|' || array_to_string(list_sort(contacts.websites), ',') || '|' || array_to_string(list_sort(contacts.domains), ',') as ck from canonical_hotels)
        select _id, head || case when p <> '' and a <> '' then p || '|' || a when p <> '' and o <> '' then p || '|' || o when a <> '' and o <> '' then 'address_operator|' || a || '|' || o when a <> '' and c <> '' then 'address_contact|' || a || '|' || c
          when p <> '' and c <> '' then 'postcode_contact|' || p || '|' || c when o <> '' and c <> '' then 'operator_contact|' || o || '|' || c else 'location_contact|' || c end as key,
          hn and (hp and ha or hp and ho or ha and ho or ha and hc or hp and hc or ho and hc or hl and hc) as strong, ck as contacts_key from k""",
    "name_class_repair": r"""with r as (select seq, trim(regexp_replace(name, '(\S)\s+[ABCabc]''\s*$', '\1')) as n, classraw, rooms, beds from raw_hotels),
        m as (select *, coalesce(regexp_matches(trim(classraw), '^[0-9]{1,3}$') and not ends_with(n, ' ' || trim(classraw)), false) as mv, coalesce(rooms > 0 and beds > 0 and beds < rooms, false) as sw from r)
        select seq, case when mv then n || ' ' || trim(classraw) else n end as name, case when mv then null else classraw end as class_raw, case when sw then beds else rooms end as rooms, case when sw then rooms else beds end as beds from m""",
    "location_repair": rf"""with n as (select seq, nullif({_squeeze('address')}, '') as a, nullif({_squeeze('postcode')}, '') as p, nullif({_squeeze('locality')}, '') as t from raw_hotels),
        x as (select *, regexp_extract(a, '^([0-9]{{4}}),?\s+(\S.*)$', 1) as code, regexp_extract(a, '^([0-9]{{4}}),?\s+(\S.*)$', 2) as rest from n),
        y as (select *, coalesce(code <> '' and (p is null or p = code) and case when t is null then not regexp_matches(upper(rest), '\b({'|'.join(STREET_WORDS)})\b') else {_pl('t')} = {_pl('rest')} end, false) as line from x)
        select seq, case when line then null when p is not null and t is not null then
            nullif(trim(regexp_replace(a, '(?i)[\s,]+' || regexp_replace(regexp_escape(p), '(\\)?[\s]+', '[\\s,]+', 'g') || '[\s,]+' || regexp_replace(regexp_escape(t), '(\\)?[\s]+', '[\\s,]+', 'g') || '\s*$', '')), '') else a end as address,
          case when line then coalesce(p, code) else p end as postcode, case when line then coalesce(t, rest) else t end as locality from y""",
    "contact_keys": f"""select seq, {_pc('postcode')} as postcode_key, array_to_string(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(contacts.phones, lambda x: string_split(x, ','))), lambda x: {_ph('x')}), lambda x: x <> ''))), ',') as phones,
        {_pm(_P0)} as phone_match, {_em(_E0)} as email, case when contains({_E0}, '@') then lower(trim(regexp_extract({_E0}, '^[^@]*@((.|\\n)*)$', 1))) end as email_domain, {_host('list_extract(contacts.websites, 1)')} as host from raw_hotels""",
    "suffix_numbers": f"""with h as (select seq, {_hn('name')} as n from raw_hotels), s as (select seq, n, regexp_extract(n, '{_BASE}', 4) as sx from h)
        select seq, case when sx <> '' then trim(regexp_extract(n, '{_BASE}', 1)) else n end as base, nullif(sx, '') as suffix, try_cast(regexp_extract(sx, '^([0-9]{{1,9}})[A-Z]?$', 1) as int) as number from s""",
    "phone_scan": r"""with p as (select seq, i, regexp_replace(regexp_replace(cell, '[+]367', '+357', 'g'), '00\s*357', '+357', 'g') as cell from (select seq, unnest(range(1, len(contacts.phones) + 1)) as i, unnest(contacts.phones) as cell from raw_hotels)),
        s as (select seq, i, unnest(range(len(x))) as j, unnest(x) as piece from (select seq, i, string_split_regex(cell, '[,;/&\n\r]+') as x from p)),
        r as (select seq, i, j, unnest(range(len(x))) as k, unnest(x) as run from (select seq, i, j, string_split(regexp_replace(piece, '[^0-9+]', '', 'g'), '+') as x from s)),
        n as (select seq, i, j, k, unnest(range(len(x))) as m, unnest(x) as num from (select seq, i, j, k, regexp_extract_all(run, '(?:00357|357)?([29][0-9]{7})', 1) as x from r where k = 0 or regexp_matches(run, '^(357)?[29][0-9]{7}'))),
        f as (select seq, num, min((i, j, k, m)) as first_at from n group by seq, num)
        select raw_hotels.seq, coalesce(string_agg('+357' || num, ',' order by first_at), '') as phones from raw_hotels left join f on f.seq = raw_hotels.seq group by raw_hotels.seq""",
    "website_kinds": f"""with w as (select _id, list_filter(contacts.websites, lambda x: trim(x) <> '') as sites, list_filter(contacts.domains, lambda x: trim(x) <> '') as doms from canonical_hotels),
        s as (select _id, sites, list_transform(case when len(doms) > 0 then doms else sites end, lambda x: {_host('x')}) as seen from w),
        l as (select _id, list_filter(list_transform(sites, lambda x: case when regexp_matches(trim(x), '(?i)^https?://') then trim(x) when regexp_matches(trim(x), '^[a-z][a-z0-9+.-]*:') then null else 'http://' || trim(x) end), lambda x: x is not null) as f from w),
        k as (select _id, list_distinct(list_transform(f, lambda x: case when regexp_matches(regexp_extract(x, '^[a-zA-Z]+://([^/?#]+)', 1), '^[^@\\s]+\\.[^@\\s]+$') then lower(regexp_extract(x, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(x, '^[a-zA-Z]+://([^/?#]+)', 1))
          || case when regexp_extract(x, '^[a-zA-Z]+://[^/?#]+(.*)$', 1) = '' then '/' else regexp_extract(x, '^[a-zA-Z]+://[^/?#]+(.*)$', 1) end end)) as u, f from l),
        o as (select _id, u, list_filter(list_transform(f, lambda x: regexp_replace(x, '^(.*)$', '\\1')), lambda x: true) as f from k)
        select s._id, len(s.sites) > 0 as declared, case when len(seen) = 0 then 'missing' when len(list_filter(seen, lambda h: h not in {_in(SHARED_EXACT)})) = 0 then 'group'
          when len(list_filter(seen, lambda h: h not in {_in(AGGREGATOR_HOSTS)})) = 0 then 'aggregator' when len(list_filter(seen, lambda h: h not in {_in(SOCIAL_HOSTS)})) = 0 then 'social' else 'own' end as kind,
          (select coalesce(string_agg(v, ' ' order by deep desc, i), '') from (select v, min(i) as i, regexp_matches(v, '^https?://[^/]+/.') as deep from (select i, case when regexp_matches(regexp_extract(x, '^[a-zA-Z]+://([^/?#]+)', 1), '^[^@\\s]+\\.[^@\\s]+$')
            then lower(regexp_extract(x, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(x, '^[a-zA-Z]+://([^/?#]+)', 1)) || case when regexp_extract(x, '^[a-zA-Z]+://[^/?#]+(.*)$', 1) = '' then '/' else regexp_extract(x, '^[a-zA-Z]+://[^/?#]+(.*)$', 1) end end as v
            from (select unnest(l.f) as x, unnest(range(len(l.f))) as i)) where v is not null group by v)) as links
        from s join l on l._id = s._id""",
    "address_forms": f"""select seq, {_af(_nt('address'))} as address, {_af(_pt('address'))} as address_plain, regexp_replace(regexp_replace({_nt('locality')}, '\\bK\\b', 'KATO', 'g'), '\\bP\\b', 'PANO', 'g') as locality from raw_hotels""",
    "file_names": r"""select f as filename, make_date(regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 3)::int, regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 2)::int, regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 1)::int) as day,
        upper(case when regexp_matches(lower(f), '^hotels_') then regexp_extract(lower(f), '^hotels_([a-z]+)', 1) else regexp_extract(lower(f), '^([a-z]+)_hotels', 1) end) as region, n from (select sourcefile.filename as f, count(*) as n from raw_hotels group by 1)""",
    "beach_types": """with s as (select datasetversion, upper(coalesce(json_extract_string(sourceproperties::json, '$.surface'), '')) as s, json_extract_string(geometry::json, '$.type') as k from beach_profiles)
        select datasetversion, case when s like '%SAND%' then 'SAND' when s like '%PEBBLE%' or s like '%GRAVEL%' then 'PEBBLE' when s like '%ROCK%' then 'ROCK' else 'UNKNOWN' end as beach_type,
          case when k in ('Point', 'MultiPoint') then 'POINT' when k in ('LineString', 'MultiLineString') then 'LINE' else 'AREA' end as kind, count(*) as n from s group by all""",
    "scored_matches": f"with {_SIDES} select cid, hid, score, reason, round(ns, 6) as name_score, richness from named",
    "mutual_matches": f"with {_SIDES} select cid, hid, score, reason from mut",
    "match_reviews": f"with {_SIDES} select cid, hid, score, reason from (select *, row_number() over (partition by cid order by score desc, richness desc, hid) as n from named where cid not in (select cid from mut)) where n = 1",
    "match_suggestions": f"""with {_SIDES} select h.hid, count(t.cid)::int as n, string_agg(t.cid, ',' order by t.r) as cids from hot h left join (select * from (select *, row_number() over (partition by hid order by score desc, cid) as r from named) where r <= 5) t on t.hid = h.hid group by h.hid""",
    "unmatched_hotels": f"with {_SIDES} select hid from hot where hid not in (select hid from named)",
    "dedupe_last": "select sourcefile.filename as filename, stricthoteldedupekey as strict, seq, name, rooms, beds from raw_hotels qualify row_number() over (partition by sourcefile.filename, stricthoteldedupekey order by seq desc) = 1",
    "dedupe_first": "select sourcefile.filename as filename, stricthoteldedupekey as strict, seq, name, rooms, beds from raw_hotels qualify row_number() over (partition by sourcefile.filename, stricthoteldedupekey order by seq) = 1",
    "soft_conflicts": f"""with k as (select {_j(_mk('name'), _pc('postcode'), _ph(_P0), 'rooms', 'beds')} as soft, stricthoteldedupekey as strict from raw_hotels)
        select soft, count(distinct strict) as strict_keys, count(*) as rows from k group by soft having count(distinct strict) > 1""",
    "strong_duplicates": f"""with r as (select seq, {_j('sourcefile.filename', _hn('name'), _it('establishmenttype'), _pc('postcode'), _it('operatorname'), 'rooms', 'beds')} as ident, unnest(list_distinct(list_transform(contacts.emails || contacts.websites, lambda x: lower(trim(x))))) as token
          from raw_hotels where postcode is not null and operatorname is not null and rooms is not null and beds is not null), f as (select *, min(seq) over (partition by ident, token) as first_seq from r)
        select distinct first_seq, seq from f where seq > first_seq""",
    "survivor_merge": f"""with g as {_GRP}, s as (select *, case when coalesce(location.district <> '' and location.locality <> '' and upper(location.district) <> upper(location.locality) and contains(upper(location.district), upper(location.locality)), false) then 10000 else 100 end
          + case when location.postcode <> '' then 1000 else 0 end + case when location.address <> '' then 100 + length(location.address) else 0 end + case when location.locality <> '' then 10 else 0 end + case when location.district <> '' then 1 else 0 end as ls from g),
        p as (select dup_group, f, string_agg(distinct v, ',' order by v) as vs from (select dup_group, 'phones' as f, unnest(contacts.phones) as v from g union all select dup_group, 'emails', unnest(contacts.emails) from g
          union all select dup_group, 'websites', unnest(contacts.websites) from g union all select dup_group, 'domains', unnest(contacts.domains) from g) group by 1, 2),
        q as (select dup_group, max(vs) filter (f = 'phones') as phones, max(vs) filter (f = 'emails') as emails, max(vs) filter (f = 'websites') as websites, max(vs) filter (f = 'domains') as domains from p group by 1)
        select s.dup_group, arg_max_null(location.address, (ls, _id)) as address, max(ls)::int as location_score, arg_min(operator, _id) filter (operator is not null) as operator, coalesce(any_value(phones), '') as phones, coalesce(any_value(emails), '') as emails,
          coalesce(any_value(websites), '') as websites, coalesce(any_value(domains), '') as domains, case when count(capacity.rooms) = count(*) then sum(capacity.rooms)::bigint end as rooms_sum, count(*) as n from s left join q on q.dup_group = s.dup_group group by s.dup_group""",
    "capacity_merge": f"""with recursive g as {_GRP}, n as (select dup_group, capacity.rooms as nr, capacity.beds as nb, row_number() over (partition by dup_group order by _id) as i from g),
        f as (select dup_group, i, nr as rooms, nb as beds, false as conflict from n where i = 1
          union all select f.dup_group, n.i, case when bad or differ then rooms when nfull and not ofull then nr else coalesce(rooms, nr) end, case when bad or differ then beds when nfull and not ofull then nb else coalesce(beds, nb) end, conflict or differ
          from f join n on n.dup_group = f.dup_group and n.i = f.i + 1, lateral (select coalesce(nr <= 0 or nb <= 0, false) as bad, rooms is not null and beds is not null as ofull, nr is not null and nb is not null as nfull) x,
            lateral (select ofull and nfull and not bad and (rooms <> nr or beds <> nb) as differ) y)
        select dup_group, rooms, beds, conflict from f qualify row_number() over (partition by dup_group order by i desc) = 1""",
    "quality_issues": """with i as (select concat_ws(',', case when coalesce(rooms <= 0, false) or coalesce(beds <= 0, false) then 'invalid_capacity' end, case when coalesce(trim(name), '') = '' then 'missing_name' end,
          case when coalesce(trim(establishmenttype), '') = '' or coalesce(trim(region), '') = '' or coalesce(trim(locality), '') = '' then 'missing_required_identity_fields' end) as issues from raw_hotels)
        select issues, count(*) as n from i group by 1""",
    "strict_sums": "select region, establishmenttype, case when count(rooms) = count(*) then sum(rooms)::bigint end as rooms, case when count(beds) = count(*) then sum(beds)::bigint end as beds, count(*) as n from raw_hotels group by 1, 2",
    "facet_stats": """with d(facet, value) as (values ('lifecycle', 'ACTIVE'), ('lifecycle', 'STALE'), ('lifecycle', 'REMOVED_FROM_SOURCE'), ('geometrykind', 'POINT'), ('geometrykind', 'LINE'), ('geometrykind', 'AREA'), ('beachtype', 'SAND'), ('beachtype', 'PEBBLE'),
          ('beachtype', 'ROCK'), ('beachtype', 'MIXED'), ('beachtype', 'UNKNOWN')),
        c as (select 'lifecycle' as facet, lifecycle.status as value, count(*) as n from beach_profiles group by 2 union all select 'geometrykind', geometrykind, count(*) from beach_profiles group by 2
          union all select 'beachtype', beachtype, count(*) from beach_profiles group by 2 union all select 'quality', quality.status, count(*) from beach_profiles group by 2)
        select d.facet, d.value, coalesce(c.n, 0) as n from d left join c on c.facet = d.facet and c.value = d.value union all select facet, value, n from c where facet = 'quality' and trim(value) <> ''""",
    "filled_counts": f"""select source.importrunid as run, count(*) filter (name <> '') as with_name, count(*) filter ({_tagp('phone')} <> '' or {_tagp('contact:phone')} <> '' or {_tagp('contact:mobile')} <> '') as with_phone,
        count(*) filter ({_tagp('website')} <> '' or {_tagp('contact:website')} <> '' or {_tagp('url')} <> '') as with_website, count(*) as n from hotel_geo_candidates group by 1""",
    "list_page": """select _id, name from (select distinct on (_id, updatedat) * from hotel_geo_candidates where matchstatus = 'UNMATCHED')
        where contains(lower(name), 'royal') or contains(lower(normalizedname), 'royal') or contains(lower(sourceproperties), 'royal') order by updatedat desc, _id limit 25 offset 10""",
    "adjacency": """select * from (select _id, canonicalhotelid, beachprofileid, walkingdistancemeters, straightdistancemeters, status, row_number() over (partition by canonicalhotelid
        order by walkingdistancemeters nulls first, straightdistancemeters nulls first, _id)::int as rank from (select distinct on (_id) * from hotel_beach_access_edges)) where rank <= 20""",
    "recent_runs": "select _id, importkind, status from geo_import_runs order by startedat desc, _id limit 50",
    "clique_groups": f"""with h as (select seq, sourcefile.filename as f, {_hn('name')} as n, contacts.emails as mails, nullif({_pc('postcode')}, '') as code, establishmenttype from raw_hotels),
        m as (select f || '|' || case when regexp_extract(n, '{_BASE}', 4) <> '' then trim(regexp_extract(n, '{_BASE}', 1)) else n end as block, * from h),
        p as (select a.block, bool_and(len(list_intersect(a.mails, b.mails)) > 0) as ov from m a join m b on a.block = b.block and a.seq < b.seq group by 1)
        select m.block, count(distinct seq) as members from m join p on p.block = m.block where p.ov group by m.block having count(distinct seq) > 1 and count(distinct code) <= 1""",
    "shadow_aggregates": """select o_orderkey, count(*) as parts, round(sum(l_extendedprice), 2) as sum_price from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_totalprice
        having count(*) >= 3 and count(l_extendedprice) = count(*) and o_totalprice > max(l_extendedprice) and sum(l_extendedprice) > 0 and abs(sum(l_extendedprice) - o_totalprice) / sum(l_extendedprice) <= 0.2""",
    "capacity_collapse": f"""with h as (select seq, sourcefile.filename as f, {_hn('name')} as n, establishmenttype, rooms, beds from raw_hotels),
        m as (select f || '|' || case when regexp_extract(n, '{_BASE}', 4) <> '' then trim(regexp_extract(n, '{_BASE}', 1)) else n end as block, * from h),
        w as (select *, first_value(rooms) over (partition by block order by seq) as fr, first_value(beds) over (partition by block order by seq) as fb from m)
        select block, count(*) as members, min(seq) as keeper from w group by block having count(*) > 1 and count(distinct establishmenttype) = 1 and bool_and(coalesce(rooms = fr, true) and coalesce(abs(beds - fb) <= 10, true))""",
    "similar_addresses": f"""with a as (select distinct sourcefile.filename as filename, {_pc('postcode')} as code, {_af(_nt('address'))} as address from raw_hotels where address is not null and postcode is not null),
        n as (select *, regexp_extract(address, '^([0-9]+[A-Z]?)', 1) as num from a)
        select l.filename, l.address as a, r.address as b from n l join n r on l.filename = r.filename and l.code = r.code and l.num = r.num and l.num <> '' and l.address < r.address
        where levenshtein(l.address, r.address)::double / greatest(length(l.address), length(r.address)) <= 0.25""",
    "edge_distances": f"""with e as (select distinct on (_id) _id, floor({_hav('hotelpoint.coordinates[1]', 'hotelpoint.coordinates[2]', 'beachpoint.coordinates[1]', 'beachpoint.coordinates[2]', 6371000)} + 0.5)::bigint as metres from hotel_beach_access_edges where hotelpoint is not null and beachpoint is not null)
        select _id, metres, ceil(metres / 1.25)::bigint as seconds from e""",
    "radius_search": f"with {_POINTS} select pid as id, round(m, 3) as metres from (select pid, {_hav('33.0', '35.0', 'x', 'y', 6378100)} as m from okp) where m <= 10000 order by m, pid limit 50",
    "nearest_beaches": f"with {_POINTS}, k as ({_KNN}) select pid, cid, round(m, 3) as metres, rank::int as rank from k where rank <= 20",
    "beach_routes": f"""with {_POINTS}, k as (select * from ({_KNN}) where rank <= 20), s as (select *, json_extract_string(geometry::json, '$.type') as kind from k),
        line as (select pid, cid, x, y, p[floor(q * (len(p) - 1) + 0.5)::int + 1] as t from (select *, from_json(geometry, '{{"coordinates": [["DOUBLE"]]}}').coordinates as p, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) as q from s where kind = 'LineString')),
        vert as (select pid, cid, x, y, p[i] as t, i from (select *, unnest(range(1, len(p) + 1)) as i from (select *, from_json(geometry, '{{"coordinates": [[["DOUBLE"]]]}}').coordinates[1] as p from s where kind = 'Polygon'))),
        area as (select pid, cid, x, y, t from vert qualify row_number() over (partition by pid, cid order by floor({_hav('x', 'y', 't[1]', 't[2]', 6371000)} + 0.5), i) <= 5),
        own as (select pid, cid, x, y, [bx, by_] as t from s where kind not in ('LineString', 'Polygon')),
        r as (select distinct pid, cid, t, floor({_hav('x', 'y', 't[1]', 't[2]', 6371000)} + 0.5)::bigint as m from (select * from line union all select * from area union all select * from own)),
        n as (select pid, cid, m, row_number() over (partition by pid, cid order by m, t) as i from r)
        select pid, cid, max(m) filter (i = 1) as metres, ceil(max(m) filter (i = 1) / 1.25)::bigint as seconds, coalesce(string_agg(m::varchar, ',' order by i) filter (i in (2, 3)), '') as alternatives from n group by 1, 2""",
    "representative_points": """with v as (select _id, datasetversion, geometry, from_json(('[' || regexp_replace(regexp_replace(json_extract(geometry::json, '$.coordinates')::varchar, '[\\[\\]]', '', 'g'), '\\s', '', 'g') || ']')::json, '["DOUBLE"]') as c from beach_profiles)
        select _id, datasetversion, round(list_avg(list_filter(c, lambda x, i: i % 2 = 1)), 9) as lng, round(list_avg(list_filter(c, lambda x, i: i % 2 = 0)), 9) as lat from v""",
    "hash_diff_upsert": f"select _id, action from {_DIFF.format(3)}",
    "upsert_counts": f"""select count(*) filter (action <> 'MISSING') as read, count(*) filter (action = 'INSERTED') as inserted, count(*) filter (action = 'UPDATED') as updated, count(*) filter (action = 'UNCHANGED') as unchanged,
        count(*) filter (action = 'MISSING') as marked_stale, 0::bigint as failed from {_DIFF.format(1)}""",
    "upsert_snapshot": f"""select coalesce(o._id, n._id) as _id, case when n._id is null then o.surface else n.surface end as surface, case when o._id is not null then o.label else n.label end as label, case when n._id is null then o.status else n.status end as status
        from {_BEACH.format(1)} o full join {_BEACH.format(4)} n on o._id = n._id""",
    "stale_marks": f"select _id, _id not in (select _id from {_BEACH.format(4)}) as stale from {_BEACH.format(1)}",
    "fill_merge": f"select coalesce(o._id, n._id) as _id, coalesce(o.label, n.label) as label, coalesce(n.surface, o.surface) as surface, coalesce(n.status, o.status) as status from {_BEACH.format(1)} o full join {_BEACH.format(4)} n on o._id = n._id",
    "resolved_targets": f"""with r as (select distinct on (_id) _id as rid, {_j(_hn('name.original'), _pc('location.postcode'), _nt('location.address'))} as key, {_hn('name.original')} as name, nullif({_nt('location.address')}, '') as a, nullif({_pc('location.postcode')}, '') as p,
          nullif({_nt('operator')}, '') as o, list_filter(contacts.phones || contacts.emails, lambda x: x <> '') as c from hotel_registry_entries where status = 'ready'),
        k as (select _id as kid, {_j(_hn('canonicalname'), _pc('location.postcode'), _nt('location.address'))} as key, {_hn('canonicalname')} as name, nullif({_nt('location.address')}, '') as a, nullif({_pc('location.postcode')}, '') as p, nullif({_nt('operator')}, '') as o,
          list_filter(contacts.phones || contacts.emails, lambda x: x <> '') as c from canonical_hotels),
        e as (select rid, count(*) as n, min(kid) as kid from r join k using (key) group by rid),
        f as (select r.rid, count(distinct k.kid) as n, min(k.kid) as kid from r join k on r.name = k.name and (r.a = k.a or r.p = k.p or r.o = k.o or len(list_intersect(r.c, k.c)) > 0) where r.rid not in (select rid from e) group by 1)
        select r.rid, case when e.n = 1 then e.kid when e.n is null and f.n = 1 then f.kid end as kid, case when e.n = 1 then 'exact' when e.n > 1 then 'ambiguous' when f.n = 1 then 'alike' when f.n > 1 then 'ambiguous' else 'new' end as how
        from r left join e on e.rid = r.rid left join f on f.rid = r.rid""",
    "version_publish": "select 'beaches' as dataset, unnest(list_distinct(list(datasetversion)) || [max(datasetversion) + 1])::int as version, 'published' as status from beach_profiles",
    "lease_rows": """select _id, processing.status as status from raw_hotels where processing.status = 'pending' or (processing.status = 'claimed' and processing.claimedat::timestamp < timestamp '2025-12-31 23:30:00') order by _id limit 50""",
    "run_progress": """with g as (select runid, count(*) filter (status <> 'failed') as done, count(*) as total from (select distinct on (_id) * from hotel_beach_access_edges) group by 1)
        select runid, case when done = total then floor(done * 1000.0 / total) / 10 else least(99.9, floor(done * 1000.0 / total) / 10) end as percent from g""",
    "page_ranges": """with p as (select doc_id, ceil(n_chars / 500)::int as pages from documents), s as (select doc_id, pages, unnest(case when pages <= 8 then [1] else range(1, pages, 4) end)::int as page_from from p where pages > 0)
        select doc_id, pages, page_from, case when pages <= 8 then pages else least(pages, page_from + 4) end as page_to from s""",
    "discovered_files": r"""select distinct 'https://registry.example/files/' || f as url, f as filename, make_date(regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 3)::int, regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 2)::int, regexp_extract(f, '(\d{1,2})\.(\d{1,2})\.(\d{4})', 1)::int) as day,
        upper(case when regexp_matches(lower(f), '^hotels_') then regexp_extract(lower(f), '^hotels_([a-z]+)', 1) else regexp_extract(lower(f), '^([a-z]+)_hotels', 1) end) as region
        from (select sourcefile.filename as f from raw_hotels) where regexp_matches(lower(f), '_hotels_|^hotels_') and lower(f) like '%.pdf'""",
    "fresh_files": "select sourcefile.filename as filename from raw_hotels group by 1 having max(createdat)::timestamp < timestamp '2025-05-05 15:00:00'",
    "stream_upsert": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
}
