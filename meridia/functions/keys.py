"""Composite identity keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.text import hotel_name, identity_text, name_match_key, name_text, phone_key, plain_text, postcode_key


def joined(*cols: Column, sep: str = "|") -> Column:
    """All parts, null as '': a missing part keeps its place."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def first_of(array: Column) -> Column:
    return F.get(array, F.lit(0))


def strict_key(name: Column, postcode: Column, phones: Column, rooms: Column, beds: Column) -> Column:
    return joined(hotel_name(name), postcode_key(postcode), phone_key(first_of(phones)), rooms, beds)


def soft_key(name: Column, postcode: Column, phones: Column, rooms: Column, beds: Column) -> Column:
    return joined(name_match_key(name), postcode_key(postcode), phone_key(first_of(phones)), rooms, beds)


def merge_key(name: Column, kind: Column, region: Column, locality: Column, postcode: Column, operator: Column, phones: Column) -> Column:
    return joined(hotel_name(name), identity_text(kind), identity_text(region), identity_text(locality), postcode_key(postcode), identity_text(operator), phone_key(first_of(phones)))


def registry_key(name: Column, kind: Column, region: Column, locality: Column, postcode: Column, address: Column) -> Column:
    return joined(F.lit("rkv1"), hotel_name(name), name_text(kind), name_text(region), name_text(locality), postcode_key(postcode), name_text(address))


def _contact(phones: Column, emails: Column) -> Column:
    """The first telephone, or without one the first e-mail address."""
    given = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(given(first_of(phones)), given(first_of(emails)))


def canonical_key(kind: Column, name: Column, district: Column, locality: Column, postcode: Column, address: Column, operator: Column, phones: Column, emails: Column) -> Column:
    """The first of seven pairs of fields that a record has makes its key; with none of them the location and the contact do."""
    has = lambda c: c != ""
    d, t, p, a, o = name_text(district), name_text(locality), postcode_key(postcode), name_text(address), name_text(operator)
    contact = name_text(_contact(phones, emails))
    head = [F.lit("chv1"), kind, name_text(name)]
    return (
        F.when(has(p) & has(a), joined(*head, d, t, p, a))
        .when(has(p) & has(o), joined(*head, d, t, p, o))
        .when(has(a) & has(o), joined(*head, d, t, F.lit("address_operator"), a, o))
        .when(has(a) & has(contact), joined(*head, d, t, F.lit("address_contact"), a, contact))
        .when(has(p) & has(contact), joined(*head, d, t, F.lit("postcode_contact"), p, contact))
        .when(has(o) & has(contact), joined(*head, d, t, F.lit("operator_contact"), o, contact))
        .otherwise(joined(*head, d, t, F.lit("location_contact"), contact))
    )


def strong_identity(name: Column, district: Column, locality: Column, postcode: Column, address: Column, operator: Column, phones: Column, emails: Column) -> Column:
    """A name, and two of postcode, address, operator and contact, or a district or locality with a contact."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    p, a, o, contact = has(postcode), has(address), has(operator), _contact(phones, emails).isNotNull()
    pairs = (p & a) | (p & o) | (a & o) | (a & contact) | (p & contact) | (o & contact) | ((has(district) | has(locality)) & contact)
    return has(name) & pairs


def contacts_key(phones: Column, emails: Column, websites: Column, domains: Column) -> Column:
    """The four lists, each sorted by code point."""
    part = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), ",")
    return joined(part(phones), part(emails), part(websites), part(domains))


def component_key(name: Column, kind: Column, postcode: Column, address: Column) -> Column:
    return joined(F.lit("component-v1"), plain_text(name), plain_text(kind), postcode_key(postcode), plain_text(address))


def json_hash(text: Column) -> Column:
    """SHA-256 of a JSON value, whatever its spacing and order of keys; null for null and for malformed text."""
    return F.sha2(F.to_json(F.try_parse_json(text)), 256)
