"""Normalising keys, names, flags and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def normalize_user(c: Column) -> Column:
    """Trim, drop a leading directory domain (`DOM/abc` or `DOM\\abc`), lower-case, blank to NULL."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z0-9._-]+[\\/]", "")
    return blank_to_null(F.lower(bare))


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(c))


def norm_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def to_bool(c: Column) -> Column:
    """Truthy spellings become TRUE, all else (NULL too) FALSE."""
    return F.coalesce(norm_text(c.cast("string")).isin("1", "true", "t", "yes", "y"), F.lit(False))


def bool_int(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def is_keylogger(filename: Column) -> Column:
    base = F.regexp_replace(F.trim(filename), r".*[\\/]", "")
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    return F.coalesce(F.lower(stem) == "keylogger", F.lit(False))


def is_admin(role: Column) -> Column:
    return F.coalesce(norm_text(role).isin("itadmin", "it admin"), F.lit(False))


def email_domain(email: Column) -> Column:
    return blank_to_null(F.regexp_extract(norm_text(email), r"@([\w.-]+)$", 1))


def handle_of(address: Column) -> Column:
    return blank_to_null(F.regexp_extract(address, r"^([^@]+)", 1))


def domain_of(address: Column) -> Column:
    """What follows the last `@`; an address without one is taken as a domain."""
    return F.substring_index(norm_text(F.coalesce(address, F.lit(""))), "@", -1)


def is_internal(address: Column, internal: Sequence[str]) -> Column:
    """The domain is one of `internal` or a sub-domain of one."""
    domain = domain_of(address)
    hit = F.lit(False)
    for name in internal:
        hit = hit | (domain == name) | domain.endswith("." + name)
    return hit


def recipients(c: Column) -> Column:
    """Addresses of one recipient field: split on `;` or `,`, empty and `nan` entries dropped."""
    squeezed = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    parts = F.split(squeezed, "[;,]")
    return F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))


def recipient_count(c: Column) -> Column:
    return F.size(recipients(c))


def attachment_count(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double").try_cast("int"), F.lit(0))


def recipient_domains(fields: Sequence[Column]) -> Column:
    """Domains of all recipients in the given fields, one entry per recipient."""
    return F.transform(F.flatten(F.array(*[recipients(c) for c in fields])), domain_of)


def direction_flags(
    sender: Column, domains: Column, internal: Sequence[str], personal: Sequence[str]
) -> dict[str, Column]:
    """The nine direction flags of one mail, from the sender and the recipients' domains."""
    from_internal = is_internal(sender, internal)
    n_internal = F.size(F.filter(domains, lambda d: is_internal(d, internal)))
    any_internal = n_internal > 0
    any_external = F.size(domains) > n_internal
    any_personal = F.arrays_overlap(domains, F.array(*[F.lit(p) for p in personal]).cast("array<string>"))
    inside_out = from_internal & any_external
    outside_in = ~from_internal & any_internal
    return {
        "dir_internal_only": from_internal & ~any_external,
        "dir_internal_to_external": inside_out,
        "dir_external_to_internal": outside_in,
        "dir_external_only": ~from_internal & ~any_internal,
        "any_personal_recipient": any_personal,
        "email_to_ext_domain": any_external,
        "internal_to_external": inside_out,
        "external_to_internal": outside_in,
        "external_to_personal": ~from_internal & any_personal,
    }
