"""Hosts and their parent domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host, NULL for text that is no URL."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain_suffixes(host: Column) -> Column:
    """The host and each of its parent domains: a.b.c gives a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.size(labels))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_blocked(url: Column, domains: Sequence[str]) -> Column:
    """True when the URL's host is one of the domains or lies below one; NULL URLs are not."""
    blocked = F.array(*[F.lit(domain.lower()) for domain in domains])
    return F.coalesce(F.arrays_overlap(domain_suffixes(host_of(url)), blocked), F.lit(False))
