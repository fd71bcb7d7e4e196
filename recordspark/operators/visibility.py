"""Publication exclusions: a policy of tokens, and the records it hides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.config import MAX_EXCLUSIONS, MAX_POLICY_BYTES

TOKEN = re.compile(r"^(?:doc:(?P<doc>[1-9]\d{0,17})|bates:(?P<bates>[A-Z][A-Z0-9_\-]{2,63}))$", re.I)


class PolicyError(ValueError):
    """A policy that cannot be read; nothing may be shown then."""


@dataclass(frozen=True)
class Policy:
    documents: frozenset[int] = frozenset()
    bates: frozenset[str] = frozenset()

    @property
    def active(self) -> bool:
        return bool(self.documents or self.bates)


def parse_policy(text: str | None) -> Policy:
    """``doc:N`` and ``bates:ID`` tokens apart by commas or white space; anything else fails closed."""
    text = text or ""
    if len(text.encode()) > MAX_POLICY_BYTES:
        raise PolicyError("policy too long")
    found = [t for t in re.split(r"[\s,]+", text) if t]
    if len(found) > MAX_EXCLUSIONS:
        raise PolicyError("too many exclusions")
    documents, bates = set(), set()
    for t in found:
        m = TOKEN.match(t)
        if not m:
            raise PolicyError("unreadable exclusion")
        if m["doc"]:
            documents.add(int(m["doc"]))
        else:
            bates.add(m["bates"].upper())
    return Policy(frozenset(documents), frozenset(bates))


def visible(policy: Policy, document_id: Column, bates: Column) -> Column:
    """Guarded predicate: a null Bates number hides nothing."""
    shown = F.lit(True)
    if policy.documents:
        shown = shown & ~document_id.isin(sorted(policy.documents))
    if policy.bates:
        shown = shown & (bates.isNull() | ~F.upper(bates).isin(sorted(policy.bates)))
    return shown


def visible_unguarded(policy: Policy, bates: Column) -> Column:
    """The plain NOT IN: rows with a null Bates number vanish while a policy is active."""
    return ~F.upper(bates).isin(sorted(policy.bates)) if policy.bates else F.lit(True)


def hidden_ids(policy: Policy, documents: DataFrame) -> DataFrame:
    """document_id of every record the policy hides under either identifier."""
    hit = F.lit(False)
    if policy.documents:
        hit = hit | F.col("id").isin(sorted(policy.documents))
    if policy.bates:
        hit = hit | F.coalesce(F.upper("bates_number").isin(sorted(policy.bates)), F.lit(False))
    return documents.filter(hit).select(F.col("id").alias("document_id"))


def without_hidden(rows: DataFrame, hidden: DataFrame, fail_closed: bool = False) -> DataFrame:
    """Rows of records that are not hidden; ``fail_closed`` drops rows of no known record as well."""
    out = rows.join(hidden, "document_id", "left_anti")
    return out.filter("document_id is not null") if fail_closed else out
