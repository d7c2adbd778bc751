"""Accounts and addresses by their names: filters that a dimension resolves before the scan, and reverse names joined back."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.staging import staged

#: SIDs that become literals of the scan; more are joined.
MOST_LITERALS = 1000


def by_account(events: DataFrame, accounts: DataFrame, names: list[str], *, name_col: str = "account", sid_col: str = "sid", event_col: str = "user_id", most: int = MOST_LITERALS) -> DataFrame:
    """Events of accounts named DOMAIN\\user or user, in any case; a name that is a SID (S-1-...) stands for itself.

    The dimension is asked first. Up to `most` SIDs become literals, so the scan skips files, row groups and partitions
    without them; more are left to a semi join. Names that nobody has select nothing; without names the request is refused.
    """
    wanted = sorted({n.strip().upper() for n in names if n and n.strip()})
    if not wanted:
        raise ValueError("at least one account name is needed")
    own = [n for n in wanted if n.startswith("S-1-")]
    full = F.upper(F.trim(F.col(name_col)))
    bare = F.element_at(F.split(full, r"\\"), -1)
    plain = [n for n in wanted if "\\" not in n]
    hit = full.isin(*wanted) | bare.isin(*plain) if plain else full.isin(*wanted)
    found = accounts.where(hit).select(F.col(sid_col).alias("_sid")).where("_sid is not null").distinct()
    sids = [r["_sid"] for r in found.limit(most + 1).collect()]
    if len(sids) + len(own) <= most:
        literal = sorted({*sids, *own})
        return events.where(F.col(event_col).isin(*literal)) if literal else events.where(F.lit(False))
    found = found.unionByName(events.sparkSession.createDataFrame([(n,) for n in own], "_sid string")).distinct()
    return events.join(found, F.col(event_col) == F.col("_sid"), "left_semi")


def reverse_name(address: str) -> str | None:
    """The host name of an address; None if it has none."""
    try:
        return socket.gethostbyaddr(address)[0]
    except OSError:
        return None


def reverse_names(events: DataFrame, address_col: str, resolver: Callable[[str], str | None] = reverse_name, *, known: DataFrame | None = None, keep_seconds: float = 3600.0, now: float | None = None, tasks: int = 8) -> tuple[DataFrame, DataFrame]:
    """(events with <address_col>_name, the names to hand over as `known` next time: address, name, resolved_at).

    Every distinct address that `known` doesn't hold, or holds for longer than keep_seconds, is resolved once, in at most `tasks` tasks
    at once, and written down; so the resolver sees no address twice. Failures of the resolver count as no name.
    """
    clock = time.time() if now is None else now
    spark = events.sparkSession
    none = spark.createDataFrame([], "address string, name string, resolved_at double")
    fresh = (none if known is None else known).where(F.col("resolved_at") > clock - keep_seconds).select("address", "name", "resolved_at")
    addresses = events.select(F.trim(F.col(f"`{address_col}`").cast("string")).alias("address")).where("address != '' and address != '-'").distinct()
    asked = addresses.join(fresh.select("address"), "address", "left_anti").repartition(max(1, tasks), "address")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = []
            for address in batch["address"]:
                try:
                    names.append(resolver(address))
                except Exception:  # noqa: BLE001
                    names.append(None)
            yield pd.DataFrame({"address": batch["address"], "name": pd.Series(names, dtype=object), "resolved_at": clock})

    names = staged(asked.mapInPandas(resolve, "address string, name string, resolved_at double").unionByName(fresh), "reverse-names")
    named = names.select(F.col("address").alias("_address"), F.col("name").alias(f"{address_col}_name"))
    return events.join(named, F.trim(F.col(f"`{address_col}`").cast("string")) == F.col("_address"), "left").drop("_address"), names
