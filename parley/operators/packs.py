"""Rule packs of cards: what users change is a log that only grows, and rules are what its replay leaves.

A log has rows (owner, version, action, kind, key, value). In a pack's log the owner is the fingerprint of a card; in a session's log
the session. Versions order the rows of an owner. Actions: `set` is a user's change (a null value takes the rule back), `apply` a rule
that a pack brought in, `undo` names by its value the version of an `apply` that does not count. Nothing is rewritten: to undo is to
append a row, so the state before an `apply` comes back exactly, and a later replay sees why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "owner string, version long, action string, kind string, key string, value string"
_RULE = ["owner", "kind", "key"]


def rules(log: DataFrame) -> DataFrame:
    """owner, kind, key, value, applied: the rules that a log leaves; applied: the version of the `apply` that brought a rule in, if any.

    The last change of a key counts. A key that an undone `apply` brought in is gone, whatever was done with it since.
    """
    undone = log.where("action = 'undo'").select("owner", F.col("value").cast("long").alias("version"))
    brought = log.where("action = 'apply'")
    gone = brought.join(undone, ["owner", "version"], "left_semi").select(*_RULE).distinct()
    last = log.where("action != 'undo'").join(gone, _RULE, "left_anti").groupBy(*_RULE).agg(
        F.max_by(F.struct("value"), "version").alias("last"), F.max(F.when(F.col("action") == "apply", F.col("version"))).alias("applied")
    )
    return last.select(*_RULE, F.col("last.value").alias("value"), "applied").where("value is not null")


def resolved(packs: DataFrame, cards: DataFrame) -> DataFrame:
    """cards (session, strong, weak; strong is null where a card's content is unknown) -> session, fingerprint, via.

    The strong fingerprint is taken where it has rules. Else the weak one's are found by name only: via is `weak`, and where the
    content is known the fingerprint is the strong one all the same, under which `migration` puts these rules.
    """
    held = rules(packs).select(F.col("owner").alias("held")).distinct()
    strong = cards.join(held, F.col("strong") == F.col("held"), "left").withColumnRenamed("held", "has_strong")
    both = strong.join(held, F.col("weak") == F.col("held"), "left")
    via = F.when(F.col("has_strong").isNotNull(), "strong").when(F.col("held").isNotNull(), "weak").otherwise("none")
    return both.select("session", "strong", "weak", F.coalesce("strong", "weak").alias("fingerprint"), via.alias("via"))


def migration(packs: DataFrame, found: DataFrame, version: int) -> DataFrame:
    """The rows to append to the packs' log: rules of weak fingerprints under the strong ones that have none yet. The weak ones stay."""
    moves = found.where("via = 'weak' and strong is not null").select("strong", "weak").distinct()
    return rules(packs).join(moves, F.col("owner") == F.col("weak")).select(F.col("strong").alias("owner"), F.lit(version).cast("long").alias("version"), F.lit("set").alias("action"), "kind", "key", "value")


def application(log: DataFrame, packs: DataFrame, found: DataFrame, version: int) -> DataFrame:
    """The rows to append to the sessions' log: each session's pack, but for keys on which the session has a rule of its own."""
    brought = rules(packs).withColumnRenamed("owner", "fingerprint").join(found.where("via != 'none'").select("session", "fingerprint"), "fingerprint")
    rows = brought.select(F.col("session").alias("owner"), F.lit(version).cast("long").alias("version"), F.lit("apply").alias("action"), "kind", "key", "value")
    return rows.join(rules(log).select(*_RULE), _RULE, "left_anti").select("owner", "version", "action", "kind", "key", "value")


def undo(owners: DataFrame, applied: int, version: int) -> DataFrame:
    """owner -> the rows to append to the sessions' log that take an `apply` back."""
    nothing = F.lit(None).cast("string")
    return owners.select("owner", F.lit(version).cast("long").alias("version"), F.lit("undo").alias("action"), nothing.alias("kind"), nothing.alias("key"), F.lit(str(applied)).alias("value"))
