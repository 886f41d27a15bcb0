"""Passes that go through rows one by one, in place, as Spark rounds.

A row that is changed is seen as changed by the rows after it, and as it was by those before. All rows are decided at once, given what the round
before made of the earlier ones, until a round changes nothing. The first row is right after one round, and a row is once all earlier
neighbours are, so the end is that of going one by one; rounds follow the longest chain of changes that lead to one another, not the number of rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.operators.tables import cut

c = F.col


def in_turn(rows: DataFrame, links: DataFrame, key: str, state: tuple[str, ...], decide) -> DataFrame:
    """key and state of the rows that change, in the order of their keys. rows: key, state and others; links: key, other.

    decide(rows, seen) -> key and new state of those that change, where seen has a row for each link: key, other and the state of the other as it is
    when the key's turn comes. Numbers in it have to be rounded, so that two rounds agree.
    """
    old = rows.select(c(key).alias("other"), *[c(s).alias(f"_{s}") for s in state])
    links = cut(links.select(key, "other").join(old, "other"))
    rows, changed = cut(rows), None
    while True:
        seen = links
        if changed is not None:
            new = changed.select(c(key).alias("other"), F.lit(True).alias("_new"), *[c(s).alias(f"_n_{s}") for s in state])
            seen = links.join(new, "other", "left")
        earlier = F.lit(False) if changed is None else F.coalesce(c("_new") & (c("other") < c(key)), F.lit(False))
        seen = seen.select(key, "other", *[(c(f"_{s}") if changed is None else F.when(earlier, c(f"_n_{s}")).otherwise(c(f"_{s}"))).alias(s) for s in state])
        after = cut(decide(rows, seen).select(key, *state))
        if changed is not None and after.exceptAll(changed).isEmpty() and changed.exceptAll(after).isEmpty():
            return after
        if changed is None and after.isEmpty():
            return after
        changed = after
