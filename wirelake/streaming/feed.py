"""Live feeds of many subscribers: an index of their filters, and filters that change while it runs.

Subscribers with the same filter share one. A filter that demands that a field equal something is
found through an inverted table of that field, joined once however many filters it holds; what else
such filters demand is evaluated once per distinct remainder. Filters without an equality are
evaluated once each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.history import replay
from ..plans import ifl

#: Subscribers that one feed serves at most; the inverted tables, which are broadcast, have no more rows
#: than filters have values (``ifl.MOST_LIST`` each).
MOST_SUBSCRIBERS = 10_000


def _conjuncts(tree) -> list:
    if isinstance(tree, ifl.Many) and tree.how == "and":
        return [c for p in tree.parts for c in _conjuncts(p)]
    return [tree]


def _anchor(parts: list) -> int | None:
    """Which conjunct is an equality that a table can look up; networks can't be."""
    for k, p in enumerate(parts):
        if isinstance(p, ifl.Test) and p.op in ("==", "in") and (p.op == "in" or ifl.parse_network(p.values[0]) is None):
            return k
    return None


class Feed:
    """The filters of some subscribers. ``errors`` has those that aren't filters, which match nothing."""

    def __init__(self, subscriptions: dict[str, str]):
        if len(subscriptions) > MOST_SUBSCRIBERS:
            raise ValueError(f"more than {MOST_SUBSCRIBERS} subscribers; serve them by several feeds")
        self.errors: dict[str, str] = {}
        by_filter: dict[str, list[str]] = defaultdict(list)
        for subscriber, text in sorted(subscriptions.items()):
            by_filter[text.strip()].append(subscriber)
        self.subscribers: list[list[str]] = []
        #: field name -> value -> filters; the remainder of each filter that a table finds; the others
        self.tables: dict[str, dict[str, set[int]]] = defaultdict(lambda: defaultdict(set))
        self.rests: dict[tuple, list[int]] = defaultdict(list)
        self.others: list[tuple[int, object]] = []
        for text, subscribers in by_filter.items():
            try:
                tree = ifl.parse(text)
            except ifl.FilterError as e:
                self.errors |= dict.fromkeys(subscribers, str(e))
                continue
            number = len(self.subscribers)
            self.subscribers.append(subscribers)
            parts = [] if tree is None else _conjuncts(tree)
            k = _anchor(parts)
            if k is None:
                self.others.append((number, tree))
                continue
            for value in parts[k].values:
                self.tables[parts[k].field.name][value.lower()].add(number)
            self.rests[tuple(parts[:k] + parts[k + 1 :])].append(number)

    def _hits(self, entries: DataFrame) -> DataFrame:
        """``entries``, batch or stream, with ``__hits``: the numbers of the filters that let each through. No
        condition is inside a lambda function, where Spark evaluates it without generated code."""
        spark, rows, found = entries.sparkSession, entries, []
        for t, (name, values) in enumerate(self.tables.items()):
            table = spark.createDataFrame([(v, sorted(n)) for v, n in values.items()], "value string, filters array<int>")
            for s, side in enumerate(ifl.fields.find(name).sides()):
                looked = table.select(F.col("value").alias(f"__value{t}_{s}"), F.col("filters").alias(f"__found{t}_{s}"))
                rows = rows.join(F.broadcast(looked), F.lower(side) == F.col(f"__value{t}_{s}"), "left").drop(f"__value{t}_{s}")
                found.append(f"__found{t}_{s}")
        none = F.array().cast("array<int>")
        some = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(c), none) for c in found]))) if found else none
        rows = rows.withColumn("__some", some).drop(*found)
        hits: list[Column] = []
        for rest, numbers in self.rests.items():
            mine = F.array_intersect("__some", F.array(*map(F.lit, numbers)))
            hits.append(F.when((F.size("__some") > 0) & F.coalesce(ifl.condition_of(rest), F.lit(False)), mine).otherwise(none) if rest else mine)
        for number, tree in self.others:
            hits.append(F.when(F.lit(True) if tree is None else F.coalesce(ifl.condition_of((tree,)), F.lit(False)), F.array(F.lit(number))).otherwise(none))
        return rows.withColumn("__hits", F.flatten(F.array(*hits)) if hits else none).drop("__some")

    def matched(self, entries: DataFrame) -> DataFrame:
        """``entries``, batch or stream, with ``subscribers``: who is to get each; rows for nobody go."""
        names = F.array(*[F.array(*map(F.lit, s)) for s in self.subscribers]) if self.subscribers else F.array(F.array(F.lit("")))
        who = F.flatten(F.transform("__hits", lambda n: F.get(names, n)))
        return self._hits(entries).withColumn("subscribers", who).drop("__hits").filter(F.size("subscribers") > 0)


def delivered(entries: DataFrame, feed: Feed) -> DataFrame:
    """(subscriber, entry columns…): a row for each entry that a subscriber gets. Hits are evaluated once: the
    inner ``explode`` would have Spark filter by them first, and so evaluate all conditions twice."""
    names = [(n, s) for n, some in enumerate(feed.subscribers) for s in some]
    who = F.broadcast(entries.sparkSession.createDataFrame(names, "__hit int, subscriber string"))
    hits = feed._hits(entries).select(*entries.columns, F.explode_outer("__hits").alias("__hit"))
    return hits.join(who, "__hit").select("subscriber", *entries.columns)


class Switchboard:
    """A feed whose subscribers come and change their filters while entries arrive.

    ``deliver`` is for ``foreachBatch`` over a stream of entries with two more columns, ``subscriber`` and
    ``filter``, that are set in control rows and null in entries. The border of a micro-batch is where
    one filter hands over to the next: a subscriber with a valid control row in a batch (the last one
    counts, by ``seq``) is first sent the newest ``history`` entries of the batches before, oldest
    first, and this batch's entries already by the new filter, so none is missed and none sent twice.
    A text that isn't a filter is answered by an error and changes nothing; a null filter leaves.

    Under ``where``: ``history`` (all that came, control rows too), ``filters`` after each batch, ``sent`` and
    ``errors``, all by batch, which a batch that is tried again overwrites. Only the filters pass through the
    driver. A batch is computed once, for its history, and the rest is read from there. All that has as many
    tasks as the batch has partitions: a stream of few files should be dealt out before.
    """

    def __init__(self, spark: SparkSession, where: str, history: int = 500):
        self.spark, self.where, self.newest = spark, where, history

    def _filters(self, batch: int) -> dict[str, str]:
        if batch < 0:
            return {}
        rows = self.spark.read.schema("subscriber string, filter string").json(f"{self.where}/filters/batch={batch}").limit(MOST_SUBSCRIBERS + 1)
        return {r["subscriber"]: r["filter"] for r in rows.collect()}

    def deliver(self, df: DataFrame, batch: int) -> None:
        spark, where = self.spark, self.where
        part = lambda name: f"{where}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(part("history"))
        came = spark.read.schema(df.schema).parquet(part("history"))
        current = self._filters(batch - 1)
        changes, wrong = {}, []
        asked = came.filter(F.col("subscriber").isNotNull()).select("subscriber", "filter", "seq")
        for r in asked.orderBy("seq").limit(MOST_SUBSCRIBERS + 1).collect():
            problem = None if r["filter"] is None else Feed({r["subscriber"]: r["filter"]}).errors.get(r["subscriber"])
            if problem:
                wrong.append((r["subscriber"], r["filter"], problem))
            else:
                changes[r["subscriber"]] = r["filter"]
        current = {s: f for s, f in (current | changes).items() if f is not None}
        entries = came.filter(F.col("subscriber").isNull()).drop("subscriber", "filter")
        sent = delivered(entries, Feed(current)).withColumn("replayed", F.lit(False))
        new = {s: f for s, f in changes.items() if f is not None}
        if new and batch > 0:
            before = spark.read.schema(StructType([*came.schema, StructField("batch", LongType())])).parquet(f"{where}/history").filter(F.col("batch") < batch)
            before = before.filter(F.col("subscriber").isNull()).select(*entries.columns)
            for subscriber, text in new.items():
                again = replay(before, text, self.newest).select(F.lit(subscriber).alias("subscriber"), *entries.columns)
                sent = sent.unionByName(again.withColumn("replayed", F.lit(True)))
        sent.write.mode("overwrite").parquet(part("sent"))
        spark.createDataFrame(wrong, "subscriber string, filter string, error string").write.mode("overwrite").json(part("errors"))
        spark.createDataFrame(sorted(current.items()), "subscriber string, filter string").write.mode("overwrite").json(part("filters"))

    def start(self, stream: DataFrame, **trigger):
        """The running query."""
        write: Callable = self.deliver
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.where}/state").trigger(**(trigger or {"processingTime": "0 seconds"})).start()

    def sent(self) -> DataFrame:
        """(subscriber, entry columns…, replayed, batch) of all that was sent."""
        return self.spark.read.parquet(f"{self.where}/sent")
