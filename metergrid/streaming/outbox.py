"""Withdrawn ids on their way to a hub: an outbox whose states survive restarts.

An id is pending once it is withdrawn, sent once it belongs to a numbered portion that may have gone out, acknowledged once
the hub has confirmed that portion, and restored once the row is uploaded again, which takes the withdrawal back. Ids that
are withdrawn already aren't sent again; a restored one may be.

The outbox is a log of steps, each a Parquet folder that counts once it is complete; the last step that names an id holds its
state. A portion is written down before it is sent. If the run fails before the acknowledgement is, the next run sends the
same ids under the same number, which a hub takes once; portions that go together once have to later. One writer at a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metergrid.tables import written

PENDING, SENT, ACKNOWLEDGED, RESTORED = "pending", "sent", "acknowledged", "restored"
SCHEMA = "device_id string, id string, state string, portion string"
KEY = ["device_id", "id"]
#: Ids of one portion.
PORTION = 10_000
Send = Callable[[DataFrame, str], object]


@dataclass(frozen=True)
class Outbox:
    spark: SparkSession
    path: str

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def steps(self) -> list[int]:
        """The complete steps."""
        fs, path = self._fs()
        found = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        done = [x for x in found if x.startswith("step-") and self._complete(x)]
        return sorted(int(x.removeprefix("step-")) for x in done)

    def _complete(self, step: str) -> bool:
        fs, path = self._fs(step, "_SUCCESS")
        return fs.exists(path)

    def append(self, rows: DataFrame) -> None:
        step = (self.steps() or [0])[-1] + 1
        rows.select(*KEY, "state", "portion").write.mode("overwrite").parquet(f"{self.path}/step-{step:012d}")

    def states(self) -> DataFrame:
        """(device_id, id, state, portion) of every id."""
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/step-{n:012d}").withColumn("step", F.lit(n)) for n in self.steps()]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        last = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.max_by(F.struct("state", "portion"), "step").alias("s"))
        return last.select(*KEY, "s.state", "s.portion")

    def compact(self) -> None:
        """The states as one step. Steps that it replaces go last, so that nothing is lost on the way."""
        old = self.steps()
        if len(old) > 1:
            self.append(self.states())
            for n in old:
                fs, path = self._fs(f"step-{n:012d}")
                fs.delete(path, True)


def withdraw(outbox: Outbox, ids: DataFrame) -> None:
    """Queues the (device_id, id) that aren't withdrawn yet."""
    known = outbox.states().where(F.col("state") != RESTORED).select(*KEY)
    new = ids.select(*KEY).distinct().join(known, KEY, "left_anti")
    outbox.append(new.withColumns({"state": F.lit(PENDING), "portion": F.lit(None).cast("string")}))


def restore(outbox: Outbox, uploaded: DataFrame) -> None:
    """Rows that were uploaded again aren't withdrawn any more."""
    back = outbox.states().join(uploaded.select(*KEY).distinct(), KEY, "left_semi").where(F.col("state") != RESTORED)
    outbox.append(back.withColumns({"state": F.lit(RESTORED), "portion": F.lit(None).cast("string")}))


def flush(outbox: Outbox, send: Send, portion: int = PORTION, together: bool = False) -> int:
    """Sends what is pending, in portions, after those that went out without an acknowledgement. send(ids, number) merges
    (device_id, id) into the hub and returns once that is done. Returns the number of portions.

    A merge may rewrite every day that a hub stores, whatever the size of a portion. With `together` the portions numbered in
    one step go to the hub with one call, under the number that they share, so that its merges don't grow with the portions."""
    waiting = outbox.states().where(F.col("state") == PENDING)
    n = waiting.count()
    if n:
        # equal shares by hash: no sort over all ids, and a portion of about the size that is asked for
        shares = -(-n // portion)
        first = (outbox.steps() or [0])[-1] + 1
        share = F.pmod(F.xxhash64(*KEY), F.lit(shares)).cast("string")
        outbox.append(waiting.withColumns({"state": F.lit(SENT), "portion": F.concat(F.lit(f"withdrawn-{first}-"), share)}))
    sent = outbox.states().where(F.col("state") == SENT).select(*KEY, "portion", (F.regexp_replace("portion", "-[0-9]+$", "") if together else F.col("portion")).alias("call"))
    # a call reads its own ids, not the states of all others again
    out = written(sent.repartition("call", F.pmod(F.xxhash64(*KEY), F.lit(8))) if together else sent.repartition("call"), "portions", "call")
    portions = {r[0]: r[1] for r in out.groupBy("call").agg(F.count_distinct("portion")).collect()}
    for number in sorted(portions):
        ids = out.where(F.col("call") == number)
        send(ids.select(*KEY), number)
        outbox.append(ids.withColumn("state", F.lit(ACKNOWLEDGED)))
    return sum(portions.values())
