"""Discovery: how queues fare, and what a restart makes of open keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.series import running

#: Picks beyond which what came before counts half.
DECAY_PICKS = 4_000
PICKS = 100_000  # events that a stretch of the order stands for


def queue_success(picks: DataFrame, window: int = DECAY_PICKS) -> DataFrame:
    """(queue, ok, n, mean) of picks (event_id, queue, won), old ones counting less.

    Every pick counts one when it is made, and a success one more after it. Whenever the sum over all queues passes
    window, everything so far is halved: at pick window + 1 and every window / 2 picks from there on. mean is that of the
    distribution a scheduler draws from. Picks are numbered within stretches of the order: no task sorts all of them.
    """
    numbered = running(picks.withColumns({"__all": F.lit(0), "__one": F.lit(1)}), "__all", ("event_id",), PICKS, k=("sum", F.col("__one")))
    total = picks.count()

    def halvings(k):
        return F.when(k <= window, 0).otherwise(1 + F.floor((k - window - 1) / (window // 2)))

    left = lambda k: F.pow(F.lit(0.5), halvings(F.lit(total)) - halvings(k))
    ok, n = F.sum(F.when(F.col("won"), left(F.col("k"))).otherwise(0.0)), F.sum(left(F.col("k") - 1))
    return numbered.groupBy("queue").agg(ok.alias("ok"), n.alias("n"), ((ok + 1) / (ok + 2 + F.greatest(n - ok, F.lit(0.0)))).alias("mean"))


#: The states that outlive a restart; the others start anew as pending.
PERSISTED = ("failed", "retry")


def replayed(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """(ih, status, failed_at) after a snapshot and the change log since: op `s` sets a key, `x` takes it out; the last counts."""
    before = snapshot.select("ih", F.lit(-1).cast("long").alias("seq"), F.lit("s").alias("op"), "status", "failed_at")
    last = before.unionByName(log.select("ih", "seq", "op", "status", "failed_at")).groupBy("ih").agg(F.max_by(F.struct("op", "status", "failed_at"), "seq").alias("r"))
    return last.filter((F.col("r.op") == "s") & F.col("r.status").isin(*PERSISTED)).select("ih", "r.status", "r.failed_at")
