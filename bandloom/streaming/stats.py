"""Statistics that go on as pixels stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from bandloom.operators.stats import GaussianStats, calc_stats, merge


class RunningStats:
    """Mean and covariance of all micro-batches so far; each batch sends one mean and one matrix to the driver.

    A batch that is repeated after a failure counts once.
    """

    def __init__(self) -> None:
        self.state: tuple | None = None
        self.seen = -1

    def update(self, batch: DataFrame, epoch: int) -> None:
        if epoch <= self.seen:
            return
        if not batch.isEmpty():
            s = calc_stats(batch)
            m2 = s.cov * (s.nsamples - 1) if s.nsamples > 1 else s.cov * 0
            m2[m2 != m2] = 0
            new = (s.nsamples, s.mean, m2)
            self.state = new if self.state is None else merge(self.state, new)
        self.seen = epoch

    @property
    def stats(self) -> GaussianStats:
        if self.state is None:
            raise ValueError("no pixels yet")
        n, mean, m2 = self.state
        return GaussianStats(mean, m2 / max(n - 1, 1), int(n))

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).start()
