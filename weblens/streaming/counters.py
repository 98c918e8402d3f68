"""Running counters of each crawl, with state that survives between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "crawl_id long, fetched long, failed long, done boolean"


def crawl_counters(fetches: DataFrame) -> DataFrame:
    """fetches(crawl_id, status_code, last) as a stream -> the counters of each crawl after each batch."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fetched, failed, done = state.get if state.exists else (0, 0, False)
        for rows in batches:
            fetched += len(rows)
            failed += int((rows["status_code"].isna() | (rows["status_code"] >= 400)).sum())
            done = bool(done or rows["last"].any())
        state.update((fetched, failed, done))
        yield pd.DataFrame({"crawl_id": [key[0]], "fetched": [fetched], "failed": [failed], "done": [done]})

    return fetches.groupBy("crawl_id").applyInPandasWithState(
        update, SCHEMA, "fetched long, failed long, done boolean", "update", GroupStateTimeout.NoTimeout
    )
