"""Change detection over a stream of descriptor readings: the same rules as operators.telemetry, state per descriptor."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "device string, descriptor string, arrival_seq long, value string, previous string"


class ChangeProcessor(StatefulProcessor):
    """first: emit the first reading too. skip_null: unknown readings neither count nor become the baseline."""

    def __init__(self, first: bool, skip_null: bool):
        self.first, self.skip_null = first, skip_null

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        last = self.last.get()[0] if known else None
        out = []
        for r in pd.concat(list(rows)).sort_values("arrival_seq", kind="stable").itertuples(index=False):
            value = None if pd.isna(r.value) else r.value
            if value is None and self.skip_null:
                continue
            if value != last if known else self.first:
                out.append((key[0], key[1], int(r.arrival_seq), value, last))
            known, last = True, value
        if known:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["device", "descriptor", "arrival_seq", "value", "previous"])

    def close(self) -> None:
        pass


def changes_stream(readings: DataFrame, first: bool = False, skip_null: bool = False) -> DataFrame:
    """readings: device, descriptor, arrival_seq, value (string)."""
    return readings.groupBy("device", "descriptor").transformWithStateInPandas(
        ChangeProcessor(first, skip_null), outputStructType=OUT, outputMode="Append", timeMode="None"
    )
