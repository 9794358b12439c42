"""Extension points: item processors, lesion extractors, grouped collation."""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def process_items(df: DataFrame, key: str, process: Callable[[dict], dict], schema: str) -> DataFrame:
    """Run ``process`` on every row, in Arrow batches. A row that fails keeps its key and gets nulls and the error's text."""
    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    r = process(row)
                    out.append([row[key], *[r.get(n) for n in names], None])
                except Exception as e:  # the error is the result of this row
                    out.append([row[key], *[None] * len(names), f"{type(e).__name__}: {e}"])
            yield pd.DataFrame(out, columns=[key, *names, "error"])

    return df.mapInPandas(run, f"{key} {kind}, {schema}, error string")


def lesion_extractor(fn: Callable[[pd.Series], pd.Series]):
    """A custom lesion extractor over pixel arrays; register it in ``functions.image.LESION_METHODS`` to select it by name."""
    udf = F.pandas_udf(fn, "array<int>")
    return lambda px, threshold: udf(px)


def collate(df: DataFrame, batch: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of one batch to one result; batches are of bounded size."""
    return df.groupBy(batch).applyInPandas(fn, schema)
