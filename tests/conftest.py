import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from nightjar.session import DEFAULT_CONF, ensure_checkpoint_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("nightjar-tests")
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    session = builder.config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false") \
        .getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


#: A Sunday night of eight hours without any fault.
GOOD_NIGHT = dict(
    date="2023-11-05", total=28800, rem=6480, deep=4320, bedtime_start_delta=-1800, midpoint_time=15000, onset_latency=900,
    restless=30, hr_average=58.5, hr_lowest=50, rmssd=61, breath_average=14.25, temperature_deviation=-0.2, temperature_trend_deviation=0.31)


@pytest.fixture
def valid_record():
    return dict(GOOD_NIGHT)


def text_frame(spark, records, extra_columns=()):
    """Records as an all-text night table with ``source_index`` = position."""
    names = []
    for rec in records:
        for k in rec:
            if k not in names:
                names.append(k)
    names += [c for c in extra_columns if c not in names]
    schema = T.StructType([T.StructField("source_index", T.LongType())] +
                          [T.StructField(n, T.StringType()) for n in names])
    rows = [[i] + [None if r.get(n) is None else str(r[n]) for n in names] for i, r in enumerate(records)]
    return spark.createDataFrame(rows, schema)


def typed_frame(spark, records):
    """Records with numeric cells as doubles (as a typed Parquet source would give)."""
    names = []
    for rec in records:
        for k in rec:
            if k not in names:
                names.append(k)
    fields = [T.StructField("source_index", T.LongType())]
    for n in names:
        sample = next((r[n] for r in records if r.get(n) is not None), None)
        kind = T.DoubleType() if isinstance(sample, (int, float)) and not isinstance(sample, bool) else T.StringType()
        fields.append(T.StructField(n, kind))
    schema = T.StructType(fields)
    rows = []
    for i, r in enumerate(records):
        row = [i]
        for f in fields[1:]:
            v = r.get(f.name)
            row.append(None if v is None else (float(v) if isinstance(f.dataType, T.DoubleType) else str(v)))
        rows.append(row)
    return spark.createDataFrame(rows, schema)
