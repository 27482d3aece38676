"""Reading tables, column names, record labels."""

import json

import pytest
from conftest import GOOD_NIGHT, text_frame
from pyspark.sql import functions as F

from nightjar import constants as K
from nightjar.operators.model import LinearScorer
from nightjar.operators.score import batch_results, record_label, score_nights
from nightjar.sources.nights import DuplicateColumnError, normalise_column_name, normalise_columns, read_nights


@pytest.mark.parametrize("header, name", [("Lowest HR", "hr_lowest"), ("\tLOWEST-hr ", "hr_lowest"), ("Onset--Latency", "onset_latency"), ("__Efficiency_", "efficiency"), ("my Own  column", "my_own_column")])
def test_header_words(header, name):
    assert normalise_column_name(header) == name


def test_headers_of_one_meaning_are_refused(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4, 5)], ["Deep Seconds", "Lowest-HR", "deep", "hr_lowest", "x"])
    with pytest.raises(DuplicateColumnError, match="deep, hr_lowest"):
        normalise_columns(frame)
    assert normalise_columns(frame.select("Deep Seconds", "hr_lowest", "x")).columns == ["deep", "hr_lowest", "x"]


def test_record_labels(spark):
    who = [("S 7", "x@mail.test"), (None, "walker@mail.test"), ("", "ab"), (None, None), (" ", " ")]
    rows = [{**GOOD_NIGHT, "participant_id": p, "email": e, "date": "n/a" if i == 1 else GOOD_NIGHT["date"]} for i, (p, e) in enumerate(who)]
    frame = text_frame(spark, rows, extra_columns=["participant_id", "email"])
    assert [r[0] for r in frame.orderBy("source_index").select(record_label(frame)).collect()] == [
        "S 7 — 2023-11-05 — Row 2", "wa***@mail.test — Row 3", "ab*** — 2023-11-05 — Row 4", "2023-11-05 — Row 5", "2023-11-05 — Row 6"]


def tables(spark, tmp_path, rows):
    names = list(GOOD_NIGHT) + ["participant_id", "email", "efficiency"]
    full = [{n: r.get(n) for n in names} for r in rows]
    for part in (0, 1):  # two files, in order of their names
        own = full[part * 3:part * 3 + 3]
        lines = [",".join(names)] + [",".join("" if v is None else str(v) for v in r.values()) for r in own]
        for kind, text in (("csv", "\n".join(lines)), ("json", "\n".join(json.dumps({k: None if v is None else str(v) for k, v in r.items()}) for r in own))):
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"part-{part}.{kind}").write_text(text + "\n")
        frame = spark.createDataFrame([[None if v is None else str(v) for v in r.values()] for r in own], ", ".join(f"{n} string" for n in names))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "parquet" / f"part={part}"))
    return {kind: str(tmp_path / kind) for kind in ("csv", "json", "parquet")}


def test_a_read_table_can_be_scored(spark, tmp_path):
    rows = [{**GOOD_NIGHT, "participant_id": f"S{i}", "rmssd": "NA" if i == 4 else 50 + i} for i in range(6)]
    scorer = LinearScorer(medians={f: 0.0 for f in K.MODEL_FEATURES})
    for kind, path in tables(spark, tmp_path, rows).items():
        nights = read_nights(spark, path, kind).drop("part")
        assert nights.columns[0] == "source_index", kind
        out = batch_results(score_nights(nights, scorer), None).orderBy("source_row").collect()
        assert [(r["source_row"], r["participant_id"]) for r in out] == [(i + 2, f"S{i}") for i in range(6)], kind
        assert [r["error"] is None for r in out] == [True] * 4 + [False, True], kind


def test_text_cells_and_schemas(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_nights(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ValueError, match="Unsupported"):
        read_nights(spark, str(tmp_path), "xls")
    (tmp_path / "a.csv").write_text("total,date\n7,n/a\n,2023-11-05\n")
    cells = read_nights(spark, str(tmp_path / "a.csv"), "csv").orderBy("source_index").collect()
    assert [tuple(r) for r in cells] == [(0, "7", None), (1, None, "2023-11-05")]
    (tmp_path / "a.json").write_text('{"total": 7, "date": "x"}\n{"total": "8h", "late": 1}\n')
    rows = read_nights(spark, str(tmp_path / "a.json"), "jsonl").orderBy("source_index").collect()
    assert [(r["total"], r["date"]) for r in rows] == [("7", "x"), ("8h", None)]
    typed = read_nights(spark, str(tmp_path / "a.json"), "json", schema="total string, late int")
    assert dict(typed.dtypes) == {"source_index": "bigint", "total": "string", "late": "int"}
    assert typed.filter(F.col("late") == 1).count() == 1


@pytest.mark.parametrize("broadcast", [0, 100])
def test_rows_are_numbered_across_files_and_splits(spark, tmp_path, monkeypatch, broadcast):
    from nightjar.sources import nights as module

    monkeypatch.setattr(module, "BROADCAST_OFFSETS", broadcast)
    n, size = 3000, "spark.sql.files.maxPartitionBytes"
    for kind in ("csv", "json", "parquet"):
        for part, (low, high) in enumerate([(0, 1700), (1700, 1700), (1700, 1701), (1701, n)]):
            frame = spark.range(low, high, 1, 1).selectExpr("cast(id as string) as total", "concat('x', id) as `__row`")
            if high == low:
                frame = frame.limit(0)
            frame.write.mode("append").option("header", True).format(kind).save(str(tmp_path / kind / f"part={part}"))
    before = spark.conf.get(size)
    spark.conf.set(size, "4096")  # a file is several splits
    try:
        for kind in ("csv", "json", "parquet"):
            got = read_nights(spark, str(tmp_path / kind), kind, schema="total string, `__row` string")
            assert got.columns[0] == "source_index"
            rows = got.select("source_index", "total").collect()
            assert sorted((r[0], int(r[1])) for r in rows) == [(i, i) for i in range(n)], kind
    finally:
        spark.conf.set(size, before)


def test_parquet_is_numbered_without_a_copy(spark, tmp_path):
    """No table is written and, while the rows are read, none is shuffled."""
    import os

    spark.range(200).selectExpr("cast(id as string) as total").repartition(3).write.parquet(str(tmp_path / "nights"))
    folder = os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "nightjar")
    held = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    nights = read_nights(spark, str(tmp_path / "nights"))
    assert [r[0] for r in nights.orderBy("source_index").collect()] == list(range(200))
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == held
    plan = nights._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan
    spark.createDataFrame([], "total string").write.parquet(str(tmp_path / "none"))
    assert read_nights(spark, str(tmp_path / "none")).collect() == []


def test_nights_of_one_row_group_are_dealt_to_several_tasks(spark, tmp_path):
    from nightjar.plans.catalog import nights

    rows = spark.range(60_000).selectExpr("if(id % 1000 = 0, null, id % 50000) as event_id", "id % 7 as user_id", "timestamp'2024-01-01 00:00:00' as ts", "'x' as props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = nights(spark, str(tmp_path))
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and max(r["count"] for r in sizes) < 25_000
    assert got.select("source_index").exceptAll(rows.select("event_id")).isEmpty() and got.count() == 60_000
