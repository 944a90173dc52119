"""A cycle's work is spread over tasks: no task has all texts of a source, of no day, or of what is no candidate."""

import json
from datetime import datetime

from echolens.operators import dedup
from echolens.streaming import ingest
from pyspark.sql import functions as F

KEYWORDS = "phrase string, type string, is_active boolean, language string, manual_forms array<string>"


def test_texts_of_one_source_without_dates_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "_tidy", lambda df: None)
    most, plain = {}, dedup.stored

    def watched(df):
        out = plain(df)
        if {"text", "card_id", "outcome"} <= set(out.columns):
            parts = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
            most["rows"] = max(parts)
        return out

    monkeypatch.setattr(dedup, "stored", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cycle = ingest.Cycle(spark, str(tmp_path), lambda: datetime(2024, 1, 31), lambda: spark.createDataFrame([("brand", "exact_phrase", True, "en", [])], KEYWORDS))
        lines = [json.dumps({"id": f"{i:04d}", "source_id": "s1", "title": f"Title {i * 7919}", "text": f"{'brand' if i % 4 == 0 else 'none'} {i}", "url": f"https://a.example/{i}"}) for i in range(400)]
        cycle(spark.createDataFrame([(v,) for v in lines], "value string"), 0)
        stories = cycle.tables["stories"].read()
        files = stories.groupBy(F.input_file_name()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert cycle.counters["found"] == 400 and cycle.counters["no_keyword"] == 300 and cycle.counters["inserted"] == stories.count()
    assert most["rows"] < 200
    assert len(files) > 1
