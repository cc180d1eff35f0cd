"""Streams over files: checked ingest and running sums."""

from datetime import datetime

from pyspark.sql import functions as F

from studyperf.operators.ingest import split
from studyperf.streaming import flows

SCHEMA = "aluno_id long, materia_id long, data timestamp, dificuldade int, total_questoes int, total_acertos int, tempo_total_segundos int, nivel_confianca_medio int, minutos_liquidos int"


def rows(spark, *hits):
    return spark.createDataFrame([(1, 2, datetime(2000, 1, 3 + k, 10), 3, 10, h, 600, None, 20) for k, h in enumerate(hits)], SCHEMA)


def test_checked_ingest_parts_blocks(spark, tmp_path):
    folder, out = str(tmp_path / "in"), [str(tmp_path / n) for n in ("valid", "rejected", "checkpoint")]
    rows(spark, 5, 11, 10).write.parquet(folder)
    flows.checked_ingest(flows.source(spark, folder, SCHEMA), "bloco", *out).awaitTermination(90)
    good, bad = split(rows(spark, 5, 11, 10), "bloco")
    assert (good.count(), bad.count()) == (2, 1)
    assert spark.read.parquet(out[0]).count() == 2 and spark.read.parquet(out[1]).count() == 1


def test_running_sums_by_week(spark, tmp_path):
    rows(spark, *range(9)).write.parquet(str(tmp_path / "in"))
    sums = flows.running_sums(flows.source(spark, str(tmp_path / "in"), SCHEMA), ["aluno_id"], weekly=True)
    query = sums.writeStream.format("memory").queryName("semanas").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = sorted((str(r["inicio"]), r["minutos"], r["registros"]) for r in spark.table("semanas").collect())
    assert got == [("2000-01-03", 140, 7), ("2000-01-10", 40, 2)]


LATE = "aluno_id long, data timestamp, minutos_liquidos int"


def arrive(spark, folder, *days):
    spark.createDataFrame([(1, datetime(2000, 1, d, 10), 20) for d in days], LATE).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint, **more):
    """One run of the stream from where the last one ended, and all that is stored then."""
    query = flows.stored_sums(flows.source(spark, folder, LATE), ["aluno_id"], out, checkpoint, late="3 days", **more)
    assert query.awaitTermination(120)
    rows = spark.read.schema("aluno_id long, inicio date, minutos long, registros long").parquet(out).collect()
    return sorted((r["inicio"].day, r["minutos"], r["registros"]) for r in rows)


def test_late_rows_by_day(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    arrive(spark, folder, 3, 3, 10)  # the newest row is of the 10th: days to the 6th are closed
    first = run(spark, folder, out, checkpoint)
    assert first == [(3, 40, 2)]
    arrive(spark, folder, 4, 8, 10)  # the 4th is too late, the 8th is late but in time
    assert run(spark, folder, out, checkpoint) == first
    arrive(spark, folder, 20)  # closes days to the 16th
    assert run(spark, folder, out, checkpoint) == [(3, 40, 2), (8, 20, 1), (10, 40, 2)]
    arrive(spark, folder, 31)
    kept = run(spark, folder, out, checkpoint)
    # as a batch over all rows but the late one; the 31st is still open
    batch = spark.read.schema(LATE).parquet(folder).where("dayofmonth(data) not in (4, 31)").groupBy("aluno_id", F.to_date("data").alias("inicio")).agg(F.sum("minutos_liquidos").alias("minutos"), F.count("*").alias("registros"))
    assert kept == sorted((r["inicio"].day, r["minutos"], r["registros"]) for r in batch.collect())
    assert run(spark, folder, out, checkpoint) == kept  # nothing new: nothing again


def test_late_rows_by_week(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    arrive(spark, folder, 3, 9, 12)  # weeks from Monday the 3rd, 10th, 17th; the watermark stands at the 9th
    assert run(spark, folder, out, checkpoint, weekly=True) == []
    arrive(spark, folder, 5, 14)  # of a week that is still open; then the watermark passes its end
    assert run(spark, folder, out, checkpoint, weekly=True) == [(3, 60, 3)]
    arrive(spark, folder, 4, 13, 31)  # the 4th is too late
    assert run(spark, folder, out, checkpoint, weekly=True) == [(3, 60, 3), (10, 60, 3)]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    folder, valid, rejected = (str(tmp_path / n) for n in ("in", "valid", "rejected"))
    rows(spark, 5, 11, 10).write.parquet(folder)
    for checkpoint in ("one", "two"):  # a lost checkpoint: the same rows come as the same batch
        flows.checked_ingest(flows.source(spark, folder, SCHEMA), "bloco", valid, rejected, str(tmp_path / checkpoint)).awaitTermination(90)
    assert (spark.read.parquet(valid).count(), spark.read.parquet(rejected).count()) == (2, 1)
