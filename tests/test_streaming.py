from datetime import datetime, timedelta

from tarn.streaming import leases

START = datetime(2024, 1, 1)
SCHEMA = "holder string, at timestamp, id long"


def beats(rng, n=300):
    at = START
    for i in range(n):
        at += timedelta(seconds=int(rng.choice([5, 15, 44, 45, 46, 600])))
        yield (str(rng.choice(["a", "b"])), at, i)


def slow(rows):
    out = []
    for holder in ("a", "b"):
        run = []
        for _, at, _ in [*sorted(r for r in rows if r[0] == holder), (holder, datetime.max, 0)]:
            if run and at - run[-1] >= timedelta(seconds=45):
                out.append((holder, run[0], run[-1], len(run)))
                run = []
            run.append(at)
    return sorted(out)


def test_leases_as_batch(spark, rng):
    rows = list(beats(rng))
    assert sorted(map(tuple, leases.leases(spark.createDataFrame(rows, SCHEMA), "holder", "at").collect())) == slow(rows)


def test_leases_as_stream(spark, rng, tmp_path):
    rows = list(beats(rng))
    end = ("end", rows[-1][1] + timedelta(days=1), -1)  # moves the watermark past all leases
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for part in (rows[:100], rows[100:101], rows[101:], [end]):  # the stream is stopped and taken up again
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withWatermark("at", "0 seconds")
        leases.append_to(leases.leases(stream, "holder", "at"), out, check).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("holder", "taken", "last_beat", "beats").collect())
    assert got == slow(rows)


def test_attempts_count_repeats_once(spark, rng, tmp_path):
    rows = list(beats(rng, 120))
    want = sorted(tuple(r) for r in leases.attempts(spark.createDataFrame(rows, SCHEMA), "holder", "at", "id").collect())
    for part in (rows[:60], rows[50:], [("end", rows[-1][1] + timedelta(days=1), -1)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        leases.append_to(leases.attempts(stream, "holder", "at", "id", late="6 hours"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "holder", "attempts").collect())
    assert got == want and sum(r[2] for r in got) == 120


def test_a_repeat_beyond_late_counts_again_in_a_stream(spark, tmp_path):
    rows = [("a", START, 7), ("a", START + timedelta(minutes=10), 7), ("a", START + timedelta(days=2), 7)]
    batch = leases.attempts(spark.createDataFrame(rows, SCHEMA), "holder", "at", "id").collect()
    assert [r.attempts for r in batch] == [1]
    for part in (rows[:2], [("b", START + timedelta(days=1), 8)], rows[2:], [("end", START + timedelta(days=9), -1)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        leases.append_to(leases.attempts(stream, "holder", "at", "id"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).where("holder = 'a'").orderBy("start").collect()
    assert [(r.start, r.attempts) for r in got] == [(START, 1), (START + timedelta(days=2), 1)]
