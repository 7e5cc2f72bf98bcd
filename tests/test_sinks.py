"""Answers as JSON and notices of a stream."""

from newsloom.streaming import sinks


def test_envelope(spark):
    page = spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string")
    got = sinks.envelope(page, ["id"], "news", demo=False, provider="x").first()
    assert got.body == '{"data":[{"id":1,"t":"a"},{"id":2,"t":"b"}],"demo":false,"provider":"x"}'
    assert got.cache_control == "public, s-maxage=90, stale-while-revalidate=180"


def test_notices_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b"), (1, "a")], "id int, t string")
    sinks.notices(rows, "match_alert", "id", "t").write.parquet(str(tmp_path / "in"))
    stream, out = spark.readStream.schema("chat_id string, message string").parquet(str(tmp_path / "in")), tmp_path / "out"
    out.mkdir()

    def send(chat, message):
        (out / chat).write_text(message)

    for n, how in enumerate((None, send)):
        assert sinks.notify(stream, str(tmp_path / f"ck{n}"), how, None).awaitTermination(60)
        assert len(list(out.iterdir())) == (2 if how else 0)
    assert (out / "1").read_text() == "⚽ a"
