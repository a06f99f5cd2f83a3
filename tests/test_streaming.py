from pyspark.sql import functions as F

from causeway.functions import cues, markup, tagging


def test_column_functions_run_on_a_stream(spark, tmp_path):
    rows = [("<ARG0>rain</ARG0> leads to <ARG1>floods</ARG1>",), ("plain text",)]
    spark.createDataFrame(rows, "t string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").json(str(tmp_path / "in"))
    tagged = stream.withColumns(
        {
            "tags": tagging.marked_tags(F.col("t")),
            "plain": markup.strip_markup(F.col("t")),
            "tagged": markup.map_tags(F.col("t"), "arg"),
        }
    ).withColumn("explicit", cues.is_explicit_row(F.col("plain"), F.col("tagged")))
    query = (
        tagged.writeStream.format("memory")
        .queryName("tagged")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    try:
        query.processAllAvailable()
        got = {r.plain: (r.tags, r.explicit) for r in spark.table("tagged").collect()}
    finally:
        query.stop()
    assert got == {
        "rain leads to floods": (["B-C", "I-C", "I-C", "B-E"], True),
        "plain text": (["O", "O"], True),
    }
